"""Text clean-up (X2-X8) as column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_MARK = "\u0001"
MAX_LEMMA_LETTERS = 100_000_000

# Languages whose stop words are removed, whatever the language of the text.
STOP_LANGUAGES = ["danish", "dutch", "english", "finnish", "french", "german", "hungarian",
                  "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish"]

# Patterns of the clean-up.
PARENTHESES = r"\([^)]*\)"
SENTENCE_END = r"([.!?])\s+"
COUNTRY = r"(?=[uU])(?iU)\b(?:u\.?\s*s\.?|usa|u\.?\s*s\.?\s*a\.?)\b"
SENTENCE_BREAK = r"[.!?]\s+"
NOT_A_TOKEN = r"[^a-z0-9]+"

# Within the clean-up sentences end with ':', the character after '9': a class of two ranges is
# matched many times faster by Java than one with a third member. Colons of the text itself become
# ';', which no rule tells from ':'.
MARK = ":"
NOT_A_TOKEN_OR_MARK = "[^a-z0-:]+"

# All up to the last mark that still has a word behind it; greedy, so found from the end.
BEFORE_LAST_SENTENCE = f"^(.*{MARK})[^{MARK}]*[a-z0-9]"

# Noun endings and their base form, first match wins.
NOUN_ENDINGS = [("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("men", "man")]
KEPT_ENDINGS = ["ss", "us", "is"]
NOUN_FINALS = sorted({ending[-1] for ending, _ in NOUN_ENDINGS} | {"s"})


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def default_stopwords() -> list[str]:
    return sorted({w for language in STOP_LANGUAGES
                   for w in StopWordsRemover.loadDefaultStopWords(language)})


def strip_parentheses(c) -> Column:
    return F.regexp_replace(_column(c), PARENTHESES, "")


def _marked_sentences(c, mark: str = SENTENCE_MARK) -> Column:
    return F.regexp_replace(_column(c), SENTENCE_END, "$1" + mark)


def split_sentences(c) -> Column:
    return F.split(_marked_sentences(c), SENTENCE_MARK)


def normalize_country(c) -> Column:
    """Every spelling of the country name to ``america``; 'U.S.A.' keeps its tail ('americaA.')."""
    return F.regexp_replace(_column(c), COUNTRY, "america")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def normalize_tokens(c) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return _tokens(F.regexp_replace(F.lower(_column(c)), NOT_A_TOKEN, " "))


def remove_stopwords(tokens, stopwords: list[str]) -> Column:
    """Drop listed words; the list compiles to a hash-set lookup and duplicates survive."""
    if not stopwords:
        return _column(tokens)
    return F.filter(_column(tokens), lambda t: ~t.isin(*stopwords))


def noun_base(token: Column) -> Column:
    """Base form of a noun by its ending; words that no rule can match are told apart first."""
    size = F.length(token)
    rule = F.when(reduce(lambda a, b: a & b, [~token.endswith(x) for x in NOUN_FINALS]), token)
    for ending, base in NOUN_ENDINGS:
        stem = F.concat(token.substr(F.lit(1), size - len(ending)), F.lit(base))
        rule = rule.when(token.endswith(ending), stem)
    for ending in KEPT_ENDINGS:
        rule = rule.when(token.endswith(ending), token)
    return rule.when(token.endswith("s"), token.substr(F.lit(1), size - 1)).otherwise(token)


def _lookup(lemmas: dict[str, str]):
    """token array -> lemma array, for a map of any length: one index look-up over each batch's tokens.

    The map travels with the function; its arrays are built once per task.
    """
    size = sum(len(word) + len(base) for word, base in lemmas.items())
    if size > MAX_LEMMA_LETTERS:
        raise ValueError(f"a lemma map of {size} letters is too large to send to every task")
    known, forms = list(lemmas), list(lemmas.values())

    @F.arrow_udf("array<string>")
    def mapped(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, bases = pa.array(known, pa.string()), pa.array(forms, pa.string())
        for column in columns:
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            found = bases.take(pc.index_in(column.flatten().cast(pa.string()), value_set=words))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.ListArray.from_arrays(offsets, found, mask=column.is_null() if column.null_count else None)

    return lambda tokens: F.transform(
        F.arrays_zip(tokens.alias("t"), mapped(tokens).alias("m")),
        lambda pair: F.coalesce(pair["m"], noun_base(pair["t"])))


def lemmatize(tokens, lemmas: dict[str, str] | None = None) -> Column:
    """Each token to its base form: the caller's map first, then the ending rules."""
    tokens = _column(tokens)
    if not lemmas:
        return F.transform(tokens, noun_base)
    return _lookup(lemmas)(tokens)


def clean_tokens(c, stopwords: list[str], lemmas: dict[str, str] | None = None) -> Column:
    """Tokens of a document after clean-up, without its last sentence that has any.

    Sentence borders travel through the string functions as a mark that is a word of its own, so every
    step runs once over the flat text. Each intermediate result is named once: inside array functions
    Spark would compute a repeated expression again.
    """
    text = strip_parentheses(F.replace(_column(c), F.lit(MARK), F.lit(";")))
    text = F.lower(normalize_country(F.regexp_replace(text, SENTENCE_BREAK, f" {MARK} ")))
    words = remove_stopwords(F.split(text, NOT_A_TOKEN_OR_MARK), ["", *stopwords])
    body = F.regexp_extract(F.array_join(words, " "), BEFORE_LAST_SENTENCE, 1)
    return lemmatize(remove_stopwords(F.split(body, " "), ["", MARK]), lemmas)


def clean_document(c, stopwords: list[str], lemmas: dict[str, str] | None = None) -> Column:
    return F.array_join(clean_tokens(c, stopwords, lemmas), " ")


def occurrences(c, term: str) -> Column:
    """Non-overlapping substring occurrences; no word border is required."""
    text = _column(c)
    removed = F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))
    return (removed / F.lit(len(term))).cast("bigint")


def whole_word_occurrences(c, term: str) -> Column:
    """Occurrences between word borders, for text that has been cleaned to single spaces."""
    spaced = F.concat(F.lit(" "), F.replace(_column(c), F.lit(" "), F.lit("  ")), F.lit(" "))
    return occurrences(spaced, f" {term.replace(' ', '  ')} ")
