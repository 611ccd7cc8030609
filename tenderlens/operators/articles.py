"""Dictionary classification of cleaned articles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.functions.dictionary import COUNTRY_CATEGORY, TARIFF_CATEGORY, TERMS
from tenderlens.functions.text import (clean_document, default_stopwords, lemmatize, occurrences,
                                       whole_word_occurrences)
from tenderlens.operators.sections import (dedupe_first, extract_sections, parse_article_id,
                                           parse_broken_date)

Dictionary = dict[str, list[str]]


def dictionary_frame(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    rows = [(category, term) for category, terms in dictionary.items() for term in terms]
    return spark.createDataFrame(rows, "category string, term string")


def lemmatize_dictionary(spark: SparkSession, dictionary: Dictionary = TERMS,
                         lemmas: dict[str, str] | None = None) -> Dictionary:
    """The dictionary with every word of every term in base form."""
    base = F.array_join(lemmatize(F.split("term", " "), lemmas), " ")
    rows = dictionary_frame(spark, dictionary).select("category", base.alias("term")).collect()
    result: Dictionary = {category: [] for category in dictionary}
    for row in rows:
        result[row["category"]].append(row["term"])
    return result


def term_hits(text, dictionary: Dictionary, whole_word: bool = False) -> Column:
    """Occurrences per category, as an array in the order of the dictionary; null for a missing text.

    One pass over the text finds all terms at once (Aho-Corasick, built once per task), whatever their number.
    A term's occurrences do not overlap each other, but those of different terms may. A term listed more
    than once weighs that often in each of its categories. With ``whole_word`` only occurrences between
    blanks or the ends of the text count.
    """
    weight = Counter(t for terms in dictionary.values() for t in terms)
    owners: dict[str, list[int]] = {}
    for at, terms in enumerate(dictionary.values()):
        for term in dict.fromkeys(terms):
            owners.setdefault(term, []).append(at)
    size = len(dictionary)

    @F.arrow_udf("array<bigint>")
    def hits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for number, (term, categories) in enumerate(owners.items()):
            finder.add_word(term, (number, len(term), weight[term], categories))
        if owners:
            finder.make_automaton()

        def count(value: str | None) -> list[int] | None:
            if value is None:
                return None
            found, ends = [0] * size, {}
            for last, (number, length, times, categories) in finder.iter(value) if owners else ():
                start = last + 1 - length
                if start < ends.get(number, 0):
                    continue
                if whole_word and ((start and value[start - 1] != " ") or value[last + 1:last + 2] not in ("", " ")):
                    continue
                ends[number] = last + 1
                for category in categories:
                    found[category] += times
            return found

        for column in columns:
            yield pa.array([count(v) for v in column.to_pylist()], pa.list_(pa.int64()))

    return hits(F.col(text) if isinstance(text, str) else text)


def category_hits(text, dictionary: Dictionary, whole_word: bool = False, one_pass: bool = False) -> dict[str, Column]:
    """Occurrences per category as plain expressions, one for each term: the text is never copied per term.

    A term listed more than once in the dictionary weighs that often in each of its categories. ``one_pass`` takes
    all counts from ``term_hits``, for dictionaries of more terms than a plan should hold.
    """
    if one_pass:
        hits = term_hits(text, dictionary, whole_word)
        return {category: hits[at] for at, category in enumerate(dictionary)}
    count = whole_word_occurrences if whole_word else occurrences
    weight = Counter(t for terms in dictionary.values() for t in terms)
    return {
        category: reduce(lambda a, b: a + b,
                         [count(text, t) * weight[t] for t in dict.fromkeys(terms)])
        for category, terms in dictionary.items()
    }


def count_terms(docs: DataFrame, key: str, text: str, dictionary: Dictionary,
                whole_word: bool = False) -> DataFrame:
    """(key, category, hits) for categories that occur in the document (X11)."""
    names = F.array(*[F.lit(c) for c in dictionary])
    found = docs.select(key, F.posexplode(term_hits(text, dictionary, whole_word)).alias("_at", "hits"))
    return found.filter(F.col("hits") > 0).select(key, names[F.col("_at")].alias("category"), "hits")


def is_fiscal(text, dictionary: Dictionary, whole_word: bool = False, one_pass: bool = False) -> Column:
    """At least two categories occur and one of them is the country."""
    hits = category_hits(text, dictionary, whole_word, one_pass)
    matched = reduce(lambda a, b: a + b, [(h > 0).cast("int") for h in hits.values()])
    return (matched >= 2) & (hits[COUNTRY_CATEGORY] > 0)


def has_tariff(text, dictionary: Dictionary, one_pass: bool = False) -> Column:
    """Any trade term occurs, whatever else does."""
    if one_pass:
        return category_hits(text, dictionary, one_pass=True)[TARIFF_CATEGORY] > 0
    column = F.col(text) if isinstance(text, str) else text
    return reduce(lambda a, b: a | b, [column.contains(t) for t in dictionary[TARIFF_CATEGORY]])


def classify(docs: DataFrame, text: str, dictionary: Dictionary, whole_word: bool = False,
             one_pass: bool = False) -> DataFrame:
    return docs.withColumns({
        "is_fiscal_article": is_fiscal(text, dictionary, whole_word, one_pass),
        "has_tariff": has_tariff(text, dictionary, one_pass),
    })


def build_article_table(lines: DataFrame, dictionary: Dictionary | None = None,
                        stopwords: list[str] | None = None,
                        lemmas: dict[str, str] | None = None) -> DataFrame:
    """Dump lines to (file, article_id, date, is_fiscal_article, has_tariff).

    Within a file the first article of an id wins. Articles without id or date keep nulls there.
    """
    spark = lines.sparkSession
    if dictionary is None:
        dictionary = lemmatize_dictionary(spark, TERMS, lemmas)
    stopwords = default_stopwords() if stopwords is None else stopwords
    cleaned = extract_sections(lines).select(
        "file", "number",
        parse_article_id("details").alias("article_id"),
        parse_broken_date("details").alias("date"),
        clean_document("article", stopwords, lemmas).alias("text"))
    flagged = classify(cleaned, "text", dictionary).drop("text")
    return dedupe_first(flagged, ["file", "article_id"], "number").drop("number")
