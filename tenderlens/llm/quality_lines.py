"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself: by its punctuation (words that end in symbols), as navigation (menu
words or cells between separators) and as boilerplate (notices). Failing lines are removed; a
document that loses more than ``max_lost`` of its word characters is rejected, and so is one with too
few words or with too many words in repeated five-word windows.

Null and empty texts have no words and are rejected. Every text is judged whole, within its row:
nothing is shuffled. Lines of any length are judged without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.registry import SPACE, WORD, query, table, text_or_empty

# Symbols counted as such; menu words; notices.
SYMBOLS = "#*$%&|<>"
MENU = ("home|menu|login|log in|log out|sign in|sign up|register|search|next|previous|back|share|print|contact|"
        "contact us|about|about us|help|faq|sitemap|top|skip to content|read more|click here|subscribe")
NOTICE = ("all rights reserved|licensed under|released under|copyright|terms of use|terms of service|"
          "privacy policy|cookie policy|use cookies|powered by|enable javascript")

NOISY = rf"(?:[{SYMBOLS}]|!!)(?:[\x20\x09-\x0D]|$)"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])(?:\||>|»|›|·|•)(?:[\x20\x09-\x0D]|$)"
MENU_LINE = rf"^[\x20\x09-\x0D]*(?:(?:{MENU})[\x20\x09-\x0D|>»›·•]*)+$"
# The same lines for Java, which calls itself once per round of a repeated group unless it is possessive. With the
# longer of two items first nothing is lost by never going back: no item starts with the rest of another.
MENU_RUN = rf"^[\x20\x09-\x0D]*+(?:(?:{'|'.join(sorted(MENU.split('|'), key=len, reverse=True))})[\x20\x09-\x0D|>»›·•]*+)++$"


def word_list(text: Column) -> Column:
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " "), "")


def line_fails(line: Column) -> Column:
    """Rules are per line, so a rule never sees its neighbours."""
    words = F.regexp_count(line, F.lit(WORD))
    noisy = F.regexp_count(line, F.lit(NOISY))
    cells = F.regexp_count(line, F.lit(SEPARATOR))
    punctuation = noisy * 10 > words * 3
    navigation = ((cells >= 2) & (cells * 4 >= words)) | F.lower(line).rlike(MENU_RUN)
    boilerplate = (words <= 20) & F.lower(line).rlike(NOTICE)
    return punctuation | navigation | boilerplate


def line_first_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10,
                     max_repeat_pct: int = 20, max_lost: float = 0.5) -> DataFrame:
    """One row per document: counts, verdict and the cleaned text.

    ``n_dup_lines`` counts lines with a word that equal an earlier line; ``n_repeat_words`` the words
    inside five-word windows that occur twice or more in the text. Windows are compared by a 64-bit
    hash. Only the id and the text are read, so other columns cannot clash; repeated rows are judged
    each by itself; an empty table gives no rows.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    split = base.select(
        "*", word_list(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    hashed = split.select(
        "doc_id", "text", "lines",
        F.size("words").cast("bigint").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("marks"))
    windows = hashed.select(
        "*", F.when(F.col("n_words") >= 5, F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")),
            lambda i: F.xxhash64(*[F.get("marks", i + k) for k in range(5)]))).alias("windows")).drop("marks")
    ordered = windows.select(
        "*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(
            F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("ordered")).drop("windows")
    repeated = ordered.select(
        "*", F.sort_array(F.transform(
            F.filter("ordered", lambda v, i: (
                F.coalesce(F.get("ordered", i - 1)["x"] == v["x"], F.lit(False))
                | F.coalesce(F.get("ordered", i + 1)["x"] == v["x"], F.lit(False)))),
            lambda v: v["i"])).alias("starts")).drop("ordered")
    judged = repeated.select(
        "*", F.filter("lines", lambda x: ~line_fails(x)).alias("good"),
        F.coalesce(F.aggregate(
            F.transform("starts", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("starts", i + 1) - p, F.lit(5)))),
            F.lit(0), lambda a, b: a + b), F.lit(0)).cast("bigint").alias("n_repeat_words")).drop("starts")

    def letters(column: Column) -> Column:
        return F.char_length(F.regexp_replace(column, SPACE, "")).cast("bigint")

    counted = judged.select(
        "doc_id", "n_words", letters(F.col("text")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("bigint").alias("n_bad_lines"),
        F.array_join("good", "\n").alias("clean_text"))
    failed = counted.select(
        "*", ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))).alias("base_failed"),
        letters(F.col("clean_text")).alias("clean_chars"))
    return failed.select(
        "*", (~F.col("base_failed") & (F.col("clean_chars") >= F.col("word_chars") * (1 - max_lost))).alias("kept"))


_SQL = """
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, regexp_extract_all(text, '{word}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM base),
windows AS (
  SELECT doc_id, unnest(range(0, len(words) - 4)) AS i,
         unnest(list_transform(range(0, len(words) - 4), lambda i: array_to_string(words[i + 1:i + 5], ' '))) AS w
  FROM split WHERE len(words) >= 5),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(following - i, 5))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice WHERE n > 1)
  GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, len(words) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '{symbols}', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         list_filter(lines, lambda x: NOT (
           len(regexp_extract_all(x, '{noisy}')) * 10 > len(regexp_extract_all(x, '{word}')) * 3
           OR (len(regexp_extract_all(x, '{separator}')) >= 2
               AND len(regexp_extract_all(x, '{separator}')) * 4 >= len(regexp_extract_all(x, '{word}')))
           OR regexp_matches(lower(x), '{menu}')
           OR (len(regexp_extract_all(x, '{word}')) <= 20 AND regexp_matches(lower(x), '{notice}')))) AS good
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
failed AS (
  SELECT *, n_lines - len(good) AS n_bad_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         length(regexp_replace(array_to_string(good, chr(10)), '{space}', '', 'g')) AS clean_chars FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND clean_chars >= word_chars * 0.5 AS kept, n_lines, n_bad_lines, clean_chars FROM failed
""".format(word=WORD, space=SPACE, symbols=SYMBOLS, noisy=NOISY, separator=SEPARATOR, menu=MENU_LINE, notice=NOTICE)


@query("op10_quality_rules", _SQL)
def op10_quality_rules(spark, sf_dir):
    return line_first_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_bad_lines", "clean_chars")
