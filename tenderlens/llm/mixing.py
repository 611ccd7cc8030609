"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words: shares by weight, none above ``max_copies`` times the source, the
excess reshared by weight. Within a source a document's expected number of copies grows with its
length class, again up to ``max_copies``, so that the expected words meet the target. The whole part of
that number is taken for certain. For the rest, documents are ranked by their random odds divided by
their inclusion odds, and taken in that order until the words of the source are used up; a document
that no longer fits is passed over in favour of later, shorter ones.

The random number is a hash of the id, so reruns agree. A source of any size is ranked over many
tasks; only one row per source and length class is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.llm.registry import WORD, query, table, text_or_empty
from tenderlens.operators.ordering import running_total
from tenderlens.session import materialise

WEIGHTS = (5, 2, 1)


def fill(table_: DataFrame, group: list[str], key: str, cap: str, weight: str, budget: Column) -> DataFrame:
    """Share ``budget`` by weight among the rows of a group, none above its cap: adds ``share``.

    Rows fill up in the order of cap / weight. A row is full if the level at which it fills is within
    the budget; the others get their weight times the level at which the budget is used up.
    """
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0))
    ranked = table_.withColumn("_ratio", ratio).withColumn("_budget", budget)
    upto = Window.partitionBy(*group).orderBy("_ratio", key).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    sums = ranked.select(
        "*", F.sum(cap).over(upto).alias("_full"),
        (F.sum(weight).over(whole) - F.sum(weight).over(upto)).alias("_rest"))
    flagged = sums.withColumn("_is_full", F.col("_full") + F.col("_ratio") * F.col("_rest") <= F.col("_budget"))
    used = F.coalesce(F.sum(F.when(F.col("_is_full"), F.col(cap))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_is_full"), F.col(weight))).over(whole)
    share = F.when(F.col("_is_full"), F.col(cap).cast("double")).otherwise(
        (F.col("_budget") - used) / open_weight * F.col(weight))
    return flagged.select(*table_.columns, share.alias("share"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5,
                   max_copies: int = 2) -> DataFrame:
    """(source, source_size, target): one row a source, weights dealt in source order, null last."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = per_source.withColumn("_at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    table_ = dealt.select("source", "source_size", "_at", weight.alias("weight"),
                          (F.col("source_size") * max_copies).alias("cap"), F.lit(1).alias("all"))
    budget = F.sum("source_size").over(Window.partitionBy("all")) * F.lit(total)
    shared = fill(table_, ["all"], "_at", "cap", "weight", budget)
    return shared.select("source", "source_size", F.col("share").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, max_copies: int = 2,
                tag: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken and row_tag.

    ``row_tag`` tells rows apart, also repeated ones: ``tag`` if given, else a number.

    ``size`` counts the words; null and empty texts have none and are never copied. A null source is a
    source of its own, the last one. Null ids share one random number, and repeated rows are ranked
    together; both are counted and taken like any other row. Only the three named columns are read. An
    empty table gives no rows.
    """
    sizes = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.monotonically_increasing_id() if tag is None else tag).alias("row_tag"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint").alias("size"))
        .withColumn("class", F.length(F.bin("size"))))
    targets = source_targets(sizes, weights, total, max_copies)
    classes = sizes.groupBy("source", "class").agg(F.sum("size").alias("words"))
    classes = classes.join(targets, classes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    classes = classes.select("*", (F.col("words") * max_copies).alias("cap"),
                             (F.col("words") * F.col("class")).alias("pull"))
    filled = fill(classes, ["source"], "class", "cap", "pull", F.col("target"))
    plan = filled.select(
        F.col("source").alias("_source"), F.col("class").alias("_class"), "source_size", "target",
        F.when(F.col("words") > 0, F.col("share") / F.col("words")).otherwise(F.lit(0.0)).alias("expected"))
    plan = materialise(plan.select(
        "*", F.floor("expected").alias("whole"), (F.col("expected") - F.floor("expected")).alias("part")))
    marked = sizes.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")))
    chance = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10)
              .cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = (F.lit(1.0) - F.col("part")) / F.col("part")
    ranked = materialise(marked.select(
        "doc_id", "source", "size", "source_size", "target", "whole", "part", "row_tag",
        F.when((F.col("part") > 0) & (F.col("size") > 0),
               chance / (F.lit(1.0) - chance) * odds).alias("rank_value")))
    certain = ranked.groupBy("source").agg(
        F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("goal"))
    left = certain.select(F.col("source").alias("_source"), (F.col("goal") - F.col("sure")).alias("room"))
    first = _take(ranked.filter("rank_value IS NOT NULL"), left, nearest=False)
    first = materialise(first)
    spent = first.groupBy("source").agg(F.sum(F.when(F.col("took"), F.col("size")).otherwise(0)).alias("spent"))
    still = spent.join(left, spent["source"].eqNullSafe(left["_source"])).select(
        "_source", (F.col("room") - F.col("spent")).alias("room"))
    waiting = first.filter("NOT took").drop("took", "room")
    second = _take(waiting, still, nearest=True, fitting=True)
    extra = (first.filter("took").select("row_tag", F.lit(1).alias("extra"))
             .unionByName(second.filter("took").select("row_tag", F.lit(1).alias("extra"))))
    joined = ranked.join(extra, "row_tag", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("bigint")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"), "row_tag")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns only."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
                         F.monotonically_increasing_id().alias("tag"))
    flat = packed.select("tag", *[F.col("row")[c].alias(a) for c, a in
                                  ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))])
    chosen = mix_sources(flat, tag=F.col("tag"), **options).filter("copies > 0").select("row_tag", "copies")
    joined = packed.join(chosen, packed["tag"] == chosen["row_tag"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def _take(rows: DataFrame, room: DataFrame, nearest: bool, fitting: bool = False) -> DataFrame:
    """Mark the rows to take in rank order while they fit, or until ``room`` is met most nearly."""
    joined = rows.join(room, rows["source"].eqNullSafe(room["_source"])).drop("_source")
    if fitting:
        joined = joined.filter(F.col("size") <= F.col("room"))
    order = [F.col("source").asc_nulls_last(), "rank_value", "doc_id", "row_tag"]
    summed = running_total(joined, order, "size", "before")
    starts = summed.groupBy("source").agg(F.min("before").alias("start"))
    starts = starts.select(F.col("source").alias("_source"), "start")
    placed = summed.join(starts, summed["source"].eqNullSafe(starts["_source"]))
    before = F.col("before") - F.col("start")
    took = 2 * before + F.col("size") < 2 * F.col("room") if nearest else before + F.col("size") <= F.col("room")
    return placed.withColumn("took", took).drop("_source", "before", "start")


_SQL = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
dealt AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM sizes GROUP BY source),
capped AS (
  SELECT *, [5, 2, 1][(nth % 3 + 1)::INT] AS weight, source_size * 2 AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM dealt),
levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio, sum(cap) OVER upto AS filled,
         sum(weight) OVER () - sum(weight) OVER upto AS rest
  FROM capped WINDOW upto AS (ORDER BY cap::DOUBLE / weight, nth ROWS UNBOUNDED PRECEDING)),
flags AS (SELECT *, filled + ratio * rest <= budget AS is_full FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
    (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) /
    sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END AS target FROM flags),
classed AS (SELECT *, length(bin(size)) AS class FROM sizes),
classes AS (
  SELECT c.source, c.class, t.source_size, t.target, words, words * 2 AS cap, words * c.class AS pull
  FROM (SELECT source, class, sum(size)::BIGINT AS words FROM classed GROUP BY source, class) c
  JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
class_ratio AS (SELECT *, CASE WHEN pull > 0 THEN cap::DOUBLE / pull ELSE 0.0 END AS ratio FROM classes),
class_levels AS (
  SELECT *, sum(cap) OVER upto AS filled, sum(pull) OVER (PARTITION BY source) - sum(pull) OVER upto AS rest
  FROM class_ratio WINDOW upto AS (PARTITION BY source ORDER BY ratio, class ROWS UNBOUNDED PRECEDING)),
class_flags AS (SELECT *, filled + ratio * rest <= target AS is_full FROM class_levels),
shares AS (
  SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE
    (target - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY source), 0)) /
    sum(CASE WHEN NOT is_full THEN pull END) OVER (PARTITION BY source) * pull END AS share FROM class_flags),
plan AS (SELECT *, CASE WHEN words > 0 THEN share / words ELSE 0.0 END AS expected FROM shares),
ranked AS (
  SELECT c.doc_id, c.source, c.size, p.source_size, p.target, floor(expected)::BIGINT AS whole,
         expected - floor(expected) AS part,
         (('0x' || substr(md5(coalesce(c.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS chance
  FROM classed c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source AND c.class = p.class),
valued AS (
  SELECT *, CASE WHEN part > 0 AND size > 0
    THEN chance / (1.0::DOUBLE - chance) * ((1.0::DOUBLE - part) / part) END AS rank_value FROM ranked),
room AS (SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS room FROM valued),
first_pass AS (
  SELECT *, rank_value IS NOT NULL AND sum(CASE WHEN rank_value IS NOT NULL THEN size END) OVER (
    PARTITION BY source ORDER BY rank_value NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= room AS took FROM room),
still AS (
  SELECT *, room - coalesce(sum(CASE WHEN took THEN size END) OVER (PARTITION BY source), 0) AS room2 FROM first_pass),
open_rows AS (
  SELECT *, rank_value IS NOT NULL AND NOT took AND size <= room2 AS is_open FROM still),
second_pass AS (
  SELECT *, is_open AND 2 * sum(CASE WHEN is_open THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY is_open DESC, rank_value, doc_id ROWS UNBOUNDED PRECEDING) - size < 2 * room2 AS took2
  FROM open_rows)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN took OR took2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM second_pass
"""


@query("op6_pareto_mix", _SQL)
def op6_pareto_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
