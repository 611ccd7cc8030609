"""Articles and their details cut out of document dumps.

A dump arrives as lines with (file, block, line number). Whether a line belongs to an article
depends on all marker lines above it, but that state is carried between blocks as a few counters,
so one dump of any size is processed block by block in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.operators.ordering import block_starts
from tenderlens.session import materialise

# Marker lines.
OPEN, SWITCH, CLOSE = "full text", "details", "links"

# Patterns of the details lines.
ID_LINE = r"(?m)^proquest ?document ?id:([^:\n]*)"
DATE_LINE = r"(?m)^publication date:([^:\n]*)"
COMPACT_DATE = r"^([a-z]{3})(\d{1,2}),(\d{4})$"


def _before(totals: list[str], window) -> dict[str, Column]:
    return {name: F.col(f"_start_{name}") + F.coalesce(F.sum(f"_is_{name}").over(window), F.lit(0))
            for name in totals}


def extract_sections(lines: DataFrame, file: str = "file", block: str = "block",
                     line: str = "line_no", text: str = "line") -> DataFrame:
    """(file, article number, article text, details text); details are null if never closed."""
    marker = F.lower(text)
    rows = lines.select(
        F.col(file).alias("file"), F.col(block).alias("block"), F.col(line).alias("line_no"),
        marker.alias("line"),
        F.when(marker.isin(OPEN, SWITCH, CLOSE), marker).alias("kind"))

    per_block = rows.groupBy("file", "block").agg(
        F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("line_no", "kind"))).alias("marks"))
    marks = materialise(
        per_block.select("file", "block", F.explode_outer("marks").alias("mark"))
        .select("file", "block", "mark.*"))

    starts = _block_states(marks)
    above = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1)
    state = _with_marker_columns(_dealt(rows, marks)).join(starts, ["file", "block"])
    state = state.withColumns({
        **_before(["opens", "switches", "closes"], above),
        "in_article": F.coalesce(F.last("_turn", ignorenulls=True).over(above), "_start_turn") == OPEN,
    })
    state = state.withColumn("_switched", (F.col("kind") == SWITCH) & F.col("in_article"))
    state = state.withColumn("_end", _details_turn())
    state = state.withColumn(
        "in_details",
        F.coalesce(F.last("_end", ignorenulls=True).over(above), "_start_end") == SWITCH)

    return _assemble(state)


def _dealt(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines in as many tasks as there are blocks, if those are more than a shuffle has: a task sorts a few blocks,
    however many there are."""
    blocks = marks.select("file", "block").distinct().count()
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(blocks, "file", "block") if blocks > usual else rows


def _with_marker_columns(rows: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return rows.withColumns({
        "_is_opens": F.when(kind == OPEN, 1).otherwise(0),
        "_is_switches": F.when(kind == SWITCH, 1).otherwise(0),
        "_is_closes": F.when(kind == CLOSE, 1).otherwise(0),
        "_turn": F.when(kind.isin(OPEN, SWITCH), kind),
    })


def _details_turn() -> Column:
    return F.when(F.col("_switched"), SWITCH).when(F.col("kind") == CLOSE, CLOSE)


def _block_states(marks: DataFrame) -> DataFrame:
    """Counters and open/closed state at the start of each block, from marker lines only."""
    marked = _with_marker_columns(marks)
    first = block_starts(
        marked, ["file"], "block", "line_no",
        {"_start_opens": "_is_opens", "_start_switches": "_is_switches",
         "_start_closes": "_is_closes"},
        {"_start_turn": "_turn"})
    above = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1)
    turns = marked.join(first.select("file", "block", "_start_turn"), ["file", "block"]).withColumn(
        "_switched",
        (F.col("kind") == SWITCH)
        & (F.coalesce(F.last("_turn", ignorenulls=True).over(above), "_start_turn") == OPEN))
    second = block_starts(turns.withColumn("_end", _details_turn()), ["file"], "block", "line_no",
                          {}, {"_start_end": "_end"})
    ends = marked.groupBy("file").agg(F.sum("_is_switches").alias("_all_switches"),
                                      F.sum("_is_closes").alias("_all_closes"))
    counted = first.withColumns({
        c: F.coalesce(F.col(c), F.lit(0))
        for c in ("_start_opens", "_start_switches", "_start_closes")})
    return counted.join(second, ["file", "block"]).join(ends, "file")


def _assemble(state: DataFrame) -> DataFrame:
    kind, in_article, in_details = F.col("kind"), F.col("in_article"), F.col("in_details")
    in_article, in_details = F.coalesce(in_article, F.lit(False)), F.coalesce(in_details, F.lit(False))
    switched = F.coalesce(F.col("_switched"), F.lit(False))
    opens = F.coalesce(kind == OPEN, F.lit(False))
    closes = F.coalesce(kind == CLOSE, F.lit(False))

    def part(role: str, segment: str, ends: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(segment).alias("segment"),
                        F.when(ends, F.col("opens")).alias("number"))

    # A segment that is never closed is dropped here, before any text is gathered.
    article = F.when(in_article & ~opens & (F.col("switches") < F.col("_all_switches")),
                     part("article", "switches", switched))
    details = F.when(in_details & ~opens & ~switched & (F.col("closes") < F.col("_all_closes")),
                     part("details", "closes", closes))
    parts = state.select(
        "file", "block", "line_no", "line",
        F.explode(F.array_compact(F.array(article, details))).alias("part"))
    pieces = F.array_sort(F.collect_list(
        F.when(F.col("part.number").isNull(), F.struct("block", "line_no", "line"))))
    bodies = parts.groupBy("file", "part.role", "part.segment").agg(
        F.max("part.number").alias("number"),
        F.transform(pieces, lambda p: p["line"]).alias("lines")).filter("number IS NOT NULL")

    def joined(separator: str) -> Column:
        return F.when(F.size("lines") > 0, F.concat(F.array_join("lines", separator), F.lit(separator))).otherwise("")

    text = F.when(F.col("role") == "article", joined(" ")).otherwise(joined("\n"))
    # Both roles of an article meet in one grouping, so the text is read and gathered once. Details left
    # open into the next article end under its number; its own details come last.
    whole = bodies.groupBy("file", "number").agg(
        *[F.max_by(F.when(F.col("role") == role, text), F.when(F.col("role") == role, F.col("segment"))).alias(role)
          for role in ("article", "details")])
    return whole.filter("article IS NOT NULL")


def _last_value(details, pattern: str) -> Column:
    found = F.regexp_extract_all(details, F.lit(pattern), F.lit(1))
    return F.replace(F.trim(F.try_element_at(found, F.lit(-1))), F.lit(" "), F.lit(""))


def parse_article_id(details) -> Column:
    """The document id with stray spaces removed; null if there is no such line."""
    return _last_value(details, ID_LINE)


def parse_broken_date(details) -> Column:
    """'au g 9, 2025' and the like; null when it cannot be read."""
    compact = _last_value(details, DATE_LINE)
    part = [F.regexp_extract(compact, COMPACT_DATE, i) for i in (1, 2, 3)]
    return F.try_to_timestamp(F.concat_ws(" ", *part), F.lit("MMM d yyyy")).cast("date")


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row per key (X15); partial minima are taken before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_first")).select(
        *keys, *[F.col(f"_first.{c}") for c in others]).select(*df.columns)
