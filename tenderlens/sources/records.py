"""Raw auction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.operators.ordering import running_total
from tenderlens.schemas import API_RECORD
from tenderlens.session import materialise

PAGE = T.StructType([
    T.StructField("page", T.LongType()),
    T.StructField("securityList", T.ArrayType(API_RECORD)),
    T.StructField("totalResultsCount", T.LongType()),
])

RECORD_CHARS = 1 << 28  # a record that crosses file splits may be this long


def with_arrival(df: DataFrame, name: str = "arrival") -> DataFrame:
    """File rows in arrival order: by file path, then by place in the file.

    Name landing files so that they sort by time; unlike modification times, names survive
    copying. Row ids grow within a file split, and a split is never cut, so the order stays the
    same however the splits are spread over tasks.
    """
    return df.withColumn(name, F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row")))


def read_auction_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Flat records, every field a string, with their arrival order.

    A file holding one JSON array is read by one task; ``read_auction_array`` reads very large ones by many.
    """
    raw = spark.read.schema(API_RECORD).option("multiLine", str(multi_line).lower()).json(path)
    return with_arrival(raw)


def _braces(segments: Column, parity: int) -> Column:
    outside = F.array_join(F.filter(segments, lambda _, at: at % 2 == parity), "")
    return F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The text up to each closing brace."""
    return with_arrival(spark.read.option("lineSep", "}").text(path)).select("arrival.*", "value")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text up to each closing brace, with its unescaped quotes and the braces it opens.

    Which braces stand outside strings depends on whether the piece begins inside one: ``opens`` holds both counts.
    Where no brace comes after a quote and nothing is escaped, the text need not be cut at its quotes.
    """
    value, brace, quote = F.col("value"), F.lit("{"), F.lit('"')

    def times(text, mark):
        return F.length(text) - F.length(F.replace(text, mark, F.lit("")))

    plain = ~F.contains(value, F.lit("\\")) & (times(value, brace) == times(F.substring_index(value, '"', 1), brace))
    segments = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    return _scan(spark, path).select(
        "path", "start", "row", "value",
        F.when(plain, times(value, quote)).otherwise(F.size(segments) - 1).alias("quotes"),
        F.when(plain, F.array(times(value, brace), F.lit(0)))
        .otherwise(F.array(_braces(segments, 0), _braces(segments, 1))).alias("opens"))


def _net(inside: Column) -> Column:
    """Change of depth by a piece that begins inside a string (1) or not (0)."""
    return F.get("opens", inside.cast("int")) - F.when((inside + F.col("quotes")) % 2 == 0, 1).otherwise(0)


def read_auction_array(spark: SparkSession, path: str, record_chars: int = RECORD_CHARS) -> DataFrame:
    """Flat records of JSON arrays of any size, each file read by as many tasks as it has splits.

    Most splits begin between records and every piece of them is one record: these are parsed where they are read.
    Only the rest is shuffled.

    The text is cut at closing braces. Whether such a brace ends a record depends on all quotes and braces above it;
    that state crosses splits as two counters each. A record whose strings hold braces, that has nested values or
    that crosses splits is put together again. Objects one after the other, or one a line, are read alike. Text
    that is no JSON gives records without values; after a lone quote or brace that holds for the rest of its file. So
    does a record over splits that is longer than ``record_chars``. No files or empty arrays give no rows.
    """
    split = Window.partitionBy("path", "start").orderBy("row")
    earlier = split.rowsBetween(Window.unboundedPreceding, -1)
    marked = _pieces(spark, path)
    # One row per split. If no piece of it holds an odd number of quotes, its sums need no order.
    opened = F.col("opens")[0]
    plain = materialise(marked.groupBy("path", "start").agg(
        (F.max(F.col("quotes") % 2) == 1).alias("uneven"), F.sum("quotes").alias("q"),
        F.sum(opened - 1).alias("n0"), F.sum(F.col("opens")[1]).alias("n1"),
        F.count_if(opened != 1).alias("others"), F.max("row").alias("last"),
        F.max(F.when(opened == 0, F.col("row"))).alias("tail")))
    uneven = marked.join(F.broadcast(plain.filter("uneven").select("path", "start")), ["path", "start"], "left_semi")
    ordered = uneven.withColumn("_quotes", F.coalesce(F.sum("quotes").over(earlier), F.lit(0))).groupBy("path", "start").agg(
        *[F.sum(_net((F.col("_quotes") + i) % 2)).alias(f"m{i}") for i in (0, 1)])
    # What comes after the last closing brace of a file is a piece too.
    calm = ~F.col("uneven") & ((F.col("others") == 0) | ((F.col("others") == 1) & F.col("tail").eqNullSafe(F.col("last"))))
    sums = plain.join(ordered, ["path", "start"], "left").select(
        "path", "start", "q", *[F.when(F.col("uneven"), F.col(f"m{i}")).otherwise(F.col(f"n{i}")).alias(f"n{i}") for i in (0, 1)],
        calm.alias("calm"), F.when(F.col("others") > 0, F.col("tail")).alias("tail"))
    above = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = sums.withColumn("_inside", F.coalesce(F.sum("q").over(above), F.lit(0)) % 2)
    states = materialise(quoted.withColumn("_depth", F.coalesce(
        F.sum(F.when(F.col("_inside") == 0, F.col("n0")).otherwise(F.col("n1"))).over(above), F.lit(0))).select(
        "path", "start", "_inside", "_depth", "tail",
        (F.col("calm") & (F.col("_inside") == 0) & (F.col("_depth") == 0)).alias("_calm")))
    at_once = _scan(spark, path).join(F.broadcast(states.filter("_calm").select("path", "start", "tail")), ["path", "start"]).filter(
        "tail IS NULL OR row <> tail").select("path", "start", "row", F.concat("value", F.lit("}")).alias("text"))
    pieces = marked.join(F.broadcast(states), ["path", "start"]).filter("NOT _calm OR row = tail").drop("_calm", "tail").withColumn(
        "_quotes", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))

    inside = (F.col("_quotes") + F.col("_inside")) % 2
    placed = (
        pieces.withColumn("_net", _net(inside))
        .withColumn("_from", F.col("_depth") + F.coalesce(F.sum("_net").over(earlier), F.lit(0)))
        .withColumn("_ends", (F.col("_from") + F.col("_net") == 0) & ((inside + F.col("quotes")) % 2 == 0))
        .withColumn("_record", F.coalesce(F.sum(F.col("_ends").cast("int")).over(earlier), F.lit(0)))
    )
    texts = placed.groupBy("path", "start", "_record").agg(
        F.min("row").alias("row"), F.max("_ends").alias("ended"),
        F.min_by((F.col("_from") == 0) & (inside == 0), "row").alias("begun"),
        F.array_sort(F.collect_list(F.struct("row", "value"))).alias("parts")
    ).withColumn("text", F.concat(F.array_join(F.col("parts.value"), "}"), F.lit("}"))).drop("parts")
    whole = F.col("ended") & F.col("begun")
    # At most two fragments a split.
    order = Window.partitionBy("path").orderBy("start", "_record").rowsBetween(Window.unboundedPreceding, -1)
    numbered = texts.filter(~whole).withColumn(
        "_number", F.coalesce(F.sum(F.col("ended").cast("int")).over(order), F.lit(0)))
    length = F.sum(F.length("text")).over(Window.partitionBy("path", "_number").orderBy("start", "_record"))
    joined = numbered.withColumn("_length", length).groupBy("path", "_number").agg(
        F.min(F.struct("start", "row")).alias("first"),
        F.array_sort(F.collect_list(F.when(
            F.col("_length") <= record_chars, F.struct("start", "_record", "text")))).alias("parts"))
    found = texts.filter(whole).select("path", "start", "row", "text").unionByName(joined.select(
        "path", "first.*", F.array_join(F.col("parts.text"), "").alias("text"))).unionByName(at_once)
    return found.filter(F.contains("text", F.lit("{"))).select(
        F.from_json(F.regexp_replace("text", r"^[^{]*", ""), API_RECORD).alias("record"),
        F.struct("path", "start", "row").alias("arrival"),
    ).select("record.*", "arrival")


def flatten_pages(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """Records of consecutive pages up to the first stop condition, in page order.

    Stops before a page without records and after the page that reaches the announced total or, if
    the caller asks for one, ``max_records``. The running number of records is summed over slices of the
    pages, so a download of any length is searched by many tasks; only the stopping page's number is
    brought together.
    """
    size = F.coalesce(F.size("securityList"), F.lit(0))
    heads = pages.select("page", F.greatest(size, F.lit(0)).alias("n"), "totalResultsCount")
    fetched = F.col("before") + F.col("n")
    complete = F.coalesce(fetched >= F.col("totalResultsCount"), F.lit(False))
    if max_records is not None:
        complete = complete | (fetched >= max_records)
    judged = running_total(heads, ["page"], "n", "before").filter(complete | (F.col("n") == 0))
    stop = judged.agg(F.min("page").alias("stop")).scalar()
    records = pages.filter(stop.isNull() | (F.col("page") <= stop)).select(
        "page", F.posexplode("securityList").alias("place", "record"))
    return records.select("record.*", F.struct("page", "place").alias("arrival"))
