"""CSV and document files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.sources.records import with_arrival

CORRUPT = "_corrupt_record"


def is_missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a fixed schema; rows that do not fit keep their text aside.

    Columns are matched by position, so ``schema`` lists all columns of the file. A missing file
    is an empty table.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    try:
        raw = (spark.read.schema(full).option("header", "true").option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
        return with_arrival(raw)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], full).withColumn("arrival", F.lit(0))


def write_csv(df: DataFrame, path: str) -> None:
    """Write with a header, as many files as there are partitions."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text dumps as (file, block, line_no, line).

    Files are split like any text input, so one large dump is read by many tasks; the split
    offset is the block, and row ids grow along the lines of a split.
    """
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"))


def lines_of(docs: DataFrame, file: str, text: str) -> DataFrame:
    """Lines of dumps held as one text per row; each row is a block of its own."""
    return docs.select(F.col(file).alias("file"), F.lit(0).cast("bigint").alias("block"),
                       F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
