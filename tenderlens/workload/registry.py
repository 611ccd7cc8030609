"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` must give the same rows and column names in DuckDB."""
    def keep(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return keep


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all double columns, so that sums taken in another order still compare equal."""
    return df.select(*[
        F.round(f.name, special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def settled(df: DataFrame, digits: int, **special: int) -> DataFrame:
    """``rounded`` for means of short decimals: exact halves are frequent there, and a nudge far
    below the last digit makes both engines round them the same way."""
    def near(name: str) -> Column:
        d = special.get(name, digits)
        return F.round(F.col(name) + F.lit(10.0 ** -(d + 3)), d).alias(name)
    return df.select(*[near(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema])


def near(expression: str, digits: int) -> str:
    """``settled`` for one SQL expression."""
    return f"round({expression} + 1e-{digits + 3}, {digits})"


def nears(*columns: str, digits: int) -> str:
    return ", ".join(f"{near(c, digits)} AS {c}" for c in columns)


def rounds(*columns: str, digits: int = 6) -> str:
    """The same for a select list in SQL."""
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
