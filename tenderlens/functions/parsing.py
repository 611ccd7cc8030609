"""Typed parsing of string fields (P1-P6) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(_column(c), F.lit(""))


def parse_decimal(c, precision: int, scale: int) -> Column:
    """Exact decimal rounded half away from zero; null when blank, malformed or too large."""
    return blank_to_null(c).try_cast(T.DecimalType(precision, scale))


def malformed_decimal(c, precision: int, scale: int) -> Column:
    """True for text that is present but is no number of the wanted precision."""
    return blank_to_null(c).isNotNull() & parse_decimal(c, precision, scale).isNull()


def parse_date(c) -> Column:
    """ISO dates (with or without time) and month/day/year; anything else is null."""
    text = blank_to_null(c)
    return F.coalesce(text.try_cast("date"),
                      F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"))


def parse_timestamp(c) -> Column:
    return blank_to_null(c).try_cast("timestamp_ntz")


def parse_bool(c) -> Column:
    """yes/true/1 in any case is true, blank is null, everything else is false."""
    text = blank_to_null(c)
    return F.when(text.isNotNull(), F.lower(text).isin("yes", "true", "1"))


def parse_int(c) -> Column:
    return blank_to_null(c).try_cast("bigint")


def parse_str(c) -> Column:
    return blank_to_null(c)


def parse_as(c, kind: T.DataType) -> Column:
    """Parse by target type. Plain strings pass through unchanged, blanks included."""
    if isinstance(kind, T.DecimalType):
        return parse_decimal(c, kind.precision, kind.scale)
    if isinstance(kind, T.DateType):
        return parse_date(c)
    if isinstance(kind, T.TimestampNTZType):
        return parse_timestamp(c)
    if isinstance(kind, T.BooleanType):
        return parse_bool(c)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return parse_int(c)
    return _column(c)


def rename_fields(df: DataFrame, fields: list[tuple[str, str, T.DataType]],
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One projection from received names to typed columns; absent fields become nulls."""
    present = set(df.columns)
    typed = [
        (parse_as(source, kind) if source in present else F.lit(None)).cast(kind).alias(target)
        for source, target, kind in fields
    ]
    return df.select(*keep, *typed)


def any_malformed(df: DataFrame, fields: list[tuple[str, str, T.DataType]]) -> Column:
    """True when any decimal field of the list is malformed."""
    checks = [
        malformed_decimal(source, kind.precision, kind.scale)
        for source, _, kind in fields
        if isinstance(kind, T.DecimalType) and source in df.columns
    ]
    verdict = F.lit(False)
    for check in checks:
        verdict = verdict | check
    return verdict
