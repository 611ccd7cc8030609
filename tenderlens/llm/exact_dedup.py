"""Exact duplicates by two passes over a Bloom filter.

Pass one sets the bits of every text's hash in a counting filter that saturates at two. Pass two
looks each row up: a row all of whose bits were set at least twice may be repeated and is shuffled
to its hash; every other row is unique and passes straight through, without a shuffle.

The filter takes ``bits_per_row`` bits a row, up to ``max_filter_bytes``, so what is broadcast has a
fixed bound. Beyond it more unique rows look repeated and are shuffled for nothing; the result
stays the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.registry import SPACE, groups_for, query, table, text_or_empty
from tenderlens.session import materialise

BITS_PER_ROW = 16
MAX_FILTER_BYTES = 64 << 20
_POSITIONS_PER_SEGMENT = 1 << 22


def text_digest(text: str) -> Column:
    """SHA-256 (lowercase hex) of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(text_or_empty(text), SPACE, " "), 256)


def _positions(first: np.ndarray, second: np.ndarray, hashes: int, bits: int) -> np.ndarray:
    steps = np.arange(hashes, dtype=np.uint64)[None, :]
    mixed = first.astype(np.uint64)[:, None] + steps * (second.astype(np.uint64)[:, None] | np.uint64(1))
    return mixed & np.uint64(bits - 1)


def may_repeat(plane: np.ndarray, bits: int, hashes: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether at least two rows have set all bits of each hash; ``bits`` is a power of two."""
    at = _positions(first, second, hashes, bits)
    set_bits = plane[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
    return (set_bits & 1).all(axis=1)


def build_filter(hashed: DataFrame, rows: int, bits_per_row: int = BITS_PER_ROW,
                 max_filter_bytes: int = MAX_FILTER_BYTES) -> tuple[np.ndarray, int, int]:
    """Plane of bits that two rows or more have set, its size in bits, hashes a row.

    ``hashed`` has two bigint columns; each map task sends every distinct hash at most twice.

    Bits are counted per segment, one group a segment; only the finished plane, of bounded size,
    reaches the driver.
    """
    wanted = min(max(1024, rows * bits_per_row), 8 * max_filter_bytes)
    bits = 1 << (wanted.bit_length() - 1 if 8 * max_filter_bytes <= wanted else (wanted - 1).bit_length())
    hashes = max(1, min(4, round(0.7 * bits / max(rows, 1))))
    segments = 1 << (groups_for(rows * hashes, _POSITIONS_PER_SEGMENT) - 1).bit_length()
    segments = min(segments, bits // 64)
    width = bits // segments

    def partial(batches):
        frames = list(batches)
        if not frames:
            return
        both = np.concatenate([f.to_numpy(dtype=np.int64) for f in frames])
        if not len(both):
            return
        distinct, counts = np.unique(both, axis=0, return_counts=True)
        distinct = np.concatenate([distinct, distinct[counts > 1]])
        at = np.sort(_positions(distinct[:, 0], distinct[:, 1], hashes, bits).ravel())
        segment = (at // np.uint64(width)).astype(np.int64)
        inside = (at % np.uint64(width)).astype(np.uint32)
        edges = np.flatnonzero(np.diff(segment, prepend=-1))
        for start, end in zip(edges, [*edges[1:], len(at)]):
            yield pd.DataFrame({"segment": [segment[start]], "bits": [inside[start:end].tobytes()]})

    def merge(key, frame):
        counts = np.zeros(width, np.uint8)
        for packed in frame["bits"]:
            times = np.bincount(np.frombuffer(packed, np.uint32), minlength=width)
            np.minimum(counts + np.minimum(times, 2).astype(np.uint8), 2, out=counts)
        plane = np.packbits(counts > 1, bitorder="little")
        return pd.DataFrame({"segment": [key[0]], "plane": [plane.tobytes()]})

    parts = hashed.mapInPandas(partial, "segment bigint, bits binary")
    planes = parts.groupBy("segment").applyInPandas(merge, "segment bigint, plane binary")
    plane = np.zeros(bits // 8, np.uint8)
    for row in planes.toLocalIterator():
        at = row["segment"] * (width // 8)
        plane[at:at + width // 8] = np.frombuffer(row["plane"], np.uint8)
    return plane, bits, hashes


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     payload: list[str] | None = None, bits_per_row: int = BITS_PER_ROW,
                     max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and ``row`` if asked for.

    Texts are equal when identical after each run of white space became one space; null counts as
    empty. Of equal texts the smallest id stays, null ids last; of repeated ids exactly one row
    stays. Where all ids of a group are null, keep_id is null and one row stays. ``payload`` names
    the columns to carry along as struct ``row``, so that no name of theirs can clash. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), text_digest(text_col).alias("text_sha256"),
        *([F.struct(*[F.col(c) for c in payload]).alias("row")] if payload else []),
    ).withColumn("_tag", F.monotonically_increasing_id())
    first, second = (F.conv(F.substring("text_sha256", at, 15), 16, 10).cast("bigint") for at in (1, 17))
    repeats = build_filter(keyed.select(first.alias("a"), second.alias("b")), docs.count(),
                           bits_per_row, max_filter_bytes)
    plane, bits, hashes = repeats
    shared = spark.sparkContext.broadcast(plane)

    @F.pandas_udf("boolean")
    def suspect(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(may_repeat(shared.value, bits, hashes, a.to_numpy(), b.to_numpy()))

    flagged = keyed.withColumn("_maybe", suspect(first, second))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *(["row"] if payload else [])]
    alone = flagged.filter(~F.col("_maybe")).select(
        "*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept")).select(*out)
    suspects = materialise(flagged.filter("_maybe").drop("_maybe"))
    groups = suspects.groupBy("text_sha256").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_tag")).alias("_first"),
        F.count(F.lit(1)).alias("group_size"))
    settled = suspects.join(groups, "text_sha256").select(
        "*", F.col("_first.doc_id").alias("keep_id"),
        (F.col("_tag") == F.col("_first._tag")).alias("kept")).select(*out)
    return alone.unionByName(settled)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with their own columns only."""
    kept = exact_duplicates(docs, id_col, text_col, payload=docs.columns, **options).filter("kept")
    return kept.select("row.*")


@query("op2_exact_dedup", """
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(plain) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS plain FROM documents)
WINDOW same AS (PARTITION BY plain)
""")
def op2_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))
