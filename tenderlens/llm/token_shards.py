"""Token shards in training order.

Texts are tokenised, each followed by an end token, and laid end to end in scan order; every ``length``
tokens are a sequence. A keyed Feistel permutation of the sequence numbers, walked until it lands inside
the range, gives every sequence its global slot. Slots are cut into ranges, one shard each, in which
sequence ``slot`` starts at byte (slot - first_slot) * stride, so a reader can go on at any slot.

The tokens of each input partition are settled in the checkpoint folder, counted, and then placed: the
only shuffle carries the pieces of sequences to their shards. Only one number per input partition
reaches the driver. The order is that of the input's partitions and rows; once settled it stays, also
when a task runs again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, table
from tenderlens.session import materialise

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 2048
SEQUENCES_PER_SHARD = 4096
_IRREGULAR = re.compile(r" (?:\s|$)")
_CACHE = 800_000
_ROW_BYTES = 4 << 20


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Tokens(dict):
    """uint16 tokens of a text. Words recur, so each distinct one is merged once and remembered.

    No token crosses the place before a space that a word follows, so a text falls apart there; the keys
    are the words after a space. Other texts are tokenised whole.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.coder = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        tokens = self[word] = self.merged(" " + word)
        return tokens

    def merged(self, text: str) -> bytes:
        return array("H", self.coder.encode_ordinary(text)).tobytes()

    def text(self, text: str) -> bytes:
        if _IRREGULAR.search(text):
            return self.merged(text)
        first, *rest = text.split(" ")
        return self.merged(first) + b"".join(map(self.__getitem__, rest))


def slots(numbers: np.ndarray, size: int, key: str, rounds: int = 4) -> np.ndarray:
    """Keyed permutation of 0 .. size - 1: a Feistel network over the next even power of two.

    A value that leaves the range is permuted again until it is back inside.
    """
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def once(x):
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            m = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((m ^ (m >> np.uint64(32))) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(numbers, np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(size))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def token_shards(docs: DataFrame, text_col: str = "text", length: int = LENGTH,
                 per_shard: int = SEQUENCES_PER_SHARD, key: str = "training", ranks: str = RANKS) -> DataFrame:
    """One row per shard: shard, first_slot, n_sequences, stride (bytes), data (little-endian uint16).

    Null and empty texts add one end token. The last sequence is filled up with end tokens. Repeated rows
    are laid out like any others; an empty table gives no shards. Only the text is read.
    """
    spark = docs.sparkSession
    vocabulary = load_ranks(ranks)
    end = np.array([max(vocabulary.values()) + 1], np.uint16).tobytes()
    shared = spark.sparkContext.broadcast(vocabulary)
    texts = docs.select(F.col(text_col).alias("text"))
    stride = 2 * length

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, size = Tokens(shared.value), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(tokens.text(text.as_py() or "") + end)
                size += len(held[-1])
                if size >= _ROW_BYTES:
                    yield pa.RecordBatch.from_pydict({"data": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"data": [b"".join(held)]})

    stream = materialise(texts.mapInArrow(tokenised, "data binary"))
    totals = dict(stream.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum(F.length("data") / 2).cast("long").alias("n")).collect())
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part] = total
        total += totals[part]
    size = -(-total // length)
    begin = spark.sparkContext.broadcast(starts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 2 * begin.value.get(TaskContext.get().partitionId(), 0)
        for data in (row.as_py() for batch in batches for row in batch.column(0)):
            cuts = np.arange(at // stride * stride, at + len(data), stride)
            if len(cuts):
                slot = slots(cuts // stride, size, key)
                left, right = np.maximum(cuts, at), np.minimum(cuts + stride, at + len(data))
                yield pa.RecordBatch.from_pydict({
                    "shard": slot // per_shard, "at": slot % per_shard * stride + left % stride,
                    "piece": [data[a - at:b - at] for a, b in zip(left.tolist(), right.tolist())]})
            at += len(data)

    def assemble(pieces: pd.DataFrame) -> pd.DataFrame:
        shard = int(pieces["shard"].iloc[0])
        held = min(per_shard, size - shard * per_shard)
        data = np.frombuffer(end * (held * length), np.uint8).copy()
        for at, piece in zip(pieces["at"], pieces["piece"]):
            data[at:at + len(piece)] = np.frombuffer(piece, np.uint8)
        return pd.DataFrame({"shard": [shard], "first_slot": [shard * per_shard], "n_sequences": [held],
                             "stride": [stride], "data": [data.tobytes()]})

    pieces = stream.mapInArrow(place, "shard long, at long, piece binary")
    return pieces.groupBy("shard").applyInPandas(
        assemble, "shard long, first_slot long, n_sequences long, stride long, data binary")


def save_shards(shards: DataFrame, folder: str) -> None:
    """One uncompressed column chunk a shard, in slot order, committed as a whole by Spark's writer."""
    ordered = shards.repartitionByRange("shard").sortWithinPartitions("shard")
    ordered.write.mode("overwrite").option("compression", "none").parquet(folder)


def read_slots(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """(slot, tokens as bytes) for slots first .. last - 1; other shards are skipped by their slot range."""
    shards = spark.read.parquet(folder).filter(
        (F.col("first_slot") < last) & (F.col("first_slot") + F.col("n_sequences") > first))
    inside = F.explode(F.sequence(
        F.greatest(F.lit(first), F.col("first_slot")),
        F.least(F.lit(last), F.col("first_slot") + F.col("n_sequences")) - 1)).alias("slot")
    return shards.select("*", inside).select("slot", F.substring(
        F.col("data"), ((F.col("slot") - F.col("first_slot")) * F.col("stride") + 1).cast("int"),
        F.col("stride").cast("int")).alias("tokens"))


@query("op3_token_shards")
def op3_token_shards(spark, sf_dir):
    return token_shards(table(spark, sf_dir, "documents"))
