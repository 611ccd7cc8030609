"""Repeated byte strings by bucket-pointer refinement, each byte of them removed.

Two positions are in one bucket at depth h if the h bytes after them are equal. A bucket identifier
of depth 2h is made of the identifiers of depth h at a position and at the offset h later, so
that ``GRAM`` bytes are named in a few steps over a whole text, and any longer string by the identifiers
at its later offsets. Wanted are all positions whose bucket at depth ``WINDOW`` has another member.

Not every position is sorted, though. The position with the smallest identifier in a window of bytes, the
window's anchor, depends on the window's bytes only, so equal windows have their anchors at the same
place and in one bucket. Anchors are about one position in 170 and all that is shuffled:

1. Anchors are grouped by their q-gram. An anchor alone in its bucket is done: none of its windows
   recur. Otherwise the bucket is refined by the bytes of all windows of the anchor together: members
   that are equal there recur in full, and one of them stands for all from here on.
2. What is left of buckets with several members (edges of copies, edited passages) is split into
   blocks of windows. A block's bucket is made of identifiers at offsets on both sides of the anchor; a block alone
   in its bucket is done, equal ones recur in full.
3. The rest is refined once more, down to single windows at the full depth.

Every level regroups only what the one before left open and reuses its identifiers' text. Counting is
pre-aggregated in each task, so a passage that a third of all texts share is one row a task.
Texts are named by their own SHA-256, so equal texts are the same text, and nothing depends on row
numbers. Identifiers have 64 bits and are compared under equal q-grams only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, settled_table, table, text_or_empty

WINDOW = 400
GRAM = 64
BLOCK = 16
_CHUNK = 1 << 16        # windows named at once; arrays of this length stay in the processor's cache
_AT_BITS = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    both = first * _ODD
    both += second
    both ^= both >> _SHIFT
    both *= _MIX
    return both


def _byte_names() -> np.ndarray:
    with np.errstate(over="ignore"):
        names = _mixed(np.arange(1, 257, dtype=np.uint64), np.full(256, 77, np.uint64))
        return _mixed(names, names[::-1].copy())


BYTE_NAMES = _byte_names()


def gram_names(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Bucket identifier of the ``gram`` bytes (a power of two) from every position on."""
    names, depth = BYTE_NAMES[data], 1
    while depth < gram:
        names = _mixed(names[:max(0, len(names) - depth)], names[depth:])
        depth *= 2
    return names


def string_names(names: np.ndarray, start: np.ndarray, length: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Identifiers of strings of ``gram`` bytes or more from the identifiers at their later offsets."""
    out = _mixed(names[start + length - gram], length.astype(np.uint64))
    for at in range(0, int(length.max(initial=0)) - gram + 1, gram):
        inside = np.flatnonzero(at + gram <= length) if at else slice(None)
        out[inside] = _mixed(out[inside], names[start[inside] + at])
    return out


def _chunks(text_of: np.ndarray):
    """Ranges of up to ``_CHUNK`` bytes that hold whole texts, or a part of one text cut at fixed places in it.

    Copies of a text are thus cut alike wherever they lie.
    """
    borders = np.flatnonzero(np.diff(text_of)) + 1
    first = 0
    while first < len(text_of):
        ends = int(np.searchsorted(borders, first + _CHUNK, "right"))
        # The last border in reach, else a cut within a text that begins at a border or at the cut before.
        end = len(text_of) if len(text_of) <= first + _CHUNK else int(borders[ends - 1]) if ends else 0
        if end <= first:
            end = first + _CHUNK
        yield first, end
        first = end


def anchors(data: np.ndarray, text_of: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows in a run of texts laid end to end; ``text_of`` numbers each byte's text.

    (text, low, anchor, high, bucket, whole): an anchor serves the windows that start at low to high, all
    of one text; ``whole`` names the bytes of these windows with the anchor's place in them. All of it depends
    on the text alone, not on the texts beside it.
    """
    found: list[tuple[np.ndarray, ...]] = []
    span = window - gram + 1            # q-grams in a window
    for first, end in _chunks(text_of):
        part = data[first:end + window - 1]
        if len(part) < window:
            continue
        names = gram_names(part, gram)
        least = (names & ~_AT_BITS) | np.arange(len(names), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:width - span], least[span - width:])
        texts = text_of[first:first + len(part)]
        own = texts[:len(least)]
        inside = own == texts[window - 1:]
        if not inside.any():
            continue
        change = np.flatnonzero((least[1:] != least[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])) + 1
        low = np.concatenate([[0], change])
        high = np.concatenate([change, [len(least)]]) - 1
        low, high = low[inside[low]], high[inside[low]]
        at = (least[low] & _AT_BITS).astype(np.int64)
        whole = string_names(names, low, high - low + window, gram)
        whole = _mixed(_mixed(whole, (at - low).astype(np.uint64)), (high - at + window).astype(np.uint64))
        found.append((own[low], low + first, at + first, high + first, names[at], whole))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*found))


def _laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, the text of each byte, and where each text starts."""
    texts = column.to_pylist()
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.repeat(np.arange(len(texts), dtype=np.int32), lengths), np.cumsum(lengths) - lengths


def _pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 24):
    """A batch in runs of rows with a bounded number of bytes (a longer text is a run of its own)."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()],
                                      names=list(columns))


def _find_anchors(window: int, gram: int):
    def find(batches):
        for batch in batches:
            for part in _pieces(batch, "text"):
                data, text_of, starts = _laid_out(part.column("text"))
                text, low, at, high, bucket, whole = anchors(data, text_of, window, gram)
                base = starts[text]
                yield _batch(tag=part.column("tag").take(pa.array(text)), low=low - base, at=at - base, high=high - base,
                             bucket=bucket.view(np.int64), whole=whole.view(np.int64))
    return find


def _cut_snippets(window: int):
    """The bytes around each open anchor: all that later levels need of a text."""
    def cut(batches):
        for batch in batches:
            for tag, text, spots in zip(*(batch.column(c).to_pylist() for c in ("tag", "text", "spots"))):
                yield _batch(
                    tag=pa.array([tag] * len(spots), pa.binary()), low=[s["low"] for s in spots], at=[s["at"] for s in spots],
                    high=[s["high"] for s in spots], open=[s["open"] for s in spots],
                    bytes=pa.array([text[s["low"]:s["high"] + window] for s in spots], pa.binary()))
    return cut


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place within the row for ``counts`` copies of each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _numbers(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)) for c in columns]


def _block_rows(window: int, gram: int, block: int):
    """One row per open anchor and block of ``block`` windows, counted from the anchor."""
    def rows(batches):
        for batch in batches:
            for part in _pieces(batch, "bytes"):
                data, _, starts = _laid_out(part.column("bytes"))
                low, at, high = _numbers(part, "low", "at", "high")
                nearest, farthest = (at - high) // block, (at - low) // block
                row, step = _spread(farthest - nearest + 1)
                number = nearest[row] + step
                first = np.maximum(low[row], at[row] - number * block - block + 1)
                last = np.minimum(high[row], at[row] - number * block)
                names, base = gram_names(data, gram), starts[row] - low[row]
                ones = np.ones(len(row), np.int64)
                shared = string_names(names, base + at[row] - number * block, ones * (window - block + 1), gram)
                whole = string_names(names, base + first, last - first + window, gram)
                whole = _mixed(_mixed(whole, (at[row] - first).astype(np.uint64)), (at[row] - last).astype(np.uint64))
                yield _batch(tag=part.column("tag").take(pa.array(row)), low=first, high=last, anchor=low[row],
                             open=part.column("open").take(pa.array(row)),
                             bucket=_mixed(shared, number.astype(np.uint64)).view(np.int64), whole=whole.view(np.int64))
    return rows


def _window_rows(window: int, gram: int):
    """One row per window that is still open or may equal one that is."""
    def rows(batches):
        for batch in batches:
            for part in _pieces(batch, "bytes"):
                data, _, starts = _laid_out(part.column("bytes"))
                base = starts - _numbers(part, "low")[0]
                spots = part.column("spots")
                owner = np.repeat(np.arange(len(part)), np.diff(np.asarray(spots.offsets)))
                spots = spots.flatten()
                low, high = np.asarray(spots.field("low")), np.asarray(spots.field("high"))
                row, step = _spread(high - low + 1)
                start, owner = low[row] + step, owner[row]
                names = gram_names(data, gram)
                name = string_names(names, base[owner] + start, np.full(len(row), window), gram)
                yield _batch(tag=part.column("tag").take(pa.array(owner)), low=start, high=start,
                             open=spots.field("open").take(pa.array(row)), bucket=name.view(np.int64), whole=name.view(np.int64))
    return rows


def _judged(members: DataFrame, row: list[str]) -> tuple[DataFrame, DataFrame]:
    """(recurring, going on) of (bucket, whole, open, tag, low, ...).

    Rows of equal ``whole`` recur. A bucket with an open row that has no equal but other members goes on,
    with one row for each of its different strings. Both counts are summed up in each task first, and rows
    are joined back to few figures, so a hot bucket is split like any skewed join.
    """
    same = members.groupBy("bucket", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.max("open").alias("any_open"), F.min(F.struct(*row)).alias("first"))
    alone = (F.col("n") == 1) & F.col("any_open")
    alive = same.groupBy("bucket").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"),
                                       F.count_if(alone).alias("lonely")).filter("all > 1")
    figures = same.join(alive, "bucket").select(
        "bucket", "whole", "first", (F.col("n") > 1).alias("recurs"),
        ((F.col("kinds") > 1) & (F.col("lonely") > 0)).alias("goes_on")).filter("recurs OR goes_on")
    found = settled_table(members.join(figures, ["bucket", "whole"]).filter(
        (F.col("recurs") & F.col("open")) | (F.col("goes_on") & (F.struct(*row) == F.col("first"))))
        .withColumn("is_first", F.struct(*row) == F.col("first")).drop("first", "bucket", "whole"))
    recurring = found.filter("recurs AND open")
    # What recurs already only stands by for the others.
    further = found.filter("goes_on AND is_first").withColumn("open", F.col("open") & ~F.col("recurs"))
    return recurring.select("tag", "low", "high"), further.drop("recurs", "goes_on", "is_first")


def repeated_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(tag, low, high): runs of positions whose ``window`` bytes also start elsewhere.

    ``texts`` has binary columns tag (the same for equal texts) and text.
    """
    found = settled_table(texts.mapInArrow(
        _find_anchors(window, gram), "tag binary, low long, at long, high long, bucket long, whole long"), "anchors")
    row = ["tag", "low", "high"]
    recurring, further = _judged(found.withColumn("open", F.lit(True)), row)

    spots = further.groupBy("tag").agg(F.collect_set(F.struct("low", "at", "high", "open")).alias("spots"))
    once = texts.groupBy("tag").agg(F.first("text").alias("text"))
    snippets = settled_table(once.join(spots, "tag").mapInArrow(
        _cut_snippets(window), "tag binary, low long, at long, high long, open boolean, bytes binary"), "snippets")

    blocks = snippets.mapInArrow(_block_rows(window, gram, block),
                                 "tag binary, low long, high long, anchor long, open boolean, bucket long, whole long")
    by_block, further = _judged(settled_table(blocks, "blocks"), row)

    spots = further.groupBy("tag", F.col("anchor").alias("low")).agg(
        F.collect_list(F.struct("low", "high", "open")).alias("spots"))
    windows = snippets.select("tag", "low", "bytes").join(spots, ["tag", "low"]).mapInArrow(
        _window_rows(window, gram), "tag binary, low long, high long, open boolean, bucket long, whole long")
    by_window, _ = _judged(settled_table(windows, "windows"), row)
    return recurring.unionByName(by_block).unionByName(by_window)


def merged_spans(spots: list[dict], window: int, most: int) -> list[tuple[int, int]]:
    """Union of the windows from low to high, as sorted (start, end)."""
    spans: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"] + window) for s in spots):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [(a, min(b, most)) for a, b in spans]


def _cut_texts(window: int):
    def cut(batches):
        for batch in batches:
            done = []
            for tag, text, spots in zip(*(batch.column(c).to_pylist() for c in ("tag", "text", "spots"))):
                spans = merged_spans(spots, window, len(text))
                ends = [0, *(b for _, b in spans)]
                kept = b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))
                done.append((tag, [{"start": a, "end": b} for a, b in spans], kept))
            spans = pa.array([d[1] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield _batch(tag=pa.array([d[0] for d in done], pa.binary()), spans=spans,
                         kept_text=pa.array([d[2] for d in done], pa.binary()),
                         kept_sha256=[hashlib.sha256(d[2]).hexdigest() for d in done])
    return cut


def _named_texts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    data = text_or_empty(text_col).cast("binary")
    return docs.select(F.unhex(F.substring(F.sha2(data, 256), 1, 32)).alias("tag"), data.alias("text"), *more)


def cut_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                block: int = BLOCK) -> DataFrame:
    """(tag, spans, kept_text, kept_sha256) of every different text that loses bytes."""
    texts = _named_texts(docs, text_col).filter(F.octet_length("text") >= window)
    spots = repeated_windows(texts, window, gram, block).groupBy("tag").agg(
        F.collect_set(F.struct("low", "high")).alias("spots"))     # copies of a text name the same spots
    once = texts.groupBy("tag").agg(F.first("text").alias("text"))
    return once.join(spots, "tag").mapInArrow(
        _cut_texts(window), "tag binary, spans array<struct<start:long,end:long>>, kept_text binary, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    Texts are their UTF-8 bytes, null counts as empty. Removed is every byte of a ``window``-byte string that
    also starts anywhere else, in the same text too; overlapping strings count, and all are judged
    on the input. Equal texts of ``window`` bytes or more are thus removed whole, each of them; shorter
    ones never change. Ids may be null or repeated and are only carried along; other columns are
    ignored. A text of any length is read in pieces. An empty table gives no rows.
    ``cut_repeats`` has the texts that remain and the spans.
    """
    lost = cut_repeats(docs, text_col, window, gram, block).select(
        "tag", "kept_sha256", F.size("spans").cast("bigint").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"))
    rows = _named_texts(docs, text_col, F.col(id_col).alias("doc_id")).select(
        "tag", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    none = F.lit(0).cast("bigint")
    return rows.join(settled_table(lost, "lost"), "tag", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


@query("op13_bucket_refinement", r"""
WITH texts AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, unnest(range(octet_length(b) - 399)) AS p FROM texts WHERE octet_length(b) >= 400),
named AS MATERIALIZED (SELECT doc_id, p, md5_number(array_slice(b, p + 1, p + 400)) AS h FROM starts),
again AS (SELECT doc_id, p FROM named SEMI JOIN (SELECT h FROM named GROUP BY h HAVING count(*) > 1) USING (h)),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
    string_agg(hex(array_slice(b, before + 1, a)), '' ORDER BY a) AS head FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(CASE WHEN c.doc_id IS NULL THEN b ELSE unhex(head || hex(array_slice(b, last + 1, octet_length(b)))) END) AS kept_sha256
FROM texts t LEFT JOIN cut c ON t.doc_id = c.doc_id
""")
def op13_bucket_refinement(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
