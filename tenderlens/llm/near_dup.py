"""N-gram Jaccard join by parity sketches.

A document's word shingles are hashed and XORed into the bits of a sketch. Shingles that two documents
share cancel out, so the Hamming distance of two sketches is at most the size of the symmetric
difference. Documents that reach the similarity differ in at most d shingles, d following from their
sizes; with more than d blocks in the sketch, some blocks must be equal. Per size band:

1. every distinct set emits the fingerprints of its blocks (a block is the parity of the shingles that
   fall in it; its fingerprint XORs their 64-bit hashes). A document emits under its own band and the
   next, because a partner may be that much larger. A few blocks more than needed are used, so that a
   document nearly always fills more blocks than it can differ in and its empty blocks, which all
   documents would share, can be left out;
2. all sets with an equal block, from whatever batch or task, meet at the first of them all, once however
   many blocks they share. There the dense sketches rule out, by Hamming distance, pairs that only have a
   passage in common. What hangs together by the others is a family; links exist only within families;
3. in each family pairs are verified on the sets.

In steps 2 and 3 pairs already connected are passed over, so a group of near copies costs a row each, not
a pair each. Large groups are cut into pairs of chunks, which different tasks take.

Equal sets are merged before step 2. Shingles and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.components import connected_components
from tenderlens.llm.registry import groups_for, query, settled_table, table
from tenderlens.llm.suffix_dedup import _pieces
from tenderlens.session import materialise

CHUNK = 500                     # sets of a family verified at once
_KEYS_PER_GROUP = 500_000
_BYTES_PER_GROUP = 16 << 20
_BYTES_PER_SLICE = 8 << 20      # of text sketched at once, however long a batch is
_WORDS = 250_000
_LEAST_BITS = 1024


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all when it holds ``_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Scramble 64-bit numbers; another salt gives an independent looking result."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    words = (text or b"").lower().split()  # for bytes, exactly A-Z and the six white-space characters
    if not words:
        return np.empty(0, np.uint64)
    marks = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width_here = min(width, len(words))
    rolled = np.full(len(words) - width_here + 1, width_here, np.uint64)
    for at in range(width_here):
        rolled = mixed(rolled ^ marks[at:len(words) - width_here + 1 + at], at + 1)
    return np.unique(rolled)


def set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def most_different(total: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return (100 - percent) * total // (100 + percent)


def bands(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """Largest size of each band; linked sets lie in one band or in neighbours."""
    out, low = [], 1
    while low <= largest:
        high = max(low, low * 100 // percent)
        out.append(high)
        low = high + 1
    return np.array(out, np.int64)


def block_keys(shingles: np.ndarray, percent: int, tops: np.ndarray) -> np.ndarray:
    """Fingerprints of the sketch blocks under the document's own band and the next."""
    band = int(np.searchsorted(tops, len(shingles)))
    keys = []
    for scheme in (band, band + 1):
        top = int(tops[scheme])
        differ = most_different(2 * top, percent)
        if not differ:
            continue  # only equal sets link
        blocks = differ + 2 + differ // 32
        block = (mixed(shingles, 101 + scheme) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        filled, starts = np.unique(block[order], return_index=True)
        parity = np.bitwise_xor.reduceat(mixed(shingles, 7)[order], starts)
        # With more filled blocks than differences to any partner, one that is filled must be equal.
        if len(filled) <= most_different(len(shingles) + min(top, len(shingles) * 100 // percent), percent):
            every = np.zeros(blocks, np.uint64)
            every[filled] = parity
            filled, parity = np.arange(blocks), every
        keys.append(mixed(parity ^ mixed(filled.astype(np.uint64), 1000 + scheme), 3))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _stars(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges from the first set of every key to each other set of that key."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    first = np.flatnonzero(_changes(keys))
    leader = np.repeat(sets[first], np.diff(first, append=len(keys)))
    leader, sets = leader[leader != sets], sets[leader != sets]
    order = np.lexsort((sets, leader))
    leader, sets = leader[order], sets[order]
    once = _changes(leader) | _changes(sets)
    return leader[once], sets[once]


def _changes(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


_PACKED = ("a", "b", "c", "d")


def _packed(width: int, percent: int, groups: int):
    """Packed rows of (part, kind, a, b, c, d) for every slice of a batch: its documents, and its keys by their group."""
    fields = pa.schema([("part", pa.int64()), ("kind", pa.int8()), *[(name, pa.binary()) for name in _PACKED]])

    def rows(part, kind, *arrays):
        return {"part": int(part), "kind": kind, **dict.fromkeys(_PACKED), **dict(zip(_PACKED, [x.tobytes() for x in arrays]))}

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tops = WordHashes(), bands(percent)
        for part in (part for batch in batches for part in _pieces(batch, "text", _BYTES_PER_SLICE)):
            yield pa.RecordBatch.from_pylist(list(packed(part, hashes, tops)), schema=fields)

    def packed(batch: pa.RecordBatch, hashes: WordHashes, tops: np.ndarray) -> Iterator[dict]:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, sets, keys, owners, dense, done = [], [], [], [], [], set()
        for text in batch.column(1):
            shingles = shingle_set(text.as_py(), width, hashes)
            sizes.append(len(shingles))
            sets.append(set_id(shingles))
            dense.append(bit_sketch(shingles))
            if len(shingles) and sets[-1] not in done:
                done.add(sets[-1])
                own = block_keys(shingles, percent, tops)
                keys.append(own)
                owners.append(np.full(len(own), sets[-1], np.int64))
        sets = np.array(sets, np.int64)
        place = int(mixed(sets[:1].astype(np.uint64), 1)[0] % np.uint64(groups))
        yield rows(-1 - place, 1, ids, np.array(sizes, np.int64), sets, np.concatenate(dense))
        if keys:
            # Every pair goes to its key's group: which set comes first is known only there.
            key, owner = np.concatenate(keys), np.concatenate(owners)
            part = (key % np.uint64(groups)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for p, own in zip(*_runs(part[order], order)):
                own = own[np.argsort(owner[own], kind="stable")]
                held, times = np.unique(owner[own], return_counts=True)
                yield rows(p, 2, held, times.astype(np.uint32), key[own])

    return sketch


def _sketch(docs: DataFrame, width: int, percent: int, groups: int) -> DataFrame:
    """(kind, a, b, c, sketch): kind 1 is a document (id, size, set) with its dense sketch, kind 0 an edge
    between two sets with an equal block (set, set, 0)."""
    def match(frame: pd.DataFrame) -> pd.DataFrame:
        out, keys, sets = [], [], []
        for kind, a, b, c, d in zip(*(frame[name] for name in ("kind", *_PACKED))):
            a = np.frombuffer(a, np.int64)
            if kind == 2:
                sets.append(np.repeat(a, np.frombuffer(b, np.uint32)))
                keys.append(np.frombuffer(c, np.uint64))
                continue
            b = np.frombuffer(b, np.int64)
            ends = np.cumsum([sketch_bits(n) // 8 for n in b.tolist()]).tolist()
            sketches = [d[start:end] for start, end in zip([0, *ends], ends)]
            out.append(pd.DataFrame({"kind": kind, "a": a, "b": b, "c": np.frombuffer(c, np.int64), "sketch": sketches}))
        if keys:
            left, right = _stars(np.concatenate(keys), np.concatenate(sets))
            out.append(pd.DataFrame({"kind": 0, "a": left, "b": right, "c": 0, "sketch": None}))
        return pd.concat(out).astype({"kind": "int8"})

    packed = docs.mapInArrow(_packed(width, percent, groups), "part long, kind byte, a binary, b binary, c binary, d binary")
    return packed.groupBy("part").applyInPandas(match, "kind byte, a long, b long, c long, sketch binary")


def _runs(sorted_keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1))
    return sorted_keys[starts], np.split(order, starts[1:])


def sketch_bits(size: int) -> int:
    """Bits of a dense sketch: a power of two, twice the size of the set or more."""
    return max(_LEAST_BITS, 1 << max(0, 2 * size - 1).bit_length())


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """Dense parity sketch; XORing its halves gives the sketch of half as many bits."""
    bits = sketch_bits(len(shingles))
    at = (mixed(shingles, 13) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


class Distances:
    """Hamming distances of sketches of different lengths, compared at the shorter length."""

    def __init__(self, sketches: list[np.ndarray]):
        self.words = np.array([len(s) for s in sketches], np.int64)
        self.at: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        for words in np.unique(self.words).tolist():
            # Linked sets differ by less than a factor of two, so no sketch is folded more than once.
            members = np.flatnonzero((self.words == words) | (self.words == 2 * words))
            place = np.full(len(sketches), -1, np.int64)
            place[members] = np.arange(len(members))
            self.at[words] = place
            self.rows[words] = np.stack([
                s if len(s) == words else s[:words] ^ s[words:] for s in (sketches[m] for m in members)])

    def of(self, one: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), np.int64)
        shorter = np.minimum(self.words[others], self.words[one])
        for words in np.unique(shorter).tolist():
            here = shorter == words
            place, rows = self.at[words], self.rows[words]
            out[here] = np.bitwise_count(rows[place[others[here]]] ^ rows[place[one]]).sum(axis=1)
        return out


def links_within(ids: np.ndarray, sides: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], percent: int,
                 sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a chunk (all on side 0) or of a pair of chunks.

    Without ``sets`` every pair within the Hamming distance counts as linked. Of a pair of chunks only links
    across are looked for; the chunks themselves are units of their own.
    """
    group, out, distances = np.arange(len(ids)), [], Distances(sketches)
    across = bool(sides.any())
    for i in range(len(ids)):
        if across and sides[i]:
            continue
        rest = sides.astype(bool) if across else np.arange(len(ids)) > i
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        at = np.flatnonzero(rest & (group != group[i]) & (100 * small >= percent * large))
        if not len(at):
            continue
        at = at[distances.of(i, at) <= (100 - percent) * (sizes[at] + sizes[i]) // (100 + percent)]
        for j in at:
            if group[j] == group[i]:
                continue
            if sets is not None:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared < percent * (sizes[i] + sizes[j] - shared):
                    continue
            out.append((int(ids[i]), int(ids[j])))
            group[group == group[j]] = group[i]
    return out


def _linked(members: DataFrame, data: str, units: float, percent: int) -> DataFrame:
    """Edges (a, b) within each family of ``members`` (set, family, chunks, n, ``data``).

    ``data`` is ``sketch`` or ``shingles``. Every pair of a family's chunks is a unit; units are dealt to so many
    groups that each has about as many bytes.
    """
    exact = data == "shingles"

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in frame.groupby(["family", "i", "j"], sort=False):
            unit = unit.drop_duplicates("set").sort_values("set")
            sets = [np.frombuffer(s, np.uint64) for s in unit[data]]
            out += links_within(
                unit["set"].to_numpy(), (unit["own"] != unit["i"]).to_numpy(), unit["n"].to_numpy(),
                [bit_sketch(s) if exact else s for s in sets], percent, sets if exact else None)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    placed = members.withColumn("own", F.pmod(F.xxhash64("set"), F.col("chunks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("set", "family", "own", "n", data,
                           F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    placed = placed.withColumn("g", F.pmod(F.xxhash64("family", "i", "j"), F.lit(groups_for(units, _BYTES_PER_GROUP))))
    return placed.groupBy("g").applyInPandas(link, "a long, b long")


def _with_chunks(members: DataFrame, chunk: int) -> DataFrame:
    """Add ``chunks``, the number of chunks of each member's family."""
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("bigint").alias("chunks"))
    return members.join(sizes, "family")


def _families(edges: DataFrame, sketches: DataFrame, percent: int, chunk: int) -> DataFrame:
    """(set, family) of sets that hang together by pairs within the Hamming distance."""
    star = edges.filter("a <> b").distinct()
    meeting = star.select(F.col("a").alias("family"), F.col("b").alias("set")).unionByName(
        star.select(F.col("a").alias("family"), F.col("a").alias("set")).distinct())
    meeting = materialise(_with_chunks(meeting, chunk))
    usual = sketches.agg(F.avg(F.length("sketch"))).first()[0] or 0
    units = (meeting.agg(F.sum("chunks")).first()[0] or 0) * (usual + 64)
    near = _linked(meeting.join(sketches, "set"), "sketch", units, percent)
    roots = connected_components(near)
    return roots.select(F.col("node").alias("set"), F.col("root").alias("family"))


def _verified(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between sets of one family that reach the similarity."""
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(text.as_py(), width, hashes) for text in batch.column("text")]
            # An id may carry several texts.
            right = [set_id(s) == wanted for s, wanted in zip(found, batch.column("set").to_pylist())]
            out = batch.drop_columns(["text"]).append_column("shingles", pa.array([s.tobytes() for s in found], pa.binary()))
            yield out.filter(pa.array(right, pa.bool_()))

    chosen = docs.join(members, "doc_id").select("text", "set", "family", "chunks", "n")
    sets = chosen.mapInArrow(shingles, "set long, family long, chunks long, n long, shingles binary")
    units = members.agg(F.sum(F.col("n") * 8 * F.col("chunks"))).first()[0] or 0
    return _linked(sets, "shingles", units, percent)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                   percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two documents link when their sets of ``width``-word shingles (words split at white space, A-Z in
    lower case) reach a Jaccard similarity of ``percent``. A text with fewer words is one shingle; null
    and empty texts have none and link with nothing. Rows that repeat an id are one node with several
    texts. A null id is no document to point at: its component is null and it links nothing. An empty
    table gives no rows. Only the id and the text are read.
    """
    if not 50 < percent <= 100:
        raise ValueError("the similarity must be above 50 percent")
    every = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    known = every.filter("doc_id IS NOT NULL")
    letters = known.agg(F.sum(F.length("text"))).first()[0] or 0
    emitted = letters / 6 * 4 * (100 - percent) / (100 + percent)
    found = materialise(_sketch(known, width, percent, groups_for(emitted, _KEYS_PER_GROUP)))
    nodes = found.filter("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("set"))
    sketches = found.filter("kind = 1 AND b > 0").select(F.col("c").alias("set"), F.col("b").alias("n"), "sketch").dropDuplicates(["set"])
    families = _families(found.filter("kind = 0").select("a", "b"), sketches, percent, chunk)
    first = nodes.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))
    members = materialise(_with_chunks(families, chunk).join(first, "set"))
    links = _verified(known, members, width, percent)
    # A document with several texts ties their sets together, and so does a link.
    ties = nodes.filter("n_shingles > 0").groupBy("doc_id").agg(
        F.min("set").alias("a"), F.max("set").alias("b")).filter("a <> b")
    several = nodes.filter("n_shingles > 0").join(ties.select("doc_id", "a"), "doc_id").select("a", F.col("set").alias("b"))
    roots = connected_components(links.unionByName(several))
    rooted = first.join(roots, first["set"] == roots["node"]).select("set", "root", "doc_id")
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("lowest"))
    merged = materialise(rooted.join(lowest, "root").select("set", "lowest"))
    starts = first.join(merged, "set", "left").select("set", F.coalesce("lowest", "doc_id").alias("lowest"))
    out = nodes.filter("n_shingles > 0").join(starts, "set").select("doc_id", "n_shingles", F.col("lowest").alias("component_id"))
    empty = nodes.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).unionByName(_without_id(every, width))


def _without_id(every: DataFrame, width: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes = [len(shingle_set(text.as_py(), width, hashes)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), batch.column(0)], ["doc_id", "n_shingles", "component_id"])

    return every.filter("doc_id IS NULL").mapInArrow(count, "doc_id long, n_shingles long, component_id long")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                 percent: int = 80) -> DataFrame:
    """One row of each group of similar texts, and all rows without words; columns as given.

    Rows are told apart by a tag of their own, so repeated and missing ids are documents like any others: of a group the
    row with the smallest id stays, null ids last, and one of several with that id.
    """
    # The tag is settled with the row: every later step must see the same one.
    tagged = settled_table(docs.select(
        F.monotonically_increasing_id().alias("tag"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "tagged")
    groups = similar_groups(tagged.select("tag", F.col("row")[text_col].alias("text")), "tag", "text", width, percent)
    linked = materialise(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("tag"), F.col("component_id").alias("group")))
    linked = linked.unionByName(linked.select(F.col("group").alias("tag"), "group").distinct())
    ids = tagged.select("tag", F.col("row")[id_col].alias("id"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")
    named = linked.join(ids, "tag").select("tag", "group", order.alias("order"))
    first = named.groupBy("group").agg(F.min("order").alias("first"))
    gone = named.join(first, "group").filter(F.col("tag") != F.col("first.tag")).select("tag")
    return tagged.join(gone, "tag", "left_anti").select("row.*")


_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(0, len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')) END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 90 * (p.n + q.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON r.y = w.x),
lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.x = d.doc_id
"""


@query("op8_parity_join", _SQL)
def op8_parity_join(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"), width=3, percent=90)
