"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tenderlens.llm import exact_dedup, near_dup
from tenderlens.llm.components import connected_components
from tenderlens.llm.near_dup import similar_groups


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_duplicates(odd_docs):
    rows = [(r.doc_id, plain(r.text)) for r in odd_docs.collect()]
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text].append(doc)
    got = exact_dedup.exact_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        text = next(t for d, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [d for d in groups[text] if d is not None]
        assert r.group_size == len(groups[text])
        assert r.keep_id == (min(ids) if ids else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[text] += r.kept
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_a_full_filter_changes_nothing(spark, size):
    docs = spark.range(3000).selectExpr("id doc_id", "cast(id % 2500 as string) text")
    got = exact_dedup.exact_duplicates(docs, max_filter_bytes=size)
    assert got.filter("kept").count() == 2500 and got.count() == 3000


def test_most_unique_rows_are_not_shuffled(spark):
    hashed = spark.range(20000).selectExpr("xxhash64(id) & 1152921504606846975 a", "xxhash64(id, 1) & 1152921504606846975 b")
    plane, bits, hashes = exact_dedup.build_filter(hashed.union(hashed.limit(100)), 20100)
    rows = np.array([(r.a, r.b) for r in hashed.collect()])
    flags = exact_dedup.may_repeat(plane, bits, hashes, rows[:, 0], rows[:, 1])
    assert 100 <= flags.sum() < 400


def test_drop_exact_keeps_columns(odd_docs, no_docs):
    out = exact_dedup.drop_exact_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == len({plain(r.text) for r in odd_docs.collect()})
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def brute_groups(rows, width, percent):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets[doc] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("width, percent, chunk", [(3, 90, 500), (5, 80, 7)])
def test_similar_groups(spark, width, percent, chunk):
    draw = random.Random(width)
    rows, bases = [], [[f"w{draw.randrange(400)}" for _ in range(draw.choice([4, 12, 30, 80, 150]))] for _ in range(6)]
    for i in range(160):
        words = list(draw.choice(bases)) if draw.random() < 0.8 else [f"v{draw.randrange(5000)}" for _ in range(30)]
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            words[draw.randrange(len(words))] = f"x{draw.randrange(50)}"
        rows.append((i, " ".join(words).upper() if i % 3 else "\n".join(words)))
    rows += [(200, None), (201, ""), (202, "a"), (203, "A"), (204, " b ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, width=width, percent=percent, chunk=chunk).collect()}
    assert got == brute_groups(rows, width, percent)


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    yield
    spark.conf.set(name, before)


def spread_copies(seed):
    """An original and pairs of variants; most are near their twin only, which lies in another batch."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for pair in range(90):
        edited = list(base)
        for at in draw.sample(range(150), draw.choice([1, 6, 12, 14])):
            edited[at] = f"p{pair}x{at}"
        for twin in range(2):
            words = list(edited)
            words[draw.randrange(150)] = f"t{twin}"
            rows.append((1 + pair + 90 * twin, " ".join(words)))
    return rows


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_copies_meet_across_batches(spark, small_batches, width, percent):
    rows = spread_copies(width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, width=width, percent=percent).collect()}
    assert got == brute_groups(rows, width, percent)


def test_drop_similar_across_batches(spark, small_batches):
    rows = spread_copies(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    kept = {r.doc_id for r in near_dup.drop_similar(docs, width=5, percent=80).collect()}
    assert kept == {root for _, root in brute_groups(rows, 5, 80).values()}


def test_a_long_batch_is_sketched_in_slices(monkeypatch):
    """What a task holds at once follows the slice, not the batch; no document or key is lost."""
    monkeypatch.setattr(near_dup, "_BYTES_PER_SLICE", 20_000)
    monkeypatch.setattr(near_dup, "_WORDS", 50)
    texts = [" ".join(f"w{(i * 7 + j) % 900}" for j in range(300)).encode() for i in range(60)] + [None, b"x " * 30_000]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    seen, keys = [], set()
    for out in near_dup._packed(5, 80, 3)(iter([batch])):
        for row in out.to_pylist():
            if row["kind"] == 1:
                ids = np.frombuffer(row["a"], np.int64).tolist()
                assert len(ids) == 1 or sum(len(texts[i] or b"") for i in ids) <= 20_000
                seen += ids
            else:
                keys.update(np.frombuffer(row["c"], np.uint64).tolist())
    tops, hashes = near_dup.bands(80), near_dup.WordHashes()
    sets = [near_dup.shingle_set(t, 5, hashes) for t in texts]
    assert seen == list(range(len(texts))) and len(hashes) <= 50
    assert keys == {k for s in sets if len(s) for k in near_dup.block_keys(s, 80, tops).tolist()}


def test_all_sets_of_a_block_meet(spark, small_batches):
    """Every two sets with an equal block stand in one star, whatever batches they came in."""
    rows, tops, hashes = spread_copies(1), near_dup.bands(80), near_dup.WordHashes()
    docs = spark.createDataFrame([(i, text.encode()) for i, text in rows], "doc_id long, text binary").repartition(12)
    stars, by_key = defaultdict(set), defaultdict(set)
    for r in near_dup._sketch(docs, 5, 80, 3).filter("kind = 0").collect():
        stars[r.a].add(r.a)
        stars[r.b].add(r.a)
    for _, text in rows:
        shingles = near_dup.shingle_set(text.encode(), 5, hashes)
        for key in near_dup.block_keys(shingles, 80, tops).tolist():
            by_key[key].add(near_dup.set_id(shingles))
    shared = [sets for sets in by_key.values() if len(sets) > 1]
    assert max(map(len, shared)) > 50
    assert all(set.intersection(*(stars[x] for x in sets)) for sets in shared)


def test_blocks_meet_without_the_empty_ones():
    draw = np.random.default_rng(3)
    for percent in (80, 90):
        tops = near_dup.bands(percent)
        for _ in range(400):
            size = int(draw.integers(5, 1200))
            a = np.unique(draw.integers(0, 1 << 60, size).astype(np.uint64))
            away = int(draw.integers(0, near_dup.most_different(2 * size, percent) // 2 + 1))
            b = np.unique(np.concatenate([a[away:], draw.integers(0, 1 << 60, int(draw.integers(0, away + 1))).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * len(np.union1d(a, b)) and len(a) != shared:
                assert len(np.intersect1d(near_dup.block_keys(a, percent, tops), near_dup.block_keys(b, percent, tops)))


def test_similar_groups_of_odd_rows(odd_docs, no_docs):
    got = similar_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.component_id)
    assert by_id[1] == {0} and by_id[10] == {9} and by_id[11] == {9} and by_id[None] == {None}
    assert by_id[2] == {2} and by_id[3] == {3}
    assert similar_groups(no_docs).count() == 0
    kept = near_dup.drop_similar(odd_docs)
    assert kept.columns == odd_docs.columns
    # Each group leaves one row, whatever its id is; rows without words all stay.
    texts = [r.text for r in odd_docs.select("text").collect()]
    bare = [t for t in texts if not (t or "").split()]
    groups = {" ".join(t.split()).replace("tail", "").strip() for t in texts if (t or "").split()}
    found = kept.collect()
    assert len(found) == len(bare) + len(groups)
    assert sum(r.text == "an id that comes twice" for r in found) == 1 and sum(r.text == "no id" for r in found) == 1
    assert near_dup.drop_similar(no_docs).count() == 0


def test_unrelated_texts_under_one_id_stay(spark):
    draw = random.Random(8)
    text = lambda: " ".join(draw.choice("abcdefgh") + str(draw.randrange(900)) for _ in range(60))
    first, other, third = text(), text(), text()
    rows = [(1, first), (2, first + " end"), (2, other), (None, third), (None, third + " end"), (5, third + " end end")]
    kept = near_dup.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.text[:20]) for r in kept) == sorted([(1, first[:20]), (2, other[:20]), (5, third[:20])])


def test_symmetric_difference_bound():
    draw = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(draw.integers(0, 1 << 60, 150).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.integers(0, 40):], draw.integers(0, 1 << 60, draw.integers(1, 40)).astype(np.uint64)]))
        assert near_dup.Distances([near_dup.bit_sketch(a), near_dup.bit_sketch(b)]).of(0, np.array([1]))[0] <= len(np.setxor1d(a, b))


def test_sketches_of_different_lengths():
    draw = np.random.default_rng(2)
    a = np.unique(draw.integers(0, 1 << 60, 600).astype(np.uint64))
    b = a[:500]
    short, long = near_dup.bit_sketch(b), near_dup.bit_sketch(a)
    assert len(long) == 2 * len(short)
    distances = near_dup.Distances([short, long, short])
    assert 60 < distances.of(0, np.array([1, 2]))[0] <= 100 and distances.of(0, np.array([1, 2]))[1] == 0
    assert distances.of(1, np.array([0]))[0] == distances.of(0, np.array([1]))[0]


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b} - set(got)
    assert got == {x: find(x) for x in root if x not in loops}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
