"""Mixing, shards, revisits, the pipeline, and all queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenderlens import llm
from tenderlens.llm import mixing, revisits, token_shards

TABLES = ("documents", "pages", "labels", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_against_sql(spark, sf, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = llm.QUERIES[name](spark, sf)
    relation = connection.sql(llm.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    rows = lambda data, names: sorted((tuple(r[names.index(c)] for c in order) for r in data), key=str)
    assert rows(df.collect(), df.columns) == rows(relation.fetchall(), relation.columns)


def test_mixing_meets_targets(spark, odd_docs, no_docs):
    docs = spark.range(4000).selectExpr(
        "id doc_id", "case when id % 3 = 0 then 'hot' when id % 40 = 1 then null else concat('s', id % 5) end source",
        "repeat('w ', cast(1 + (id * 37) % 300 as int)) text")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 4000 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    taken, target = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = (r.target, r.source_size)
    assert all(abs(taken[s] - t) < 0.01 * t + 1 and t <= 2 * size for s, (t, size) in target.items())
    assert abs(sum(t for t, _ in target.values()) - 1.5 * sum(s for _, s in target.values())) < 1
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix_sources(odd_docs).count() == odd_docs.count() and mixing.mix_sources(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.filter("length(trim(coalesce(text, ''))) = 0").count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 1000, 4097])
def test_slots_are_a_permutation(size):
    assert sorted(token_shards.slots(np.arange(size), size, "k").tolist()) == list(range(size))


def test_cached_tokens_equal_whole_tokens():
    tokens = token_shards.Tokens(token_shards.load_ranks())
    for text in ("", " ", "a  b", "a \n b", "x\n y", "don't stop", " lead", "trail ", "tab\tx y\n\nz 12 ab!? é 漢", "a  b"):
        assert tokens.text(text) == tokens.merged(text)


def test_shards_hold_every_token_once(spark, odd_docs, no_docs, tmp_path):
    docs = odd_docs.select("text").repartition(4)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    tokens, end = token_shards.Tokens(token_shards.load_ranks()), 50256
    length = 64
    parts = docs.select(F.spark_partition_id().alias("p"), "text").collect()
    stream = np.concatenate([np.append(np.frombuffer(tokens.text(r.text or ""), np.uint16), np.uint16(end)) for r in parts])
    size = -(-len(stream) // length)
    stream = np.append(stream, np.full(size * length - len(stream), end, np.uint16)).reshape(size, length)
    shards = token_shards.token_shards(docs, length=length, per_shard=100)
    token_shards.save_shards(shards, str(tmp_path / "shards"))
    slot = token_shards.slots(np.arange(size), size, "training")
    got = {r.slot: bytes(r.tokens) for r in token_shards.read_slots(spark, str(tmp_path / "shards"), 0, size).collect()}
    assert got == {int(s): row.tobytes() for s, row in zip(slot, stream)}
    some = token_shards.read_slots(spark, str(tmp_path / "shards"), 95, 130)
    assert sorted(r.slot for r in some.collect()) == list(range(95, min(130, size)))
    assert token_shards.token_shards(no_docs).count() == 0


def test_canonical_url(spark):
    cases = {"HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2",
             "https://example.com/a?a=1&b=2": "example.com/a?a=1&b=2", "https://u:p@example.com/": "example.com",
             "example.com?ref": "example.com", "": None, None: None}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: r.key for r in df.select("url", revisits.canonical_url(F.col("url")).alias("key")).collect()}
    assert got == cases


def test_revisits_against_a_loop(spark):
    rows = []
    for i in range(400):
        kind = "response" if i % 3 == 0 else "revisit"
        url = f"http://h/{'hot' if i % 2 else i % 7}"
        headers = None if i % 13 == 0 else {"etag": f"e{i % 2}", "date": str(i), "content-type": f"t{i}"}
        rows.append((i, url if i % 50 else None, None if i % 41 == 0 else (i * 7919) % 90, kind, headers, f"p{i}", "x"))
    rows.append(rows[10])
    records = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, "
                                          "payload_digest string, full string").repartition(3)
    want = []
    for i, url, at, kind, headers, _, _ in rows:
        if kind != "revisit":
            continue
        old = [r for r in rows if r[3] == "response" and url and r[1] == url and at is not None and r[2] is not None and r[2] < at]
        last = max(old, key=lambda r: (r[2], r[0])) if old else None
        same = last and headers and last[4] and headers["etag"] == last[4]["etag"]
        outcome = "resolved" if same else "conflict" if last else "orphan"
        merged = {**last[4], "date": headers["date"], "etag": headers["etag"]} if same else headers or {}
        want.append((i, last and last[0], outcome, sorted(merged.items()), last[5] if same else None))
    got = [(r.record_id, r.response_id, r.outcome, sorted(r.headers.items()), r.payload_digest)
           for r in revisits.resolve_revisits(records).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert revisits.resolve_revisits(records.filter("false")).count() == 0


def test_pipeline_stages(spark, sf, odd_docs, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "encoding":
            assert docs.columns == columns
        if name == "exact_dedup":
            texts = [" ".join(r.text.split()) for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    assert docs.filter("NOT round_trip").count() == 0


def test_pipeline_of_odd_rows(spark, sf, odd_docs, no_docs, tmp_path):
    for number, docs in enumerate((odd_docs, no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).write.parquet(str(tmp_path / f"{number}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{number}-{name}"))


@pytest.mark.parametrize("stored, asked, outcome", [
    ('"v1"', 'W/"v1"', "resolved"), ('W/"v1"', '"v1"', "resolved"), ('W/"v1"', ' W/"v1" ', "resolved"),
    ('W/"v1"', 'W/"v2"', "conflict"), ('"W/v1"', '"v1"', "conflict"), (None, 'W/"v1"', "conflict")])
def test_weak_validators(spark, stored, asked, outcome):
    rows = [(1, "http://a.b/c", 1, "response", {"etag": stored} if stored else {}, "d"),
            (2, "http://a.b/c", 2, "revisit", {"etag": asked}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, payload_digest string")
    assert revisits.resolve_revisits(df).first().outcome == outcome
