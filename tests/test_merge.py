import datetime as dt
import gzip
import json
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tenderlens import schemas
from tenderlens.operators import joins, merge
from tenderlens.plans.ingest import AuctionStore, NewsStore, ingest_batch
from tenderlens.sources import files, records
from tenderlens.sources.tables import PartitionedTable, RunLedger, hash_folder, load_table, save_table
from tenderlens.streaming.ingest import changed_rows, record_entries, rejected_records, stream_ingest


def record(**fields):
    base = {"cusip": "C1", "securityType": "Bill", "auctionDate": "2024-01-02T00:00:00", "totalAccepted": "100",
            "primaryDealerAccepted": "40", "highYield": "4.5"}
    return {**base, **fields}


def raw(spark, *rows):
    data = [(i, *[r.get(n) for n in schemas.API_FIELDS]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "arrival long, " + ", ".join(f"{n} string" for n in schemas.API_FIELDS))


def test_stages(spark):
    rows = [
        record(), record(interestRate="x"), record(auctionDate=""), record(auctionDate="", highYield="bad"),
        record(highYield="bad"), record(primaryDealerAccepted="bad"),
        record(primaryDealerAccepted="bad", totalAccepted="0"), record(totalAccepted=""), record(cusip=None),
        record(primaryDealerAccepted="99999"), record(securityType=None),
    ]
    got = [tuple(r) for r in merge.stage_records(raw(spark, *rows)).orderBy("arrival").select(
        "to_security", "to_auction", "to_bidder", "failed").collect()]
    assert got == [
        (True, True, True, False), (False, False, False, True), (True, False, False, False),
        (True, False, False, False), (True, False, False, True), (True, True, False, True),
        # malformed bidder text is only looked at when something was accepted
        (True, True, False, False), (True, True, False, False), (False, False, False, True),
        (True, True, False, True), (False, False, False, True)]


def test_last_record_wins_with_its_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x", 0), ("a", None, None, 2), ("b", 3, "z", 1)], "k string, n int, s string, o int")
    got = sorted(tuple(r) for r in merge.upsert(None, df, ["k"], "o").collect())
    assert got == [("a", None, None), ("b", 3, "z")]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "k string, n int")
    new = spark.createDataFrame([("b", 5, 0), ("c", 6, 1), ("c", 7, 2)], "k string, n int, o int")
    once = merge.upsert(old, new, ["k"], "o")
    twice = merge.upsert(once, new, ["k"], "o")
    rows = sorted(map(tuple, once.collect()), key=str)
    assert rows == sorted([("a", 1), ("b", 5), ("c", 7), (None, 9)], key=str)
    assert sorted(map(tuple, twice.collect()), key=str) == rows
    assert tuple(merge.upsert_stats(old, new, ["k"]).first()) == (1, 2)
    assert tuple(merge.upsert_stats(once, new, ["k"]).first()) == (0, 3)


def test_ids_continue(spark):
    day = dt.date(2024, 1, 1)
    known = spark.createDataFrame([("a", day, 7)], "cusip string, auction_date date, auction_id long")
    rows = [("a", day, 1.0, 0), ("c", day, 1.0, 1), ("b", day, 1.0, 2), ("c", day, 2.0, 3)]
    arrived = spark.createDataFrame(rows, "cusip string, auction_date date, high_yield double, arrival long")
    numbered = merge.with_auction_ids(arrived, known).collect()
    assert {r["cusip"]: r["high_yield"] for r in numbered} == {"a": 1.0, "b": 1.0, "c": 2.0}
    got = {r["cusip"]: r["auction_id"] for r in numbered}
    assert got == {"a": 7, "c": 8, "b": 9}


def test_duplicate_keys_and_conform(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", 2.0)], "phrase string, count double")
    assert [tuple(r) for r in merge.duplicate_keys(df, ["phrase"]).collect()] == [("a", 2)]
    fixed = merge.conform(df, schemas.PHRASES)
    assert fixed.schema == schemas.PHRASES and fixed.filter("count is null").count() == 1
    assert merge.conform(fixed, schemas.PHRASES).schema == schemas.PHRASES


def test_articles(spark):
    rows = [(1, "2024-01-02", True, None, 0), (1, "2024-01-03", None, True, 1), (2, "nonsense", True, True, 2), (3, None, True, True, 3)]
    df = spark.createDataFrame(rows, "article_id long, date string, is_fiscal_article boolean, has_tariff boolean, o int")
    assert [tuple(r) for r in merge.upsert_articles(None, df, "o").collect()] == [("1", dt.date(2024, 1, 3), False, True)]
    bare = merge.upsert_articles(None, df.drop("has_tariff"), "o").first()
    assert bare["has_tariff"] is False


@pytest.mark.parametrize("n_scores, want", [(2, 2), (3, 3), (5, 3)])
def test_positional_dates(spark, n_scores, want):
    days = [dt.date(2024, 1, d) for d in (9, 2, 5, 2)] + [None]
    articles = spark.createDataFrame([(d,) for d in days], "date date")
    scores = spark.createDataFrame([(i, i * 10, 1 / 3) for i in range(n_scores)], "o int, total_articles int, rate double")
    got = sorted(tuple(r) for r in merge.upsert_indices(None, scores, articles, "o").select("date", "total_articles", "rate").collect())
    dates = [dt.date(2024, 1, d) for d in (2, 5, 9)]
    assert got == [(dates[i], i * 10, Decimal("0.333333")) for i in range(want)]


def test_phrases_are_trimmed(spark):
    df = spark.createDataFrame([(" tax ", 1, 0), ("tax", 5, 1), ("cut", 2, 2)], "phrase string, count long, o int")
    assert sorted(map(tuple, merge.upsert_phrases(None, df, "o").collect())) == [("cut", 2), ("tax", 5)]


def test_append_new_compares_text(spark):
    old = spark.createDataFrame([("1", "old"), (None, "old")], "cusip string, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new"), (2, "again"), (None, "new")], "cusip long, v string").withColumn("extra", F.lit(1))
    fresh = joins.new_records(old, new)
    assert sorted(r["v"] for r in fresh.collect()) == ["again", "new"]
    assert joins.append_new(None, new).count() == 4


def test_orphans_keep_missing_keys(spark):
    child = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, cusip string")
    parent = spark.createDataFrame([("a",)], "cusip string")
    assert sorted(r["id"] for r in joins.orphans(child, parent, "cusip", ["id", "cusip"]).collect()) == [2, 3]


PAGES = "page long, securityList array<struct<cusip:string>>, totalResultsCount long"


@pytest.mark.parametrize("pages, cap, want", [
    ([(0, "ab", 9), (1, "cd", 9)], 100, "abcd"),
    ([(0, "ab", 3), (1, "cd", 3), (2, "ef", 3)], 100, "abcd"),
    ([(0, "ab", None), (1, "", None), (2, "ef", None)], 100, "ab"),
    ([(0, "ab", None), (1, None, None), (2, "ef", None)], 100, "ab"),
    ([(0, "ab", None), (1, "cd", None), (2, "ef", None)], 3, "abcd"),
])
def test_pages(spark, pages, cap, want):
    rows = [(p, None if s is None else [(c,) for c in s], t) for p, s, t in pages]
    flat = records.flatten_pages(spark.createDataFrame(rows, PAGES), cap)
    assert "".join(r["cusip"] for r in flat.orderBy("arrival").collect()) == want


def test_json_array_file(spark, tmp_path):
    (tmp_path / "cache.json").write_text('[{"cusip": "A", "highYield": "4.5", "other": 1}, {"cusip": "B"}]')
    rows = records.read_auction_json(spark, str(tmp_path)).orderBy("arrival").collect()
    assert [(r["cusip"], r["highYield"]) for r in rows] == [("A", "4.5"), ("B", None)]


@pytest.fixture
def short_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    old = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("indent", [None, 1])
def test_array_file_in_splits(spark, tmp_path, short_splits, indent):
    """Strings with braces, quotes and backslashes, nested values and long records, over many splits."""
    rng = random.Random(11)
    parts = ["{", "}", '"', "\\", "},{", "[", "a", "\u00e9", "\n", ":", ","]
    want = []
    for name in ("a.json", "b.json"):
        rows = []
        for i in range(40):
            text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 12, 150 if i == 20 else 5])))
            rows.append({"cusip": f"{name}{i}", "other": rng.choice([1, None, {"x": {"y": "}"}}, [{}, {"cusip": "no"}]]),
                         "securityTerm": text, "highYield": rng.choice([None, "4.5"])})
        (tmp_path / name).write_text(json.dumps(rows, indent=indent))
        want += [(r["cusip"], r["securityTerm"], r["highYield"]) for r in rows]
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text('{"cusip": "l1"}\n{"cusip": "l2"}\n')
    want += [("l1", None, None), ("l2", None, None)]
    read = records.read_auction_array(spark, str(tmp_path))
    assert records._pieces(spark, str(tmp_path)).select("path", "start").distinct().count() > 20
    rows = read.orderBy("arrival").collect()
    assert [(r["cusip"], r["securityTerm"], r["highYield"]) for r in rows] == want
    assert read.columns == records.read_auction_json(spark, str(tmp_path)).columns


def test_regular_array_files_are_parsed_where_they_are_read(spark, tmp_path, short_splits):
    """All pieces used to be shuffled with their text; now only those of splits that hold other than whole records."""
    rows = {f"{name}.json": [{"cusip": f"{name}{i}", "highYield": "4.5"} for i in range(60)] for name in "abc"}
    rows["b.json"][30]["securityTerm"] = 'a } and { in "quotes" '
    for name, found in rows.items():
        (tmp_path / name).write_text(json.dumps(found))
    read = records.read_auction_array(spark, str(tmp_path))
    plan = read._jdf.queryExecution().executedPlan().toString()
    at_once = plan[plan.rindex("FileScan") - 2000:]
    assert "BroadcastHashJoin" in at_once and "hashpartitioning" not in at_once
    got = read.orderBy("arrival").collect()
    assert [(r["cusip"], r["securityTerm"]) for r in got] == [
        (r["cusip"], r.get("securityTerm")) for name in sorted(rows) for r in rows[name]]


def test_faulty_array_file(spark, tmp_path, short_splits):
    """A cut file gives its whole records and a faulty one; other files lose nothing."""
    (tmp_path / "a.json").write_text(json.dumps([{"cusip": f"a{i}"} for i in range(30)])[:-9] + '"')
    (tmp_path / "b.json").write_text('[{"cusip": "b0"}, {"cusip": b1}, {"cusip": "b2"}]')
    (tmp_path / "c.json").write_text(json.dumps([{"cusip": "c" * 900}, {"cusip": "c1", "highYield": "}" * 900}]))
    rows = records.read_auction_array(spark, str(tmp_path), record_chars=950).orderBy("arrival").collect()
    assert [r["cusip"] for r in rows] == [f"a{i}" for i in range(29)] + [None, "b0", None, "b2", "c" * 900, "c1"]
    short = records.read_auction_array(spark, str(tmp_path), record_chars=500).orderBy("arrival").collect()
    assert [r["cusip"] for r in short][-2:] == ["c" * 900, None]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("phrase,count\ntax,5\ncut,many\n")
    rows = files.read_typed_csv(spark, str(tmp_path / "a.csv"), schemas.PHRASES).orderBy("arrival").collect()
    assert rows[0]["count"] == 5 and rows[1]["count"] is None and rows[1][files.CORRUPT] == "cut,many"
    assert files.read_typed_csv(spark, str(tmp_path / "none.csv"), schemas.PHRASES).count() == 0


def test_corpus_splits(spark, tmp_path):
    from tenderlens.operators.sections import extract_sections
    article = ["Full Text", *[f"line {i} of the body" for i in range(60)], "Details", "a: b", "Links"]
    (tmp_path / "dump.txt").write_text("\n".join(article * 40))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.read_corpus(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        found = extract_sections(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["number"] for r in found) == list(range(1, 41))
    assert {r["article"] for r in found} == {" ".join(article[1:61]) + " "}
    assert {r["details"] for r in found} == {"a: b\n"}


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("C1", dt.date(2024, 1, 2), 4.56789)], "cusip string, auction_date date, high_yield double")
    path = str(tmp_path / "auctions")
    save_table(rows.withColumn("y", F.year("auction_date")), path, schemas.AUCTIONS, ("y",), ("cusip",))
    got = load_table(spark, path, schemas.AUCTIONS)
    assert got.schema == schemas.AUCTIONS and got.first()["high_yield"] == Decimal("4.5679")


def files_of(folder):
    """Data files by folder of the table, with their times of writing."""
    return {d.name: {(f.name, f.stat().st_mtime_ns) for f in d.glob("*.parquet")} for d in folder.glob("part=*")}


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    rows = [(f"p{i}", i) for i in range(200)] + [(None, 1)]
    table = PartitionedTable(spark, str(tmp_path / "t"), schemas.PHRASES, ["phrase"], hash_folder("phrase", folders=16))
    assert table.read() is None and table.touched(spark.createDataFrame(rows, "phrase string, count long")) is None

    def put(batch, *new):
        return table.merge(spark.createDataFrame(new, "phrase string, count long"), batch)

    assert put(0, *rows) == {"written": 201, "inserted": 201}
    before = files_of(tmp_path / "t")
    assert len(before) == 16
    folder = spark.createDataFrame([("p7",), ("new",)], "phrase string").select(hash_folder("phrase", folders=16)).collect()
    touched = {f"part={r[0]}" for r in folder}
    for _ in range(2):      # a batch that is repeated gives the same rows and figures
        assert put(1, ("p7", 70), ("new", 5)) == {"written": 2, "inserted": 1}
        after = files_of(tmp_path / "t")
        assert {d for d in after if after[d] != before.get(d)} == touched
        assert dict(map(tuple, table.read().collect())) == {**dict(rows), "p7": 70, "new": 5}
    assert put(2, (None, 9)) == {"written": 1, "inserted": 0}
    assert dict(map(tuple, table.read().collect()))[None] == 9
    known = table.touched(spark.createDataFrame([("new", 0)], "phrase string, count long"), before=1)
    assert known.filter("phrase = 'new'").count() == 0 and known.count() > 0
    assert put(3) == {"written": 0, "inserted": 0} and table.read().count() == 202


def test_keys_without_a_folder_value_are_kept(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), schemas.INDICES, ["date"], F.year("date"))
    day = dt.date(2024, 1, 2)

    def put(batch, *rows):
        return table.merge(spark.createDataFrame(rows, "date date, total_articles int"), batch)

    assert put(0, (day, 1), (None, 2)) == {"written": 2, "inserted": 2}
    assert put(1, (None, 3)) == {"written": 1, "inserted": 0}
    assert {r["date"]: r["total_articles"] for r in table.read().collect()} == {day: 1, None: 3}


def test_scan_reads_touched_folders_only(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path), schemas.PHRASES, ["phrase"], hash_folder("phrase", folders=8))
    table.merge(spark.createDataFrame([(f"p{i}", i) for i in range(50)], "phrase string, count long"), 0)
    plan = table.touched(spark.createDataFrame([("p1", 0)], "phrase string, count long"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_ledger(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "runs"))
    assert ledger.runs().count() == 0
    ledger.record("r1", "RUNNING")
    ledger.record("r1", "SUCCESS", records_fetched=5)
    ledger.record("r2", "RUNNING")
    assert {r["run_id"]: (r["status"], r["records_fetched"]) for r in ledger.runs().collect()} == {
        "r1": ("SUCCESS", 5), "r2": ("RUNNING", None)}


def test_batch_ingest(spark, tmp_path):
    store = AuctionStore(spark, str(tmp_path))
    first = raw(spark, record(), record(cusip="C2", totalAccepted="", highYield=""), record(cusip="C3", highYield="x"))
    result = ingest_batch(store, first, 0)
    assert result == {"status": "success", "fetched": 3, "inserted": 2, "updated": 0, "errors": 1}
    # The pending auction gets its results; the first one is corrected without bidder data.
    second = raw(spark, record(cusip="C2", highYield="4.9"), record(totalAccepted="0", highYield=None))
    for _ in range(2):  # a repeated batch changes nothing
        assert ingest_batch(store, second, 1)["updated"] == 2
    auctions = {r["cusip"]: r for r in store.auctions.read().collect()}
    assert auctions["C2"]["high_yield"] == Decimal("4.9000") and auctions["C1"]["high_yield"] is None
    assert len({r["auction_id"] for r in auctions.values()}) == 2
    bidders = {r["auction_id"]: r for r in store.bidders.read().collect()}
    assert bidders[auctions["C1"]["auction_id"]]["primary_dealer_percentage"] == Decimal("40.00")
    assert len(bidders) == 2 and store.securities.read().count() == 3
    runs = store.ledger.runs().collect()
    assert {r["status"] for r in runs} == {"SUCCESS"} and {r["last_auction_date"] for r in runs} == {dt.date(2024, 1, 2)}
    # The last date is the ledger's where a batch has only older ones.
    ingest_batch(store, raw(spark, record(cusip="C9", auctionDate="2023-05-05")), 2)
    assert {r["last_auction_date"] for r in store.ledger.runs().collect()} == {dt.date(2024, 1, 2)}


def test_failed_run_is_noted(spark, tmp_path):
    store = AuctionStore(spark, str(tmp_path))
    with pytest.raises(Exception):
        ingest_batch(store, raw(spark, record()).drop("cusip"), 0)
    assert store.ledger.runs().first()["status"] == "FAILED"


def test_stream_picks_up_new_files(spark, tmp_path):
    landing, store = tmp_path / "landing", AuctionStore(spark, str(tmp_path / "store"))
    landing.mkdir()

    def land(name, *records):
        (landing / f"{name}.json").write_text(json.dumps(list(records)))

    def run():
        stream_ingest(spark, str(landing), store, str(tmp_path / "progress"), max_files=1).awaitTermination()
        runs = store.ledger.runs().orderBy("update_timestamp").collect()
        return [(r["status"], r["records_fetched"], r["records_inserted"], r["records_updated"]) for r in runs]

    def state():
        return {r["cusip"]: r["high_yield"] for r in store.auctions.read().collect()}

    land("2024-01-01", record(), record(cusip="C2", highYield=""), record(cusip="C2", highYield="4.1"))
    first = [("SUCCESS", 3, 2, 1)]
    assert run() == first and run() == first      # nothing new
    ids = {r["cusip"]: r["auction_id"] for r in store.auctions.read().collect()}
    land("2024-01-03", record(cusip="C2", highYield="4.2"), record(cusip="C3", highYield="x"), record(interestRate="x"))
    assert run()[1:] == [("SUCCESS", 3, 0, 1)]
    assert state() == {"C1": Decimal("4.5000"), "C2": Decimal("4.2000")}
    # A file that comes late does not overwrite what a later file has brought.
    land("2024-01-02", record(cusip="C2", highYield="9.9"), record(highYield="4.6"), record(cusip="C4", highYield="1"))
    assert run()[2:] == [("SUCCESS", 3, 1, 2)]
    assert state() == {"C1": Decimal("4.6000"), "C2": Decimal("4.2000"), "C4": Decimal("1.0000")}
    assert {r["cusip"]: r["auction_id"] for r in store.auctions.read().collect()}.items() >= ids.items()
    assert store.securities.read().count() == 4 and store.bidders.read().count() == 3
    rejected = rejected_records(spark, str(tmp_path / "progress"))
    assert sorted((r["batch"], r["record"]["cusip"]) for r in rejected.collect()) == [(1, "C1"), (1, "C3")]
    assert rejected_records(spark, str(tmp_path / "nowhere")) is None


def test_stream_state_needs_no_python_per_key(spark, tmp_path):
    """One Python call per key and batch used to take most of the time; keys are now combined before the shuffle."""
    (tmp_path / "a.json").write_text("{}")
    stream = spark.readStream.schema(schemas.API_RECORD).json(str(tmp_path))
    plan = changed_rows(stream)._jdf.queryExecution().logical().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


def test_stream_counts_records_of_all_files_of_a_batch(spark, tmp_path):
    landing, store = tmp_path / "landing", AuctionStore(spark, str(tmp_path / "store"))
    landing.mkdir()
    for batch, highest in enumerate(("4.1", "4.2")):
        for name in "ab":
            records = [record(highYield=highest), record(cusip=f"{name}{batch}"), record(cusip=None), record(auctionDate=None)]
            (landing / f"{batch}{name}.json").write_text(json.dumps(records))
        stream_ingest(spark, str(landing), store, str(tmp_path / "progress")).awaitTermination()
    runs = store.ledger.runs().orderBy("update_timestamp").collect()
    assert [(r["records_fetched"], r["records_inserted"], r["records_updated"]) for r in runs] == [(8, 3, 1), (8, 2, 2)]
    assert {r["cusip"]: r["high_yield"] for r in store.auctions.read().collect()}["C1"] == Decimal("4.2000")
    assert rejected_records(spark, str(tmp_path / "progress")).count() == 4


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_stream_leaves_no_shuffle_files(spark, tmp_path):
    """They used to stay on disk until the driver's garbage was collected, those of all batches together."""
    landing, store = tmp_path / "landing", AuctionStore(spark, str(tmp_path / "store"))
    landing.mkdir()
    before, settings = shuffle_files(spark), {k: v for k, v in spark.conf.getAll.items()}
    for batch in range(2):
        (landing / f"{batch}.json").write_text(json.dumps([record(cusip=f"C{i}", highYield=f"4.{batch}") for i in range(20)]))
        stream_ingest(spark, str(landing), store, str(tmp_path / "progress")).awaitTermination()
    assert store.auctions.read().count() == 20
    end = time.time() + 20
    while (kept := {f for f in shuffle_files(spark) - before if f.endswith(".data")}) and time.time() < end:
        time.sleep(0.2)     # they are removed in the background
    # Left are the caller's own: count() above and the ledger's last date of each batch.
    assert len({f.split("_")[1] for f in kept}) <= 3
    assert {k: v for k, v in spark.conf.getAll.items()} == settings


def test_state_names_the_place_of_a_failed_record_once(spark):
    records = raw(spark, record(), record(cusip=None)).drop("arrival").withColumns(
        {"path": F.lit("a.json"), "start": F.lit(0).cast("long"), "row": F.lit(7).cast("long")})
    entries = {(r["kind"], r["cusip"]): (r["path"], r["start"], r["row"]) for r in record_entries(records).collect()}
    assert entries == {("security", "C1"): ("a.json", 0, 7), ("auction", "C1"): ("a.json", 0, 7), ("bidder", "C1"): ("a.json", 0, 7),
                       ("rejected", "a.json:0:7"): (None, None, None), ("file", "a.json"): (None, None, None)}


def test_landing_files_of_the_query_are_compressed_and_short(spark, tmp_path, monkeypatch):
    """Plain text files took half of the disk; many short ones in order of arrival give the same rows."""
    import duckdb
    from tenderlens.workload import ORACLES, QUERIES, ingest
    day, tables = dt.datetime(2000, 1, 15), str(tmp_path / "sf")
    frames = {
        "customer": ([(i, f"c{i}", i % 25, 10.5 + i, "BUILDING") for i in range(5)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(i, i % 5, "O", 100.0 + i, day + dt.timedelta(days=31 * (i % 3)), "1") for i in range(90)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(i, 1, 1, n, 10.0, 50.0 + i, n / 100, 0.02, "ANR"[(i + n) % 3], "FO"[n % 2], day) for i in range(90) for n in (1, 2)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    }
    duck = duckdb.connect()
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tables}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    monkeypatch.setattr(ingest, "scratch", lambda spark: str(tmp_path / "scratch"))
    monkeypatch.setattr(ingest, "LANDED_RECORDS", 7, raising=False)
    df = QUERIES["stream_ingest"](spark, tables)
    got, wanted = df.collect(), duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['stream_ingest']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str) and len(got) > 10
    landed = sorted((tmp_path / "scratch" / "landing").glob("*/part-*"))
    assert {f.suffix for f in landed} == {".gz"}
    counts = {name: [len(gzip.open(f, "rt").readlines()) for f in landed if f.parent.name == name] for name in ("1", "2", "3", "2b")}
    assert {name: sum(n) for name, n in counts.items()} == {"1": 30, "2": 30, "3": 30, "2b": 30}
    assert max(max(n) for n in counts.values()) <= 7


def test_stream_plan_reads_no_stored_table(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    stream = spark.readStream.schema(schemas.API_RECORD).json(str(tmp_path))
    plan = changed_rows(stream)._jdf.queryExecution().logical().toString()
    assert plan.count("StreamingRelation") + plan.count("StreamingExecutionRelation") == 1 and "parquet" not in plan


def test_news_store(spark, tmp_path):
    store = NewsStore(spark, str(tmp_path))
    articles = spark.createDataFrame([("1", "2024-01-02", True, False, 0)], "article_id string, date string, is_fiscal_article boolean, has_tariff boolean, arrival long")
    scores = spark.createDataFrame([(0, 1, 0.5)], "arrival long, total_articles int, rate double")
    phrases = spark.createDataFrame([("tax", 3, 0), ("cut", 8, 1)], "phrase string, count long, arrival long")
    for batch in (0, 1):
        got = dict(map(tuple, store.load(articles, scores, phrases, batch).collect()))
    assert got == {"fiscal_articles": 1, "fiscal_policy_indices": 1, "top_phrases": 2, "top phrase: cut": 8,
                   "sample article: 1 2024-01-02 true false": 1, "sample index: 2024-01-02 1": 1}


def test_bucketed_facts_are_joined_without_a_shuffle(spark, tmp_path):
    from tenderlens.operators.joins import auction_facts
    from tenderlens.plans.facts import ALL_KEYS, FactTables
    day = dt.date(2024, 1, 1)
    known = merge.conform(spark.createDataFrame(
        [(i, None if i == 9 else f"c{i % 4}", day + dt.timedelta(days=i), float(i)) for i in range(30)],
        "auction_id long, cusip string, auction_date date, high_yield double"), schemas.AUCTIONS)
    securities = merge.conform(spark.createDataFrame([(f"c{i}", "Bill") for i in range(3)], "cusip string, security_type string"), schemas.SECURITIES)
    bidders = merge.conform(spark.createDataFrame([(i, 1.0) for i in range(0, 40, 2)], "auction_id long, fima_accepted double"), schemas.BIDDER_DETAILS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", ALL_KEYS)}
    stored = FactTables(spark, str(tmp_path), f"t{tmp_path.name.replace('-', '_')}", buckets=4)
    stored.save(known, securities, bidders)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        facts = stored.facts("2024-01-05")
        plan = facts._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        want = auction_facts(known, securities, bidders, "2024-01-05")
        assert facts.columns == want.columns
        assert sorted(map(tuple, facts.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
