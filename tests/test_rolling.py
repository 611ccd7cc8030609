import datetime as dt
import random

import pandas as pd
import pytest

from tenderlens.operators import ordering, rolling

ORDER = ["day", "id"]


@pytest.fixture(scope="module")
def series():
    rng = random.Random(5)
    rows, start = [], dt.date(2020, 1, 1)
    for i in range(400):
        # A third of all rows share one day; group "one" has a single row.
        day = start if i % 3 == 0 else start + dt.timedelta(days=rng.randrange(60))
        kind = "one" if i == 7 else rng.choice(["Bill", "Bill", "Note"])
        value = None if rng.random() < 0.1 else round(rng.uniform(1, 4), 4)
        rows.append((i, kind, day, value))
    return rows


@pytest.fixture(scope="module")
def frames(spark, series):
    df = spark.createDataFrame(series, "id long, kind string, day date, v double")
    pdf = pd.DataFrame(series, columns=["id", "kind", "day", "v"]).sort_values(["day", "id"])
    return df, pdf


def compare(df, name, expected):
    got = {r["id"]: r[name] for r in df.collect()}
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        if pd.isna(value):
            assert got[key] is None, key
        else:
            assert got[key] == pytest.approx(value, abs=1e-9), key


@pytest.mark.parametrize("slices", [1, 8, 60])
def test_mean_per_type(frames, slices):
    df, pdf = frames
    present = pdf.dropna(subset=["v"])
    means = present.groupby("kind")["v"].transform(lambda s: s.rolling(30, min_periods=1).mean())
    compare(rolling.rolling_mean(df, "v", ORDER, ["kind"], slices=slices), "moving_avg",
            dict(zip(present["id"], means)))


@pytest.mark.parametrize("slices", [10, 500])
def test_mean_whole_market(frames, slices):
    df, pdf = frames
    present = pdf.dropna(subset=["v"])
    compare(rolling.rolling_mean(df, "v", ORDER, slices=slices), "moving_avg",
            dict(zip(present["id"], present["v"].rolling(30, min_periods=1).mean())))


@pytest.mark.parametrize("slices", [1, 33])
def test_std_keeps_gaps(frames, slices):
    df, pdf = frames
    std = pdf.groupby("kind")["v"].transform(lambda s: s.rolling(10, min_periods=5).std())
    expected = {k: x for k, x in zip(pdf["id"], std) if not pd.isna(x)}
    compare(rolling.rolling_std(df, "v", ORDER, ["kind"], rows=10, slices=slices), "volatility", expected)


@pytest.mark.parametrize("slices", [1, 13])
def test_annualized_volatility(frames, slices):
    df, pdf = frames
    present = pdf.dropna(subset=["v"]).copy()
    change = present.groupby("kind")["v"].pct_change(fill_method=None)
    vol = change.groupby(present["kind"]).transform(lambda s: s.rolling(30, min_periods=10).std()) * 252 ** 0.5
    got = rolling.annualized_volatility(df, "v", ORDER, ["kind"], slices=slices)
    compare(got, "volatility", dict(zip(present["id"], vol)))
    compare(got, "btc_returns", dict(zip(present["id"], change)))


def test_change_after_zero_is_missing(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), 0.0), (2, dt.date(2020, 1, 2), 2.0),
                                (3, dt.date(2020, 1, 3), 3.0)], "id long, day date, v double")
    got = {r["id"]: r["change"] for r in rolling.pct_change(df, "v", ORDER).collect()}
    assert got == {1: None, 2: None, 3: 0.5}


def test_daily_windows(spark):
    days = [(dt.date(2020, 1, 1 + i), None if i == 2 else float(i)) for i in range(8)]
    df = spark.createDataFrame(days, "date date, v double")
    pdf = pd.DataFrame(days, columns=["date", "v"])
    smooth = [r["v_smooth"] for r in rolling.smooth(df, ["v", "absent"], rows=3).orderBy("date").collect()]
    assert smooth == pytest.approx(pdf["v"].rolling(3, min_periods=1).mean().tolist())
    strict = [r["v_avg"] for r in rolling.rolling_mean_strict(df, ["v"], rows=3).orderBy("date").collect()]
    assert [x is None for x in strict] == pdf["v"].rolling(3).mean().isna().tolist()
    assert rolling.smooth(df, ["v"], rows=None).columns == ["date", "v"]


def test_positions_and_running_totals(frames):
    df, pdf = frames
    got = {r["id"]: r["p"] for r in ordering.with_position(df, ORDER, "p").collect()}
    assert got == {k: i for i, k in enumerate(pdf["id"])}
    totals = {r["id"]: r["t"] for r in ordering.running_total(df, ORDER, "id", "t").collect()}
    assert totals == dict(zip(pdf["id"], pdf["id"].cumsum() - pdf["id"]))


@pytest.mark.parametrize("slices", [1, 7, 300])
def test_halo_holds_the_rows_before_each_slice(frames, slices):
    df, pdf = frames
    place = {k: i for i, k in enumerate(pdf["id"])}
    found = {}
    for r in ordering.with_halo(df, ORDER, 5, slices).collect():
        found.setdefault(r["_slice"], ([], []))[r["_halo"]].append(place[r["id"]])
    assert sorted(p for own, _ in found.values() for p in own) == list(range(len(pdf)))
    for own, lent in found.values():
        first = min(own)
        assert sorted(own) == list(range(first, first + len(own)))
        assert sorted(lent) == list(range(max(first - 5, 0), first))
    # The day with a third of all rows does not fill one slice.
    assert max(len(own) for own, _ in found.values()) < 3 * len(pdf) / slices + 1


def test_halo_of_nulls_and_of_no_rows(spark):
    rows = [(i, None if i % 3 else dt.date(2020, 1, i), float(i)) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "id long, day date, v double")
    placed = sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.date.min, r[0]))
    means = pd.Series([r[2] for r in placed]).rolling(4, min_periods=1).mean()
    compare(rolling.rolling_mean(df, "v", ORDER, rows=4, slices=6), "moving_avg",
            dict(zip([r[0] for r in placed], means)))
    assert rolling.rolling_mean(df.limit(0), "v", ORDER, rows=4).collect() == []


def test_rolling_window_shuffles_rows_once_and_writes_none(frames):
    df, _ = frames
    mean = rolling.rolling_mean(df, "v", ORDER, ["kind"])
    mean.collect()
    plan = mean._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert "rangepartitioning" not in plan
    # The rows, the rows they lend on the way to one task, and those on the way to their slices.
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 2 and "ReusedExchange" in plan
    assert plan.count("Exchange SinglePartition") == 1
