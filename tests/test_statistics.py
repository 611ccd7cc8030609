import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tenderlens.operators import aggregates as agg
from tenderlens.operators import correlation as corr
from tenderlens.operators import filters as flt
from tenderlens.operators import policy_index as idx
from tenderlens.operators import ranking

COLUMNS = ["a", "b", "c", "flat", "empty"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        kind = "big" if i < 31 else "mid" if i < 42 else "small"
        a = None if i % 5 == 0 else rng.gauss(0, 1)
        b = None if i % 7 == 0 else rng.gauss(3, 2)
        rows.append((i, kind, a, b, rng.random(), 2.5, None))
    schema = "id long, kind string, a double, b double, c double, flat double, empty double"
    return spark.createDataFrame(rows, schema), pd.DataFrame(
        rows, columns=["id", "kind", *COLUMNS]).astype({c: float for c in COLUMNS})


def long_matrix(df, *keys):
    return {tuple(r[k] for k in (*keys, "col_a", "col_b")): r["r"] for r in df.collect()}


def same(got, want):
    assert (got is None) == bool(pd.isna(want))
    if got is not None:
        assert got == pytest.approx(want, abs=1e-9)


def test_pairwise_matrix(wide):
    df, pdf = wide
    got = long_matrix(corr.corr_matrix(df, COLUMNS))
    want = pdf[COLUMNS].corr()
    assert len(got) == 25
    for (a, b), r in got.items():
        same(r, want.loc[a, b])
        assert got[b, a] == r
    assert got["a", "a"] == pytest.approx(1.0) and got["flat", "a"] is None


def test_group_sizes(wide):
    df, pdf = wide
    got = long_matrix(corr.corr_matrix(df, ["a", "b"], ["kind"], 31), "kind")
    assert {k[0] for k in got} == {"big"}
    same(got["big", "a", "b"], pdf[pdf.kind == "big"][["a", "b"]].corr().iloc[0, 1])


def test_listwise_matrix(wide):
    df, pdf = wide
    got = long_matrix(corr.corr_matrix_listwise(df, ["a", "b", "c"], ["kind"], 8), "kind")
    for kind, part in pdf.groupby("kind"):
        complete = part[["a", "b", "c"]].dropna()
        if len(complete) < 8:
            assert (kind, "a", "b") not in got
        else:
            same(got[kind, "a", "c"], complete.corr().loc["a", "c"])


def test_large_offsets_do_no_harm(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    x[:, 1] += x[:, 0]
    data = pd.DataFrame(1e6 + x, columns=["a", "b", "c"])
    data.loc[::7, "b"] = np.nan
    data["kind"] = ["k", None, "l"] * 1000
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), "a double, b double, c double, kind string").repartition(5)
    got = {(r["kind"], r["col_a"], r["col_b"]): r for r in corr.corr_matrix(df, ["a", "b", "c"], ["kind"]).collect()}
    assert len(got) == 27
    for kind, part in data.groupby("kind", dropna=False):
        want = (part[["a", "b", "c"]] - 1e6).corr()
        for a in "abc":
            for b in "abc":
                row = got[None if pd.isna(kind) else kind, a, b]
                assert row["r"] == pytest.approx(want.loc[a, b], abs=1e-9)
                assert row["n_obs"] == part[list({a, b})].dropna().shape[0]


def test_constant_where_both_are_present(spark):
    rows = [(0.1 * 3, float(i), "x") for i in range(40)] + [(float(i), None, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, kind string").repartition(6)
    got = {(r["col_a"], r["col_b"]): (r["r"], r["n_obs"]) for r in corr.corr_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] == got["b", "a"] == (None, 40) and got["a", "a"][1] == 80


def test_no_row_is_expanded(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", *[f"double(id) AS c{i}" for i in range(8)])
    plan = corr.corr_matrix(df, [f"c{i}" for i in range(8)], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Generate" not in plan[plan.index("MapInPandas"):]


@pytest.mark.parametrize("n, kept", [(9, 0), (10, 1), (11, 1)])
def test_pairs_need_ten_observations(spark, n, kept):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(n)] + [(None, 1.0)] * 5, "x double, y double")
    rows = corr.corr_pairs(df, ["x"], ["y"]).collect()
    assert len(rows) == kept
    assert len(corr.ols_trendline(df, "x", "y").collect()) == kept
    if kept:
        assert rows[0]["n_obs"] == n and rows[0]["strength"] == "Strong" and rows[0]["direction"] == "Positive"


def test_constant_x_has_no_line(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(12)], "x double, y double")
    row = corr.ols_trendline(df, "x", "y").first()
    assert row["slope"] is None and row["n_obs"] == 12


def test_policy_figures(spark):
    rows = [(float(i), float(i % 3), float(-i), float(i % 2), float(i) if i < 10 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "fiscal_policy_index double, tariff_fiscal_index double, "
                                     "bid_to_cover_ratio double, avg_high_yield double, fima_share double")
    row = corr.policy_correlations(df).first()
    assert row["index_btc"] == pytest.approx(-1) and row["index_fima"] is None


def test_anomalies(spark):
    rows = [(i, "a", 1.0 + (i % 2) * 0.1) for i in range(40)] + [(90, "a", 9.0), (91, "a", None)]
    rows += [(100, "flat", 2.0), (101, "flat", 2.0), (200, "single", 7.0)]
    df = spark.createDataFrame(rows, "auction_id long, security_type string, bid_to_cover_ratio double")
    got = corr.detect_anomalies(df).collect()
    assert [r["auction_id"] for r in got] == [90] and got[0]["z_score"] > 3


def test_anomaly_limit_is_strict(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 2.0)], "auction_id long, security_type string, bid_to_cover_ratio double")
    z = abs((0 - 1) / 2 ** 0.5)
    assert corr.detect_anomalies(df, threshold=z).count() == 0


def test_stress_index(spark):
    start = dt.date(2024, 1, 1)
    rows = []
    for week in range(6):
        for n in range(1 if week == 3 else 3):
            rows.append((week * 10 + n, start + dt.timedelta(days=7 * week + n), 2.0 + 0.1 * week + 0.05 * n * week, 4.0 - 0.1 * week))
    df = spark.createDataFrame(rows, "auction_id long, auction_date date, bid_to_cover_ratio double, high_yield double")
    weekly = agg.weekly_rollup(df, "2024-03-01")
    pdf = weekly.toPandas().sort_values("week")
    z = lambda c: (pdf[c] - pdf[c].mean()) / pdf[c].std()
    want = ((-z("avg_btc") + z("avg_yield") + z("std_btc")) / 3).tolist()
    got = [r["stress_index"] for r in corr.market_stress_index(weekly).orderBy("week").collect()]
    assert got[3] is None
    for g, w in zip(got, want):
        same(g, w)


def test_index_means_100(spark):
    day = dt.date(2024, 5, 1)
    rows = [(str(i), day + dt.timedelta(days=i % 4), i % 4 > 0, i % 8 == 1) for i in range(24)] + [("x", None, True, True)]
    daily = idx.daily_article_counts(spark.createDataFrame(
        rows, "article_id string, date date, is_fiscal_article boolean, has_tariff boolean"))
    got = idx.normalized_index(daily).toPandas()
    assert len(got) == 4 and got["fiscal_policy_index"].mean() == pytest.approx(100)
    assert got["tariff_fiscal_index"].mean() == pytest.approx(100)


def test_index_without_tariff_articles(spark):
    rows = [("1", dt.date(2024, 5, 1), True, False), ("2", dt.date(2024, 5, 2), False, False)]
    index = idx.normalized_index(idx.daily_article_counts(spark.createDataFrame(
        rows, "article_id string, date date, is_fiscal_article boolean, has_tariff boolean"))).orderBy("date").collect()
    assert [r["tariff_fiscal_index"] for r in index] == [None, None]
    assert [r["fiscal_policy_index"] for r in index] == [200.0, 0.0]


def test_tariff_only_day_goes_negative(spark):
    rows = [("1", dt.date(2024, 5, 1), False, True), ("2", dt.date(2024, 5, 2), True, False)]
    daily = idx.daily_article_counts(spark.createDataFrame(
        rows, "article_id string, date date, is_fiscal_article boolean, has_tariff boolean"))
    assert {r["date"].day: r["non_tariff_fiscal_articles"] for r in daily.collect()} == {1: -1, 2: 1}


def test_latest_and_edges(spark):
    day = dt.date(2024, 5, 1)
    df = spark.createDataFrame([(1, day, 1.0), (2, day, 2.0), (3, day + dt.timedelta(1), None)],
                               "id long, day date, v double")
    assert ranking.latest_non_null(df, "v", ["day", "id"]).first()["v"] == 2.0
    assert [r["id"] for r in ranking.edge_n(df, ["day", "id"], 2).collect()] == [3, 2]
    assert [r["id"] for r in ranking.edge_n(df, ["day", "id"], 9, "oldest").collect()] == [1, 2, 3]


def test_filters(spark, wide):
    df, _ = wide
    assert flt.available_columns(df, ["a", "empty", "absent", "flat"]) == ["a", "flat"]
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 15, 31)], "d date")
    assert flt.date_window(days, "d", "2024-01-15", "2024-01-31").count() == 2
    assert flt.default_window(days, "d", 20).count() == 2
    bounds = flt.default_bounds(days, "d").first()
    assert bounds["start_date"] == dt.date(2024, 1, 1)


def test_sums_without_values(spark):
    df = spark.createDataFrame([(1, "a", None, 2.0, None, None)], "auction_id long, security_type string, "
                               "fima_percentage double, soma_percentage double, fima_accepted double, soma_accepted double")
    row = agg.participation_by_type(df).first()
    assert row["fima_accepted"] == 0.0 and row["fima_percentage"] is None


def test_empty_index_kpis(spark):
    empty = spark.createDataFrame([], "date date, total_articles long, rate double, tariff_rate double, fiscal_policy_index double")
    row = agg.index_kpis(empty).first()
    assert row["total_articles"] == 0 and row["latest_index"] == 0.0 and row["avg_fiscal_rate_pct"] is None


def test_out_of_bounds(spark):
    rows = [(1, -0.1, 100.0, 2.0), (2, 1.0, 201.0, 2.0), (3, 1.0, None, 10.5), (4, 1.0, 100.0, 10.0), (5, None, None, None), (6, 1.0, 100.0, 0.0)]
    df = spark.createDataFrame(rows, "auction_id long, high_yield double, price_per_100 double, bid_to_cover_ratio double")
    assert sorted(r["auction_id"] for r in flt.out_of_bounds(df).collect()) == [1, 2, 3, 6]
