"""Latest rows, rolling frames and year offsets, with random data against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from seatflow.operators import features, periods, ranking, summaries, trends
from seatflow.plans.ballots import add_trends


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(5)
    data = []
    for e in range(12):
        for c in "AB":
            for y in range(2015, 2024):
                if rng.random() < 0.7:
                    rate = None if rng.random() < 0.2 else round(rng.uniform(0.5, 2), 4)
                    code = rng.choice([None, "SC<1", "SC<1#"])
                    data.append((e, c, y, rate, rng.randrange(90), code))
    schema = "e long, c string, y long, rate double, vacancy long, code string"
    return data, spark.createDataFrame(data, schema).repartition(3)


def test_row_frame_and_year_offset_differ_on_gaps(rows):
    df = rows([("x", 2019, 1.0), ("x", 2020, 2.0), ("x", 2022, 6.0)], "k string, y long, v double")
    w = trends.by_year(["k"], "y")
    out = trends.offset_lag(df, ["k"], "y", {"lag1": ("v", 1), "lag2": ("v", 2)})
    out = out.select("y", "lag1", "lag2", trends.rolling_avg(F.col("v"), w, 3).alias("avg"),
                     trends.change(F.col("v"), w).alias("d"))
    assert [tuple(r) for r in out.orderBy("y").collect()] == [
        (2019, None, None, 1.0, None),
        (2020, 1.0, None, 1.5, 1.0),
        (2022, None, 2.0, 3.0, 4.0),
    ]


def test_offset_lag_equals_row_lag_without_gaps(rows):
    df = rows([("x", y, float(y * y)) for y in range(2000, 2010)], "k string, y long, v double")
    w = trends.by_year(["k"], "y")
    out = trends.offset_lag(df, ["k"], "y", {"a": ("v", 2)}).select("a", F.lag("v", 2).over(w))
    assert all(a == b for a, b in out.collect())


def test_trends_by_hand(cells):
    data, df = cells
    out = add_trends(df, ["e", "c"], "y", "rate", "vacancy", "code", 1.2).collect()
    assert len(out) == len(data)
    groups = {}
    for row in sorted(data, key=lambda r: r[2]):
        groups.setdefault(row[:2], []).append(row)
    for r in out:
        own = [g for g in groups[r.e, r.c] if g[2] <= r.y]
        rates = [g[3] for g in own[-3:] if g[3] is not None]
        mean = sum(rates) / len(rates) if rates else None
        hits = sum(g[5] == "SC<1" for g in own[-3:])
        assert r.ballot_occurrences_last_3yr == hits
        assert r.ballot_occurrences_last_5yr == sum(g[5] == "SC<1" for g in own[-5:])
        if mean is None:
            assert r.subscription_rate_3yr_avg is None and r.ballot_risk_level == "LOW"
        else:
            assert r.subscription_rate_3yr_avg == pytest.approx(mean, abs=6e-5)
            over = mean > 1.2
            tier = "HIGH" if over and hits == 3 else "MEDIUM" if over and hits else "LOW"
            assert r.ballot_risk_level == tier
        before = own[-2] if len(own) > 1 else None
        assert r.vacancy_yoy_change == (own[-1][4] - before[4] if before else None)


def test_dedupe_is_idempotent_and_total(rows):
    data = [("a", 1, 5), ("a", 1, 5), ("a", 2, 1), ("b", 1, 1), (None, 3, 3), (None, 4, None)]
    df = rows(data, "k string, t long, v long")
    once = ranking.keep_latest(df, ["k"], ["t"])
    got = sorted(map(tuple, once.collect()), key=repr)
    assert got == [("a", 2, 1), ("b", 1, 1), (None, 4, None)]
    assert sorted(map(tuple, ranking.keep_latest(once, ["k"], ["t"]).collect()), key=repr) == got


def test_top_n_equals_sort_and_slice(cells):
    data, df = cells
    got = ranking.top_n(df, ["e"], ["y", F.col("c").asc()], 3).collect()
    want = []
    for e in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == e), key=lambda r: (-r[2], r[1]))
        want += own[:3]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_latest_period_ways_agree(cells):
    _, df = cells
    a = ranking.rows_at_latest(df, ["e"], "y").select("e", "c", "y")
    b = ranking.top_rank(df, ["e"], "y").select("e", "c", "y")
    assert sorted(a.collect()) == sorted(b.collect())


def test_qualify_ways_agree(cells):
    _, df = cells
    ok = F.coalesce(F.col("code") == "SC<1", F.lit(False))
    done = df.filter("y < 2022")
    a = ranking.qualify(df, done, ["e", "c"], "y", ok)
    b = periods.with_latest_completed(df, ["e", "c"], "y", 2022, ok)
    assert a.count() > 0
    assert sorted(map(repr, a.select(df.columns).collect())) == sorted(
        map(repr, b.select(df.columns).collect())
    )


def test_completed_current_and_padding(rows):
    df = rows([("a", 2020, 1), ("a", 2021, 2), ("a", 2022, 3), ("a", 2023, 4), ("b", 2021, 5),
               ("c", 2022, 6)], "k string, y long, v long")
    kept = periods.completed_and_current(df, ["k"], "y", 2022, 1)
    assert sorted(map(tuple, kept.collect())) == [
        ("a", 2021, 2), ("a", 2022, 3), ("b", 2021, 5), ("c", 2022, 6),
    ]
    padded = periods.pad_current_year(kept, ["k"], "y", 2022).filter("v is null")
    assert [tuple(r) for r in padded.collect()] == [("b", 2022, None)]


def test_last_non_null_is_per_column(rows):
    df = rows([("a", 1, 1, "x"), ("a", 2, None, "y"), ("a", 3, 3, None), ("b", 1, None, None)],
              "k string, t long, p long, q string")
    got = summaries.last_non_null(df, ["k"], ["t"], ["p", "q"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 3, "y"), ("b", None, None)]


def test_metrics_by_hand(rows):
    df = rows([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 4.0)], "g string, y double, p double")
    got = summaries.regression_metrics(df, "y", "p").first()
    assert tuple(got) == (3, 0.666667, 0.816497, 0.75)
    by = summaries.mae_by(df, "g", "y", "p").orderBy("g").collect()
    assert [tuple(r) for r in by] == [("a", 2, 0.5), ("b", 1, 1.0)]


def test_features_and_frame(rows):
    df = rows(
        [("x", 2020, 1.0, 10, "N", True), ("x", 2021, None, 20, None, True),
         ("x", 2023, 2.0, 30, None, False), ("y", 2019, 1.0, 5, "S", None)],
        "k string, y long, rate double, v long, z string, f boolean",
    )
    out = features.lag_features(df, ["k"], "y", "rate", "v", ["f"])
    got = {(r.k, r.y): r for r in out.collect()}
    assert got["x", 2023].lag3 == 1.0 and got["x", 2023].lag2 is None
    assert got["x", 2023].rate_3yr_mean == 1.0 and got["x", 2021].lag1_vacancy == 10
    assert got["x", 2020].rate_3yr_mean is None and got["x", 2020].f == 1.0
    frame = features.prediction_frame(df, ["k"], "y", 2024, "rate", "v", ["z", "f"], ["f"])
    rows_ = frame.collect()
    assert [r.k for r in rows_] == ["x"]
    assert (rows_[0].z, rows_[0].f, rows_[0].lag1, rows_[0].lag1_vacancy, rows_[0].y) == (
        "N", 0.0, 2.0, 30, 2024,
    )


def test_time_split(rows):
    df = rows([(2018, 1.0), (2019, None), (2020, 2.0), (2021, 3.0)], "y long, t double")
    got = features.time_split(df, "y", "t", [2018, 2019], [2020]).select("y", "part").collect()
    assert sorted(map(tuple, got)) == [(2018, "train"), (2020, "eval")]
