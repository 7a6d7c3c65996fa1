"""Sinks, seeds, typed columns, and streams with restarts."""

import pytest
from pyspark.sql import functions as F

from seatflow import schemas
from seatflow.plans import demand_model as D
from seatflow.plans.ballots import write_by_year
from seatflow.session import shared_dir
from seatflow.sources import tables as io
from seatflow.streaming import events as E
from seatflow.streaming import state as St
from seatflow.streaming.projection import project_fill


def test_seed_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text(
        '﻿priority,codes,description,additional_notes,has_balloting\n'
        '1,SC<1,"near, ""very""",,TRUE\n2,SC#,far,x,FALSE\n', encoding="utf-8",
    )
    got = io.load_seed(spark, str(path), schemas.SEED_BALLOTING_CODES).collect()
    assert [tuple(r) for r in got] == [
        (1, "SC<1", 'near, "very"', None, True), (2, "SC#", "far", "x", False),
    ]


def test_flag_text_is_read_as_boolean(spark, tmp_path):
    path = tmp_path / "app_config.csv"
    path.write_text("config_key,config_value\nshow,false\n")
    assert io.load_seed(spark, str(path), schemas.SEED_FLAGS).first().config_value is False


def test_coerce_schema(rows):
    df = rows([("1", "x"), ("a", "2.5")], "a string, b string")
    got = io.coerce_schema(df, schemas.struct("a bigint, b double, c string")).collect()
    assert [tuple(r) for r in got] == [(1, None, None), (None, 2.5, None)]


def test_replace_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(2020, "a"), (2021, "b"), (2021, "c")], "y int, v string")
    io.append_partitioned(first, path, ["y"])
    io.append_partitioned(first.filter("y = 2020"), path, ["y"], files=2)
    again = spark.createDataFrame([(2021, "z")], "y int, v string")
    io.replace_partitions(again, path, ["y"])
    got = spark.read.schema(first.schema).parquet(path).collect()
    assert sorted((r.y, r.v) for r in got) == [(2020, "a"), (2020, "a"), (2021, "z")]


def test_year_layout_prunes(spark, tmp_path):
    path = str(tmp_path / "mart")
    df = spark.createDataFrame(
        [(y, f"s{i}", "2C") for y in (2020, 2021) for i in range(5)],
        "registration_year long, school_name_clean string, phase_normalised string",
    )
    write_by_year(df, path)
    plan = spark.read.parquet(path).filter("registration_year = 2021 and school_name_clean = 's1'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(registration_year" in text
    assert "EqualTo(school_name_clean,s1)" in text
    assert plan.count() == 1


def test_table_or_empty(spark):
    assert io.table_or_empty(spark, "no_such_table", schemas.PREDICTIONS).count() == 0


EVENT = schemas.struct("k string, at string, id bigint, v int")


def write_events(spark, path, data):
    df = spark.createDataFrame(data, EVENT)
    E.encode_events(df, ["k"]).select("value").coalesce(1).write.mode("append").text(path)


def finish(run):
    run.awaitTermination()
    assert run.exception() is None


def test_events_of_several_layouts(rows):
    schema = schemas.struct("k string not null, id bigint not null, v double")
    paths = {"k": ["$.k", "$.key.name"]}
    lines = ['{"k":"a","id":1,"v":1.5}', '{"key":{"name":"b"},"id":"2","v":"2.5","more":[1]}', '{"k":"c","id":3}',
             '{"k":"d","id":"x"}', '{"id":5}', '{"k":"e"', "", None, '{"k":"f","id":6,"v":"much"}']
    frame = rows([(x,) for x in lines], "value string")
    got = sorted(map(tuple, E.parse_versions(frame, schema, paths).collect()))
    assert got == [("a", 1, 1.5), ("b", 2, 2.5), ("c", 3, None), ("f", 6, None)]
    bad = {(r.value, r.problem) for r in E.rejected_versions(frame, schema, paths).collect()}
    assert bad == {(lines[3], "no id"), (lines[4], "no k"), (lines[5], "malformed"), ("", "malformed"), (None, "malformed")}


def test_append_restart_adds_only_new_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    write_events(spark, source, [("a", "1", 1, 1), ("b", "1", 2, 2)])
    for _ in range(2):
        finish(E.run_append(E.read_events(spark, source, EVENT), out, mark))
    write_events(spark, source, [("a", "2", 3, 3)])
    finish(E.run_append(E.read_events(spark, source, EVENT), out, mark))
    got = spark.read.schema(EVENT).parquet(out).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3]


def test_rejected_events_keep_their_text(rows):
    lines = ['{"k":"a","at":"1","id":1,"v":1}', '{"k":"a","at":', "", '{"at":"1","id":1,"v":2}', '{"k":"a","at":"1","id":"x"}']
    schema = schemas.struct("k string not null, at string, id bigint, v int")
    frame = rows([(x,) for x in [*lines, None]], "value string")
    assert [tuple(r) for r in E.parse_events(frame, schema).collect()] == [("a", "1", 1, 1)]
    got = {(r.value, r.problem) for r in E.rejected_events(frame, schema).collect()}
    bad = [lines[1], lines[2], lines[4], None]
    assert got == {(lines[3], "no k")} | {(x, "malformed") for x in bad}


KEYS, ORDER = ["k"], ["at", "id"]


def run_latest(name, stream, path, mark, **more):
    if name == "upsert":
        return St.run_changes(stream, path, mark, **more)
    return St.run_latest(stream, path, mark, KEYS, ORDER, "at", "100 days", 86_400_000, **more)


def day(n):
    return f"2024-01-{n:02d}"


def latest(spark, path):
    return sorted(map(tuple, St.read_latest(spark, path, EVENT, KEYS, ORDER).select("k", "at", "id", "v").collect()))


@pytest.mark.parametrize("name", ["state", "upsert"])
def test_latest_by_stream_equals_batch(spark, tmp_path, name):
    """With restarts, late records, and after them a new checkpoint over the whole inbox."""
    first = [("a", day(1), 1, 1), ("a", day(2), 2, 2), ("b", day(5), 3, None)]
    late = [("a", day(1), 9, 9), ("b", day(5), 4, 4), ("c", day(1), 5, 5)]
    path, mark, inbox = (str(tmp_path / n) for n in ("t", "mark", "in"))
    for part in (first, late):
        write_events(spark, inbox, part)
        finish(run_latest(name, E.read_events(spark, inbox, EVENT), path, mark))
    want = [("a", day(2), 2, 2), ("b", day(5), 4, 4), ("c", day(1), 5, 5)]
    assert latest(spark, path) == want
    finish(run_latest(name, E.read_events(spark, inbox, EVENT), path, f"{mark}-new"))
    assert latest(spark, path) == want


def test_a_second_checkpoint_loses_nothing(spark, tmp_path):
    """Both streams start at batch 0; of each, the record counts."""
    path = str(tmp_path / "t")
    for n, stream in enumerate(("main", "main", "other"), 1):
        inbox = str(tmp_path / f"in{n}")
        write_events(spark, inbox, [(f"k{n}", day(n), n, n)])
        finish(St.run_changes(E.read_events(spark, inbox, EVENT), path, str(tmp_path / f"mark{n}"), stream=stream))
    assert [r[0] for r in latest(spark, path)] == ["k1", "k2", "k3"]


def test_compaction_keeps_the_latest_and_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")

    def bring(n, generation, rows):
        write_events(spark, str(tmp_path / f"in{n}"), rows)
        events = E.read_events(spark, str(tmp_path / f"in{n}"), EVENT)
        finish(St.run_changes(events, path, str(tmp_path / f"mark{n}"), generation=generation))

    bring(1, 0, [("a", day(1), 1, 1), ("a", day(3), 2, 2), ("b", day(2), 3, 3)])
    bring(2, 1, [("b", day(4), 4, 4)])
    want = [("a", day(3), 2, 2), ("b", day(4), 4, 4)]
    assert latest(spark, path) == want

    def stopped(*_):  # the base is replaced, then the machine is lost
        raise OSError

    monkeypatch.setattr(St, "_folder", stopped)
    with pytest.raises(OSError):
        St.compact(spark, path, EVENT, KEYS, ORDER, 0)
    monkeypatch.undo()
    assert latest(spark, path) == want
    St.compact(spark, path, EVENT, KEYS, ORDER, 0)
    assert latest(spark, path) == want
    assert spark.read.parquet(f"{path}/base").count() == 2
    assert [tuple(r) for r in spark.read.parquet(f"{path}/changes").select("k", "generation").collect()] == [("b", 1)]
    bring(3, 2, [("a", day(9), 9, 9)])
    St.compact(spark, path, EVENT, KEYS, ORDER, 2)
    assert latest(spark, path) == [("a", day(9), 9, 9), ("b", day(4), 4, 4)]
    assert spark.read.parquet(f"{path}/changes").count() == 0


def test_state_expires(spark, tmp_path):
    """After a week without delay the state holds the last keys alone, the table all keys."""
    path, mark, inbox = (str(tmp_path / n) for n in ("t", "mark", "in"))
    for n in range(1, 8):
        write_events(spark, inbox, [(f"k{n}", day(3 * n), n, n), ("often", day(3 * n), 100 + n, n)])
        run = St.run_latest(
            E.read_events(spark, inbox, EVENT), path, mark, KEYS, ORDER, "at", "1 day", 4 * 86_400_000
        )
        finish(run)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert 1 <= kept[-1] < 8
    got = latest(spark, path)
    assert len(got) == 8 and got[-1] == ("often", day(21), 107, 7)


def test_replayed_and_late_events(spark, tmp_path):
    inbox, path, mark = (str(tmp_path / n) for n in ("in", "t", "mark"))
    raw, raw_mark = str(tmp_path / "raw"), str(tmp_path / "raw-mark")

    def step(rows):
        write_events(spark, inbox, rows)
        events = E.read_events(spark, inbox, EVENT)
        finish(E.run_append(events, raw, raw_mark))
        finish(St.run_changes(St.once(events, ["id"], "at", "2 days"), path, mark))
        return sorted(r[0] for r in spark.read.schema(EVENT).parquet(f"{path}/changes").select("id").collect())

    rows = [("a", day(1), 1, 1), ("b", day(2), 2, 2), ("a", day(1), 1, 1)]
    assert step(rows) == [1, 2]
    assert step(rows) == [1, 2]
    assert step([("c", day(20), 3, 3), *rows]) == [1, 2, 3]
    assert step([("d", day(5), 4, 4), ("d", day(19), 5, 5)]) == [1, 2, 3, 5]
    assert step([("d", day(5), 4, 4), ("d", day(5), 4, 4)]) == [1, 2, 3, 5]
    taken = spark.read.schema(EVENT).parquet(f"{path}/changes")
    late = St.late_events(spark.read.schema(EVENT).parquet(raw), taken, ["id"])
    assert [r["id"] for r in late.collect()] == [4]


def test_a_dimension_that_changed_is_seen_by_the_next_batch(spark, tmp_path):
    inbox, path, mark, places = (str(tmp_path / n) for n in ("in", "t", "mark", "places"))
    shape = schemas.struct("k string, at string, id bigint, v int, zone string")
    for n, zone in ((1, "east"), (2, "west")):
        dim = spark.createDataFrame([("a", zone), ("z", "none")], "k string, zone string")
        dim.write.mode("overwrite").parquet(places)
        write_events(spark, inbox, [("a", day(n), n, n), ("b", day(n), 10 + n, n)])
        enrich = St.attach_stored(places, dim.schema, "k")
        finish(St.run_changes(E.read_events(spark, inbox, EVENT), path, mark, enrich=enrich, schema=shape))
    got = St.read_latest(spark, path, shape, ["id"], ["at"]).collect()
    assert sorted((r.id, r.k, r.zone) for r in got) == [(1, "a", "east"), (2, "a", "west"), (11, "b", None), (12, "b", None)]


def test_projection(rows):
    seeds = rows([("A", "2C", 2026, 40, 33), ("B", "2C", 2026, 10, None)],
                 "school_name string, phase string, registration_year long, vacancy_at_open long,"
                 "final_applied_count long")  # fmt: skip
    got = project_fill(seeds, F.lit("2026-08-08").cast("date")).collect()
    a = sorted((r for r in got if r.school_name == "A"), key=lambda r: r.snapshot_timestamp)
    shares = (0.35, 0.55, 0.75, 0.87, 0.95, 1.0)
    assert [r.applied_count for r in a] == [round(33 * s) for s in shares]
    assert [r.pct_filled for r in a] == [round(round(33 * s) / 40, 4) for s in shares]
    assert a[0].snapshot_timestamp == "2026-08-08T12:00:00+08:00"
    assert a[-1].snapshot_timestamp == "2026-08-10T18:00:00+08:00"
    assert all(r.vacancy_remaining == 10 for r in got if r.school_name == "B")


def test_model_beats_the_group_mean(spark, tmp_path):
    data = [
        (f"e{i}", "AB"[i % 2], 2010 + y, 1.0 + (i % 5) * 0.3 + (i % 2) + 0.02 * y)
        for i in range(60)
        for y in range(6)
    ]
    df = spark.createDataFrame(data, "e string, c string, year long, rate double")
    from seatflow.operators.features import lag_features, time_split

    lagged = lag_features(
        df.withColumn("vacancy", F.lit(10)), ["e", "c"], "year", "rate", "vacancy"
    )
    split = time_split(lagged, "year", "rate", range(2010, 2015), [2015])
    params = D.Params(trees=15, rate=0.3)
    model = D.train(split.filter("part = 'train'"), "rate", ["c"], D.NUMERIC, params)
    scored = D.predict(model, split.filter("part = 'eval'"), D.NUMERIC)
    overall, by_category = D.evaluate(scored, "rate", "c")
    mean = split.filter("part = 'train'").groupBy("c").agg(F.avg("rate").alias("predicted"))
    base, _ = D.evaluate(split.filter("part = 'eval'").join(mean, "c"), "rate", "c")
    assert overall.first().mae < base.first().mae / 2
    path = str(tmp_path / "runs")
    for name in ("one", "two"):
        D.log_run(D.run_record(name, params, overall, by_category, split, "year", "rate", model), path)
    runs = spark.read.parquet(path).collect()
    assert {r.run_name for r in runs} == {"one", "two"}
    assert set(runs[0].mae_by_category) == {"mae_phase_A", "mae_phase_B"}
    assert runs[0].params["trees"] == "15" and runs[0].target == "rate"
    assert (runs[0].train_rows, runs[0].eval_rows) == (300, 60)
    assert (runs[0].train_first_year, runs[0].train_last_year, runs[0].eval_last_year) == (2010, 2014, 2015)
    assert set(runs[0].features) == set(runs[0].importances) and "c_index" in runs[0].features
    top = D.importances(model, spark, 3).collect()
    assert len(top) == 3 and top[0].importance >= top[1].importance
    unseen = spark.createDataFrame(
        [("Z", 2016, None, None, None, None, None)],
        "c string, year long, lag1 double, lag2 double, lag3 double, rate_3yr_mean double, lag1_vacancy long",
    )
    row = D.score(model, unseen, D.NUMERIC).first()
    assert row.predicted_subscription_rate >= 0 and 0 <= row.predicted_ballot_chance_pct <= 1


class Master:
    def __init__(self, master, named):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}-{named}"


def test_shared_folder():
    assert shared_dir(Master("yarn", "hdfs://n/ck/")) == "hdfs://n/ck"
    assert shared_dir(Master("local[2]", None)).startswith("/tmp/seatflow-")
    with pytest.raises(RuntimeError):
        shared_dir(Master("yarn", None))


def test_rules_of_the_tables():
    from collections import Counter

    from seatflow.plans.table_rules import table_rules

    kinds = Counter((r.kind, r.where is not None) for r in table_rules())
    assert kinds == {
        ("unique", False): 14, ("not_null", False): 34, ("not_null", True): 14,
        ("relationship", False): 6, ("accepted", False): 3,
    }
    assert len({(r.table, r.name) for r in table_rules()}) == 71


def test_facets(rows):
    from seatflow.operators.nesting import facet_lists, facet_rows

    df = rows([("E", "b"), ("E", "a"), ("E", "a"), ("UNKNOWN", "x"), ("W", "UNKNOWN"), (None, "y")],
              "z string, e string")
    assert [tuple(r) for r in facet_lists(df, "z", "e").collect()] == [("E", ["a", "b"])]
    assert facet_rows(df, "z", "e").count() == 2


def test_audit_column(rows):
    df = io.with_audit(rows([(1,)], "a long"))
    assert df.first().loaded_at is not None


def test_seed_columns_go_by_position(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("from_site,from_ministry\nAI TONG,AI TONG SCHOOL\n")
    got = io.load_seed(spark, str(path), schemas.SEED_NAME_MAPPING)
    assert got.columns == ["listed_name", "official_name"]
    assert tuple(got.first()) == ("AI TONG", "AI TONG SCHOOL")


def test_a_thousand_categories_train(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("zone"), (F.col("id") % 1000).cast("string")).alias("zone"),
        (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") % 3).cast("double").alias("rate"),
    )
    model = D.train(rows, "rate", ["zone"], ["x"], D.Params(trees=1, depth=2))
    assert model.stages[-1].getMaxBins() >= 1001
    assert D.predict(model, rows, ["x"]).count() == 4000


def test_seeds_by_header(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text("b,a\n2,1\n")
    schema = schemas.struct("first int, second string")
    got = io.load_seed(spark, str(path), schema, names={"first": "a", "second": "b"})
    assert [tuple(r) for r in got.collect()] == [(1, "2")]
    with pytest.raises(ValueError, match="lacks"):
        io.load_seed(spark, str(path), schema, names={"first": "a", "second": "c"})


def test_line_breaks_in_quotes_on_request(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    schema = schemas.struct("a int, b string")
    got = io.load_snapshot_csv(spark, str(path), schema, multi_line=True).collect()
    assert [tuple(r) for r in got] == [(1, "x\ny"), (2, "z")]


def test_required_fields_stay_required(spark, tmp_path):
    name = "needed_" + tmp_path.name.replace("-", "_")
    io.ensure_table(spark, name, schemas.struct("a int not null, b string"), str(tmp_path / "t"))
    try:
        io.insert_rows(spark.createDataFrame([("x", 1), (None, 2)], "b string, a int"), name)
        with pytest.raises(Exception, match="must be known"):
            io.insert_rows(spark.createDataFrame([("x", 3), ("y", None)], "b string, a int").coalesce(1), name)
        assert sorted(r.a for r in spark.table(name).collect()) == [1, 2]
    finally:
        spark.sql(f"DROP TABLE {name}")
