"""Raw tables to mart and served answers, on handmade rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seatflow import schemas
from seatflow.operators import quality
from seatflow.operators.quality import Rule, run_checks
from seatflow.plans import advisor, ballots, serving

AS_OF = "2024-06-30"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def ballot(name, phase, year, vacancy, applied, taken, code=None, total=100, at=T1):
    return (name, total, phase, vacancy, applied, taken, code, "d", None, None, None, year, at)


def school(name, level="PRIMARY", zone="EAST", **over):
    row = {c: "na" for c in schemas.SCHOOL_TEXT_COLUMNS}
    row |= dict(school_name=name, mainlevel_code=level, zone_code=zone, dgp_code="BEDOK",
                type_code="GOVERNMENT-AIDED SCH", nature_code="CO-ED SCHOOL", address="1 Road",
                session_code="SINGLE", mothertongue1_code="Chinese")
    row |= dict(postal_code=1234, sap_ind=True, autonomous_ind=False, gifted_ind=False, ip_ind=False)
    row |= over
    return tuple(row[f.name] for f in schemas.RAW_SCHOOLS.fields)


@pytest.fixture(scope="module")
def inputs(spark):
    raw = spark.createDataFrame(
        [
            ballot("Girls’ ", "2C", 2021, 10, 13, 10, "SC<1"),
            ballot("Girls’ ", "2C", 2021, 10, 99, 10, None, at=dt.datetime(2023, 1, 1)),
            ballot("Girls’ ", "2C", 2022, 10, 13, 10, "SC1-2", total=12),
            ballot("Girls’ ", "2C", 2023, 10, 13, 10, "SC<1"),
            ballot("Girls’ ", "2B", 2023, 0, None, None),
            ballot("Girls’ ", "2B", 2022, 5, 1, 1),
            ballot("Girls’ ", "3", 2022, None, 4, 4),
            ballot("Girls’ ", " 3 ", 2023, None, 4, 4),
            ballot("Girls’ ", "Phase 1", 2018, 9, 9, 9),
            ballot("Girls’ ", "2C", 2018, 10, 50, 10, "SC<1"),
            ballot("Girls’ ", "odd", 2022, 1, 1, 1),
            ballot("New", "2C", 2024, 10, 5, 5),
            ballot("Stranger", "2C", 2023, 10, 5, 5),
            ballot("Stranger 2", "2C", 2023, 20, 5, 5),
            ballot("Gone", "2C", 2020, 10, 30, 10, "SC<1"),
        ],
        schemas.RAW_BALLOTS,
    )
    schools = spark.createDataFrame(
        [school("Girls' School"), school("New"), school("Upper", level="SECONDARY"),
         school("Resting", zone="na")],
        schemas.RAW_SCHOOLS,
    )
    seeds = ballots.Seeds(
        spark.createDataFrame([("1", "1"), ("2B", "2B"), ("2C", "2C"), ("3", "3")],
                              "phase_raw string, phase_normalised string"),
        spark.createDataFrame([("SC<1", "within 1km")], "codes string, description string"),
        spark.createDataFrame([("GIRLS’", "GIRLS' SCHOOL")], schemas.SEED_NAME_MAPPING),
        spark.createDataFrame(
            [("RESTING", "relocated_gap", 2024, 2027, None), ("GONE", "merged", 2021, None, "NEW")],
            schemas.SEED_LIFECYCLE,
        ),
    )
    return raw, schools, seeds


@pytest.fixture(scope="module")
def built(inputs):
    return tuple(df.cache() for df in ballots.build(*inputs, AS_OF))


def test_stored_tables_equal_the_lazy_ones(spark, inputs, built, tmp_path):
    raw, schools, seeds = inputs
    path = str(tmp_path / "tables")
    tables = ballots.build_tables(raw, schools, seeds, path, AS_OF)
    for df, lazy in zip(tables.values(), built):
        same = lazy.select(df.columns)
        assert sorted(map(repr, df.collect())) == sorted(map(repr, same.collect()))
    # New results with the stored dimensions: the school list given now is not looked at.
    more = raw.unionByName(
        spark.createDataFrame([ballot("New", "2C", 2023, 8, 9, 8)], schemas.RAW_BALLOTS)
    )
    again = ballots.build_tables(
        more, schools.limit(0), seeds, path, AS_OF, keep=("dim_school", "dim_school_generalinfo")
    )
    assert again["dim_school"].count() == 4
    row = one(again["mart_school_analysis"], school_name_clean="NEW", registration_year=2024)
    assert row.vacancy_yoy_change == 2 and row.zone_code == "EAST"


def test_a_rebuild_drops_years_that_are_gone(spark, inputs, tmp_path):
    raw, schools, seeds = inputs
    path = str(tmp_path / "tables")
    years = lambda t: {r[0] for r in t.select("registration_year").distinct().collect()}
    whole = ballots.build_tables(raw, schools, seeds, path, AS_OF)
    assert 2022 in years(whole["fact_balloting"]) and 2022 in years(whole["mart_school_analysis"])
    less = ballots.build_tables(raw.filter("registration_year <> 2022"), schools, seeds, path, AS_OF)
    assert 2022 not in years(less["fact_balloting"]) | years(less["mart_school_analysis"])
    before = years(less["fact_balloting"])
    some = ballots.build_tables(raw, schools, seeds, path, AS_OF, years=[2022])
    assert years(some["fact_balloting"]) == before | {2022}


def test_gates_are_counted_by_the_writing_jobs(spark, inputs, tmp_path):
    raw, schools, seeds = inputs
    rules = [Rule("fact_balloting", "not_null", "school_key"), Rule("fact_balloting", "row_gate"),
             Rule("dim_school", "unique", "school_key"), Rule("dim_school", "not_null", "school_key"),
             Rule("mart_school_analysis", "accepted", "phase_normalised", arg=("2B", "2C"))]
    gates = quality.Gates(rules, stop=False)
    tables = ballots.build_tables(raw, schools, seeds, str(tmp_path / "a"), AS_OF, gates=gates)
    got = {(r.table_name, r.rule): (r.violations, r.status) for r in gates.report(spark).collect()}
    again = run_checks(tables, [r for r in rules if r.kind != "unique"]).collect()
    assert got == {(r.table_name, r.rule): (r.violations, r.status) for r in again}
    assert got[("fact_balloting", "not_null:school_key")][0] > 0 and got[("fact_balloting", "row_gate")][0] == 0
    with pytest.raises(quality.GateError, match="fact_balloting not_null:school_key"):
        ballots.build_tables(raw, schools, seeds, str(tmp_path / "b"), AS_OF, gates=quality.Gates(rules))
    assert not (tmp_path / "b" / "mart_school_analysis").exists()
    empty = quality.Gates([Rule("fact_balloting", "row_gate")])
    with pytest.raises(quality.GateError, match="row_gate"):
        ballots.build_tables(raw.limit(0), schools, seeds, str(tmp_path / "c"), AS_OF, gates=empty)


def test_phases_in_any_case(spark, built):
    _, _, _, mart = built
    predictions = spark.createDataFrame(
        [("GIRLS' SCHOOL", "2C", 2024, 1.5, 0.6)],
        "school_name string, phase string, registration_year long, predicted_subscription_rate double,"
        "predicted_ballot_chance_pct double",
    )
    for phase in ("2C", "2c"):
        found = serving.predictions_for(predictions, 2024, phase)
        row = serving.recommend_one(mart, phase, 2024, predictions=found, zone_code="EAST").filter(
            "school_name_clean = 'GIRLS'' SCHOOL'"
        ).first()
        assert row.phase_normalised == "2C" and row.ml_prediction.predicted_subscription_rate == 1.5
        assert serving.assess_risk(mart, 2024, phase=phase).count() > 0


def one(df, **where):
    for col, value in where.items():
        df = df.filter(F.col(col) == value)
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_dimension(built):
    dim, general, _, _ = built
    assert {r.school_name_clean for r in dim.collect()} == {"GIRLS' SCHOOL", "NEW", "RESTING", "GONE"}
    gone = one(dim, school_name_clean="GONE")
    assert (gone.zone_code, gone.is_active, gone.type_code) == ("UNKNOWN", False, None)
    assert gone.school_status_description.endswith("merged under NEW on 2021")
    assert one(dim, school_name_clean="RESTING").zone_code == "UNKNOWN"
    assert one(dim, school_name_clean="NEW").type_code == "GOVERNMENT-AIDED SCHOOL"
    assert general.count() == 3


def test_fact(built):
    _, _, fact, _ = built
    girls = fact.filter("school_name_clean = \"GIRLS' SCHOOL\"")
    latest = one(girls, phase_normalised="2C", registration_year=2021)
    assert (latest.applied, latest.subscription_rate, latest.ballot_description) == (
        13, 1.3, "within 1km",
    )
    closed = one(girls, phase_normalised="2B", registration_year=2023)
    assert (closed.applied, closed.taken, closed.subscription_rate) == (0, 0, None)
    # The fill rule sees the phase as loaded: with blanks it is not phase 3.
    assert one(girls, phase_normalised="3", registration_year=2022).vacancy == 0
    assert one(girls, phase_normalised="3", registration_year=2023).vacancy is None
    early = one(girls, phase_normalised="1")
    assert not early.has_full_figures and early.subscription_rate is None
    odd = one(girls, phase_raw="odd")
    assert odd.phase_normalised is None and odd.has_full_figures
    over = one(girls, phase_normalised="2C", registration_year=2022)
    assert over.is_over_enrolled and over.over_enrolled_count == 10 + 1 + 4 + 1 - 12
    strangers = fact.filter("school_key is null")
    assert {r.school_name_clean for r in strangers.collect()} == {"STRANGER", "STRANGER 2"}


def test_mart(built):
    _, _, _, mart = built
    assert mart.filter("registration_year < 2019 or phase_normalised = '1'").count() == 0
    girls = mart.filter("school_name_clean = \"GIRLS' SCHOOL\" and phase_normalised = '2C'")
    first = one(girls, registration_year=2021)
    assert first.subscription_rate_3yr_avg == 1.3  # 2018 is out of scope
    assert one(girls, registration_year=2023).ballot_risk_level == "HIGH"
    assert one(girls, registration_year=2022).ballot_distance_band == "1_to_2km"
    # Rows of unknown schools keep their own trends.
    assert one(mart, school_name_clean="STRANGER 2").vacancy_yoy_change is None


def test_recommend_all_orders_current_first_and_sentinel_last(built):
    _, _, _, mart = built
    rows = serving.recommend_all_rows(serving.recommend_all(mart, 2024, zone_code="east"))
    got = [
        (r.school_name_clean, r.phase_normalised, r.place, r.registration_year, r.vacancy,
         r.is_current_year)
        for r in rows.collect()
    ]
    girls = [g[1:] for g in got if g[0] == "GIRLS' SCHOOL"]
    assert sorted(girls) == [
        ("2B", 0, 2023, 0, False), ("2B", 1, 2024, None, True),
        ("2C", 0, 2023, 10, False), ("2C", 1, 2024, None, True),
        ("3", 0, 2023, None, False), ("3", 1, 2024, None, True),
    ]
    # A school that only has the current year stays in this mode.
    assert [g for g in got if g[0] == "NEW"] == [("NEW", "2C", 0, 2024, 10, True)]
    both = serving.recommend_all_rows(serving.recommend_all(mart, 2023, zone_code="east"))
    years = [r.registration_year for r in both.filter("phase_normalised = '2C'").orderBy("place").collect()]
    assert years == [2023, 2022]


def test_recommend_one(built):
    _, _, _, mart = built
    nested = serving.recommend_one(mart, "2C", 2024, zone_code="east").collect()
    assert [r.school_name_clean for r in nested] == ["GIRLS' SCHOOL"]  # NEW has no completed year
    answer = nested[0]
    assert answer.reference_years == [2023, 2022, 2021]
    assert [h.registration_year for h in answer.history] == [2023, 2022, 2021, 2024]
    assert answer.history[-1].is_current_year and answer.history[-1].vacancy is None
    assert answer.latest_year.registration_year == 2023
    assert answer.trend.ballot_occurrences_last_3yr == 3
    assert answer.ml_prediction is None and answer.interim is None
    assert serving.recommend_one(mart, "2B", 2024, True, zone_code="EAST").count() == 0
    assert serving.recommend_one(mart, "2B", 2024, False, zone_code="EAST").count() == 1


def test_enrichment_and_flags(spark, built):
    _, _, _, mart = built
    preds = spark.createDataFrame(
        [("GIRLS' SCHOOL", "2C", 2024, 1.5, 0.67)],
        "school_name string, phase string, registration_year long,"
        "predicted_subscription_rate double, predicted_ballot_chance_pct double",
    )
    chosen = serving.predictions_for(preds, 2024)
    answer = serving.recommend_all(mart, 2024, predictions=chosen, zone_code="east")
    by_phase = {c.category: c for r in answer.collect() if r.school_name_clean != "NEW" for c in r.categories}
    assert by_phase["2C"].ml_prediction.predicted_subscription_rate == 1.5
    assert by_phase["2B"].ml_prediction is None and by_phase["2C"].interim is None
    one_ = serving.recommend_one(mart, "2C", 2024, predictions=chosen, zone_code="east").first()
    assert one_.ml_prediction.predicted_ballot_chance_pct == 0.67
    config = spark.createDataFrame([("a", True), ("b", False), ("c", None)], schemas.SEED_FLAGS)
    flags = [serving.flag(config, k, True) for k in "abcd"]
    assert flags == [True, False, True, True]


def test_bad_parameters(built):
    _, _, _, mart = built
    with pytest.raises(ValueError):
        serving.recommend_all(mart, 2024)
    with pytest.raises(ValueError):
        serving.recommend_one(mart, "1", 2024, zone_code="EAST")
    with pytest.raises(ValueError):
        serving.recommend_all(mart, 2024, zone_code="EAST", colour="red")


def test_assess_risk_includes_inactive(built):
    _, _, _, mart = built
    gone = serving.assess_risk(mart, 2024, " gone ", "2C").collect()
    assert [(r.row_rank, r.is_active) for r in gone] == [(1, False)]
    girls = serving.assess_risk(mart, 2024, "girls' school", "2C").orderBy("row_rank").collect()
    assert [r.registration_year for r in girls] == [2023, 2022, 2021]
    assert girls[0].risk_explanation.startswith("Balloted in all 3") and girls[1].risk_explanation is None


def test_lists_and_detail(built):
    dim, general, _, _ = built
    assert [r.school_name for r in serving.list_schools(dim).collect()] == ["GIRLS' SCHOOL", "NEW"]
    assert serving.list_schools(dim, is_active=None, sap_ind=True).count() == 3
    detail = serving.school_detail(dim, general, "gone").first()
    assert detail.url_address is None and detail.school_status == "merged"
    assert serving.school_detail(dim, general, "nobody").count() == 0
    lists = {k: [tuple(r) for r in v.collect()] for k, v in serving.metadata_rows(dim).items()}
    assert lists["zones"] == [("EAST", 3)] and lists["all_estates"] == [("BEDOK",)]
    assert [s[0] for s in lists["schools"]] == ["GIRLS' SCHOOL", "NEW"]


def test_projection_seeds_take_the_latest_open_rows(built):
    _, _, _, mart = built
    assert [r.school_name for r in serving.projection_seeds(mart, ["2C"]).collect()] == ["NEW"]


def test_context(spark, built):
    dim, general, _, mart = built
    vec = lambda *v: [float(x) for x in v]
    chunks = spark.createDataFrame(
        [("d1", "first", "t1", "f1.md", "u1", vec(1, 0)), ("d2", "second", "t2", "f1.md", "u1", vec(1, 1)),
         ("d3", "third", "t3", "f2.md", "u2", vec(0, 1))],
        "doc_id string, content string, topic string, source_file string, source_url string,"
        "embedding array<double>",
    )
    questions = spark.createDataFrame(
        [("q1", "Which zone is it in, and the bus?", vec(1, 0.1), ["girls' school", "new"]),
         ("q2", "hello", vec(-1, -1), []),
         ("q3", "hello", vec(-1, -1), ["nobody"])],
        "question_id string, question string, embedding array<double>, school_names array<string>",
    )
    other = chunks.withColumn("domain", F.lit("other")).withColumn("content", F.lit("wrong domain"))
    other = other.withColumn("doc_id", F.concat(F.lit("0"), "doc_id"))
    both = chunks.withColumn("domain", F.lit("policy")).unionByName(other)
    out = advisor.retrieve_context(questions, both, mart, dim, general, k=2, domain="policy")
    got = {r.query_id: r for r in out.collect()}
    assert got["q1"].policy_context == "first\n\n---\n\nsecond"
    text = got["q1"].school_context
    parts = ["Balloting Data: girls'", "Balloting Data: new", "Attributes: girls'", "Transport: new"]
    assert [text.index(p) for p in parts] == sorted(text.index(p) for p in parts)
    assert "## 2023 Balloting Data" in text and "ballot_risk=N/A" in text
    assert "Mother tongue: Chinese\n" in text
    assert got["q2"].out_of_scope and got["q2"].policy_context is None
    assert not got["q3"].out_of_scope and not got["q3"].school_context_used
    assert got["q3"].school_context == "No specific school data requested."
    sources = advisor.unique_sources(out.filter("query_id = 'q1'")).collect()
    assert [(r.source_file, r.topic) for r in sources] == [("f1.md", "t1")]


def test_intents(rows):
    df = rows([("What PHASE?",), ("Where is the east zone",), ("phone",), ("hm",), (None,)], "q string")
    got = advisor.intent_flags(df, "q").select("needs_ballot", "needs_attributes", "needs_general")
    assert [tuple(r) for r in got.collect()] == [
        (True, False, False), (False, True, False), (False, False, True), (True, False, False),
        (True, False, False),
    ]


def test_rules_on_the_built_tables(built):
    dim, general, fact, mart = built
    report = run_checks(
        {"dim": dim, "general": general, "fact": fact, "mart": mart},
        [
            Rule("dim", "unique", "school_key"),
            Rule("dim", "not_null", "address", where="school_status <> 'merged'"),
            Rule("dim", "not_null", "address"),
            Rule("general", "relationship", "school_key", arg=("dim", "school_key")),
            Rule("fact", "not_null", "school_key"),
            Rule("fact", "not_null", "phase_normalised"),
            Rule("mart", "accepted", "ballot_risk_level", arg=("HIGH", "MEDIUM", "LOW")),
            Rule("mart", "row_gate", where="registration_year = 2030"),
        ],
    )
    got = {(r.table_name, r.rule): (r.violations, r.status) for r in report.collect()}
    assert got["dim", "unique:school_key"] == (0, "pass")
    assert got["dim", "not_null:address where school_status <> 'merged'"] == (0, "pass")
    assert got["dim", "not_null:address"] == (1, "fail")
    assert got["general", "relationship:school_key"] == (0, "pass")
    assert got["fact", "not_null:school_key"] == (2, "fail")
    assert got["fact", "not_null:phase_normalised"] == (1, "fail")
    assert got["mart", "accepted:ballot_risk_level"] == (0, "pass")
    assert got["mart", "row_gate where registration_year = 2030"] == (1, "fail")


def test_interim(spark, built):
    dim, _, _, _ = built
    at = lambda h: dt.datetime(2024, 7, 24, h)
    events = spark.createDataFrame(
        [("e1", "2C", 2024, "NEW", at(4), "midday", 40, 30, 10, 0.25, 1),
         ("e2", "2C", 2024, "NEW", at(4), "midday", 40, 30, 10, 0.25, 1),
         ("e3", "2C", 2024, "NEW", at(10), "end_of_day", 40, 20, 20, 0.5, 1),
         ("e4", "2C", 2024, "WHO", at(4), "midday", 40, 20, 20, 0.5, 1)],
        schemas.VACANCY_EVENTS,
    )
    staged = ballots.stage_snapshots(events)
    assert staged.count() == 3
    interim = ballots.mart_vacancy_interim(staged, dim)
    assert interim.count() == 2
    got = serving.interim_for(interim, 2024, zone_code="east").collect()
    assert [(r.school_name, r.snapshot_timestamp, r.applied_count) for r in got] == [
        ("NEW", "2024-07-24T18:00:00+08:00", 20)
    ]


def test_no_rules_no_report(rows):
    assert run_checks({"t": rows([(1,)], "a int")}, []).count() == 0


def test_rules_share_a_pass(rows):
    tables = {
        "c": rows([(1, "x"), (1, "y"), (None, "z"), (2, None)], "a int, b string"),
        "p": rows([(1, "x"), (3, "y")], "k int, l string"),
    }
    rules = [
        Rule("c", "unique", "a"), Rule("c", "unique", "b"), Rule("c", "unique", "a", where="b <> 'x'"),
        Rule("c", "relationship", "a", arg=("p", "k")), Rule("c", "relationship", "b", arg=("p", "l")),
    ]
    got = {r["rule"]: r["violations"] for r in run_checks(tables, rules).collect()}
    assert got == {
        "unique:a": 1, "unique:b": 0, "unique:a where b <> 'x'": 0, "relationship:a": 1, "relationship:b": 1,
    }
