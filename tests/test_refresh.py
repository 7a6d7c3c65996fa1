"""A refresh of some years gives the tables of a full build, and computes no more than it must."""

import pytest
from pyspark.sql import functions as F

from seatflow.catalog import standins as S
from seatflow.operators import deltas
from seatflow.plans import ballots

SF = "/root/testdata/sf0.001"



def year():
    return F.col("registration_year")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "ballots")
    S.raw_ballots(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def build(spark, raw, path, as_of=S.PIPELINE_AS_OF, schools=None, **more):
    schools = S.raw_schools(spark, SF) if schools is None else schools
    return ballots.build_tables(raw, schools, S.seeds(spark, SF), str(path), as_of, S.PIPELINE_RISK, **more)


def listed(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def same(a, b):
    for name in b:
        assert listed(a[name]) == listed(b[name]), name


def changed(raw, of):
    return raw.withColumn("applied", F.when((year() == of) & (F.col("phase") == "3"), 999).otherwise(F.col("applied")))


@pytest.mark.parametrize(
    ("before", "after", "years"),
    [
        (lambda r: changed(r, 2022).filter(year() != 2020), lambda r: r.filter(year() != 2019), [2019, 2020, 2022, 2050]),
        (lambda r: r, lambda r: r, [2020]),
    ],
    ids=["changed, new and withdrawn years", "nothing"],
)
def test_refreshed_years_equal_a_full_build(spark, raw, tmp_path, before, after, years):
    build(spark, before(raw), tmp_path / "a")
    same(build(spark, after(raw), tmp_path / "a", years=years), build(spark, after(raw), tmp_path / "b"))


def test_dimensions_and_the_current_year_are_followed(spark, raw, tmp_path):
    """A school is new, one is gone, one moved; and the calendar went on by a year."""
    schools = S.raw_schools(spark, SF)
    names = sorted(r[0] for r in schools.select("school_name").collect())
    later = schools.filter(F.col("school_name") != names[1]).withColumn(
        "address", F.when(F.col("school_name") == names[2], "elsewhere").otherwise(F.col("address"))
    )
    earlier = schools.filter(F.col("school_name") != names[0])
    build(spark, changed(raw, 2022), tmp_path / "a", schools=earlier)
    as_of = "2027-03-01"
    got = build(spark, raw, tmp_path / "a", as_of, later, years=[2022])
    same(got, build(spark, raw, tmp_path / "b", as_of, later))


@pytest.mark.parametrize("table", ["mart_school_analysis", "fact_balloting"])
def test_an_interrupted_refresh_is_repeated(spark, raw, tmp_path, monkeypatch, table):
    build(spark, changed(raw, 2020), tmp_path / "a")
    write = ballots.replace_values

    def stopped(df, path, *rest):
        if path.endswith(table):
            raise OSError("the machine is gone")
        write(df, path, *rest)

    monkeypatch.setattr(ballots, "replace_values", stopped)
    with pytest.raises(OSError):
        build(spark, raw, tmp_path / "a", years=[2020])
    monkeypatch.setattr(ballots, "replace_values", write)
    same(build(spark, raw, tmp_path / "a", years=[2020]), build(spark, raw, tmp_path / "b"))


def test_only_touched_groups_and_years_are_made(spark, raw, tmp_path, monkeypatch):
    old = build(spark, raw, tmp_path / "a")
    name, phase = old["mart_school_analysis"].filter(year() == 2021).select("school_name_clean", "phase_normalised").first()
    one = (F.col("school_name_clean") == name) & (F.col("phase_normalised") == phase)
    fact, mart = old["fact_balloting"], old["mart_school_analysis"]
    new = fact.withColumn("vacancy", F.when(one & (year() == 2021), -1).otherwise(F.col("vacancy")))
    none = fact.select("school_name_clean").limit(0)
    touched = ballots.touched_groups(
        fact.filter(year() == 2021), new.filter(year() == 2021), none, old["dim_school"], mart, S.PIPELINE_AS_OF
    )
    assert [tuple(r) for r in touched.collect()] == [(name, phase, 2021)]
    made = ballots.refreshed_mart(new, old["dim_school"], mart, touched, S.PIPELINE_AS_OF, S.PIPELINE_RISK)
    got = made.collect()
    assert got and {(r.school_name_clean, r.phase_normalised) for r in got} == {(name, phase)}
    assert {r.registration_year for r in got} == {
        r[0] for r in mart.filter(one & (year() >= 2021)).select("registration_year").collect()
    }
    # The groups are cut before the window, so no other group is sorted or computed.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi", plan.index("Window")) and "CartesianProduct" not in plan
    window = plan[plan.rindex("Window [") :]
    assert "LeftSemi" in window

    written = []
    monkeypatch.setattr(ballots, "replace_values", lambda df, path, by, values, *rest: written.append((path, values)))
    build(spark, raw, tmp_path / "a", years=[2021])
    assert written == []


def test_changed_rows_count_nulls_and_repeats(rows):
    schema = "a int, b string"
    old = rows([(1, None), (1, None), (2, "x"), (3, "y")], schema)
    new = rows([(1, None), (2, "x"), (3, "z")], schema)
    got = sorted(map(tuple, deltas.changed_rows(old, new).collect()), key=repr)
    assert got == [(1, None), (3, "y"), (3, "z")]
    touched = deltas.first_changes(rows([(None, 2), (None, 5)], "b string, a int"), ["b"], "a")
    data = rows([(None, 1), (None, 2), ("x", 9)], "b string, a int")
    assert [tuple(r) for r in deltas.from_first_change(data, touched, ["b"], "a").collect()] == [(None, 2)]
    assert sorted(map(repr, map(tuple, deltas.before_first_change(data, touched, ["b"], "a").collect()))) == sorted(
        map(repr, [(None, 1), ("x", 9)])
    )
