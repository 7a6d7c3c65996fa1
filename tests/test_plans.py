"""What the physical plans must and must not hold."""

import re

import pytest

from seatflow import catalog
from seatflow.catalog import schools
from seatflow.catalog import standins as S
from seatflow.plans import serving
from seatflow.plans.ballots import add_trends

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


# Training queries write tables while their plan is built; what they read back is a plain scan.
TRAINED = {"gbt_predict", "gbt_importances", "run_log", "school_predictions", "model_error", "model_reload"}


@pytest.mark.parametrize("name", sorted(set(catalog.all_queries()) - TRAINED))
def test_no_pair_product_and_no_python_rows(spark, name):
    text = plan(catalog.all_queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in text
    if not re.search("vector|scope|hit_at_k|retrieve|context|letters|headings|html_blocks", name):
        assert not re.search("InPandas|InArrow|ArrowEval", text)


def test_search_runs_no_job_before_it_is_asked(spark):
    from seatflow.operators.vectors import top_k

    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    group = "search-plan"
    spark.sparkContext.setJobGroup(group, "")
    found = top_k(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 2, "vec_id", block_rows=4)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert found.count() == 18
    spark.sparkContext.setJobGroup("tests", "")


def test_lookups_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    tables = schools.tables(spark, SF)
    mart, dim = tables["mart_school_analysis"], tables["dim_school"]
    one = plan(serving.school_detail(dim, tables["dim_school_generalinfo"], " supplier#000000004"))
    assert "EqualTo(school_name_clean,SUPPLIER#000000004)" in one
    risk = plan(serving.assess_risk(mart, 2023, "supplier#000000004", "2c"))
    assert "EqualTo(school_name_clean,SUPPLIER#000000004)" in risk and "EqualTo(phase_normalised,2C)" in risk
    assert "PartitionFilters: [isnotnull(registration_year" in risk
    phase = plan(serving.recommend_one(mart, "2c", 2023, zone_code="asia"))
    assert "EqualTo(phase_normalised,2C)" in phase


def test_all_trends_share_one_shuffle_and_sort(spark, tmp_path):
    path = str(tmp_path / "rated")
    S.rated(spark, SF).write.parquet(path)
    df = add_trends(
        spark.read.parquet(path), ["entity", "category"], "year", "rate", "vacancy", "code"
    )
    assert shuffles(df) == 1 and len(re.findall(r"\bSort \[", plan(df))) == 1


@pytest.fixture(scope="module")
def stored_mart(spark, tmp_path_factory):
    from seatflow.catalog.schools import mart

    path = str(tmp_path_factory.mktemp("mart") / "t")
    mart(spark, SF).write.partitionBy("registration_year").parquet(path)
    return spark.read.parquet(path)


def test_served_from_a_table_in_one_shuffle(stored_mart):
    one = serving.recommend_one(stored_mart, "2C", 2023, True, zone_code="ASIA")
    both = serving.recommend_all(stored_mart, 2023, zone_code="ASIA")
    assert shuffles(one) == 1
    assert shuffles(both) <= 2
    assert "PartitionFilters: [isnotnull(registration_year" in plan(both)


def test_latest_rows_are_cut_before_the_shuffle(spark):
    text = plan(catalog.all_queries()["dedupe_latest"](spark, SF))
    assert text.count("WindowGroupLimit") == 2


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(catalog.all_queries()["filter_in"](spark, SF))
    assert "PushedFilters: [In(p_type, [ECONOMY,PROMO])]" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string,p_size:int>" in text


def test_bucketed_tables_join_and_roll_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(schools.mart_bucketed(spark, SF))
        assert "SortMergeJoin" in text and "Window" in text and "Exchange" not in text
        # Over the plain tables the same mart takes one for each side of the join.
        stored = schools.tables(spark, SF)
        made = schools.ballots.mart_school_analysis(stored["fact_balloting"], stored["dim_school"])
        assert shuffles(made) >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
