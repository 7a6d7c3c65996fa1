import hashlib

from pyspark.sql import functions as F

from seatflow.llm.common import label_sample, remainder


def test_sample_is_the_first_of_each_label(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 7, "rare").otherwise("often").alias("label")
    )
    odd = spark.createDataFrame([(None, "rare"), (5, None)], "doc_id long, label string")
    got = label_sample(rows.unionByName(odd), 200, 350).collect()
    key = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    first = {
        "rare": sorted((i for i in range(30_000) if i % 100 == 7), key=key),
        "often": sorted((i for i in range(30_000) if i % 100 != 7), key=key),
    }
    found = {name: [r["doc_id"] for r in got if r["label"] == name] for name in first}
    assert len(got) == 350 and abs(len(found["rare"]) - len(found["often"])) <= 1
    assert all(set(found[n]) == set(first[n][: len(found[n])]) for n in first)


def test_no_shuffle_of_all_labels(spark):
    """Other ids are left out before any exchange, with broadcasting by estimate off as well."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
        sample = label_sample(rows, 100, 200)
        plan = sample._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert plan.index("BroadcastHashJoin") > plan.index("Exchange hashpartitioning(label")
        assert sample.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_remainder_is_that_of_the_text(spark):
    import zlib

    got = spark.range(50).select("id", remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
