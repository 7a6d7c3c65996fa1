"""How the training of the demand model is spread; what it learns is held by the other tests."""

from pyspark.ml import Pipeline

from seatflow.plans import demand_model as D


def test_a_level_of_a_tree_has_no_more_tasks_than_it_needs(spark, monkeypatch):
    seen = []

    class Watched(Pipeline):
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), self.getStages()[-1].getCacheNodeIds(), rows.count()))
            return super().fit(rows)

    monkeypatch.setattr(D, "Pipeline", Watched)
    monkeypatch.setattr(D, "LEAST_ROWS", 100)
    frame = spark.range(250, numPartitions=40).selectExpr(
        "id % 3 AS kind", "CAST(id % 7 AS DOUBLE) AS a", "IF(id % 50 = 0, NULL, CAST(id % 5 AS DOUBLE)) AS rate"
    )
    model = D.train(frame.withColumn("kind", frame.kind.cast("string")), "rate", ["kind"], ["a"], D.Params(trees=3))
    assert seen == [(3, False, 245)]
    assert D.predict(model, frame.withColumn("kind", frame.kind.cast("string")), ["a"]).count() == 250


def test_tasks_follow_the_rows_beyond_the_cores():
    few, many = D.LEAST_ROWS, D.TASK_ROWS
    assert [D._n_tasks(n, 12) for n in (0, 1, few + 1, 12 * few, 12 * many, 30 * many)] == [1, 1, 2, 12, 12, 30]


def test_the_jobs_of_the_trees_start_at_written_features(spark, monkeypatch):
    seen = []

    class Watched(Pipeline):
        def fit(self, rows):
            plan = rows._jdf.queryExecution().optimizedPlan().toString()
            seen.append((rows.columns, plan.startswith("LogicalRDD"), rows._jdf.rdd().toDebugString()))
            return super().fit(rows)

    monkeypatch.setattr(D, "Pipeline", Watched)
    frame = spark.range(90).selectExpr(
        "CAST(id % 3 AS STRING) AS kind", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS rate"
    )
    model = D.train(frame, "rate", ["kind"], ["a"], D.Params(trees=2))
    [(columns, written, lineage)] = seen
    assert columns == ["features", "rate"] and written and "ReliableCheckpointRDD" in lineage
    assert [type(s).__name__ for s in model.stages] == ["StringIndexerModel", "VectorAssembler", "GBTRegressionModel"]
    # Which feature is a category is still known.
    assert "in {" in model.stages[-1].toDebugString and D.predict(model, frame, ["a"]).count() == 90
