"""The trees grown over bins against MLlib's own, and what a task keeps of its rows."""

import os

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor

from seatflow.operators import boosting as B
from seatflow.plans import demand_model as D

SETTINGS = dict(labelCol="y", maxIter=4, maxDepth=4, stepSize=0.1, maxBins=16, minInstancesPerNode=5, seed=3)


@pytest.fixture(scope="module")
def ready(spark):
    """Categories, one of them rare, numbers of many and of few values, a gap marked, a constant."""
    raw = spark.range(900, numPartitions=1).selectExpr(
        "IF(id = 7, 'rare', CAST(hash(id) % 4 AS STRING)) AS kind", "rand(1) AS a", "CAST(rand(2) * 9 AS INT) AS b",
        "IF(rand(3) < 0.3, -1.0, rand(4)) AS c", "1.0 AS same", "rand(5) AS noise",
    )
    raw = raw.selectExpr("*", "sin(a * 7) + b * c + hash(kind) % 7 + noise AS y")
    indexer = StringIndexer(inputCol="kind", outputCol="k", handleInvalid="keep", stringOrderType="alphabetAsc")
    features = VectorAssembler(inputCols=["k", "a", "b", "c", "same"], outputCol="features")
    rows = features.transform(indexer.fit(raw).transform(raw)).select("features", "y")
    return rows.repartition(3).localCheckpoint()


def predicted(model, rows):
    return np.array([r.prediction for r in model.transform(rows).select("prediction").collect()])


@pytest.mark.parametrize("few", [0, B.ONE_TASK_ROWS], ids=["a job for each level", "one task"])
def test_trees_are_those_of_mllib_if_nothing_is_drawn(ready, monkeypatch, few):
    monkeypatch.setattr(B, "ONE_TASK_ROWS", few)
    theirs, ours = GBTRegressor(**SETTINGS).fit(ready), B.BinnedGBTRegressor(**SETTINGS).fit(ready)
    assert np.allclose(predicted(theirs, ready), predicted(ours, ready), rtol=0, atol=1e-9)
    assert np.allclose(theirs.featureImportances.toArray(), ours.featureImportances.toArray(), rtol=0, atol=1e-9)
    assert [t.numNodes for t in theirs.trees] == [t.numNodes for t in ours.trees]
    assert theirs.treeWeights == ours.treeWeights and theirs.numFeatures == ours.numFeatures
    assert type(ours) is type(theirs) and ours.getMaxIter() == 4


def test_rows_and_features_are_drawn_by_seed(ready):
    some = SETTINGS | {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.4"}
    one, again, other = (
        B.BinnedGBTRegressor(**some | {"seed": seed}).fit(ready).toDebugString.split("\n", 1)[1] for seed in (5, 5, 6)
    )
    assert one == again != other
    kept = [B._sampled(50_000, 0.8, (5, tree, 0)) for tree in (0, 1)]
    assert all(abs(k.mean() - 0.8) < 0.01 for k in kept) and (kept[0] != kept[1]).any()
    how = B.BinnedGBTRegressor(**some)._settings(5)
    draw = B._allowed(how, [B.Node(np.array([9.0, 3.0, 5.0]), 0)] * 200, 0, 5, (1, 2, 3))
    assert set(draw.sum(axis=1)) == {2} and draw.any(axis=0).all()


def test_sums_of_many_tasks_and_cut_lineage_change_nothing(spark, ready, monkeypatch):
    whole = B.BinnedGBTRegressor(**SETTINGS).fit(ready)
    monkeypatch.setattr(B, "MANY_TASKS", 1)
    monkeypatch.setattr(B, "ONE_TASK_ROWS", 0)
    cut = B.BinnedGBTRegressor(**SETTINGS, checkpointInterval=1).fit(ready)
    assert np.allclose(predicted(whole, ready), predicted(cut, ready), rtol=0, atol=1e-9)
    # Of the rows of four trees none is left behind; those of other tests are.
    own = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(own))
    B.BinnedGBTRegressor(**SETTINGS, checkpointInterval=1).fit(ready)
    assert set(os.listdir(own)) <= before


def test_a_task_keeps_bins_and_one_number_of_a_row(spark, monkeypatch):
    seen, plain = [], B._trees

    def watched(rows, layout, how, n_rows):
        assert n_rows == 4000
        seen.append((layout, rows.collect()))
        return plain(rows, layout, how, n_rows)

    monkeypatch.setattr(B, "_trees", watched)
    frame = spark.range(4000).selectExpr(
        "CAST(id % 3 AS STRING) AS kind", "rand(1) AS a", "rand(2) AS b", "IF(id % 9 = 0, NULL, id % 5) AS c", "rand(3) AS y"
    )
    model = D.train(frame, "y", ["kind"], ["a", "b", "c"], D.Params(trees=2))
    [(layout, parts)] = seen
    # Seven features: the widest two apart, those of few bins beside them, constants nowhere.
    assert sorted(f for fs in layout.columns for f in fs) == [0, 1, 3, 5, 6] and len(layout.columns) == 2
    for columns, label, _ in parts:
        assert sum(c.nbytes for c in columns) <= 2 * len(layout.columns) * len(label) and label.dtype == np.float64
    assert D.predict(model, frame, ["a", "b", "c"]).count() == 4000


def test_one_task_grows_the_trees_of_many(ready, monkeypatch):
    drawn = SETTINGS | {"featureSubsetStrategy": "0.6", "subsamplingRate": 0.7}
    one = B.BinnedGBTRegressor(**drawn).fit(ready)
    monkeypatch.setattr(B, "ONE_TASK_ROWS", 0)
    many = B.BinnedGBTRegressor(**drawn).fit(ready)
    assert np.allclose(predicted(many, ready), predicted(one, ready), rtol=0, atol=1e-9)


def test_columns_hold_every_bin_of_their_features():
    layout = B.Layout([np.array([0.0, 1.5]), None, np.array([]), np.arange(999.0)], [3, 4, 1, 1000])
    features = np.array([[0.0, 3, 7, -5], [1.5, 0, 7, 998], [9.0, 2, 7, 4.5]])
    columns = layout.binned(features)
    got = {f: layout.place(f)[1][columns[layout.place(f)[0]]] for f in (0, 1, 3)}
    assert [list(got[f]) for f in (0, 1, 3)] == [[0, 1, 2], [3, 0, 2], [0, 998, 5]]
    with pytest.raises(ValueError):
        layout.binned(np.array([[0.0, 4, 7, 0]]))


def test_cuts_are_between_values_or_after_as_many_rows():
    assert list(B.thresholds(np.array([3.0, 1, 1, 2]), 5)) == [1.5, 2.5]
    assert list(B.thresholds(np.repeat(np.arange(8.0), 10), 3)) == [1.5, 3.5, 5.5]
    assert len(B.thresholds(np.ones(9), 3)) == 0


def test_nothing_to_split_and_numbers_that_are_none(spark):
    assemble = VectorAssembler(inputCols=["a"], outputCol="features", handleInvalid="keep")
    same = assemble.transform(spark.range(20).selectExpr("1.0 AS a", "CAST(id AS DOUBLE) AS y"))
    model = B.BinnedGBTRegressor(**SETTINGS).fit(same)
    assert [t.numNodes for t in model.trees] == [1] * 4 and predicted(model, same)[0] == pytest.approx(9.5)
    with pytest.raises(Exception, match="finite"):
        B.BinnedGBTRegressor(**SETTINGS).fit(same.selectExpr("features", "IF(y = 3, CAST('NaN' AS DOUBLE), y) AS y"))
    with pytest.raises(ValueError):
        B.BinnedGBTRegressor(**SETTINGS).fit(same.limit(0))
