"""Nearest vectors against brute force, on both ways and with ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatflow.operators import vectors as V
from seatflow.operators.encoding import QUERY, embed_hashed, embed_with, letter_encoder


def brute(corpus, queries, k):
    out = set()
    for q, qv in queries:
        ranked = []
        for i, v in corpus:
            norm = np.linalg.norm(v) * np.linalg.norm(qv)
            if norm > 0:
                ranked.append((round(1 - float(np.dot(v, qv)) / norm, 6), i))
        for rank, (d, i) in enumerate(sorted(ranked)[:k], start=1):
            out.add((q, i, d, rank))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8))
    vectors[100:200] = vectors[0]  # a third of all rows are copies
    vectors[7] = 0
    corpus = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    queries = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(9, 8)))]
    queries.append(("copy", corpus[0][1]))
    return corpus, queries


@pytest.mark.parametrize("way", ["blocks", "one block", "held queries"])
def test_top_k_is_exact(spark, data, way):
    corpus, queries = data
    c = spark.createDataFrame([*corpus, (999, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([*queries, ("none", None)], "query_id string, embedding array<double>")
    if way == "held queries":
        got = V.nearest_to(c.repartition(5), dict(queries), 4, "vec_id")
    else:
        got = V.top_k(c.repartition(5), q, 4, "vec_id", block_rows=70 if way == "blocks" else 1000)
    got = {(r.query_id, r.id, round(r.distance, 6), r["rank"]) for r in got.collect()}
    want = brute(corpus, queries, 4)
    assert {(a, b, abs(c), d) for a, b, c, d in got} == {(a, b, abs(c), d) for a, b, c, d in want}


def test_cosine_expression_agrees(spark, data):
    corpus, queries = data
    df = spark.createDataFrame([(corpus[1][1], queries[0][1]), (corpus[7][1], queries[0][1])],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()]
    a, b = np.array(corpus[1][1]), np.array(queries[0][1])
    assert got[0] == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert got[1] is None


def test_scope_gate(spark):
    questions = spark.createDataFrame(
        [("near", False), ("far", False), ("far_named", True), ("none", False)],
        "question_id string, named boolean",
    )
    hits = spark.createDataFrame(
        [("near", 0.6), ("near", 0.9), ("far", 0.61), ("far_named", 0.7)],
        "query_id string, distance double",
    )
    gate = V.scope_gate(questions, hits, "question_id", F.col("named"))
    got = {r.query_id: (r.best_distance, r.out_of_scope) for r in gate.collect()}
    assert got == {
        "near": (0.6, False), "far": (0.61, True), "far_named": (0.7, False), "none": (1.0, True),
    }


def test_hit_at_k(spark):
    results = spark.createDataFrame(
        [("a", "Phase_2C"), ("a", "other"), ("b", "other")], "query_id string, topic string"
    )
    truth = spark.createDataFrame(
        [("a", ["phase"]), ("b", ["ballot", "distance"]), ("c", ["x"])],
        "query_id string, accepted array<string>",
    )
    got = dict(tuple(r) for r in V.hit_at_k(results, truth, "topic", "accepted").collect())
    assert got == {"a": True, "b": False, "c": False}


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "A, b!"), (3, None)], "id long, text string")
    out = {r.id: r.embedding for r in embed_hashed(df, "text", width=32).collect()}
    assert np.linalg.norm(out[1]) == pytest.approx(1.0)
    assert sorted(x for x in out[2] if x) == pytest.approx([2**-0.5, 2**-0.5])
    assert sum(out[3]) == 0
    sizes = embed_with(df.coalesce(1), "text", lambda: lambda texts, mode: [[len(t), len(texts), len(mode)] for t in texts],
                       QUERY, batch=2)
    assert [r.embedding for r in sizes.orderBy("id").collect()] == [[5, 2, 5], [5, 2, 5], [0, 1, 5]]
    letters = embed_with(df, "text", letter_encoder).orderBy("id").collect()
    assert letters[0].embedding[:3] == [2, 1, 0] and sum(letters[2].embedding) == 0
    with pytest.raises(ValueError):
        embed_with(df, "text", letter_encoder, "other")


def test_mean_vectors(rows):
    df = rows([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0]), ("b", None)], "k string, embedding array<double>")
    got = {r.k: r.embedding for r in V.mean_vectors(df, "k").collect()}
    assert got == {"a": [2.0, 3.0], "b": [5.0, 6.0]}
