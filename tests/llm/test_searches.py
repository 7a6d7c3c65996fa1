import math

import numpy as np
import pytest

from seatflow.llm import blocks, prefix_forest, va_file

NAN, INF = float("nan"), float("inf")


def sound(rows, zero=True):
    out = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if zero or any(v):
            out[i, tuple(v)] = None
    return list(out)


def brute(rows, every, k, score):
    found = set()
    kept = sound(rows)
    for qi, q in kept:
        if qi % every == 0:
            best = sorted((-score(q, v), i) for i, v in kept if i != qi and len(v) == len(q))[:k]
            found |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return found


def whole(q, v):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 150)
    monkeypatch.setattr(blocks, "GROUP", 3)


def handmade(seed, n=120, d=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d).astype(np.float32)]) for i in range(n)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # many copies of one
    rows += [(0, rows[0][1]), (300, [0.5] * 3), (301, [1.0] * 3), (350, [2.0] * 3), (400, [0.0] * d)]
    rows += [(500, None), (None, rows[1][1]), (550, [1.0] * (d - 1) + [NAN]), (551, [INF] * d), (600, []), (601, [None] * d)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, score int, block int"


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_search(spark, rows, small_blocks, seed):
    data = handmade(seed)
    got = va_file.whole_top_k(rows([(i, v, 1, 2) for i, v in data], SCHEMA), 50, 5).collect()
    assert {tuple(r) for r in got} == brute(data, 50, 5, whole)


def test_few_candidates_and_large_numbers(spark, rows):
    data = [(0, [1e14, -1.0]), (50, [3e14, 2.0]), (1, [-1.0, 0.25])]
    got = {tuple(r) for r in va_file.whole_top_k(rows(data, "vec_id long, embedding array<double>"), 50, 5).collect()}
    cut = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert got == {(q, r, i, cut(s)) for q, r, i, s in brute(data, 50, 5, whole)}


def test_cells_bound_every_score():
    rng = np.random.default_rng(3)
    exact = np.floor(256 * rng.normal(size=(500, 8)))
    low, high = exact.min(0), exact.max(0)
    step = (high - low) / 256
    cells = np.clip((exact - low) // step, 0, 255).astype(np.uint8)
    queries = np.floor(256 * rng.normal(size=(20, 8)))
    ids = np.arange(500)
    at, found, score = va_file.nearest_in_block(ids, low, step, cells, exact, np.full(20, -1), queries, 5)
    want = [sorted(zip(-(exact @ q), ids))[:5] for q in queries]
    assert list(zip(at, found, score)) == [(n, i, -s) for n, w in enumerate(want) for s, i in w]


def test_empty_tables(spark, rows):
    for search in (va_file.whole_top_k, prefix_forest.nearest_embeddings):
        assert search(rows([], "vec_id long, embedding array<float>")).count() == 0


def cosine(q, v):
    return float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v)))


def test_forest_on_few_rows_is_exact(spark, rows, small_blocks):
    """With a share of 1 the ascent ends at the root, where nothing is left out."""
    data = [r for r in handmade(4) if r[1] is None or any(r[1])]
    forest = prefix_forest.Forest(trees=4, share=1.0)
    got = prefix_forest.nearest_embeddings(rows([(i, v, 1, 2) for i, v in data], SCHEMA), 50, 5, forest).collect()
    want = {(q, r): (i, s) for q, r, i, s in brute(data, 50, 5, cosine)}
    assert {(r["query_id"], r["rank"]) for r in got} == set(want)
    for r in got:
        assert r["score"] == pytest.approx(want[r["query_id"], r["rank"]][1], abs=1e-12)
    copies = [r["vec_id"] for r in got if r["query_id"] == 200]
    assert copies == [3, 201, 202, 203, 204]


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), np.float64), rows["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = prefix_forest.nearest_embeddings(table).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        hits.append(len(found[ids[q]] & set(ids[np.argsort(-s)[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_ascent_collects_shared_prefixes():
    strings = np.array([[0b0001, 0b0010, 0b0111, 0b1100]])
    places = np.array([[2, 0, 3, 1]])
    take = lambda q, n: sorted(prefix_forest.candidates(strings, places, np.array([q]), 2, 4, n).tolist())
    assert take(0b0001, 1) == [2]
    assert take(0b0001, 2) == [0, 2]
    assert take(0b0001, 3) == [0, 2, 3]
    assert take(0b0001, 4) == [0, 1, 2, 3]
