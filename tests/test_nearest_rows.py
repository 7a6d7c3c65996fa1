"""The search inside one block against a plain reading of all distances."""

import numpy as np

from seatflow.operators import vectors as V


def test_only_near_rows_are_rounded_and_ranked(monkeypatch):
    """Copies, ties by rounding alone, rows and queries without a direction."""
    g = np.random.default_rng(7)
    rows, asked = (g.integers(0, 9, (n, 6)).astype(float) for n in (3000, 300))
    rows[:40], rows[40], rows[41], asked[5], asked[6] = rows[50], 0, np.nan, 0, np.nan
    rows[60:90] = rows[50] + 1e-5 * g.random((30, 6))
    ids, names = g.permutation(3000), np.arange(300)
    units = V._unit(asked)
    dist = np.round(1 - units @ V._unit(rows).T, V.DIGITS)
    want = [
        (q, ids[c], abs(dist[q, c]))
        for q in names for c in sorted(np.flatnonzero(np.isfinite(dist[q])), key=lambda c: (dist[q, c], ids[c]))[:3]
    ]
    rounded, plain = [], np.round
    monkeypatch.setattr(V.np, "round", lambda x, *a: (rounded.append(np.size(x)), plain(x, *a))[1])
    found = V._nearest(names, units, ids, rows, 3)
    assert sum(rounded) < dist.size / 20
    assert list(found.sort_values(["query_id", "distance", "id"]).itertuples(index=False, name=None)) == want
    few = V._nearest(names[:2], units[:2], ids[:4], rows[45:49], 9)
    assert len(few) == 8 and V._nearest(names[5:6], units[5:6], ids, rows, 3).empty


def test_single_precision_only_tells_where_to_look(monkeypatch):
    """Nearer to each other than single precision can tell, wide, all unlike, and more wanted than groups."""
    g = np.random.default_rng(11)
    monkeypatch.setattr(V, "TILE", 64)
    monkeypatch.setattr(V, "GROUPS", 8)
    monkeypatch.setattr(V, "EXACT_NUMBERS", 500)
    for width, apart, sign in ((3, 1e-3, 1), (200, 1e-2, 1), (5, 0.5, -1)):
        rows = np.abs(g.normal(size=width)) + apart * g.normal(size=(500, width))
        asked = sign * (np.abs(rows[:70]) + apart * g.random((70, width)))
        ids = np.array([f"{i:03d}" for i in g.permutation(500)], object)
        dist = np.round(1 - V._unit(asked) @ V._unit(rows).T, V.DIGITS)
        for k in (1, 4, 30):
            found = V._nearest(np.arange(70), V._unit(asked), ids, rows, k)
            for q, part in found.groupby("query_id"):
                best = sorted(zip(dist[q], ids, strict=True))[:k]
                assert list(zip(np.abs(part["distance"]), part["id"], strict=True)) == [(abs(d), i) for d, i in best]
            assert len(found) == 70 * k


def test_few_products_are_made_in_double_precision(monkeypatch):
    g = np.random.default_rng(5)
    rows, asked = g.random((20_000, 26)), V._unit(g.random((64, 26)))
    exact, plain = [], np.einsum
    monkeypatch.setattr(V.np, "einsum", lambda how, a, b: (exact.append(b.shape[0] * b.shape[1]), plain(how, a, b))[1])
    assert len(V._nearest(np.arange(64), asked, np.arange(20_000), rows, 3)) == 192
    assert 0 < sum(exact) < 64 * 20_000 / 50


def test_copies_of_a_row_and_asked_rows_without_an_id():
    rows = np.tile([1.0, 2.0, 2.0], (9000, 1))
    found = V._nearest(np.array([1.0, np.nan]), V._unit(np.ones((2, 3))), np.arange(9000)[::-1], rows, 2)
    assert found[["query_id", "id"]].to_numpy().tolist() == [[1, 0], [1, 1]]


def test_blocks_are_fewer_for_narrow_vectors_and_bounded_for_wide_ones(spark, monkeypatch):
    def blocks(n, width):
        rows = spark.range(n).selectExpr("id", f"array_repeat(CAST(id % 7 AS DOUBLE) + 1, {width}) AS embedding")
        met = []
        monkeypatch.setattr(V.F, "sequence", lambda a, b: (met.append(b), plain(a, b))[1])
        V.top_k(rows, rows.withColumnRenamed("id", "query_id"), 1, "id")
        return spark.range(1).select(*[(m + 1).alias(f"b{i}") for i, m in enumerate(met)]).first()

    plain = V.F.sequence
    assert tuple(blocks(4_000, 1)) == (1, 1)
    # Four cores: eight by eight pairs.
    assert tuple(blocks(60_000, 1)) == (8, 8) and tuple(blocks(9_000, 1)) == (3, 3)
    monkeypatch.setattr(V, "PAIRS_PER_CORE", 0)
    assert tuple(blocks(60_000, 1)) == (1, 1) and tuple(blocks(66_000, 1)) == (2, 2)
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 1000)
    assert tuple(blocks(500, 10)) == (5, 5)
