"""The registered queries: those with SQL against it, all of them on the smallest data."""

import zlib

import pytest

from seatflow.llm.queries import QUERIES, SQL
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_answer(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", ["op4_language_id", "op5_quality_cnn", "op7_toxicity"])
def test_scores_every_document(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    by, held = {"op4_language_id": (3, 1)}.get(name, (5, 0))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % by == held) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    if name != "op4_language_id":
        line = {"op5_quality_cnn": 0.3, "op7_toxicity": 0.5}[name]
        assert all(r["predicted"] == int(r["score"] >= line) for r in rows)


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
