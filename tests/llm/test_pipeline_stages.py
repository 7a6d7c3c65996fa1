import pytest

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    out = C.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == sizes[4] and all(r["n_ids"] == len(r["ids"]) > 0 for r in out)
    mixed = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert sorted(r["doc_id"] for r in out) == mixed


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES[:-1]], ids=[n for n, _ in C.STAGES[:-1]])
def test_stages_take_odd_documents(spark, rows, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    data = [(1, None, None, None, None, 0.1), (2, "", "en", "a", 0, None), (None, "the word", "en", "a", 8, None)]
    data += [(4, "the word " * 30_000, "en", "a", 5, None), (5, "again and again", "en", None, 5, 1.0)] * 2
    given = rows(data, schema)
    got = stage(spark, given, SF)
    assert got.columns == given.columns
    assert {(r["doc_id"], r["text"]) for r in got.collect()} <= {(r[0], r[1]) for r in data}
    assert stage(spark, given.limit(0), SF).count() == 0
