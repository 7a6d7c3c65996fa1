import random

import numpy as np
import pyarrow as pa
import pytest

from seatflow.llm import byte_cnn, lang_id, quality
from seatflow.llm.common import text_bytes

SHAPE = byte_cnn.Shape(window=32, hop=24, filters=8)


def texts(seed, n):
    rng = random.Random(seed)
    sounds = {"xa": ["ka", "ko", "ri", "na"], "yb": ["sch", "ung", "lich", "ß"], "zc": ["ção", "lha", "em", "os"]}
    out = []
    for i in range(n):
        name = rng.choice(sorted(sounds))
        out.append((i, " ".join("".join(rng.choice(sounds[name]) for _ in range(3)) for _ in range(rng.randrange(3, 60))), name))
    return out


def test_windows_cover_every_byte():
    raw = [b"", b"abc", bytes(range(1, 33)), bytes(range(1, 250)), b"z" * 56]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    seen = [set() for _ in raw]
    rows = {i: [] for i in range(len(raw))}
    for number, sizes, windows in byte_cnn.windows_of(data, offsets, SHAPE, at_once=3):
        for t, n, w in zip(number, sizes, windows):
            start = len(rows[t]) * SHAPE.hop
            rows[t].append(w)
            reach = raw[t][start : start + len(w)]
            assert bytes(w) == reach + bytes(len(w) - len(reach))
            assert n == min(SHAPE.window, len(raw[t]) - start)
            seen[t] |= set(range(start, start + n))
    assert all(s == set(range(len(r))) for s, r in zip(seen, raw))


def test_texts_are_scored_alike_in_any_batch():
    rng = np.random.default_rng(1)
    windows = rng.integers(1, 255, (40, 35)).astype(np.uint8)
    network = byte_cnn.fit(windows, np.arange(40), np.arange(40) % 2, [0, 1], SHAPE, steps=5)
    some = ["", "a", "é" * 70, "long " * 100]
    alone = [network.text_logits(*text_bytes(pa.array([t]))) for t in some]
    assert np.allclose(network.text_logits(*text_bytes(pa.array(some))), np.concatenate(alone), atol=1e-5)


def test_languages(spark, rows):
    schema = "doc_id long, text string, lang string, n0 int"
    known = [(*r, 1) for r in texts(1, 200)] + [(900, None, "xa", 1), (901, "ka", None, 1), (None, "ka", "xa", 1)]
    network = lang_id.train(rows(known, schema), lang_id.Training(per_language=50, steps=120), SHAPE)
    assert network.classes == ["xa", "yb", "zc"]
    asked = texts(2, 60)
    odd = [(None, "kana riko", None), (700, None, None), (701, "", None), (702, "12 34 !?", None), (5, asked[5][1], None)]
    got = lang_id.identify(rows([(*r, 1) for r in asked + odd], schema), network).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert np.mean([by[i][0] == name for i, _, name in asked]) >= 0.95
    assert by[700] == by[701] == by[702] == ["und"] and by[None] == ["xa"] and len(by[5]) == 2


def test_without_languages_all_is_undetermined(spark, rows):
    docs = rows([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lang_id.train(docs) is None
    assert [tuple(r) for r in lang_id.identify(docs, None).collect()] == [(1, "und", 0.0)]
    assert lang_id.identify(docs.limit(0), None).count() == 0


@pytest.fixture(scope="module")
def graded():
    out = []
    for i, text, _ in texts(3, 240):
        good = i % 3 > 0
        out.append((i, text if good else text.upper().replace(" ", "!! "), int(good)))
    return out


def test_quality(spark, rows, graded):
    docs = rows([(i, t, 0.5, "r") for i, t, _ in graded], "doc_id long, text string, score double, c0 string")
    labels = rows([(i, y, None) for i, _, y in graded[:160]] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    network = quality.train(docs, labels, quality.Training(per_label=60, steps=80), SHAPE)
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, network).collect()}
    assert np.mean([(score[i] >= 0.3) == bool(y) for i, _, y in graded[160:]]) >= 0.95
    kept = quality.accepted(docs, network)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in score.items() if s >= 0.3}
    odd = rows([(1, None), (1, ""), (None, "ka")], "doc_id long, text string")
    assert quality.score(odd, network).count() == 3
    assert quality.score(odd.limit(0), network).count() == 0


def test_without_labels_nothing_is_rejected(spark, rows):
    docs = rows([(1, "abc")], "doc_id long, text string")
    network = quality.train(docs, rows([], "doc_id long, quality int, toxic int"))
    assert network is None and quality.accepted(docs, network).count() == 1


def test_held_out_accuracy(spark):
    """Learned from the other rows, the held-out ones of the given data are told apart."""
    from seatflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op4_language_id"](spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = QUERIES["op5_quality_cnn"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in found]) >= 0.9
