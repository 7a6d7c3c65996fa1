"""Every stage of the pipeline, and run(), against a plain reading of the same rows."""

import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as C
from seatflow.llm import deobfuscate, quality
from seatflow.llm.common import table
from tests.llm.test_ngram_join import brute, shingles

SF = "/root/testdata/sf0.001"


def naive_chance(network, text):
    """Score of a text: every filter at every place of every window, one after the other."""
    data, shape = (text or "").encode(), network.shape
    total, weight = np.zeros(2), 0
    wide = max(shape.widths)
    starts = [0] if data else []
    while starts and starts[-1] + shape.window < len(data):
        starts.append(starts[-1] + shape.hop)
    for start in starts:
        size = min(shape.window, len(data) - start)
        window = data[start : start + shape.window + wide - 1].ljust(shape.window + wide - 1, b"\0")
        best = np.full(network.kernel.shape[1], -np.inf)
        for at in range(shape.window):
            patch = np.concatenate([network.table[b] for b in window[at : at + wide]])
            best = np.maximum(best, patch @ network.kernel)
        total += size * (np.maximum(best + network.bias, 0) @ network.out)
        weight += size
    logits = total / max(weight, 1) + network.prior
    return float(np.exp(logits[1]) / np.exp(logits).sum())


def naive_toxic(scorer, text):
    weights = []
    for token in deobfuscate.tokens_of(text or ""):
        words = deobfuscate.words_of(token, scorer.model)
        weights.append(max([0.0] + [scorer.weights.get(f, 0.0) for w in words for f in deobfuscate.features_of(w)]))
    evidence = sum(sorted(weights)[-scorer.strongest :])
    return float(1 / (1 + np.exp(-(scorer.slope * evidence + scorer.level))))


def first_ones(docs):
    groups = {i: least for i, _, least in brute([(d["doc_id"], d["text"]) for d in docs], C.SHARED_PERCENT, C.SHINGLE_WORDS)}
    return [d for d in docs if not shingles(d["text"], C.SHINGLE_WORDS) or groups[d["doc_id"]] == d["doc_id"]]


def mixed(docs):
    import re

    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    total = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources}
    full, level = set(), None
    while True:  # sources above their cap are full; the others share what is left
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        level = Fraction(rest, sum(weight[s] for s in sources if s not in full))
        more = {s for s in sources if s not in full and weight[s] * level > 3 * total[s]}
        if not more:
            break
        full |= more
    out = Counter()
    for s in sources:
        target = min(weight[s] * level, 3 * total[s])
        whole = target // total[s] if total[s] else 0
        need, before = target - whole * total[s], 0
        key = lambda d: hashlib.md5(f"{d['doc_id']}/mix-1".encode()).hexdigest()
        for d in sorted((d for d in docs if d["source"] == s), key=key):
            n = size[d["doc_id"]]
            times = int(whole) + (2 * before + n <= 2 * need)
            before += n
            if times:
                out[d["doc_id"]] += times
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_and_run_by_hand(spark, documents):
    labels = C._labels(spark, SF)
    network = quality.train(documents, labels)
    rows = [r.asDict() for r in documents.collect()]
    chances = {d["doc_id"]: naive_chance(network, d["text"]) for d in rows}
    scores = {r["doc_id"]: r["score"] for r in quality.score(documents, network).collect()}
    assert max(abs(scores[i] - c) for i, c in chances.items()) < 1e-4
    rows = [d for d in rows if chances[d["doc_id"]] >= quality.THRESHOLD]
    docs = C.stored(C.good_quality(spark, documents, SF), "by-hand")
    assert ids(docs) == Counter(d["doc_id"] for d in rows)

    scorer = deobfuscate.train(docs, labels)
    rows = [d for d in rows if naive_toxic(scorer, d["text"]) < deobfuscate.THRESHOLD]
    docs = C.stored(C.not_toxic(spark, docs, SF), "by-hand")
    assert ids(docs) == Counter(d["doc_id"] for d in rows)

    before, rows = len(rows), first_ones(rows)
    assert len(rows) < before
    docs = C.stored(C.without_copies(spark, docs, SF), "by-hand")
    assert ids(docs) == Counter(d["doc_id"] for d in rows)
    assert sorted(map(repr, docs.collect())) == sorted(
        map(repr, documents.where(documents["doc_id"].isin([d["doc_id"] for d in rows])).collect())
    )

    times = mixed(rows)
    assert ids(C.mixed(spark, docs, SF)) == times and max(times.values()) <= 3

    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    text = {d["doc_id"]: d["text"] or "" for d in rows}
    want = Counter()
    for i, n in times.items():
        want[i, tuple(library.encode(text[i]))] += n
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in C.run(spark, SF).collect())
    assert got == want
