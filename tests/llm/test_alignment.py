"""Matrix products against dense ones, and alignments against a reading token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from seatflow.llm import alignment as A
from seatflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row string, n0 int"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    return A.Tokenizers.load()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.B_PATH)


def test_product_of_sparse_matrices():
    rng = np.random.default_rng(4)
    for _ in range(30):
        m, k, n = rng.integers(1, 9, 3)
        dense = [rng.random((m, k)) < 0.4, rng.random((n, k)) < 0.4]
        a, b = (A.Rows(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], int(k)) for d in dense)
        want = dense[0].astype(int) @ dense[1].T.astype(int)
        rows, columns, values = A.product(a, b.transposed())
        got = np.zeros_like(want)
        got[rows, columns] = values
        assert (got == want).all() and (values > 0).all() and len(rows) == (want > 0).sum()


def spans(libraries, both, text):
    """(id, first byte, end) of both tokenizers' tokens, or none."""
    if not text:
        return [], []
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    out = []
    for ids, spelled in ((a, both.a_bytes), (b, both.b_bytes)):
        if b"".join(spelled[i] for i in ids) != b" " + text.encode():
            return [], []
        at, found = 0, []
        for i in ids:
            found.append((i, at, at + len(spelled[i])))
            at = found[-1][2]
        out.append(found)
    return tuple(out)


def figures(libraries, both, given):
    read, counts = [spans(libraries, both, t) for _, t, *_ in given], Counter()
    for a, b in read:
        ends = {e: i for i, _, e in b}
        counts.update((i, ends[e]) for i, _, e in a if e in ends)
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    out = []
    for (doc, *_), (a, b) in zip(given, read, strict=True):
        ends = {e: i for i, _, e in b}
        links = [(i, ends[e]) for i, _, e in a if e in ends]
        cuts, groups, at = [e for _, _, e in a if e in ends], [], 0
        for cut in cuts:
            sides = [",".join(str(i) for i, s, e in side if at < e <= cut) for side in (a, b)]
            groups.append("|".join(sides))
            at = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((doc, len(a), len(b), len(cuts), len(links), best, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def odd_texts():
    out = [None, "", " ", "\n\n", "\t a", "<|endoftext|> </s><s> <unk> <0x41>", "▁ under", "naïve café ☃ \U0001f600 x", "a\u0000b"]
    out += ["I'm we'll THEY'RE 123,456.7   x  y   z\r\n", "日本語のテキスト。" * 5, "́​﻿", "é ﬁ Ⅷ"]
    return out + ["word " * 3000, "abcdefgh" * 500]


@pytest.mark.parametrize(("size", "sent"), [(1 << 20, 1 << 20), (40, 0)])
def test_figures_of_odd_texts(rows, monkeypatch, both, libraries, size, sent):
    monkeypatch.setattr(A, "SLICE_BYTES", size)
    given = [(i, t, "x", 1) for i, t in enumerate(odd_texts())] + [(None, "the word", "x", 1), (3, "the word", "y", 2)] * 2
    got = A.alignment_figures(rows(given, SCHEMA).repartition(3), both, sent)
    assert sorted(map(tuple, got.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr
    ) == figures(libraries, both, given)
    assert A.alignment_figures(rows([], SCHEMA), both).count() == 0


def test_query_by_hand(spark, both, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_alignment"](spark, SF)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == figures(libraries, both, docs)


@pytest.mark.parametrize("kind", ["overlap", "group", "end"])
def test_links(rows, both, libraries, kind):
    given = [(i, t, "x", 1) for i, t in enumerate([*odd_texts()[:-2], "tokenization of pseudopseudohypoparathyroidism"])]
    got = {r["doc_id"]: r for r in A.align(rows(given, SCHEMA), both, kind).collect()}
    for i, text, *_ in given:
        a, b = spans(libraries, both, text)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        group = lambda e: sum(c < e for c in cuts)
        want = {}
        for x, (_, s, e) in enumerate(a):
            for y, (_, t, f) in enumerate(b):
                shared = {"overlap": min(e, f) - max(s, t), "group": int(group(e) == group(f)), "end": int(e == f)}[kind]
                if shared > 0:
                    want[x, y] = shared
        assert got[i]["a_ids"] == [x for x, *_ in a] and got[i]["b_ids"] == [x for x, *_ in b]
        assert {(x["a"], x["b"]): x["n"] for x in got[i]["links"]} == want
    assert A.align(rows([], SCHEMA), both, kind).count() == 0
