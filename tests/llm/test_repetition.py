"""Suffix arrays against sorting, and the rules against a brute-force reading of each text."""

import random
import re

import numpy as np
import pytest

from seatflow.llm import repetition as R
from seatflow.llm.suffixes import common_prefixes, suffix_order

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, c0 int"


def by_hand(text, rules):
    """All figures of a text, by looking at every window."""
    data = (text or "").encode()
    words = WORD.findall(data)
    n = len(words)

    def windows(k):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(words[i : i + k]), []).append(i)
        return {i + j for places in seen.values() if len(places) > 1 for i in places for j in range(k)}

    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    longest = max((k for k in range(1, n) if windows(k)), default=0)
    inside = sorted(windows(rules.repeat)) if n else []
    spans = [[x, 1] for x in inside if x - 1 not in inside]
    for x in spans:
        while x[0] + x[1] in inside:
            x[1] += 1
    repeated = len(windows(rules.window)) if n else 0
    failed = n < rules.fewest or 100 * repeated > rules.most_in_windows * n
    kept = not failed and 100 * len(inside) <= rules.most_covered * n and longest <= rules.longest
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(inside), longest, spans, failed, kept


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 30, 300):
        keys = np.append(rng.integers(1, 4, n), 0)
        order, levels = suffix_order(keys, keep_levels=True)
        want = sorted(range(len(keys)), key=lambda i: keys[i:].tolist())
        assert order.tolist() == want
        for x, y, common in zip(want, want[1:], common_prefixes(order, levels)[1:], strict=False):
            k = 0
            while keys[x + k] == keys[y + k]:
                k += 1
            assert common == k


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "one", "a a a a a a a", "a b " * 60, "x\n\nx\nx \n\n", "é#ü *$%&|<>  word"]
    for size in (5, 40, 60, 120, 200):
        for letters in (2, 6, 40, 300):
            words = [f"w{rng.randrange(letters)}" for _ in range(size)]
            out.append("".join(w + rng.choice([" ", " ", "\n", "\t", "  "]) for w in words))
    passage = " ".join(f"p{i}" for i in range(30))
    other = " ".join(f"q{i}" for i in range(90))
    out += [f"{passage} {other} {passage}", f"{other} {passage} x {passage[3:]}", "s " * 5000]
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 21, 64])
def test_figures_and_verdicts(spark, rows, monkeypatch, slice_bytes):
    monkeypatch.setattr(R, "SLICE_BYTES", slice_bytes)
    rules = R.Rules(repeat=5, longest=25)
    given = [(i, t, "x", 1) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in R.repetition(rows(given, SCHEMA), rules).collect()}
    assert len(got) == len(given)
    for i, text, *_ in given:
        r = got[i]
        if text and len(text) > 9000:  # by hand this takes too long
            assert (r["n_words"], r["longest_repeat"], r["n_repeat_words"]) == (5000, 4999, 5000)
            continue
        want = by_hand(text, rules)
        values = [r[c] for c in list(R.COLUMNS)[:-1]]
        spans = [[s["first"], s["words"]] for s in r["spans"]]
        assert (*values, spans, r["base_failed"], r["kept"]) == want, text
    kept = R.accepted(rows(given, SCHEMA), rules)
    assert kept.columns == ["doc_id", "text", "n_words", "c0"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_ids_rows_and_no_rows(rows):
    text = " ".join(f"w{i}" for i in range(80))
    got = R.repetition(rows([(None, text, "a", 1), (3, text, "a", 1), (3, text, "b", 2)], SCHEMA)).collect()
    assert len(got) == 3 and all(r["kept"] and r["spans"] == [] for r in got)
    assert R.repetition(rows([], SCHEMA)).count() == 0 and R.accepted(rows([], SCHEMA)).count() == 0
