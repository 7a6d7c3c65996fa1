"""The index against direct counting, and whole results against a brute-force version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from seatflow.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, shard int"


def test_rows_of_an_index_go_on_in_their_suffixes():
    rng = np.random.default_rng(2)
    symbols = np.where(rng.random(500) < 0.2, 0, rng.integers(1, 5, 500)).astype(np.int32)
    symbols[-1] = 0
    index = C.Index(C.transform(symbols))
    deep = index.first
    rows = [(int(x),) for x in index.first]
    for depth in range(2, 5):
        deep, starts = index.extended(deep)
        rows = [(int(index.first[i]), *rows[index.next[i]]) for i in range(len(rows))]
        sizes = np.diff(np.append(starts, len(rows)))
        got = {rows[s]: int(n) for s, n in zip(starts, sizes, strict=True) if 0 not in rows[s]}
        want = Counter(tuple(symbols[i : i + depth].tolist()) for i in range(500 - depth + 1))
        assert got == {k: n for k, n in want.items() if 0 not in k}


def by_hand(given, least, percent, top):
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in given:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    known = {k: n for k, n in counts.items() if len(k) > 2 and n >= least}
    covered = Counter()
    for (lang, *words), n in known.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, *words[i : i + k])
                covered[part] = max(covered[part], n)
    found = {}
    for (lang, *words), a in known.items():
        if 100 * covered[(lang, *words)] >= percent * a:
            continue
        cuts = [(counts[(lang, *words[:k])], counts[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, (left, right) = min((2_000_000 * a // sum(c), k, c) for k, c in enumerate(cuts))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = set()
    for lang, rows in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def corpus():
    rng = random.Random(5)
    out = [(None, None, None, "x", 1), (1, "", "en", "x", 1), (2, "., ;\n", "en", "x", 1)]
    for i in range(240):
        words = [rng.choice(["the", "The", "of", "a", "New", "york", "city", "état", f"w{rng.randrange(30)}"]) for _ in range(60)]
        words += ["one", "two", "three", "four", "five"] * rng.randrange(3)
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", "\n", ". "]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und"]), "x", 1))
    return [*out, out[-1], out[-1], (9, "new york " * 4000, "en", "x", 1)]


@pytest.mark.parametrize(("shard", "parts", "top"), [(1 << 21, 1, 2000), (700, 3, 2000), (97, 4, 12)])
def test_result_by_hand(rows, monkeypatch, shard, parts, top):
    monkeypatch.setattr(C, "ROW_SYMBOLS", 64)
    monkeypatch.setattr(C, "SLICE_BYTES", 500)
    given = corpus()
    frame = rows(given, SCHEMA).repartition(parts)
    got = C.collocations(frame, least=15, inside_percent=70, top=top, shard_words=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(set(got)) == len(got)
    assert set(got) == by_hand(given, 15, 70, top)


def test_no_rows_and_nothing_frequent(rows):
    assert C.collocations(rows([], SCHEMA)).count() == 0
    assert C.collocations(rows([(1, "a b c", "en", "x", 1)], SCHEMA)).count() == 0


def test_scores_are_exact_beyond_64_bits(rows):
    from pyspark.sql import functions as F

    a, left, right = 9_007_199_254_740_993, 9_007_199_254_740_995, 9_223_372_036_854_775_807
    got = rows([(a, left, right)], "a long, l long, r long").select(C._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 2_000_000 * a // (left + right)
