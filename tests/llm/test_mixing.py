import hashlib
import math
import random
import re

import pytest

from seatflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, figures int, copy int"


def brute(rows, max_epochs=3, weights=(1, 2, 3), seed=mixing.SEED):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(z for z, r in zip(sizes, rows) if r[2] == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes))
    while free:
        level = left / sum(weight[n] for n in free)
        full = {n for n in free if max_epochs * total[n] < weight[n] * level}
        if not full:
            target |= {n: weight[n] * level for n in free}
            break
        target |= {n: max_epochs * total[n] for n in full}
        left -= sum(target[n] for n in full)
        free -= full
    out = []
    for n in names:
        own = {}
        for z, (i, _, s) in zip(sizes, rows):
            if s == n:
                key = hashlib.md5(f"{'null' if i is None else i}/{seed}".encode()).hexdigest()
                own.setdefault(key, []).append((i, z))
        whole = math.floor(target[n] / total[n]) if total[n] else 0
        need, passed = target[n] - whole * total[n], 0
        for key in sorted(own):
            size = sum(z for _, z in own[key])
            times = whole + (2 * passed + size <= 2 * need)
            out += [(i, z, total[n], target[n], z * times) for i, z in own[key]]
            passed += size
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    sources = ["hot"] * 30 + ["b", "é", "Z", None, "tiny", "a b"]
    rows = [(i, " \t\n".join(["w"] * rng.randrange(0, 40)), rng.choice(sources)) for i in range(n)]
    return rows + [(n, None, "hot"), (n + 1, "", None), (None, "x y", "b"), (None, "x", "b"), rows[3], rows[3], (n + 2, "", "empty")]


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


@pytest.mark.parametrize("seed", [1, 2])
def test_sizes_and_targets(spark, rows, seed):
    data = corpus(seed)
    frame = rows([(*r, 1, 2) for r in data], SCHEMA).repartition(4)
    found = mixing.mix_sizes(frame).collect()
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in found]
    close(got, brute(data))
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    for name in {r[2] for r in data}:
        own = [r for r in found if r["source"] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_rows_are_repeated_with_all_columns(spark, rows):
    data = corpus(5, 60)
    frame = rows([(*r, 1, 2) for r in data], SCHEMA)
    times = {r["doc_id"]: r["repeats"] for r in mixing.mix_sizes(frame).collect()}
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    seen = {}
    for r in mixed.collect():
        assert (r["figures"], r["copy"]) == (1, 2)
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    rows_of = {}
    for i, _, _ in data:
        rows_of[i] = rows_of.get(i, 0) + 1
    assert seen == {i: n * times[i] for i, n in rows_of.items() if times[i]}


def test_a_very_long_text_counts_with_all_its_words(spark, rows):
    data = [(1, "long " * 300_000, "a"), (2, "b c", "a"), (3, "d e f", "b")]
    got = mixing.mix_sizes(rows([(*r, 0, 0) for r in data], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == sorted(brute(data))
    assert max(r["size"] for r in got) == 300_000


def test_nothing_to_mix(spark, rows):
    assert mixing.mix_sizes(rows([], SCHEMA)).count() == 0
    found = mixing.mix_sizes(rows([(1, "", "a", 1, 1), (2, None, None, 1, 1)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in found] == [(0, 0.0, 0)] * 2
