import bisect
import heapq
import itertools
import random
import re

import numpy as np
import pytest

from seatflow.llm import ngram_join
from seatflow.llm.components import component_roots
from seatflow.llm.ngram_join import Index, forest, overlap, prefix_of, shared_of, smallest_partner
from seatflow.llm.shingles import shingle_sets


def shingles(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=90, width=3):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(sets[x]), least.get(find(x))) for x, (i, _) in enumerate(rows)), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "日本"]
    common = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30, 120, 400]))]
        if rng.random() < 0.3:
            base = common.split() + base
        for _ in range(rng.choice([1, 1, 2, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            sep = rng.choice([" ", "  ", "\n", "\t"])
            rows.append((len(rows) * 7 % 1000, sep.join(copy).upper() if rng.random() < 0.2 else sep.join(copy)))
    return rows + [(2001, None), (2002, ""), (2003, " \n"), rows[5], (2004, "a b"), (2005, "A  B"), (2006, "a b c")]


@pytest.mark.parametrize(("seed", "percent", "width"), [(1, 90, 3), (2, 80, 5), (3, 90, 3), (4, 90, 3)])
def test_groups(spark, rows, monkeypatch, seed, percent, width):
    if seed == 2:  # ids are joined by shuffle
        monkeypatch.setattr(ngram_join, "SENT_IDS", 0)
    if seed == 3:  # parts of a few texts that meet two at a time
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    if seed == 4:  # parts so small that units are better left as they are
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 20)
    data = corpus(seed)
    frame = rows([(i, t, 1, 2) for i, t in data], "doc_id long, text string, unit int, a int").repartition(3)
    got = ngram_join.join_groups(frame, percent, width).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(data, percent, width)


def test_first_of_each_group_stays_with_its_columns(spark, rows):
    data = [(4, "a b c d", 1), (2, "A b  c d", 2), (2, "A b  c d", 3), (9, None, 4), (8, "x y z", 5), (7, None, 6)]
    kept = ngram_join.first_of_groups(rows(data, "doc_id long, text string, row int"))
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8, 9]


@pytest.mark.parametrize("sent", [0, 1 << 21])
def test_first_of_groups_keeps_other_texts_of_an_id(rows, monkeypatch, sent):
    monkeypatch.setattr(ngram_join, "SENT_IDS", sent)
    data = [(1, "a b c d", 1), (1, "a b c d", 1), (1, "p q r s", 2), (None, "a b c d", 3), (None, "k l m n", 4)]
    data += [(None, "k l m n", 5), (None, "", 6), (None, None, 7), (3, "p q r s", 8)]
    got = ngram_join.first_of_groups(rows(data, "doc_id long, text string, id int"))
    got = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=repr)
    assert got == sorted([(1, "a b c d"), (1, "p q r s"), (None, "k l m n"), (None, "")], key=repr)


def test_null_ids_and_empty_tables(spark, rows):
    data = [(None, "a b c d"), (5, "a b c d"), (None, "p q r s"), (None, None)]
    got = ngram_join.join_groups(rows(data, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(None, 2, 5), (5, 2, 5), (None, 2, None), (None, 0, None)], key=repr)
    assert ngram_join.join_groups(rows([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_search_finds_all_partners(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(10_000, 60, replace=False)
    sets = []
    for _ in range(80):
        keep = base[rng.random(60) > rng.choice([0, 0.03, 0.1, 0.4])]
        sets.append(np.unique(np.concatenate([keep, rng.choice(20_000, rng.integers(0, 6))])).astype(np.uint64))
    sets.sort(key=len)
    index = Index(sets)
    for x in range(len(sets)):
        mask = np.arange(len(sets)) > x
        want = [
            y for y in range(x + 1, len(sets))
            if len(np.intersect1d(sets[x], sets[y])) >= overlap(len(sets[x]), len(sets[y]))
        ]
        assert index.partners(x, mask, 90).tolist() == want
    edges = forest(sets, None, 90)
    assert len(edges) <= len(sets) - 1


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_prefixes_of_similar_sets_share_enough(percent):
    """Enough that each set may leave out all but one of what it has to share."""
    rng = np.random.default_rng(percent)
    tried = 0
    for _ in range(3000):
        n = int(rng.choice([*range(1, 30), 40, 60, 100, 200, 333]))
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        other = base[rng.random(len(base)) > rng.choice([0.02, 0.05, 0.1])]
        other = np.unique(np.concatenate([other, rng.integers(0, 2**64, rng.integers(0, 2 + n // 12), dtype=np.uint64)]))
        common = len(np.intersect1d(base, other))
        if len(other) and 100 * common >= percent * (len(base) + len(other) - common):
            tried += 1
            both = set(prefix_of(base, percent)) & set(prefix_of(other, percent))
            assert len(both) >= max(shared_of(smallest_partner(len(x), percent)) for x in (base, other))
    assert tried > 150


@pytest.mark.parametrize("seed", range(4))
def test_merging_and_probing_as_told(seed):
    """Partners as found by a heap over the short lists and binary probes of the long ones."""
    rng = np.random.default_rng(seed)
    core = rng.choice(5_000, 50, replace=False)
    sets = [np.unique(np.concatenate([core[rng.random(50) > 0.08], rng.choice(9_000, 4)])).astype(np.uint64) for _ in range(60)]
    sets.sort(key=len)
    index = Index(sets)
    lists = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            lists.setdefault(x, []).append(i)
    for x, s in enumerate(sets):
        mine = sorted((lists[t] for t in s.tolist()), key=len)
        sizes = [len(y) for y in sets]
        least = int(overlap(len(s), min(sizes[x + 1 :], default=1), 90))
        aside = min(int(least / (ngram_join.MU * np.log2(len(mine[-1]) + 1) + 1)), least - 1)
        found = []
        for y, run in itertools.groupby(heapq.merge(*mine[: len(mine) - aside])):
            seen = len(list(run))
            if y <= x or seen < least - aside:
                continue
            for long in mine[len(mine) - aside :]:
                at = bisect.bisect_left(long, y)
                seen += at < len(long) and long[at] == y
            if seen >= overlap(len(s), sizes[y], 90):
                found.append(y)
        assert index.partners(x, np.arange(len(sets)) > x, 90).tolist() == found


def test_overlap_is_the_threshold():
    for nx in range(1, 40):
        for ny in range(nx, 45):
            least = next((c for c in range(nx + ny) if 100 * c >= 90 * (nx + ny - c)))
            assert overlap(nx, ny) == least


def test_sets_do_not_depend_on_neighbours_or_pieces(monkeypatch):
    from seatflow.llm import shingles as S

    texts = ["a b c d", "", "x", "Y z", "word " * 50, "e" * 90 + " f g h"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    together = {t: s.tolist() for t, s in shingle_sets(data, offsets)}
    monkeypatch.setattr(S, "PIECE", 16)
    apart = {}
    for i, r in enumerate(raw):
        for _, s in shingle_sets(np.frombuffer(r, np.uint8), np.array([0, len(r)])):
            apart[i] = s.tolist()
    assert together == apart and [len(together.get(i, [])) for i in range(6)] == [2, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    pairs = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(0, i) for i in range(1, 30)] + [(50, 51)],
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)],
    }[shape]
    got = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(pairs, "u long, v long")).collect()}
    least = {x: x for p in pairs for x in p}
    for _ in range(100):
        for u, v in pairs:
            least[u] = least[v] = min(least[u], least[v])
    assert got == {x: m for x, m in least.items() if x != m}
