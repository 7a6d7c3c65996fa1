"""Words of texts as numbers, and the order of their suffixes, in numpy.

A batch of texts is one sequence of numbers in which every text (or piece of one) ends in a
number of its own. So a comparison of two suffixes never runs over the end of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_set(values: bytes) -> np.ndarray:
    """Which of the 256 bytes are among these."""
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def runs(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``outside``; none goes over a text's end."""
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """``data`` cut into values of these sizes."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), buffers)


def numbered(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Equal values get equal numbers, from 0 on in the order they are met; and the values."""
    found = binaries(data, sizes).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and sizes of the runs of equal values."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(values)))


def suffix_order(keys: np.ndarray, keep_levels: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the suffixes in their order, by prefix doubling.

    Every sequence has to end in a key that occurs once. Suffixes that already stand alone
    are not sorted again. Level k numbers the suffixes by their first 2**k keys; levels are
    kept on request only. Fewer than 2**31 keys.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    first, size = _groups(keys[order])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first.astype(np.int32), size)
    levels = [rank.copy()] if keep_levels else []
    held = np.flatnonzero(np.repeat(size > 1, size)).astype(np.int32)
    reach = 1
    while len(held):
        at = order[held]
        key = rank[at].astype(np.int64) * n + rank[at + reach]
        turn = np.argsort(key, kind="stable")
        at = at[turn]
        first, size = _groups(key[turn])
        del key, turn
        order[held] = at
        rank[at] = np.repeat(held[first], size)
        if keep_levels:
            levels.append(rank.copy())
        held = held[np.repeat(size > 1, size)]
        reach *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of each suffix and the one before it in the order."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    pairs = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[pairs - 1], order[pairs]
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        step = same.astype(np.int32) << k
        out[pairs] += step
        a, b = a + step, b + step
    return out
