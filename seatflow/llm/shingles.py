"""Sets of word shingles as 64-bit hashes, computed over batches of texts in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 3
#: Bytes that are hashed at a time.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        found = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in bases]
        _POWERS[:] = found
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts, number of words of each text).

    A word is a run of bytes that are not ASCII white space, with A-Z in lower case. Its hash
    is a polynomial of its bytes, taken from running sums; sums over a piece end at its words.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    text = 0
    while text < len(counts):
        upto = max(text + 1, int(np.searchsorted(offsets, offsets[text] + PIECE, "right")) - 1)
        first, last = int(offsets[text]), int(offsets[upto])
        if upto == text + 1 and last - first > PIECE:
            for part in _parts_of(data[first:last]):
                found, _ = _hash_piece(part, np.array([0, len(part)]))
                hashes.append(found)
                counts[text] += len(found)
        elif last > first:
            found, n = _hash_piece(data[first:last], offsets[text : upto + 1] - first)
            hashes.append(found)
            counts[text:upto] = n
        text = upto
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def _parts_of(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text that end at white space, about a piece each."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            after = np.flatnonzero(_SPACE[data[end : end + PIECE]])
            end = end + int(after[0]) if len(after) else min(end + PIECE, len(data))
        yield data[at:end]
        at = end


def _hash_piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * power[: len(data)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverse[starts]
    found = mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return found, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, its distinct shingle hashes, sorted) of every text that has a word.

    A shingle is ``width`` words in a row; a text with fewer words is one shingle as a whole.
    """
    first = 0
    while first < len(offsets) - 1:  # a piece of texts at a time, so that little is held
        upto = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        words, counts = word_hashes(data, offsets[first : upto + 1])
        ends = np.cumsum(counts)
        if len(words) >= width:
            runs = np.zeros(len(words) - width + 1, np.uint64)
            for i in range(width):
                runs = mix(runs * np.uint64(3) + words[i : len(words) - width + 1 + i] + np.uint64(i))
        for text in np.flatnonzero(counts):
            n, end = int(counts[text]), int(ends[text])
            if n >= width:
                yield first + int(text), np.unique(runs[end - n : end - width + 1])
            else:
                whole = np.array([n], np.uint64)
                for i in range(end - n, end):
                    whole = mix(whole * np.uint64(5) + words[i : i + 1])
                yield first + int(text), whole
        first = upto
