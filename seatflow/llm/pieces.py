"""SentencePiece encoding and decoding by max-plus products of chunk matrices.

A text's encoding is the path of pieces with the highest sum of scores. A giant text is cut
into chunks of fixed length. A piece may reach over a chunk's end, so the state at a boundary
is how many characters of the next chunk are already covered, and a chunk amounts to a matrix
from states to states: the best score of a path through it. Matrices are combined by the
associative max-plus product, which gives the best score of every boundary state; with these
each chunk finds where its paths come from, and once the states that the best path passes are
known, each chunk is traced back on its own.

All other texts are one chunk. No piece of such a vocabulary reaches over certain places (in
front of a word mark, around a line feed), so the parts between them are solved one by one
and remembered.

A vocabulary made for merges has ranks for scores, which may not be summed. Its encoding still
is one path: of all sequences of pieces it is the only one whose neighbours, merged on their
own, stay as they are, for the first merge across a border would happen in the two pieces
beside it as well. So a state is the whole piece at the boundary instead of its overlap, a
step scores 0 if the two pieces fit and never otherwise, and the same products find the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm.common import stored

#: The word mark, which stands for a space.
MARK = "▁"
_FACTOR = 0x9E3779B97F4A7C15
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 32_768
#: Texts whose ids are made, and handed on, at a time.
SLICE = 512
CHUNKS = 32
#: Parts that a worker remembers at most, and characters of those that are solved together.
REMEMBERED = 250_000
TOGETHER_CHARS = 32
#: An unknown character scores this much below the lowest piece.
UNKNOWN_BELOW = 10.0
NEVER = -np.inf


@dataclass
class Vocabulary:
    """Pieces with ids and scores; bytes spell what no piece covers."""

    texts: list[str]  # by id; what the piece looks like, also for bytes and control pieces
    scores: dict[str, float]  # of the pieces that texts are cut into
    ids: dict[str, int]
    byte_ids: list[int]  # of the 256 bytes
    silent: frozenset[int]  # control and unknown pieces, which decode to nothing
    merges: bool = False  # the scores give the order of merges and are not summed

    @classmethod
    def load(cls, path: str = MODEL_PATH, merges: bool = False) -> Vocabulary:
        """Pieces and scores of a SentencePiece model file that has byte pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        everything = range(model.get_piece_size())
        texts = [model.id_to_piece(i) for i in everything]
        silent = frozenset(i for i in everything if model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        plain = [i for i in everything if i not in silent and not model.is_byte(i)]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in byte_ids):
            raise ValueError("the vocabulary has no byte pieces")
        scores = {texts[i]: float(model.get_score(i)) for i in plain}
        made = cls(texts, scores, {texts[i]: i for i in plain}, byte_ids, silent, merges)
        made.fingerprint  # noqa: B018 - once here instead of once a task
        return made

    @cached_property
    def fingerprint(self) -> str:
        """Of all that decides the ids."""
        told = (self.texts, list(self.scores.items()), list(self.ids.items()), self.byte_ids, sorted(self.silent), self.merges)
        return sha256(repr(told).encode()).hexdigest()

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.scores))

    @cached_property
    def unknown(self) -> float:
        return min(self.scores.values()) - UNKNOWN_BELOW

    @cached_property
    def letters(self) -> frozenset[str]:
        """Characters that are pieces."""
        return frozenset(p for p in self.scores if len(p) == 1)

    @cached_property
    def pairs(self) -> frozenset[str]:
        """Neighbours within a piece; between any others every path has a node."""
        return frozenset(p[i : i + 2] for p in self.scores for i in range(len(p) - 1))

    @cached_property
    def branches(self) -> dict[str, float]:
        """The scores of pieces, and never for what only starts a piece."""
        starts = {p[:n]: NEVER for p in self.scores for n in range(1, len(p))}
        return starts | self.scores

    @cached_property
    def parts(self) -> re.Pattern:
        """Cuts a text at places where it may always be cut."""
        mark_starts = not any(b == MARK and a != MARK for a, b in self.pairs)
        feed_alone = not any("\n" in p for p in self.pairs)
        if mark_starts and feed_alone:
            return re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        if mark_starts:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        return re.compile("(?s).+")

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that the ids decode to, one after the other, and their starts and lengths."""
        out = [b"" if i in self.silent else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        sizes = np.array([len(x) for x in out], np.int64)
        return np.frombuffer(b"".join(out), np.uint8), np.cumsum(sizes) - sizes, sizes

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash table of pieces and of what starts them: hashes, scores (never for mere
        starts) and ids; a hash stands at its own place or at the next free one behind it."""
        size = 1 << max(10, (4 * len(self.branches)).bit_length())
        keys, scores, ids = np.zeros(size, np.uint64), np.full(size, NEVER), np.full(size, -1, np.int32)
        for text, score in self.branches.items():
            key = 0
            for char in text:
                key = (key + ord(char) + 1) * _FACTOR % (1 << 64)
            at = key >> 64 - (size.bit_length() - 1)
            while keys[at]:
                if keys[at] == key:
                    raise ValueError("two pieces have one hash")
                at = (at + 1) % size
            keys[at], scores[at], ids[at] = key, score, self.ids.get(text, -1)
        return keys, scores, ids

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash table of neighbours that together are a piece: hashes, scores and ids of what they make."""
        ids = self.ids
        halves = [(p, p[:n], p[n:]) for p in self.scores for n in range(1, len(p)) if p[:n] in ids and p[n:] in ids]
        size = 1 << max(10, (4 * len(halves)).bit_length())
        keys, scores, made = np.zeros(size, np.uint64), np.full(size, NEVER), np.full(size, -1, np.int32)
        taken = {}
        for piece, left, right in halves:
            key = (ids[left] * len(self.texts) + ids[right] + 1) * _FACTOR % (1 << 64)
            at = key >> 64 - (size.bit_length() - 1)
            while at in taken:
                at = (at + 1) % size
            taken[at] = key, self.scores[piece], ids[piece]
        at = np.fromiter(taken, np.int64, len(taken))
        for column, values in zip((keys, scores, made), zip(*taken.values(), strict=True), strict=False):
            column[at] = np.array(values, column.dtype)
        return keys, scores, made

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (never if there is none) and ids of the pieces that neighbours make."""
        hashes = (left.astype(np.uint64) * np.uint64(len(self.texts)) + right.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR)
        at = _found(self.joins, hashes.ravel()).reshape(hashes.shape)
        return np.where(at >= 0, self.joins[1][at], NEVER), self.joins[2][at]

    @cached_property
    def fitting(self) -> dict[tuple[str, str], bool]:
        return {}

    def fits(self, left: str, right: str) -> bool:
        """Whether neighbours stay as they are when they are merged on their own; nothing may come in front."""
        found = self.fitting.get((left, right))
        if found is None:
            if len(self.fitting) >= REMEMBERED:
                self.fitting.clear()
            found = self.fitting[left, right] = merged(left + right, self) == ([left, right] if left else [right])
        return found

    def __getstate__(self) -> dict:
        names = ("texts", "scores", "ids", "byte_ids", "silent", "merges")
        return {k: self.__dict__[k] for k in names}

    def arcs(self, text: str, start: int) -> list[tuple[int, float]]:
        """(end, score) of the pieces that start here, the shortest first."""
        out = [(start + 1, self.scores.get(text[start], self.unknown))]
        for end in range(start + 2, len(text) + 1):
            score = self.branches.get(text[start:end])
            if score is None:
                break
            if score > NEVER:
                out.append((end, score))
        return out

    def spell(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.byte_ids[b] for b in piece.encode()]


def normalized(text: str) -> str:
    """Spaces become marks, and a mark comes first; the empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def best_path(text: str, vocabulary: Vocabulary) -> tuple[float, list[int]]:
    """The highest sum of scores, and the ends of its pieces.

    Of equal sums the one whose last piece is longest is kept, and so on backwards.
    """
    size = len(text)
    best, back = [NEVER] * (size + 1), [0] * (size + 1)
    best[0] = 0.0
    scores, branch, unknown = vocabulary.scores, vocabulary.branches.get, vocabulary.unknown
    for start in range(size):
        here = best[start]
        total = here + scores.get(text[start], unknown)
        if total > best[start + 1]:
            best[start + 1], back[start + 1] = total, start
        for end in range(start + 2, size + 1):
            score = branch(text[start:end])
            if score is None:
                break
            if here + score > best[end]:
                best[end], back[end] = here + score, start
    ends, at = [], size
    while at:
        ends.append(at)
        at = back[at]
    return best[size], ends[::-1]


def _found(table: tuple, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes in the table, -1 for those that are not in it."""
    keys = table[0]
    at = (hashes >> np.uint64(64 - (len(keys).bit_length() - 1))).astype(np.int64)
    seen = keys[at]
    out = np.where(seen == hashes, at, -1)
    open_ = np.flatnonzero((seen != hashes) & (seen != 0))
    while len(open_):
        at[open_] = (at[open_] + 1) % len(keys)
        seen = keys[at[open_]]
        hit = seen == hashes[open_]
        out[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit & (seen != 0)]
    return out


def best_paths(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """``best_path`` of texts of one length whose characters all are pieces, in step.

    Gives the scores and a matrix with the ids of the pieces, -1 in front where there are fewer.
    """
    n, size = len(texts), len(texts[0])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.uint64)
    table = vocabulary.table
    best = np.full((size + 1, n), NEVER)
    best[0] = 0.0
    back, last = np.zeros((size + 1, n), np.int64), np.full((size + 1, n), -1, np.int32)
    for start in range(size):
        rows, hashes = np.arange(n), np.zeros(n, np.uint64)
        for end in range(start + 1, size + 1):
            hashes = (hashes + codes[rows, end - 1] + np.uint64(1)) * np.uint64(_FACTOR)
            at = _found(table, hashes)
            known = at >= 0
            if not known.all():
                rows, hashes, at = rows[known], hashes[known], at[known]
            if not len(rows):
                break
            total = best[start, rows] + table[1][at]
            better = total > best[end, rows]
            at, hit = at[better], rows[better]
            best[end, hit], back[end, hit], last[end, hit] = total[better], start, table[2][at]
    ids = np.full((n, size), -1, np.int32)
    node, rows, column = np.full(n, size), np.arange(n), size
    while len(rows):
        column -= 1
        ids[rows, column] = last[node, rows]
        node = back[node, rows]
        rows, node = rows[node > 0], node[node > 0]
    return best[size], ids


def merged(text: str, vocabulary: Vocabulary) -> list[str]:
    """The pieces that merging leaves: neighbours that together are a piece of the highest score
    are merged first, of equal ones those in front."""
    size, score = len(text), vocabulary.scores.get
    ends, before = list(range(1, size + 1)), list(range(-1, size - 1))  # by start; an end of 0: merged into another
    heap = [(-found, i, i + 1, i + 2) for i in range(size - 1) if (found := score(text[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, left, right, end = heappop(heap)
        if ends[left] != right or ends[right] != end:
            continue
        ends[left], ends[right] = end, 0
        if left and (found := score(text[before[left] : end])) is not None:
            heappush(heap, (-found, before[left], left, end))
        if end < size:
            before[end] = left
            if (found := score(text[left : ends[end]])) is not None:
                heappush(heap, (-found, left, end, ends[end]))
    return [text[start:end] for start, end in enumerate(ends) if end]


def merged_together(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """``merged`` of texts of one length whose characters all are pieces, a merge of each at a
    time: a matrix with the ids of the pieces, -1 in front where there are fewer."""
    n, size = len(texts), len(texts[0])
    letters, which = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    here = np.array([vocabulary.ids[chr(c)] for c in letters], np.int32)[which].reshape(n, size)
    score, made = vocabulary.joined(here[:, :-1], here[:, 1:])
    ids, rows = np.full((n, size), -1, np.int32), np.arange(n)
    for left in range(size, 1, -1):
        at = score.argmax(axis=1)
        go = score[np.arange(len(rows)), at] > NEVER
        ids[rows[~go], size - left :] = here[~go]
        rows, here, score, made, at = (x[go] for x in (rows, here, score, made, at))
        k = np.arange(len(rows))
        here[k, at] = made[k, at]
        stay = np.ones(here.shape, bool)
        stay[k, at + 1] = False
        here = here[stay].reshape(len(k), left - 1)
        stay = np.ones(score.shape, bool)
        stay[k, at] = False
        score, made = (x[stay].reshape(len(k), left - 2) for x in (score, made))
        for near in (at - 1, at):
            ok = (near >= 0) & (near < left - 2)
            row, pair = k[ok], near[ok]
            score[row, pair], made[row, pair] = vocabulary.joined(here[row, pair], here[row, pair + 1])
        if not len(rows):
            return ids
    ids[rows, size - 1 :] = here
    return ids


class Memory(dict):
    """Solved parts: each has a number, under which its ids and its score are kept.

    Parts that are met for the first time are solved together, a length at a time. A full
    memory is emptied.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids_ = np.zeros(0, np.int32)
        self.starts, self.sizes, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def learn(self, parts: set[str]) -> None:
        if len(self) + len(parts) > REMEMBERED:
            self.forget()
        plain, by = self.vocabulary.letters.issuperset, {}
        for part in parts:
            if part not in self:
                by.setdefault(len(part) if len(part) <= TOGETHER_CHARS and plain(part) else 0, []).append(part)
        ids, sizes, scores = [self.ids_], [self.sizes], [self.scores]
        for length, some in by.items():
            self.update(zip(some, range(len(self), len(self) + len(some)), strict=True))
            if length:
                if self.vocabulary.merges:
                    score, matrix = np.zeros(len(some)), merged_together(some, self.vocabulary)
                else:
                    score, matrix = best_paths(some, self.vocabulary)
                used = matrix >= 0
                ids.append(matrix[used])
                sizes.append(used.sum(axis=1))
                scores.append(score)
            else:
                for part in some:
                    if self.vocabulary.merges:
                        score, pieces = 0.0, merged(part, self.vocabulary)
                    else:
                        score, ends = best_path(part, self.vocabulary)
                        pieces = [part[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    spelled = [x for piece in pieces for x in self.vocabulary.spell(piece)]
                    ids.append(np.array(spelled, np.int32))
                    sizes.append(np.array([len(spelled)]))
                    scores.append(np.array([score]))
        self.ids_, self.sizes, self.scores = np.concatenate(ids), np.concatenate(sizes), np.concatenate(scores)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all parts of texts that start and end where they may be cut, parts of each text)."""
        split = [self.vocabulary.parts.findall(t) for t in texts]
        new = set().union(*split).difference(self)
        if new:
            before = len(self)
            self.learn(new)
            if len(self) < before + len(new):  # it was emptied
                self.learn(set().union(*split))
        n = np.array([len(x) for x in split], np.int64)
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum())), n

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        numbers, parts = self.numbers(texts)
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.arange(ends[-1]) + np.repeat(self.starts[numbers] - ends[:-1], sizes)
        return self.ids_[flat], np.diff(ends[np.concatenate([[0], np.cumsum(parts)])])

    def ids_of(self, text: str) -> list[int]:
        return self.ids([text])[0].tolist()

    def score(self, texts: list[str]) -> np.ndarray:
        """The scores of texts that start and end where they may be cut."""
        numbers, parts = self.numbers(texts)
        sums = np.concatenate([[0.0], np.cumsum(self.scores[numbers])])
        return np.diff(sums[np.concatenate([[0], np.cumsum(parts)])])


_MEMORIES: dict[str, Memory] = {}


def memory_of(vocabulary: Vocabulary) -> Memory:
    """A worker keeps its solved parts from task to task."""
    key = vocabulary.fingerprint
    if key not in _MEMORIES:
        _MEMORIES.clear()
        _MEMORIES[key] = Memory(vocabulary)
    return _MEMORIES[key]


# --- chunks of giant texts ---------------------------------------------------------------


@dataclass
class Chunk:
    """``body`` with the characters after it that its pieces may reach (none at the text's end)."""

    body: str
    ahead: str

    def forward(self, vocabulary: Vocabulary, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best scores at all nodes, for each row of scores of the states in ``first``, and the
        start of the last piece, -1 where a piece of an earlier chunk ends.

        Pieces start in the body. Earlier starts win ties, so the longest last piece does.
        """
        text = self.body + self.ahead
        states = first.shape[1]
        best = np.full((len(text) + states + 1, first.shape[0]), NEVER)
        back = np.full(best.shape, -1, np.int64)
        best[:states] = first.T
        for start in range(len(self.body)):
            here = best[start]
            if here.max() == NEVER:
                continue
            for end, score in vocabulary.arcs(text, start):
                better = here + score > best[end]
                if better.any():
                    best[end][better] = (here + score)[better]
                    back[end][better] = start
        return best, back

    def cuts(self, vocabulary: Vocabulary) -> tuple[int, int] | None:
        """The first place behind all start states that no piece reaches over, and the last one.

        Every path has a node at both, so that what lies between is the same for all.
        """
        body, pairs, first = self.body, vocabulary.pairs, vocabulary.longest
        low = next((i for i in range(first, len(body)) if body[i - 1 : i + 1] not in pairs), None)
        if low is None:
            return None
        return low, next(i for i in range(len(body) - 1, 0, -1) if body[i - 1 : i + 1] not in pairs)

    def tail(self, vocabulary: Vocabulary, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and last starts from the last cut on; row n is the node n behind the cut."""
        start = np.full((1, vocabulary.longest), NEVER)
        start[0, 0] = 0.0
        return Chunk(self.body[high:], self.ahead).forward(vocabulary, start)

    def middle(self, cut: tuple[int, int] | None) -> str:
        """The text between the cuts."""
        return self.body[cut[0] : cut[1]] if cut else ""

    def transfer(self, vocabulary: Vocabulary, cut: tuple[int, int] | None, middle: float) -> np.ndarray:
        """Best score from each state at the chunk's start to each state at its end."""
        states = vocabulary.longest
        unit = np.full((states, states), NEVER)
        np.fill_diagonal(unit, 0.0)
        if cut is None:
            return self.forward(vocabulary, unit)[0][len(self.body) :][:states].T.copy()
        low, high = cut
        head = Chunk(self.body[:low], "").forward(vocabulary, unit)[0][low]
        tail = self.tail(vocabulary, high)[0][len(self.body) - high :][:states, 0]
        return head[:, None] + (middle + tail)[None, :]

    def origins(self, vocabulary: Vocabulary, first: np.ndarray) -> list[int]:
        """For each end state the start state that its best path comes from, -1 if there is none."""
        states, cut = vocabulary.longest, self.cuts(vocabulary)
        if cut is None:
            best, back = self.forward(vocabulary, first[None])
            ends = range(len(self.body), len(self.body) + states)
            return [_origin(back, n) if best[n, 0] > NEVER else -1 for n in ends]
        low, high = cut
        _, back = Chunk(self.body[:low], "").forward(vocabulary, first[None])
        tail = self.tail(vocabulary, high)[0][len(self.body) - high :][:states, 0]
        return [_origin(back, low) if x > NEVER else -1 for x in tail]

    def trace(
        self, vocabulary: Vocabulary, cut: tuple[int, int] | None, middle: np.ndarray, first: np.ndarray, state: int
    ) -> list[int]:
        """Ids of the pieces that start here, on the best path to an end state."""
        text, end = self.body + self.ahead, len(self.body) + state
        if cut is None:
            return _spelled(vocabulary, text, self.forward(vocabulary, first[None])[1], end)
        low, high = cut
        head = Chunk(self.body[:low], "").forward(vocabulary, first[None])[1]
        return (
            _spelled(vocabulary, text, head, low)
            + middle.tolist()
            + _spelled(vocabulary, text[high:], self.tail(vocabulary, high)[1], end - high)
        )


@dataclass
class MergeChunk(Chunk):
    """A chunk for merges, with the characters in front that pieces may start at (none at the text's start).

    A state is a piece that starts before a boundary and ends there or behind. Nodes are counted
    from the body's start; a node has the starts of the pieces that end there, and with each as
    bits the states at the chunk's start that a path comes from.
    """

    behind: str

    def states(self, vocabulary: Vocabulary, at: int) -> list[tuple[int, int]]:
        """(characters before, characters behind) of all pieces at a node; (0, 0) at the text's start."""
        text, node = self.behind + self.body + self.ahead, len(self.behind) + at
        if not node:
            return [(0, 0)]
        longest = vocabulary.longest
        return [
            (back, over)
            for back in range(1, min(longest, node) + 1)
            for over in range(min(longest - back, len(text) - node) + 1)
            if back + over == 1 or text[node - back : node + over] in vocabulary.scores
        ]

    def paths(
        self, vocabulary: Vocabulary, nodes: dict[int, dict[int, int]], low: int, high: int
    ) -> dict[int, dict[int, int]]:
        """The nodes that pieces which start from ``low`` up to ``high`` reach from those given."""
        text, offset = self.behind + self.body + self.ahead, len(self.behind)
        for node in range(low, high):
            here = [(text[offset + start : offset + node], bits) for start, bits in nodes.get(node, {}).items()]
            for end, _ in vocabulary.arcs(text, offset + node) if here else ():
                piece, bits = text[offset + node : end], 0
                for left, some in here:
                    if vocabulary.fits(left, piece):
                        bits |= some
                if bits:
                    nodes.setdefault(end - offset, {})[node] = bits
        return nodes

    def head(self, vocabulary: Vocabulary, end: int, first: np.ndarray | None = None) -> dict[int, dict[int, int]]:
        """The nodes up to an end, from all states or from those that ``first`` reaches."""
        nodes: dict[int, dict[int, int]] = {}
        for n, (back, over) in enumerate(self.states(vocabulary, 0)):
            if first is None or first[n] > NEVER:
                nodes.setdefault(over, {})[-back] = 1 << n
        return self.paths(vocabulary, nodes, 0, end)

    def tail(self, vocabulary: Vocabulary, high: int) -> dict[int, dict[int, int]]:
        return self.paths(vocabulary, {high: {high: 1}}, high, len(self.body))

    def transfer(self, vocabulary: Vocabulary, cut: tuple[int, int] | None, middle: float) -> np.ndarray:
        rows, size = np.arange(len(self.states(vocabulary, 0))), len(self.body)
        last = [(size + over, size - back) for back, over in self.states(vocabulary, size)]
        scores = lambda bits, n: np.array([0.0 if bits >> i & 1 else NEVER for i in range(n)])
        if cut is None:
            nodes = self.head(vocabulary, size)
            return np.stack([scores(nodes.get(end, {}).get(start, 0), len(rows)) for end, start in last], 1)
        low, high = cut
        bits = 0
        for some in self.head(vocabulary, low).get(low, {}).values():
            bits |= some
        tail = self.tail(vocabulary, high)
        ends = np.array([0.0 if tail.get(end, {}).get(start) else NEVER for end, start in last])
        return scores(bits, len(rows))[:, None] + (middle + ends)[None, :]

    def origins(self, vocabulary: Vocabulary, first: np.ndarray) -> list[int]:
        matrix = self.transfer(vocabulary, self.cuts(vocabulary), 0.0)
        found = first[: len(matrix), None] + matrix
        return [int(n) if best > NEVER else -1 for n, best in zip(found.argmax(axis=0), found.max(axis=0), strict=True)]

    def trace(
        self, vocabulary: Vocabulary, cut: tuple[int, int] | None, middle: np.ndarray, first: np.ndarray, state: int
    ) -> list[int]:
        size = len(self.body)
        back, over = self.states(vocabulary, size)[state]
        if cut is None:
            return self.spelled(vocabulary, self.head(vocabulary, size, first), size - back, size + over, 0)
        low, high = cut
        head = self.head(vocabulary, low, first)
        return (
            self.spelled(vocabulary, head, next(iter(head[low])), low, 0)
            + middle.tolist()
            + self.spelled(vocabulary, self.tail(vocabulary, high), size - back, size + over, high)
        )

    def spelled(self, vocabulary: Vocabulary, nodes: dict[int, dict[int, int]], start: int, end: int, low: int) -> list[int]:
        """Ids on the path to a piece, of the pieces that start from ``low`` on; each fits one in front."""
        text, offset, pieces = self.behind + self.body + self.ahead, len(self.behind), []
        while low <= start < end:
            piece = text[offset + start : offset + end]
            pieces.append(piece)
            before = next(x for x in nodes[start] if vocabulary.fits(text[offset + x : offset + start], piece))
            start, end = before, start
        return list(chain.from_iterable(vocabulary.spell(p) for p in reversed(pieces)))


def _origin(back: np.ndarray, node: int) -> int:
    while back[node, 0] >= 0:
        node = back[node, 0]
    return int(node)


def _spelled(vocabulary: Vocabulary, text: str, back: np.ndarray, node: int) -> list[int]:
    pieces = []
    while back[node, 0] >= 0:
        pieces.append(text[back[node, 0] : node])
        node = back[node, 0]
    return list(chain.from_iterable(vocabulary.spell(p) for p in reversed(pieces)))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two stacks of matrices in which max takes the place of + and + that of x."""
    return (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """All products of the first 1, 2, ... matrices, in a logarithmic number of rounds."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = _shifted(out, step)
        step *= 2
    return out


def _shifted(out: np.ndarray, step: int) -> np.ndarray:
    left, right = out[:-step], out[step:]
    some = max(1, (1 << 22) // out.shape[1] ** 3)
    return np.concatenate([max_plus(left[i : i + some], right[i : i + some]) for i in range(0, len(left), some)])


def stacked(matrices: list[bytes], states: int) -> np.ndarray:
    """Matrices of one row after the other, the first from so many states; of fewer states than
    the largest get states that nothing reaches."""
    found = []
    for data in matrices:
        found.append(np.frombuffer(data, np.float64).reshape(states, -1))
        states = found[-1].shape[1]
    most = max(n for x in found for n in x.shape)
    out = np.full((len(found), most, most), NEVER)
    for to, x in zip(out, found, strict=True):
        to[: x.shape[0], : x.shape[1]] = x
    return out


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _spell_out(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """The texts that runs of ids spell, without the mark in front."""
    data, starts, lengths = vocabulary.spelled
    length = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(length)])
    flat = data[np.arange(ends[-1]) + np.repeat(starts[ids] - ends[:-1], length)]
    offsets = ends[np.concatenate([[0], np.cumsum(sizes)])]
    spelled = flat.tobytes()
    return pa.array([spelled[a + 1 : b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Kept columns and the text to kept columns, ids and, if it is named, what the ids spell."""
    memory = memory_of(vocabulary)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for first in range(0, batch.num_rows, SLICE):
            ids, sizes = memory.ids([normalized(t.as_py()) for t in texts[first : first + SLICE]])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
            if "decoded" in names:
                made.append(_spell_out(ids, sizes, vocabulary))
            kept = [c.slice(first, SLICE) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)


PLACE = "row long, place long, places long"


def _split(chunk_chars: int, ahead: int):
    """Chunks of normalized texts, with what their last pieces may reach and their first ones start at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0), batch.column(1), strict=True):
                text = normalized(value.as_py())
                starts = range(0, len(text), chunk_chars)
                for first in range(0, len(starts), 64):
                    some = starts[first : first + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row.as_py()] * len(some), pa.int64()),
                        pa.array(range(first, first + len(some)), pa.int64()),
                        pa.array([len(starts)] * len(some), pa.int64()),
                        pa.array([text[i : i + chunk_chars] for i in some], pa.string()),
                        pa.array([text[i + chunk_chars : i + chunk_chars + ahead] for i in some], pa.string()),
                        pa.array([text[max(0, i - ahead - 1) : i] for i in some], pa.string()),
                    ], ["row", "place", "places", "body", "ahead", "behind"])

    return run


def _chunks(batch: pa.RecordBatch, vocabulary: Vocabulary) -> list[Chunk]:
    kind, names = (MergeChunk, ["body", "ahead", "behind"]) if vocabulary.merges else (Chunk, ["body", "ahead"])
    return [kind(*x) for x in zip(*(batch.column(name).to_pylist() for name in names), strict=True)]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few chunks, whose parts are solved together."""
    for batch in batches:
        for first in range(0, batch.num_rows, CHUNKS):
            yield batch.slice(first, CHUNKS)


def _giants(giants: DataFrame, vocabulary: Vocabulary, chunk_chars: int) -> DataFrame:
    """``row, ids`` of ``row, text``: three passes over the chunks, with two scans between them."""
    states = vocabulary.longest
    chunks = giants.mapInArrow(_split(chunk_chars, states - 1), f"{PLACE}, body string, ahead string, behind string")
    chunks = stored(chunks, "piece-chunks")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(vocabulary)
        for batch in _few(batches):
            chunks_ = _chunks(batch, vocabulary)
            cuts = [c.cuts(vocabulary) for c in chunks_]
            scores = memory.score([c.middle(cut) for c, cut in zip(chunks_, cuts, strict=True)])
            found = [c.transfer(vocabulary, *x).tobytes() for c, *x in zip(chunks_, cuts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["row", "place", "places", "matrix"])

    def reached(table: pa.Table) -> pa.Table:
        """Best scores of the states at the start of each chunk, over all that comes before it."""
        table = table.sort_by("place")
        stack = stacked(table["matrix"].to_pylist(), 1 if vocabulary.merges else states)
        unit = np.full((1, stack.shape[1]), NEVER)
        unit[0, 0] = 0.0
        firsts = np.concatenate([unit, scan(stack)[:-1, 0]])
        return pa.table({"row": table["row"], "place": table["place"], "first": [x.tobytes() for x in firsts]})

    matrices = chunks.mapInArrow(transfers, f"{PLACE}, matrix binary")
    firsts = matrices.groupBy("row").applyInArrow(reached, "row long, place long, first binary")
    known = stored(chunks.join(firsts, ["row", "place"]), "piece-scores")

    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [np.frombuffer(x.as_py(), np.float64) for x in batch.column("first")]
            found = [c.origins(vocabulary, f) for c, f in zip(_chunks(batch, vocabulary), firsts, strict=True)]
            place = [batch.column("row"), batch.column("place")]
            yield pa.RecordBatch.from_arrays([*place, pa.array(found, pa.list_(pa.int64()))], ["row", "place", "origins"])

    def passed(table: pa.Table) -> pa.Table:
        """The state at the end of each chunk on the best path, found from the last one back."""
        table = table.sort_by("place")
        origins_, ends = table["origins"].to_pylist(), []
        state = next(i for i, origin in enumerate(origins_[-1]) if origin >= 0)
        for origin in reversed(origins_):
            ends.append(state)
            state = origin[state]
        return pa.table({"row": table["row"], "place": table["place"], "state": pa.array(ends[::-1], pa.int64())})

    sources = known.mapInArrow(origins, "row long, place long, origins array<long>")
    ends = sources.groupBy("row").applyInArrow(passed, "row long, place long, state long")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(vocabulary)
        for batch in _few(batches):
            chunks_ = _chunks(batch, vocabulary)
            cuts = [c.cuts(vocabulary) for c in chunks_]
            flat, sizes = memory.ids([c.middle(cut) for c, cut in zip(chunks_, cuts, strict=True)])
            middles = np.split(flat, np.cumsum(sizes)[:-1])
            firsts = [np.frombuffer(x.as_py(), np.float64) for x in batch.column("first")]
            states_ = batch.column("state").to_pylist()
            rows = zip(chunks_, cuts, middles, firsts, states_, strict=True)
            ids = [c.trace(vocabulary, *x) for c, *x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("place"), _lists(ids)], ["row", "place", "ids"])

    traced = known.join(ends, ["row", "place"]).mapInArrow(traces, "row long, place long, ids array<int>")
    whole = F.sort_array(F.collect_list(F.struct("place", "ids")))
    return traced.groupBy("row").agg(F.flatten(F.transform(whole, lambda x: x["ids"])).alias("ids"))


def encode(
    documents: DataFrame, vocabulary: Vocabulary, chunk_chars: int = CHUNK_CHARS, decoded: bool = False
) -> DataFrame:
    """``doc_id, ids array<int>`` of every row, from its whole text.

    Texts of more than ``chunk_chars`` characters are solved in chunks; the result is the same
    to the id. Null and empty texts have no ids. Repeated rows give repeated rows, an empty
    table none; a null id is kept; other columns are not looked at. With ``decoded`` there is
    a third column as of ``decode``, made while the ids are at hand.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    giant = F.length("text") > chunk_chars
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", *["decoded"] * decoded]
    small = rows.where(~giant).mapInArrow(
        lambda batches: _encode(batches, vocabulary, names),
        f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded,
    )
    # A row number of their own, since document ids may repeat; stored, so that it stays.
    giants = stored(rows.where(giant).withColumn("row", F.monotonically_increasing_id()), "piece-giants")
    ids = _giants(giants.select("row", "text"), vocabulary, chunk_chars)
    large = giants.select("row", "doc_id").join(ids, "row").select("doc_id", "ids")
    return small.unionByName(decode(large, vocabulary) if decoded else large)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The frame with a column ``decoded``: the text that the ``ids`` spell.

    The mark in front is dropped and bytes are read as UTF-8, so encoding and decoding give
    the text itself. Null and empty ids give the empty text; ids out of range raise.
    """
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                lists = some.column(at).fill_null([])
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = _spell_out(ids, np.diff(lists.offsets.to_numpy()), vocabulary)
                yield pa.RecordBatch.from_arrays([*some.columns, texts], [*names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kept}, decoded string")
