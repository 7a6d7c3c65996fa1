"""Alignment of two tokenizers' tokens by products of sparse incidence matrices.

The tokens of one tokenizer and the bytes they cover are a matrix of tokens by bytes, built by
hand as compressed rows. Row by row (Gustavson), the product A B^T has an entry for each pair
of tokens that share a byte, and counts the shared bytes. With the last byte of each token
instead, it has the pairs that end together; these bytes cut both sequences into groups, and
the product of the tokens-by-groups matrices has the pairs that share a group.

How often a pair of token ids is linked is counted over the corpus from each text's distinct
pairs, and goes back to the texts by a join on the pair.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatflow.llm.common import scored_rows, stored

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Where byte-level BPE cuts a text before merging (fixed value of that kind of tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes whose tokens are aligned together; a longer text is aligned alone.
SLICE_BYTES = 1 << 20
#: Pairs that are sent to all tasks at most, some 40 MB; beyond that they are joined by shuffle.
SENT_PAIRS = 1 << 20


@dataclass
class Rows:
    """A sparse matrix of ones as compressed rows."""

    starts: np.ndarray  # of the rows, and the end
    columns: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, first: np.ndarray, end: np.ndarray, width: int) -> Rows:
        """Row i has the columns from ``first[i]`` up to ``end[i]``."""
        starts = np.concatenate([[0], np.cumsum(end - first)])
        return cls(starts, np.repeat(first - starts[:-1], end - first) + np.arange(starts[-1]), width)

    @classmethod
    def of_places(cls, columns: np.ndarray, width: int) -> Rows:
        """Row i has one column."""
        return cls(np.arange(len(columns) + 1), columns, width)

    def transposed(self) -> Rows:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Rows(starts, rows[order], len(self.starts) - 1)


def product(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a b, in their order: the rows of b that the entries of a row
    of a name are put together and added up."""
    rows = np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts))
    first, size = b.starts[a.columns], np.diff(b.starts)[a.columns]
    before = np.cumsum(size) - size
    columns = b.columns[np.repeat(first - before, size) + np.arange(int(size.sum()))]
    key = np.repeat(rows, size) * max(b.width, 1) + columns
    if np.any(key[1:] < key[:-1]):
        key = np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at] // max(b.width, 1), key[at] % max(b.width, 1), np.diff(np.append(at, len(key)))


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others by signs from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Tokenizers:
    """Both vocabularies, as they are sent to the tasks."""

    ranks: dict[bytes, int]  # of A: bytes and ids, which stand in the order of merges
    model: bytes  # of B
    _made: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def load(cls, a_path: str = A_PATH, b_path: str = B_PATH) -> Tokenizers:
        """A byte-level BPE file and a SentencePiece model."""
        with open(a_path, encoding="utf-8") as file:
            told = json.load(file)
        before, merges = told["pre_tokenizer"], told["model"]["merges"]
        if told["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{a_path} is no plain byte-level vocabulary")
        vocabulary = told["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocabulary[x + y] for x, y in pairs]
        if made != sorted(made):
            raise ValueError(f"the ids of {a_path} are not in the order of its merges")
        signs = _byte_signs()
        with open(b_path, "rb") as file:
            return cls({bytes(signs[c] for c in t): i for t, i in vocabulary.items()}, file.read())

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "model": self.model, "_made": {}}

    @property
    def a(self):
        if "a" not in self._made:
            import tiktoken

            self._made["a"] = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self._made["a"]

    @property
    def b(self):
        if "b" not in self._made:
            import sentencepiece

            self._made["b"] = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self._made["b"]

    @cached_property
    def a_bytes(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            out[i] = token
        return out

    @cached_property
    def b_bytes(self) -> list[bytes]:
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [p.replace("▁", " ").encode() for p in pieces]
        return [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else x for i, (p, x) in enumerate(zip(pieces, plain, strict=True))]

    @cached_property
    def written(self) -> list[bytes]:
        """Decimal ids with what follows them: of A ``,`` or ``|``, of B ``,``, ``;`` or nothing."""
        a = [b"%d%s" % (i, x) for i in range(len(self.a_bytes)) for x in (b",", b"|")]
        return a + [b"%d%s" % (i, x) for i in range(len(self.b_bytes)) for x in (b",", b";", b"")]


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, starts and sizes of the tokens."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def _spelled(ids: np.ndarray, table: tuple) -> np.ndarray:
    data, starts, sizes = table
    size = sizes[ids]
    before = np.cumsum(size) - size
    return data[np.repeat(starts[ids] - before, size) + np.arange(int(size.sum()))]


class Slice:
    """The aligned tokens of some texts. Texts without tokens (null, empty, or spelled
    differently by either tokenizer) have none."""

    def __init__(self, texts: list[str | None], both: Tokenizers, tables: tuple) -> None:
        n = len(texts)
        spelled = [b" " + t.encode() if t else b"" for t in texts]
        want = np.array([len(s) for s in spelled], np.int64)
        lists = [[both.a.encode_ordinary(" " + t) if t else [] for t in texts], both.b.encode([t or "" for t in texts], num_threads=1)]
        good, sides = want > 0, []
        for found, table in zip(lists, tables, strict=True):
            counts = np.array([len(x) for x in found], np.int64)
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
            owner = np.repeat(np.arange(n), counts)
            size = np.bincount(owner, table[2][ids], n).astype(np.int64)
            good &= size == want
            sides.append((ids, owner))
        for (ids, owner), table in zip(sides, tables, strict=True):
            # Of equal length: now byte by byte.
            kept = good[owner]
            text = np.frombuffer(b"".join([s for s, g in zip(spelled, good, strict=True) if g]), np.uint8)
            differ = np.concatenate([[0], np.cumsum(_spelled(ids[kept], table) != text)])
            ends = np.cumsum(want * good)
            good = good & (differ[ends] == differ[ends - want * good])
        self.n, self.good, self.want = n, good, want * good
        self.ids = [ids[good[owner]] for ids, owner in sides]
        self.owner = [owner[good[owner]] for _, owner in sides]
        self.sizes = [table[2][ids] for ids, table in zip(self.ids, tables, strict=True)]
        self.ends = [np.cumsum(size) for size in self.sizes]
        self.bytes = int(self.want.sum())
        last = [Rows.of_places(end - 1, self.bytes) for end in self.ends]
        #: Pairs of tokens that end together, and the groups these cut.
        self.together = product(last[0], last[1].transposed())
        self.cuts = self.ends[0][self.together[0]] - 1
        self.groups = [np.searchsorted(self.cuts, end - 1) for end in self.ends]

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token, B token and number of shared bytes, ends or groups of the pairs."""
        if kind == "end":
            return self.together
        if kind == "overlap":
            a, b = (Rows.of_spans(e - s, e, self.bytes) for e, s in zip(self.ends, self.sizes, strict=True))
        else:
            a, b = (Rows.of_places(g, len(self.cuts)) for g in self.groups)
        return product(a, b.transposed())

    def digests(self, both: Tokenizers) -> list[str]:
        """Hex digests of the written groups."""
        (a, b), (ga, gb), n = self.ids, self.groups, len(self.cuts)
        in_a, in_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))]) for g in (ga, gb))
        codes = np.empty(len(a) + len(b), np.int64)
        ends = [np.append(g[1:] != g[:-1], [True] * (len(g) > 0)) for g in (ga, gb)]
        codes[np.arange(len(a)) + in_b[ga]] = 2 * a + ends[0]
        final = np.append(self.owner[1][1:] != self.owner[1][:-1], [True] * (len(b) > 0))
        codes[np.arange(len(b)) + in_a[gb + 1]] = 2 * len(both.a_bytes) + 3 * b + np.where(final, 2, ends[1])
        written = both.written
        parts = [written[i] for i in codes.tolist()]
        upto = np.cumsum(sum(np.bincount(o, minlength=self.n) for o in self.owner))
        at, out = 0, []
        for end in upto.tolist():
            out.append(sha256(b"".join(parts[at:end])).hexdigest() if end > at else "")
            at = end
        return out


def _slices(column: pa.Array, both: Tokenizers, tables: tuple) -> Iterator[Slice]:
    texts, held, size = column.to_pylist(), [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= SLICE_BYTES:
            yield Slice(held, both, tables)
            held, size = [], 0
    if held:
        yield Slice(held, both, tables)


def _listed(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def align(documents: DataFrame, both: Tokenizers, kind: str = "overlap") -> DataFrame:
    """``doc_id, a_ids, b_ids, links`` per row of ``doc_id, text``.

    Tokens are those of a space and the text. ``links`` has the numbers of the linked tokens
    (from 0) and what they share: bytes for ``overlap``, 1 for ``group`` and ``end``. Links of
    a group are all pairs in it. Null and empty texts, and texts that either tokenizer spells
    differently, have no tokens. Very long texts are taken whole; repeated rows each get their
    answer; no rows give no rows; other columns are not looked at.
    """
    if kind not in ("overlap", "group", "end"):
        raise ValueError(kind)

    def of_texts(column: pa.Array) -> list[pa.Array]:
        tables = _table(both.a_bytes), _table(both.b_bytes)
        out: list[list[pa.Array]] = [[], [], []]
        for part in _slices(column, both, tables):
            counts = [np.bincount(o, minlength=part.n) for o in part.owner]
            first = [np.cumsum(c) - c for c in counts]
            rows, columns, values = part.links(kind)
            owner = part.owner[0][rows]
            struct = [rows - first[0][owner], columns - first[1][owner], values]
            struct = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in struct], ["a", "b", "n"])
            for to, count, items in zip(out, [*counts, np.bincount(owner, minlength=part.n)], [*map(pa.array, part.ids), struct], strict=True):
                to.append(_listed(count, items))
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([(c, pa.int32()) for c in "abn"]))]
        return [pa.concat_arrays(x) if x else pa.array([], k) for x, k in zip(out, kinds, strict=True)]

    kinds = ["array<int>", "array<int>", "array<struct<a:int,b:int,n:int>>"]
    rows, kept = scored_rows(documents, ["doc_id"], kinds, of_texts)
    return rows.select(*kept, F.col("n0").alias("a_ids"), F.col("n1").alias("b_ids"), F.col("n2").alias("links"))


def _figures(both: Tokenizers):
    """Numbers of tokens, groups and links, digest, distinct linked pairs of ids and their counts."""

    def of_texts(column: pa.Array) -> list[pa.Array]:
        tables, width = (_table(both.a_bytes), _table(both.b_bytes)), len(both.b_bytes)
        out: list[list[pa.Array]] = [[] for _ in range(7)]
        for part in _slices(column, both, tables):
            a, b, _ = part.together
            owner = part.owner[0][a]
            pair = part.ids[0][a].astype(np.int64) * width + part.ids[1][b]
            whole = len(both.a_bytes) * width
            found, times = np.unique(owner * whole + pair, return_counts=True)
            each = np.bincount(found // whole, minlength=part.n)
            sizes = [np.bincount(o, minlength=part.n) for o in part.owner]
            groups = np.bincount(part.owner[0][np.searchsorted(part.ends[0], part.cuts + 1)], minlength=part.n)
            numbers = [*sizes, groups, np.bincount(owner, minlength=part.n)]
            arrays = [*(pa.array(x.astype(np.int64)) for x in numbers), pa.array(part.digests(both), pa.string())]
            arrays += [_listed(each, pa.array(found % whole)), _listed(each, pa.array(times.astype(np.int64)))]
            for to, x in zip(out, arrays, strict=True):
                to.append(x)
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
        return [pa.concat_arrays(x) if x else pa.array([], k) for x, k in zip(out, kinds, strict=True)]

    return of_texts


def alignment_figures(documents: DataFrame, both: Tokenizers, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``doc_id, text``.

    Links are the pairs of tokens that end together. The count of a pair of ids is the number
    of its links in all texts; ``count_sum`` adds the counts of a text's links, ``n_best``
    counts those whose count is the highest of their B id. Texts without tokens (see
    ``align``) have zeros and an empty digest. Repeated rows count as often as they are there.
    """
    kinds = ["long"] * 4 + ["string", "array<bigint>", "array<bigint>"]
    rows, kept = scored_rows(documents, ["doc_id"], kinds, _figures(both))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), *kept, *[F.col(f"n{i}").alias(c) for i, c in enumerate(names)])
    rows = stored(rows, "alignment")
    pairs = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    pairs = pairs.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    highest = F.max("count").over(W.partitionBy(F.col("pair") % len(both.b_bytes)))
    counts = stored(counts.select("pair", "count", (F.col("count") == highest).alias("best")), "alignment-pairs")
    if counts.count() <= sent_pairs:
        counts = F.broadcast(counts)
    best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")
    sums = pairs.join(counts, "pair").groupBy("row").agg(best, F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
