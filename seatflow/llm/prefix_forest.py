"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Every tree gives a vector a long hash string. Its symbols come from random rotations: the
axis that the rotated vector lies closest to, with its sign, so that vectors at a small angle
tend to agree. A tree is the sorted array of the strings; all strings that share a prefix
stand together in it. A query descends in all trees to its longest matching prefixes, then
ascends in all trees at once, a symbol at a time, and collects what shares the shorter
prefix, until it has enough candidates. At the root these are all vectors, so a query that
finds too little ends with an exact answer. Candidates are scored on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm.blocks import best, build_blocks, first_copies, matrix, search_blocks, sound

INDEX = "ids array<long>, exact binary, strings binary, places binary"


@dataclass(frozen=True)
class Forest:
    """Trees, symbols of a string, axes of a rotation, and the share of the rows at which the
    ascent stops. Nothing is fitted to the data. Recall against brute force is in the README."""

    trees: int = 56
    symbols: int = 3
    axes: int = 64
    share: float = 0.2
    seed: int = 11


FOREST = Forest()


@lru_cache(maxsize=4)
def rotations(dim: int, forest: Forest) -> np.ndarray:
    """(trees * symbols, dim, axes) matrices with orthonormal columns, the same in every task."""
    rng = np.random.default_rng([forest.seed, dim])
    axes = min(dim, forest.axes)
    return np.stack([
        np.linalg.qr(rng.normal(size=(dim, axes)))[0].astype(np.float32) for _ in range(forest.trees * forest.symbols)
    ])


def hash_strings(vectors: np.ndarray, forest: Forest) -> np.ndarray:
    """(trees, vectors) strings, read as numbers whose digits are the symbols."""
    turns = rotations(vectors.shape[1], forest)
    base = 2 * turns.shape[2]
    unit = (vectors / np.abs(vectors).max(1, keepdims=True)).astype(np.float32)
    out = np.zeros((forest.trees, len(vectors)), np.int64)
    rows = np.arange(len(vectors))
    for i, turn in enumerate(turns):
        along = unit @ turn
        axis = np.abs(along).argmax(1)
        out[i // forest.symbols] = out[i // forest.symbols] * base + 2 * axis + (along[rows, axis] > 0)
    return out


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, each row summed in the same order wherever it stands."""
    scale, own = np.abs(vectors).max(1, keepdims=True), np.abs(query).max()
    vectors, query = vectors / scale, query / own
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return np.einsum("ij,j->i", vectors, query) / (norms * np.sqrt(np.einsum("j,j->", query, query)))


def build_index(vectors: DataFrame, k: int, forest: Forest = FOREST) -> DataFrame:
    """The stored forest of ``vec_id, vector`` rows: every row is in it, block by block."""

    def pack(table: pa.Table) -> dict:
        exact = matrix(table.column("vector"))
        strings = hash_strings(exact, forest)
        places = np.argsort(strings, axis=1, kind="stable")
        return {
            "ids": table.column("vec_id").to_pylist(),
            "exact": exact.tobytes(),
            "strings": np.take_along_axis(strings, places, 1).tobytes(),
            "places": places.astype(np.int32).tobytes(),
        }

    return build_blocks(first_copies(vectors, k), pack, INDEX, "forest")


def candidates(strings: np.ndarray, places: np.ndarray, query: np.ndarray, base: int, symbols: int, enough: int):
    """Positions of the rows collected by the synchronous ascent of one query."""
    n = strings.shape[1]
    taken = np.zeros(n, bool)
    for depth in range(symbols, 0, -1):
        width = base ** (symbols - depth)
        low = query // width * width
        for tree in range(len(strings)):
            first, last = np.searchsorted(strings[tree], (low[tree], low[tree] + width))
            taken[places[tree, first:last]] = True
        if np.count_nonzero(taken) >= enough:
            return np.flatnonzero(taken)
    return np.arange(n)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, forest: Forest = FOREST) -> DataFrame:
    """The k nearest found for each query: query_id, rank, vec_id, score (the cosine).

    ``vectors`` and ``queries`` are ``vec_id, vector`` rows of finite numbers that are not all
    zero. A query does not find its own id; ties go to the smaller id; with fewer candidates
    than k all are returned. Empty tables give no rows.
    """

    def answer(row: dict, query_ids: np.ndarray, wanted: np.ndarray):
        ids = np.array(row["ids"].as_py(), np.int64)
        n = len(ids)
        exact = np.frombuffer(row["exact"].as_py(), np.float64).reshape(n, -1)
        strings = np.frombuffer(row["strings"].as_py(), np.int64).reshape(-1, n)
        places = np.frombuffer(row["places"].as_py(), np.int32).reshape(-1, n)
        base = 2 * min(exact.shape[1], forest.axes)
        asked = hash_strings(wanted, forest)
        # Rough cosines in single precision choose what is worth an exact one.
        rough = exact / np.abs(exact).max(1, keepdims=True)
        rough = (rough / np.linalg.norm(rough, axis=1, keepdims=True)).astype(np.float32)
        enough = max(k + 1, int(np.ceil(forest.share * n)))
        out = [], [], []
        for i, query in enumerate(wanted):
            found = candidates(strings, places, asked[:, i], base, forest.symbols, enough)
            found = found[ids[found] != query_ids[i]]
            if len(found) > k:
                unit = query / np.abs(query).max()
                near = rough[found] @ (unit / np.linalg.norm(unit)).astype(np.float32)
                found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-4]
            score = cosines(exact[found], query)
            top = best(score, ids[found], k)
            out[0].extend([i] * len(top))
            out[1].extend(ids[found[top]].tolist())
            out[2].extend(score[top].tolist())
        return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.float64)

    return search_blocks(build_index(vectors, k, forest), queries, answer, k, "double")


def nearest_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5, forest: Forest = FOREST) -> DataFrame:
    """``nearest`` over all ``vec_id, embedding`` rows; queries have an id divisible by ``every``.

    Rows that ``sound`` leaves out, and vectors of zeros, take no part.
    """
    rows = sound(embeddings, zero_allowed=False)
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(every)) == 0), k, forest)
