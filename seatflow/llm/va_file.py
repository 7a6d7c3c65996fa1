"""Exact top-k by inner product with a vector-approximation file.

The index holds, beside the exact vectors, one byte per component: the cell of the range
that the block's vectors span. A query scans the cells, which gives bounds for every score,
then reads exact vectors in the order of their upper bounds until its kth score is certain:
no vector left has a bound above it. Results are exact whatever the cells are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm.blocks import best, build_blocks, first_copies, matrix, search_blocks, sound

CELLS = 256
#: Exact vectors read at a time, and queries scanned at a time.
READ, SCAN = 16, 64
INDEX = "ids array<long>, low array<double>, step array<double>, cells binary, exact binary"
#: Sums up to this are exact in double precision.
EXACT = 2.0**53


def whole_numbers(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """floor(factor * component) of every vector, as doubles that hold whole numbers."""
    return vectors.withColumn(
        "vector", F.transform("vector", lambda x: F.floor(x * factor).cast("double"))
    )


def _pack(table: pa.Table) -> dict:
    exact = matrix(table.column("vector"))
    low, high = exact.min(0), exact.max(0)
    step = np.where(high > low, (high - low) / CELLS, 1.0)
    cells = np.clip((exact - low) // step, 0, CELLS - 1).astype(np.uint8)
    return {
        "ids": table.column("vec_id").to_pylist(),
        "low": low.tolist(),
        "step": step.tolist(),
        "cells": cells.tobytes(),
        "exact": exact.tobytes(),
    }


def build_index(vectors: DataFrame, k: int) -> DataFrame:
    """The stored approximation file of ``vec_id, vector`` rows, fit for up to k answers."""
    return build_blocks(first_copies(vectors, k), _pack, INDEX, "va-file")


def _scores(exact: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    if safe:
        return (exact @ query).astype(np.int64)
    # Beyond the exact range of doubles: Python's integers, cut to what a long holds.
    whole = [[int(x) for x in row] for row in exact]
    sums = (sum(a * int(b) for a, b in zip(row, query, strict=True)) for row in whole)
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def nearest_in_block(ids, low, step, cells, exact, query_ids, queries, k):
    """(query position, id, score) of each query's k best in one block, its own id left out."""
    middle = low + (cells + 0.5) * step
    out = [], [], []
    for first in range(0, len(queries), SCAN):
        some = queries[first : first + SCAN]
        # What rounding may add to a bound is far less than this share of the largest sum.
        size = np.abs(some) @ np.abs(exact).max(0)
        slack = np.abs(some) @ (step / 2) + 1e-9 * size + 1e-9
        middles = some @ middle.T
        for i, query in enumerate(some):
            upper = middles[i] + slack[i]
            upper[ids == query_ids[first + i]] = -np.inf
            order = np.flatnonzero(upper > -np.inf)
            if len(order) > k:
                # The kth highest lower bound; nothing below it can be among the k best.
                least = np.partition(upper[order], len(order) - k)[len(order) - k] - 2 * slack[i]
                order = order[upper[order] >= least]
            order = order[np.argsort(-upper[order], kind="stable")]
            scores = np.zeros(0, np.int64)
            for at in range(0, len(order), READ):
                if len(scores) >= k and np.partition(scores, len(scores) - k)[len(scores) - k] > upper[order[at]]:
                    break
                scores = np.append(scores, _scores(exact[order[at : at + READ]], query, size[i] < EXACT))
            seen = order[: len(scores)]
            top = best(scores, ids[seen], k)
            out[0].extend([first + i] * len(top))
            out[1].extend(ids[seen[top]].tolist())
            out[2].extend(scores[top].tolist())
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest inner products of each query: query_id, rank, vec_id, score (long).

    ``vectors`` and ``queries`` are ``vec_id, vector`` rows of whole numbers, as ``sound`` and
    ``whole_numbers`` give them. A query is compared with every vector of its length but those
    that have its id; ties go to the smaller id; with fewer candidates than k all are returned.
    Empty tables give no rows.
    """

    def answer(row: dict, query_ids: np.ndarray, matrix_: np.ndarray):
        ids = np.array(row["ids"].as_py(), np.int64)
        shape = (len(ids), -1)
        cells = np.frombuffer(row["cells"].as_py(), np.uint8).reshape(shape)
        exact = np.frombuffer(row["exact"].as_py(), np.float64).reshape(shape)
        low, step = np.array(row["low"].as_py()), np.array(row["step"].as_py())
        at, found, score = nearest_in_block(ids, low, step, cells, exact, query_ids, matrix_, k)
        return np.array(at, np.int64), np.array(found, np.int64), np.array(score, np.int64)

    return search_blocks(build_index(vectors, k), queries, answer, k, "long")


def whole_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` over all ``vec_id, embedding`` rows in 256ths; queries have an id divisible by ``every``.

    Rows that ``sound`` leaves out take no part, neither as queries nor as candidates.
    """
    rows = whole_numbers(sound(embeddings))
    return top_k(rows, rows.where(F.pmod("vec_id", F.lit(every)) == 0), k)
