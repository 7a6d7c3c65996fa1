"""Vectors in blocks of bounded size, and queries that visit every block.

The two vector searches share this: an index is a stored table with one row per block of
vectors; the rows of a query are copied to all blocks, but only in bounded groups, and each
block answers with its k best, which are merged per query. No task holds more than a block
and a group of queries, whatever the sizes of the tables, and no bucket can run hot, because
vectors are dealt to blocks by a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatflow.llm.common import stored

#: Vector components in a block at most, about: 2 MB in double precision.
BLOCK_VALUES = 1 << 18
#: Queries that visit a block together.
GROUP = 2048
ARROW = {
    "int": pa.int32(),
    "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "binary": pa.binary(),
}


def sound(vectors: DataFrame, zero_allowed: bool = True) -> DataFrame:
    """``vec_id long, vector array<double>`` of the rows of ``vec_id, embedding`` that take part.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite component
    and, unless allowed, vectors of zeros. Rows that repeat id and vector count once.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite)
    if not zero_allowed:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "vector"])


def first_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors the k + 1 smallest ids.

    Equal vectors score alike and ties go to the smaller id, so no query can have more of
    them among its k best, even if it is itself one of the k + 1. This is no cap: nothing
    that could be returned is left out. The window is cut before its shuffle.
    """
    place = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build_blocks(rows: DataFrame, pack: Callable[[pa.Table], dict], schema: str, name: str) -> DataFrame:
    """A stored index, one row per block: block, dim and what ``pack`` makes of its rows.

    Vectors of different lengths do not share a block.
    """
    rows = rows.withColumn("dim", F.size("vector"))
    count = rows.groupBy("dim").count()
    n_blocks = F.ceil(F.col("count") * F.col("dim") / BLOCK_VALUES).cast("int").alias("blocks")
    dealt = rows.join(count.select("dim", n_blocks), "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    full = f"dim int, block int, blocks int, {schema}"
    arrow = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in full.split(", ")])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        fixed = {c: table.column(c)[0].as_py() for c in ("dim", "block", "blocks")}
        return pa.Table.from_pylist([{**fixed, **pack(table)}], schema=arrow)

    packed = dealt.groupBy("dim", "block").applyInArrow(run, full)
    return stored(packed, name)


def search_blocks(index: DataFrame, queries: DataFrame, answer: Callable, k: int, score_type: str) -> DataFrame:
    """The k best per query: query_id, rank, vec_id, score.

    ``answer(block row, query ids, query matrix)`` gives (query position, vec_id, score) arrays.
    """
    blocks = index.select("dim", "block")
    group = F.pmod(F.xxhash64("vec_id", F.lit("group")), F.lit(1 << 20))
    queries = queries.withColumn("dim", F.size("vector"))
    counts = queries.groupBy("dim").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    queries = queries.join(counts, "dim").withColumn("group", (group % F.col("groups")).cast("int")).drop("groups")
    keyed = F.xxhash64("vec_id", "vector")
    copies = queries.withColumn("query", keyed).join(index.groupBy("dim").agg(F.max("blocks").alias("blocks")), "dim")
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    copies = copies.join(blocks, ["dim", "block"], "left_semi")
    groups = F.sequence(F.lit(0), (F.col("groups") - 1).cast("int"))
    visited = index.join(counts, "dim").withColumn("group", F.explode(groups)).drop("groups")
    keys = ["dim", "block", "group"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([[]] * 4, schema=SCHEMA)
        row = {c: left.column(c)[0] for c in left.column_names}
        ids = right.column("vec_id").to_numpy()
        at, found, score = answer(row, ids, matrix(right.column("vector")))
        query = right.column("query").to_numpy()
        return pa.table([query[at], ids[at], found, score], schema=SCHEMA)

    kind = pa.int64() if score_type == "long" else pa.float64()
    SCHEMA = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])
    found = (
        visited.groupBy(*keys)
        .cogroup(copies.groupBy(*keys))
        .applyInArrow(run, f"query long, query_id long, vec_id long, score {score_type}")
    )
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
