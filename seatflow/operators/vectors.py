"""Nearest chunks by cosine distance, and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A block holds no more rows, and no more bytes of vectors.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 128 * 2**20
#: Blocks may be smaller, down to this many rows, so that there are more pairs of them than cores.
LEAST_ROWS, PAIRS_PER_CORE = 4_096, 16
#: Queries and rows whose products are made at a time, so that they stay in the cache of a core.
QUERY_SLICE, TILE = 128, 2_048
#: The rows of a tile make so many groups; the nearest row of a group tells if the others matter.
GROUPS = 256
#: Numbers of the vectors that are multiplied again in double precision at a time.
EXACT_NUMBERS = 4 * 2**20
DIGITS = 6
OUT_OF_SCOPE = 0.60


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two array columns, computed in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    norms[norms == 0] = np.nan
    return vectors / norms


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one width as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(widths) != 1:
        raise ValueError("vectors differ in width")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), int(widths[0]))


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows per query; equal distances by id."""
    ordered = found.sort_values(["query_id", "distance", "id"], ignore_index=True)
    return ordered.groupby("query_id", sort=False).head(k)


def _tiles(units: np.ndarray) -> list[np.ndarray]:
    """The rows as columns of single precision, some at a time."""
    return [np.ascontiguousarray(units[at : at + TILE].T, np.float32) for at in range(0, len(units), TILE)]


def _candidates(units: np.ndarray, tiles: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries and groups of rows that may hold one of their ``k`` nearest, and how like a row has to be.

    Products in single precision are off by no more than their length times its precision. The k-th
    greatest of the greatest of groups is no more than the k-th greatest of the rows, so
    nothing below it, less twice that error and a step of rounding, is among the ``k`` nearest.
    """
    asked = units.astype(np.float32)
    most = np.empty((len(asked), len(tiles) * GROUPS), np.float32)
    like = np.empty((len(asked), TILE), np.float32)
    for t, tile in enumerate(tiles):
        np.matmul(asked, tile, out=like[:, : tile.shape[1]])
        like[:, tile.shape[1] :] = -np.inf
        of_tile = like.reshape(len(asked), -1, GROUPS)
        of_tile.max(axis=1, out=most[:, t * GROUPS : (t + 1) * GROUPS])
    coarse = most.reshape(len(asked), -1, GROUPS).max(axis=1) if k <= GROUPS else most
    edge = np.full(len(asked), -np.inf)
    if k <= coarse.shape[1]:
        off = (units.shape[1] + 4) * 2.0**-23
        edge = np.partition(coarse, -k, axis=1)[:, -k] - (2 * off + 2 * 10.0**-DIGITS)
    rows, groups = np.nonzero(most >= edge[:, None])
    return rows, groups, edge


def _nearest(
    query_ids: np.ndarray, query_units: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> pd.DataFrame:
    """The ``k`` nearest corpus rows of every query, within one block.

    All rows as near as the k-th are looked at, so ties are cut by id alone. Single precision
    tells which rows can be among them; only these are multiplied in double precision, rounded
    and ranked. Vectors without a direction are near to nothing.
    """
    units = _unit(vectors)
    directed, asked = np.isfinite(units).all(axis=1), np.isfinite(query_units).all(axis=1) & ~pd.isna(query_ids)
    units, ids = units[directed], ids[directed]
    query_ids, query_units = query_ids[asked], query_units[asked]
    if not len(ids) or not len(query_ids):
        return pd.DataFrame({"query_id": query_ids[:0], "id": ids[:0], "distance": np.empty(0)})
    places, _ = pd.factorize(ids, sort=True)
    places = np.where(places < 0, len(ids), places)
    tiles, in_group = _tiles(units), GROUPS * np.arange(TILE // GROUPS)
    at_once = max(1, EXACT_NUMBERS // (len(in_group) * max(1, units.shape[1])))
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(query_ids), QUERY_SLICE):
        mine = query_units[start : start + QUERY_SLICE]
        of, groups, edge = _candidates(mine, tiles, k)
        near = []
        for at in range(0, len(of), at_once):
            rows, group = of[at : at + at_once], groups[at : at + at_once]
            cols = (group // GROUPS * TILE + group % GROUPS)[:, None] + in_group
            like = np.einsum("pw,pjw->pj", mine[rows], units[np.minimum(cols, len(ids) - 1)])
            own, which = np.nonzero((cols < len(ids)) & (like >= edge[rows, None]))
            near.append((rows[own], cols[own, which], np.round(1.0 - like[own, which], DIGITS) + 0.0))  # no negative zero
        rows, cols, distance = map(np.concatenate, zip(*near, strict=True))
        order = np.lexsort((places[cols], distance, rows))
        rows, cols, distance = rows[order], cols[order], distance[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((rows[kept] + start, cols[kept], distance[kept]))
    rows, cols, distance = map(np.concatenate, zip(*found, strict=True))
    return pd.DataFrame({"query_id": query_ids[rows], "id": ids[cols], "distance": distance})


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_pandas().to_numpy()


def _scan(
    query_ids: np.ndarray, query_units: np.ndarray, k: int, schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: one pass over a partition, keeping ``k`` rows per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            if batch.num_rows and len(query_ids):
                found = _nearest(query_ids, query_units, _values(batch.column(0)), _matrix(batch.column(1)), k)
                kept = found if kept is None else _first(pd.concat([kept, found]), k)
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept, schema, preserve_index=False)

    return run


def _sides(corpus: DataFrame, id_col: str, vector: str) -> DataFrame:
    return corpus.filter(F.col(vector).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("embedding")
    )


def _arrow(query_id: pa.DataType, id_: pa.DataType) -> pa.Schema:
    return pa.schema([("query_id", query_id), ("id", id_), ("distance", pa.float64())])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    window = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def nearest_to(
    corpus: DataFrame, vectors: Mapping, k: int, id_col: str, vector: str = "embedding"
) -> DataFrame:
    """``query_id, id, distance, rank`` for query vectors that the caller holds in memory.

    This is the way of a single request: its vectors go to the tasks with the code, and each
    task makes one pass over its part of the corpus, keeping k rows per query.
    """
    base = _sides(corpus, id_col, vector)
    ids = np.array(list(vectors))
    units = _unit(np.array([list(v) for v in vectors.values()], np.float64)) if len(ids) else np.empty((0, 0))
    kind = "string" if ids.dtype.kind in "UO" else "long"
    id_kind = base.schema["id"].dataType.simpleString()
    schema = _arrow(pa.string() if kind == "string" else pa.int64(), to_arrow_type(base.schema["id"].dataType))
    found = base.mapInArrow(_scan(ids, units, k, schema), f"query_id {kind}, id {id_kind}, distance double")
    return _ranked(found, k)


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str,
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, id, distance, rank``: the ``k`` nearest rows of every query, exactly.

    Filter ``corpus`` first for a metadata condition. Both sides are hashed into blocks of
    about ``block_rows`` rows, fewer if their vectors are very wide or cores would have nothing to
    do, and every corpus block meets every query block in one task, which keeps k rows per query.
    The plan is lazy: the number of blocks is a subquery over the sizes of the vectors. Nothing
    depends on the size but that number.
    """
    base = _sides(corpus, id_col, vector)
    asked = queries.filter(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("query_id"),
        F.col(query_vector).cast("array<double>").alias("embedding"),
    )

    cores = corpus.sparkSession.sparkContext.defaultParallelism

    def blocks(df: DataFrame) -> Column:
        numbers = F.coalesce(F.sum(F.size("embedding")), F.lit(0))
        spread = F.least(F.count("*") / LEAST_ROWS, F.sqrt(F.lit(PAIRS_PER_CORE * cores)))
        most = F.greatest(F.count("*") / block_rows, numbers * 8 / BLOCK_BYTES, spread)
        return df.agg(F.greatest(F.lit(1), F.ceil(most)).cast("int")).scalar()

    def every(n: Column, alias: str) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1)).alias(alias)

    of_corpus, of_queries = blocks(base), blocks(asked)
    left = base.withColumn("cb", F.pmod(F.xxhash64("id"), of_corpus).cast("int"))
    left = left.select("cb", every(of_queries, "qb"), "id", "embedding")
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), of_queries).cast("int"))
    right = right.select("qb", every(of_corpus, "cb"), "query_id", "embedding")
    kinds = asked.schema["query_id"].dataType, base.schema["id"].dataType
    schema = _arrow(*map(to_arrow_type, kinds))

    def meet(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return schema.empty_table()
        units = _unit(_matrix(q["embedding"]))
        found = _nearest(_values(q["query_id"]), units, _values(c["id"]), _matrix(c["embedding"]), k)
        return pa.Table.from_pandas(found, schema, preserve_index=False)

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(
        meet, f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, distance double"
    )
    return _ranked(found, k)


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key; one vector per key and task is shuffled."""
    rows = df.filter(F.col(vector).isNotNull())
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.groupBy(key).agg(mean.alias("_mean")).select(key, vector_to_array("_mean").alias(vector))


def is_out_of_scope(distance: Column, has_entity: Column, limit: float = OUT_OF_SCOPE) -> Column:
    """Nothing near was found and no entity is named."""
    return (distance > limit) & ~has_entity


def scope_gate(
    questions: DataFrame,
    hits: DataFrame,
    query_id: str,
    has_entity: Column,
    limit: float = OUT_OF_SCOPE,
) -> DataFrame:
    """Best distance of every question (1.0 without a hit) and whether it is out of scope."""
    best = hits.groupBy("query_id").agg(F.min("distance").alias("_best"))
    asked = questions.select(F.col(query_id).alias("query_id"), has_entity.alias("_has_entity"))
    return (
        asked.join(best, "query_id", "left")
        .select("query_id", F.coalesce("_best", F.lit(1.0)).alias("best_distance"), "_has_entity")
        .withColumn("out_of_scope", is_out_of_scope(F.col("best_distance"), F.col("_has_entity"), limit))
        .drop("_has_entity")
    )


def hit_at_k(results: DataFrame, truth: DataFrame, topic: str, accepted: str) -> DataFrame:
    """Per question whether a found topic contains an accepted word."""
    found = F.exists(accepted, lambda word: F.contains(F.lower(topic), word))
    hits = results.join(truth, "query_id").groupBy("query_id").agg(F.max(found).alias("_hit"))
    return truth.join(hits, "query_id", "left").select(
        "query_id", F.coalesce("_hit", F.lit(False)).alias("hit")
    )
