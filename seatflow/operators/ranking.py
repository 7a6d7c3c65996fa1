"""Latest row, top rows and rows at the latest period of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _tie_breakers(df: DataFrame, used: Sequence[str]) -> list[Column]:
    """All other sortable columns, so that equal rows are the only ties left."""
    return [
        F.col(f"`{field.name}`").desc_nulls_last()
        for field in df.schema.fields
        if field.name not in used and field.dataType.typeName() not in ("map", "variant")
    ]


def _descending(col: str | Column) -> Column:
    return F.col(col).desc_nulls_last() if isinstance(col, str) else col


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    n: int = 1,
    rank_col: str | None = None,
) -> DataFrame:
    """First ``n`` rows per key; names in ``order`` sort descending.

    Spark cuts every input partition to ``n`` rows per key before the shuffle
    (WindowGroupLimit), so a hot key never reaches one task whole.
    """
    order = [order] if isinstance(order, (str, Column)) else list(order)
    named = [c for c in order if isinstance(c, str)]
    ranking = [_descending(c) for c in order] + _tie_breakers(df, [*keys, *named])
    rank = rank_col or "_rank"
    window = W.partitionBy(*keys).orderBy(*ranking)
    out = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return out if rank_col else out.drop(rank)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one that sorts first."""
    return top_n(df, keys, order, 1)


def rows_at_latest(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """All rows of the latest period, per key or over the whole table."""
    if not keys:
        latest = df.agg(F.max(period).alias(period))
        return df.join(latest, period, "left_semi")
    latest = df.groupBy(*keys).agg(F.max(period).alias(period))
    return df.join(latest, [*keys, period], "left_semi")


def top_rank(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Rows of the latest period per key in one shuffle, where a key has few such rows.

    Earlier periods are dropped before the shuffle. ``rows_at_latest`` is the way
    for keys that may hold many rows in their latest period.
    """
    window = W.partitionBy(*keys).orderBy(F.col(period).desc_nulls_last())
    return df.withColumn("_rank", F.rank().over(window)).filter("_rank = 1").drop("_rank")


def qualify(
    df: DataFrame, candidates: DataFrame, keys: Sequence[str], order: str, predicate: Column
) -> DataFrame:
    """Rows of ``df`` whose key has a latest candidate row that meets the predicate."""
    chosen = keep_latest(candidates, keys, [order]).filter(predicate).select(*keys)
    return df.join(chosen, list(keys), "left_semi")
