"""Completed years, the current year, and stand-in rows for a missing one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def completed_and_current(
    df: DataFrame, keys: Sequence[str], year: str, current: int, n: int
) -> DataFrame:
    """Last ``n`` completed years per key and every current-year row, in one scan.

    Later years are left out. The window group is bounded by the years of a key.
    """
    completed = F.col(year) < current
    window = W.partitionBy(*keys, completed).orderBy(F.col(year).desc_nulls_last())
    return (
        df.filter(F.col(year) <= current)
        .withColumn("_rank", F.row_number().over(window))
        .filter((F.col(year) == current) | (F.col("_rank") <= n))
        .drop("_rank")
    )


def with_latest_completed(
    df: DataFrame, keys: Sequence[str], year: str, current: int, predicate: Column
) -> DataFrame:
    """Rows of the keys whose latest completed row meets the predicate.

    For rows that are unique per key and year; the window shares its shuffle with
    ``completed_and_current``. ``ranking.qualify`` does the same for any rows.
    """
    completed_year = F.when(F.col(year) < current, F.col(year))
    return (
        df.withColumn(
            "_qualifies", F.max_by(predicate, completed_year).over(W.partitionBy(*keys))
        )
        .filter(F.col("_qualifies"))
        .drop("_qualifies")
    )


def pad_current_year(
    df: DataFrame, keys: Sequence[str], year: str, current: int
) -> DataFrame:
    """One all-NULL row for every key that has no row of the current year."""
    lacking = (
        df.groupBy(*keys)
        .agg(F.max((F.col(year) == current).cast("int")).alias("_has"))
        .filter(F.coalesce(F.col("_has"), F.lit(0)) == 0)
        .select(*keys, F.lit(current).cast(df.schema[year].dataType).alias(year))
    )
    return df.unionByName(lacking, allowMissingColumns=True)
