"""Profiles, last known values, error measures and distinct filter values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions.cleaning import round_to


def last_non_null(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Per column the last value that is not NULL; columns may come from different rows."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in cols]
    )


def profile(df: DataFrame, entity: str, year: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(entity).alias("n_entities"),
        F.min(year).cast("bigint").alias("min_year"),
        F.max(year).cast("bigint").alias("max_year"),
    )


def profile_parts(df: DataFrame, part: str, cols: Sequence[str]) -> DataFrame:
    """Per value of ``part`` what can be added up later: rows, known values and a sketch of the
    distinct values of each column. Stored by ``part``, a new or changed one is profiled alone."""
    measures = [F.count("*").alias("n_rows")]
    for c in cols:
        measures += [F.count(c).alias(f"{c}_known"), F.hll_sketch_agg(F.col(c).cast("string")).alias(f"{c}_sketch")]
    return df.groupBy(part).agg(*measures)


def merged_profile(parts: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row over all stored parts: n_rows and per column known and distinct values. The latter
    are estimates, within some percent; ``profile`` counts them exactly by reading all rows."""
    measures = [F.sum("n_rows").alias("n_rows")]
    for c in cols:
        distinct = F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch"))
        measures += [F.sum(f"{c}_known").alias(f"{c}_known"), distinct.alias(f"{c}_distinct")]
    return parts.agg(*measures)


def regression_metrics(df: DataFrame, truth: str, guess: str, digits: int = 6) -> DataFrame:
    """MAE, RMSE and R2 in one pass over the rows."""
    y, error = F.col(truth), F.col(truth) - F.col(guess)
    spread = F.var_pop(y) * F.count(y)
    return df.agg(
        F.count(y).alias("n"),
        round_to(F.avg(F.abs(error)), digits).alias("mae"),
        round_to(F.sqrt(F.avg(error * error)), digits).alias("rmse"),
        round_to(
            1 - F.try_divide(F.sum(error * error), F.nullif(spread, F.lit(0.0))), digits
        ).alias("r2"),
    )


def mae_by(df: DataFrame, key: str, truth: str, guess: str, digits: int = 6) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("n"),
        round_to(F.avg(F.abs(F.col(truth) - F.col(guess))), digits).alias("mae"),
    )


def filter_values(df: DataFrame, required: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distinct value tuples whose required columns are known."""
    for c in required:
        df = df.filter(F.col(c) != "UNKNOWN")
    return df.select(*cols).distinct()
