"""Model inputs: lag features, the split by year, and rows to predict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.functions.metrics import row_mean
from seatflow.operators.trends import offset_lag

LAGS = ("lag1", "lag2", "lag3")


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    year: str,
    rate: str,
    vacancy: str,
    flags: Sequence[str] = (),
) -> DataFrame:
    """Rates of the three years before, their mean, last year's vacancy, flags as numbers."""
    lags = {alias: (rate, back) for back, alias in enumerate(LAGS, start=1)}
    out = offset_lag(df, keys, year, {**lags, "lag1_vacancy": (vacancy, 1)})
    out = out.withColumn("rate_3yr_mean", row_mean(*map(F.col, LAGS)))
    return out.withColumns({f: F.col(f).cast("double") for f in flags})


def time_split(
    df: DataFrame, year: str, target: str, train: Sequence[int], evaluate: Sequence[int]
) -> DataFrame:
    """Rows with a target, marked ``train`` or ``eval`` by their year; other years drop out."""
    part = F.when(F.col(year).isin(*train), "train").when(F.col(year).isin(*evaluate), "eval")
    return (
        df.filter(F.col(target).isNotNull())
        .withColumn("part", part)
        .filter(F.col("part").isNotNull())
    )


def prediction_frame(
    df: DataFrame,
    keys: Sequence[str],
    year: str,
    predict_year: int,
    rate: str,
    vacancy: str,
    attributes: Sequence[str],
    flags: Sequence[str] = (),
) -> DataFrame:
    """One row per key for ``predict_year``: last known attributes and lag features.

    Keys without a rate in the three years before are left out. Everything is
    one aggregation: the lags are conditional maxima over the years needed.
    """
    place = F.col(year)
    out = df.groupBy(*keys).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
            for c in attributes
        ],
        *[
            F.max(F.when(place == predict_year - back, F.col(rate))).alias(alias)
            for back, alias in enumerate(LAGS, start=1)
        ],
        F.max(F.when(place == predict_year - 1, F.col(vacancy))).alias("lag1_vacancy"),
    )
    out = (
        out.dropna(how="all", subset=list(LAGS))
        .withColumn("rate_3yr_mean", row_mean(*map(F.col, LAGS)))
        .withColumn(year, F.lit(predict_year).cast("bigint"))
    )
    return out.withColumns({f: F.col(f).cast("double") for f in flags})
