"""Rolling measures over the years of an entity and category.

Input rows are unique per entity, category and year (``keep_latest`` or an
aggregation comes first), so a window group never holds more rows than there
are years, or categories for a total, however many raw rows the key had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def by_year(keys: Sequence[str], year: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(F.col(year).asc_nulls_first())


def rolling_avg(col: Column, window: WindowSpec, rows: int) -> Column:
    return F.avg(col).over(window.rowsBetween(1 - rows, 0))


def rolling_count(condition: Column, window: WindowSpec, rows: int) -> Column:
    hits = F.when(condition, 1).otherwise(0).cast("bigint")
    return F.sum(hits).over(window.rowsBetween(1 - rows, 0))


def change(col: Column, window: WindowSpec) -> Column:
    """Difference to the previous row, whatever its year."""
    return col - F.lag(col).over(window)


def offset_lag(
    df: DataFrame, keys: Sequence[str], year: str, lags: dict[str, tuple[str, int]]
) -> DataFrame:
    """Values of an exact earlier year: ``{alias: (column, years back)}``.

    Unlike a row lag a missing year gives NULL. All lags share one shuffle and
    one sort; a self join would need one of each per lag.
    """
    window = W.partitionBy(*keys).orderBy(F.col(year).cast("bigint"))
    return df.select(
        "*",
        *[
            F.max(col).over(window.rangeBetween(-back, -back)).alias(alias)
            for alias, (col, back) in lags.items()
        ],
    )


def group_total(col: Column, keys: Sequence[str]) -> Column:
    """Group total on every row; the group holds the categories of an entity and year."""
    return F.sum(col).over(W.partitionBy(*keys))
