"""Which groups of a table changed, and tables of windowed rows kept up to date by them.

A measure over the earlier rows of a group changes only in groups with a changed row, and there
only from the first changed row on. So the rest of a stored table stays as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST = "_first"


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of the two tables has, with their number of times; nulls are equal.

    Both sides are counted per distinct row, which Spark does by the rows' hash: one shuffle
    with a partial count before it.
    """
    rows = old.withColumn("_times", F.lit(-1)).unionByName(new.withColumn("_times", F.lit(1)))
    return rows.groupBy(*new.columns).agg(F.sum("_times").alias("_times")).where("_times <> 0").drop("_times")


def first_changes(changed: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``keys`` and ``_first``, the least ``order`` of the changed rows, per touched group."""
    return changed.groupBy(*keys).agg(F.min(order).alias(FIRST))


def _matched(df: DataFrame, touched: DataFrame, keys: Sequence[str], how: str, order: str | None = None) -> DataFrame:
    """Join on the keys, where nulls match; with ``order``, of rows from the first change on."""
    side = touched.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], FIRST)
    on = [df[k].eqNullSafe(side[f"_k{i}"]) for i, k in enumerate(keys)]
    if order:
        on.append(df[order] >= side[FIRST])
    condition = on[0]
    for more in on[1:]:
        condition &= more
    return df.join(side, condition, how)


def of_groups(df: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the touched groups."""
    return _matched(df, touched, keys, "left_semi")


def from_first_change(df: DataFrame, touched: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of the touched groups from their first change on."""
    return _matched(df, touched, keys, "left_semi", order)


def before_first_change(df: DataFrame, touched: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of other groups, and those of touched groups before their first change."""
    return _matched(df, touched, keys, "left_anti", order)
