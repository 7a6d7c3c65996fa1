"""Optional filters, point lookups and custom orders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions.cleaning import canonical


def apply_filters(
    df: DataFrame, canonical_columns: Sequence[str] = (), **wanted: str | bool | None
) -> DataFrame:
    """AND of all given filters: text without case, flags exact, None means no filter.

    Columns named in ``canonical_columns`` hold canonical text, so they are compared bare,
    which reaches the scan; other text columns may be in any case.
    """
    for name, value in wanted.items():
        if value is None or value == "":
            continue
        if isinstance(value, str) and name in canonical_columns:
            df = df.filter(F.col(name) == F.lit(value.upper().strip()))
        elif isinstance(value, str):
            df = df.filter(F.upper(name) == F.upper(F.lit(value)))
        else:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def lookup_one(df: DataFrame, col: str, name: str, is_canonical: bool = False) -> DataFrame:
    """At most one row whose canonical name equals the given one.

    ``is_canonical`` says that the column holds canonical names, as built tables do; then the
    filter is pushed to the scan.
    """
    column = F.col(col) if is_canonical else canonical(F.col(col))
    return df.filter(column == F.lit(name.upper().strip())).limit(1)


def rank_of(col: Column, order: Sequence[str]) -> Column:
    """1-based place of a value in a fixed order, NULL if it is not listed."""
    return reduce(
        lambda acc, item: acc.when(col == F.lit(item[1]), F.lit(item[0])),
        enumerate(order, start=1),
        F,
    )


def in_order(df: DataFrame, col: str, order: Sequence[str], rank_col: str = "rank") -> DataFrame:
    """Rows with a listed value, in the listed order."""
    return (
        df.withColumn(rank_col, rank_of(F.col(col), order))
        .filter(F.col(rank_col).isNotNull())
        .orderBy(rank_col)
    )
