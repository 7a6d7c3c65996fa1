"""Rows to the nested response shapes, and text blocks for prompts.

Groups are bounded: an entity has a handful of categories and at most a few
years of each, because the rows were cut by ``completed_and_current`` first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _year_struct(columns: Sequence[str], current: Column) -> Column:
    return F.struct(*columns, current.alias("is_current_year"))


def _sentinel(df: DataFrame, year: str, columns: Sequence[str], current: int) -> Column:
    """All-NULL year record that stands for a current year without data."""
    return F.struct(
        *[
            F.lit(current if c == year else None).cast(df.schema[c].dataType).alias(c)
            for c in columns
        ],
        F.lit(True).alias("is_current_year"),
    )


def _padded(years: Column, sentinel: Column) -> Column:
    return F.when(F.exists(years, lambda y: y["is_current_year"]), years).otherwise(
        F.concat(years, F.array(sentinel))
    )


def nest_all(
    df: DataFrame,
    entity_cols: Sequence[str],
    category: str,
    year: str,
    year_cols: Sequence[str],
    current: int,
) -> DataFrame:
    """Entity with categories[] of years[].

    A real current-year row sorts first (latest year first); a stand-in for a
    missing one comes last.
    """
    record = _year_struct(year_cols, F.col(year) == current)
    rows = F.collect_list(
        F.struct(F.col(category).alias("c"), (-F.col(year)).alias("o"), record.alias("y"))
    )
    sentinel = _sentinel(df, year, year_cols, current)
    grouped = df.groupBy(*entity_cols).agg(F.sort_array(rows).alias("_rows"))

    def one_category(name: Column) -> Column:
        years = F.transform(
            F.filter("_rows", lambda r: r["c"].eqNullSafe(name)), lambda r: r["y"]
        )
        return F.struct(name.alias("category"), _padded(years, sentinel).alias("years"))

    names = F.array_distinct(F.transform("_rows", lambda r: r["c"]))
    return grouped.select(*entity_cols, F.transform(names, one_category).alias("categories"))


def nest_one(
    df: DataFrame,
    entity_cols: Sequence[str],
    year: str,
    year_cols: Sequence[str],
    trend_cols: Sequence[str],
    current: int,
) -> DataFrame:
    """Entity with latest{}, trend{}, history[] and reference_years[].

    The latest completed year gives ``latest`` and ``trend``; history is the
    completed years, newest first, then the current year or its stand-in.
    """
    is_current = F.col(year) == current
    record = _year_struct(year_cols, is_current)
    rows = F.collect_list(
        F.struct(
            is_current.alias("cur"),
            (-F.col(year)).alias("o"),
            record.alias("y"),
            F.struct(*trend_cols).alias("t"),
        )
    )
    sentinel = _sentinel(df, year, year_cols, current)
    grouped = df.groupBy(*entity_cols).agg(F.sort_array(rows).alias("_rows"))
    done = F.filter("_rows", lambda r: ~r["cur"])
    return grouped.select(
        *entity_cols,
        F.get(done, F.lit(0))["y"].alias("latest_year"),
        F.get(done, F.lit(0))["t"].alias("trend"),
        _padded(F.transform("_rows", lambda r: r["y"]), sentinel).alias("history"),
        F.transform(done, lambda r: r["y"][year]).alias("reference_years"),
    )


def text_block(
    df: DataFrame, keys: Sequence[str], order: str, line: Column, heading: Column, alias: str
) -> DataFrame:
    """One text per key: a heading and one line per row, in category order."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return (
        df.groupBy(*keys)
        .agg(lines.alias("_lines"))
        .withColumn(
            alias,
            F.concat_ws(
                "\n", heading, F.array_join(F.transform("_lines", lambda r: r["line"]), "\n")
            ),
        )
        .drop("_lines")
    )


def facet_rows(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Distinct known (outer, inner) pairs, one row each; grows with the data."""
    return (
        df.filter((F.col(outer) != "UNKNOWN") & (F.col(inner) != "UNKNOWN"))
        .select(outer, inner)
        .distinct()
    )


def facet_lists(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Per outer value the sorted list of its distinct inner values: the pick list a person
    reads. ``facet_rows`` gives the same as rows, where a list would get too long for one row.
    """
    pairs = facet_rows(df, outer, inner)
    return pairs.groupBy(outer).agg(F.sort_array(F.collect_list(inner)).alias("values"))
