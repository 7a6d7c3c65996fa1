"""Reference joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(
    df: DataFrame, ref: DataFrame, on: Column | str | Sequence[str], columns: Sequence[Column | str] = ()
) -> DataFrame:
    """Left join that keeps unmatched rows with NULLs; NULL keys never match."""
    return df.join(ref.select(*columns) if columns else ref, on, "left")


def map_or_keep(
    df: DataFrame, mapping: DataFrame, col: str, source: Column, target: Column, alias: str
) -> DataFrame:
    """Mapped value where the mapping knows the name, else the name itself."""
    pairs = mapping.select(source.alias("_source"), target.alias("_target"))
    return (
        df.join(pairs, F.col(col) == F.col("_source"), "left")
        .withColumn(alias, F.coalesce("_target", col))
        .drop("_source", "_target")
    )


def merge_dimension(dim: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Full outer join on one shared key column."""
    return dim.join(extra, key, "full")


def split_dimension(
    df: DataFrame, key: str, volatile: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Stable and volatile halves of a wide table; both carry the key."""
    return df.drop(*volatile), df.select(key, *volatile)


def attach_record(
    df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str], alias: str
) -> DataFrame:
    """Matching record as one struct column, NULL when there is none."""
    record = other.select(*keys, F.struct(*columns).alias(alias))
    return df.join(record, list(keys), "left")
