"""Deterministic hash keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a NULL part contributes, so NULL and '' give different keys.
NULL_PART = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*cols: str | Column) -> Column:
    parts = []
    for col in cols:
        col = F.col(col) if isinstance(col, str) else col
        parts.append(F.coalesce(col.cast("string"), F.lit(NULL_PART)))
    return F.md5(F.concat_ws("-", *parts))
