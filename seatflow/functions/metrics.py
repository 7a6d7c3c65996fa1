"""Demand and capacity measures, tiers and texts derived from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seatflow.functions.cleaning import round_binary, round_to

# Categories without published figures before the cutoff year.
POLICY_CATEGORIES = ("1", "2A(1)", "2A(2)", "2A")
POLICY_CUTOFF = 2019

# Scenario code to distance band.
DISTANCE_BANDS = {
    "within_1km": ("SC<1", "PR<1"),
    "within_1km_no_leftover": ("SC<1#", "PR<1#"),
    "1_to_2km": ("SC1-2", "PR1-2"),
    "within_2km_no_leftover": ("SC<2#", "PR<2#"),
    "beyond_2km": ("SC>2", "PR>2"),
    "beyond_2km_no_leftover": ("SC#",),
}
CITIZEN_GROUPS = ("SC", "PR")


def has_full_figures(
    category: Column,
    year: Column,
    categories: Sequence[str] = POLICY_CATEGORIES,
    cutoff: int = POLICY_CUTOFF,
) -> Column:
    """False where figures are withheld by policy; an unknown category counts as published."""
    withheld = category.isin(*categories) & (year < cutoff)
    return ~F.coalesce(withheld, F.lit(False))


def guarded_ratio(num: Column, den: Column, published: Column, digits: int = 4) -> Column:
    """Rounded ratio, NULL if withheld or if the denominator is NULL or zero."""
    return F.when(published, round_to(F.try_divide(num, F.nullif(den, F.lit(0))), digits))


def remaining_places(capacity: Column, taken: Column, published: Column) -> Column:
    """May be negative: more were admitted than announced."""
    return F.when(published, capacity - taken)


def risk_tier(occurrences: Column, average: Column, threshold: float = 1.2, years: int = 3) -> Column:
    """HIGH, MEDIUM or LOW; a NULL average is LOW."""
    over = average > threshold
    return (
        F.when((occurrences == years) & over, "HIGH")
        .when((occurrences >= 1) & over, "MEDIUM")
        .otherwise("LOW")
    )


def is_occurrence(code: Column) -> Column:
    """A code counts as a ballot unless it ends in '#', which means all were admitted."""
    return F.coalesce(~code.endswith("#"), F.lit(False))


def prefix_class(code: Column, prefixes: Sequence[str] = CITIZEN_GROUPS) -> Column:
    return reduce(lambda acc, p: acc.when(code.startswith(p), F.lit(p)), prefixes, F)


def code_band(code: Column, bands: Mapping[str, Sequence[str]] = DISTANCE_BANDS) -> Column:
    """Band whose code set holds the code, else NULL."""
    return reduce(
        lambda acc, item: acc.when(code.isin(*item[1]), F.lit(item[0])), bands.items(), F
    )


def mask_not_open(capacity: Column, label: Column, mask: str = "N/A") -> Column:
    return F.when(capacity == 0, F.lit(mask)).otherwise(label)


def chance_ratio(rate: Column) -> Column:
    """Chance of a place (0 to 1) at a demand rate; rates below zero count as zero."""
    clipped = F.greatest(rate, F.lit(0.0))
    return F.when(clipped <= 1, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.try_divide(F.lit(1.0), clipped))
    )


def explain_risk(tier: Column, occurrences: Column, average: Column, change: Column) -> Column:
    """Sentence for a risk tier. LOW says "No balloting" whatever the count is.

    Fixed values: the four sentences are shown to users as they stand.
    """
    rate = F.format_string("%.2fx", round_binary(average, 2))
    in_all = F.concat(
        F.lit("Balloted in all 3 of the last 3 years with an average subscription rate of "), rate
    )
    return (
        F.when(
            (tier == "HIGH") & (change > 0),
            F.concat(
                in_all,
                F.lit(". Demand is increasing year-on-year — competition is intensifying."),
            ),
        )
        .when(
            tier == "HIGH",
            F.concat(
                in_all,
                F.lit(". Demand appears to be stabilising but competition remains high."),
            ),
        )
        .when(
            tier == "MEDIUM",
            F.concat(
                F.lit("Balloted in "),
                occurrences.cast("string"),
                F.lit(" of the last 3 years with an average subscription rate of "),
                rate,
                F.lit(". Monitor closely — this school has shown recent balloting activity."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("No balloting in the last 3 years. Average subscription rate of "),
                F.when(average.isNull(), F.lit("unavailable")).otherwise(rate),
                F.lit(". Ballot risk is currently low based on recent trends."),
            )
        )
    )


def fill_progress(capacity: Column, count: Column) -> tuple[Column, Column]:
    """Places left (never below zero) and filled share (0 when there is no capacity)."""
    left = F.greatest(F.lit(0), capacity - count)
    share = F.when(
        capacity > 0, round_binary(F.try_divide(capacity - left, capacity), 4)
    ).otherwise(F.lit(0.0))
    return left, share


def row_mean(*cols: Column) -> Column:
    """Mean of the non-NULL values in one row, NULL if there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, F.nullif(count, F.lit(0)))
