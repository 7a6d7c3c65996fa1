"""Projected counts of a registration window: six slots per school and phase."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions.dates import iso_text, slot_time
from seatflow.functions.metrics import fill_progress

# Day, slot and share of the final count reached by then.
SCHEDULE = (
    (1, "midday", 0.35),
    (1, "end_of_day", 0.55),
    (2, "midday", 0.75),
    (2, "end_of_day", 0.87),
    (3, "midday", 0.95),
    (3, "end_of_day", 1.00),
)


# First day of the three-day window per year and phase.
WINDOW_START = {
    (2026, "2B"): "2026-07-24",
    (2026, "2C"): "2026-08-08",
    (2026, "2C(S)"): "2026-08-24",
}


def window_start(
    year: Column, phase: Column, windows: Mapping[tuple[int, str], str] = WINDOW_START
) -> Column:
    """First day of the window of a year and phase, NULL if none is announced."""
    return reduce(
        lambda acc, item: acc.when(
            (year == item[0][0]) & (phase == item[0][1]), F.lit(item[1]).cast("date")
        ),
        windows.items(),
        F,
    )


def project_fill(
    seeds: DataFrame,
    start: Column,
    key_cols: Sequence[str] = ("school_name", "phase", "registration_year"),
    capacity: str = "vacancy_at_open",
    final: str = "final_applied_count",
    schedule: Sequence[tuple[int, str, float]] = SCHEDULE,
) -> DataFrame:
    """Rows of ``seeds`` times the slots of the schedule, without a join.

    Counts are rounded half to even. Slot times are wall-clock times in the
    zone of the registration.
    """
    slots = F.array(
        *[
            F.struct(
                F.lit(day).alias("simulation_day"),
                F.lit(slot).alias("snapshot_type"),
                F.lit(share).alias("share"),
            )
            for day, slot, share in schedule
        ]
    )
    rows = seeds.select(*key_cols, capacity, final, start.alias("_start"), F.inline(slots))
    count = F.rint(F.coalesce(F.col(final), F.lit(0)) * F.col("share")).cast("bigint")
    rows = rows.withColumn("applied_count", count)
    left, filled = fill_progress(F.col(capacity), F.col("applied_count"))
    time = slot_time(F.col("_start"), F.col("simulation_day"), F.col("snapshot_type"))
    event = F.md5(
        F.concat_ws(
            "-", *[F.col(c).cast("string") for c in key_cols], "simulation_day", "snapshot_type"
        )
    )
    return rows.select(
        event.alias("event_id"),
        *key_cols,
        iso_text(time).alias("snapshot_timestamp"),
        "snapshot_type",
        F.col(capacity).alias("vacancy_at_open"),
        left.alias("vacancy_remaining"),
        "applied_count",
        filled.alias("pct_filled"),
        "simulation_day",
    )
