"""Dates, lifecycle state at a date, and timestamps in a named zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Singapore"
ZONE_OFFSET = "+08:00"


def as_of_date(as_of: str | dt.date | Column | None = None) -> Column:
    """The reference date of a run; today unless given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def is_current_year(year: Column, as_of=None) -> Column:
    return F.year(as_of_date(as_of)) == year


def is_active(status: Column, to_year: Column, as_of=None) -> Column:
    """Merged entities and gaps without an end year are never active."""
    return (
        F.when(status == "active", F.lit(True))
        .when(
            status == "relocated_gap",
            F.coalesce(F.year(as_of_date(as_of)) > to_year, F.lit(False)),
        )
        .otherwise(F.lit(False))
    )


def status_text(
    active: Column, status: Column, from_year: Column, to_year: Column, merged_into: Column
) -> Column:
    """Sentence for a lifecycle state; NULL if a part it needs is NULL.

    Fixed values: the sentences are shown to users as they stand.
    """
    closed = "School is not for enrollment. "
    return (
        F.when(active, F.lit("School is active for enrollment"))
        .when(
            status == "merged",
            F.concat(
                F.lit(closed + "It was merged under "),
                merged_into,
                F.lit(" on "),
                from_year.cast("string"),
            ),
        )
        .when(
            status == "relocated_gap",
            F.concat(
                F.lit(closed + "Enrollment was ceased in "),
                from_year.cast("string"),
                F.lit(" and will be reopened in "),
                (to_year + 1).cast("string"),
            ),
        )
        .otherwise(F.lit("Unknown status"))
    )


def iso_text(local: Column, offset: str = ZONE_OFFSET) -> Column:
    """ISO text of a wall-clock time. Java's zone pattern prints the session
    offset, so the offset of the named zone is appended."""
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def iso_in_zone(
    ts: Column, zone: str = ZONE, offset: str = ZONE_OFFSET, source: str | None = None
) -> Column:
    """ISO text of an instant, seen in a zone with a fixed offset.

    ``source`` names the zone of a TIMESTAMP_NTZ; a TIMESTAMP needs none.
    """
    source_zone = F.current_timezone() if source is None else F.lit(source)
    local = F.convert_timezone(source_zone, F.lit(zone), ts.cast("timestamp_ntz"))
    return iso_text(local, offset)


def slot_time(start: Column, day: Column, slot: Column) -> Column:
    """Wall-clock time of a snapshot slot: noon or six in the evening of the n-th day."""
    hour = F.when(slot == "midday", F.lit(12)).otherwise(F.lit(18))
    day_start = F.date_add(start, day.cast("int") - 1).cast("timestamp_ntz")
    return day_start + F.make_dt_interval(F.lit(0), hour)
