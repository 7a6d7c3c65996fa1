"""Parameterised read queries over the built tables, each one lazy plan.

School names and phases of built tables are canonical, so filters on them are compared bare
and reach the scan; given names and phases may be in any case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions.dates import iso_in_zone
from seatflow.functions.metrics import explain_risk
from seatflow.operators.filters import apply_filters, in_order, lookup_one
from seatflow.operators.lookups import attach_record
from seatflow.operators.nesting import facet_rows, nest_all, nest_one
from seatflow.operators.periods import completed_and_current, with_latest_completed
from seatflow.operators.ranking import top_n
from seatflow.plans.ballots import MART_PHASES

# Pick-list orders.
ZONE_ORDER = ("NORTH", "SOUTH", "EAST", "WEST")
NATURE_ORDER = ("CO-ED SCHOOL", "BOYS' SCHOOL", "GIRLS' SCHOOL")

LOCATION_FILTERS = ("zone_code", "dgp_code")
ATTRIBUTE_FILTERS = (
    "type_code", "nature_code", "sap_ind", "autonomous_ind", "gifted_ind", "ip_ind"
)
ENTITY_COLUMNS = (
    "school_name_clean dgp_code zone_code type_code nature_code sap_ind autonomous_ind gifted_ind "
    "ip_ind mothertongue1_code mothertongue2_code mothertongue3_code postal_code school_status "
    "school_status_description"
).split()
YEAR_COLUMNS = (
    "registration_year total_vacancy vacancy applied taken remaining_places subscription_rate "
    "ballot_scenario_code ballot_description ballot_applicants ballot_vacancies ballot_chance_pct "
    "ballot_citizen_group ballot_distance_band ballot_risk_level"
).split()
TREND_COLUMNS = (
    "ballot_occurrences_last_3yr ballot_occurrences_last_5yr subscription_rate_3yr_avg "
    "subscription_rate_5yr_avg subscription_rate_yoy_change vacancy_3yr_avg vacancy_yoy_change"
).split()
INTERIM_COLUMNS = (
    "simulation_day snapshot_type snapshot_timestamp vacancy_at_open vacancy_remaining "
    "applied_count pct_filled"
).split()
PREDICTION_COLUMNS = ["predicted_subscription_rate", "predicted_ballot_chance_pct"]
PREDICTION_TYPE = "struct<predicted_subscription_rate:double,predicted_ballot_chance_pct:double>"
INTERIM_TYPE = (
    "struct<simulation_day:int,snapshot_type:string,snapshot_timestamp:string,"
    "vacancy_at_open:int,vacancy_remaining:int,applied_count:int,pct_filled:double>"
)


def _checked(filters: dict, location: bool) -> dict:
    unknown = set(filters) - set(LOCATION_FILTERS) - set(ATTRIBUTE_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    if location and not any(filters.get(c) for c in LOCATION_FILTERS):
        raise ValueError("give a zone_code, a dgp_code or both")
    return filters


def flag(config: DataFrame, key: str, default: bool = False) -> bool:
    """Value of one flag. The key is unique, so at most one row reaches the driver."""
    row = config.filter(F.col("config_key") == key).select("config_value").first()
    return default if row is None or row[0] is None else bool(row[0])


def list_schools(dim: DataFrame, is_active: bool | None = True, **filters) -> DataFrame:
    """Schools that meet all given filters; only active ones unless told otherwise."""
    _checked(filters, location=False)
    return (
        apply_filters(dim, is_active=is_active, **filters)
        .withColumnRenamed("school_name_clean", "school_name")
        .select(
            "school_key", "school_name", *ENTITY_COLUMNS[1:3], "session_code",
            *ENTITY_COLUMNS[3:], "is_active",
        )
        .orderBy(F.col("school_name").asc_nulls_first())
    )


def school_detail(dim: DataFrame, general: DataFrame, name: str) -> DataFrame:
    """One school with its contact details, or no row."""
    return lookup_one(dim, "school_name_clean", name, is_canonical=True).join(general, "school_key", "left")


def result_count(found: DataFrame, **echo: str | bool | None) -> DataFrame:
    """One row: number of results and the filters they were asked with."""
    given = [F.lit(v).alias(k) for k, v in echo.items() if v is not None]
    return found.agg(F.count("*").alias("count")).select("count", *given)


def metadata_rows(
    dim: DataFrame,
    zone_order: Sequence[str] = ZONE_ORDER,
    nature_order: Sequence[str] = NATURE_ORDER,
) -> dict[str, DataFrame]:
    """Filter values in display order and the active schools, each as rows."""
    known = dim.filter((F.col("zone_code") != "UNKNOWN") & (F.col("dgp_code") != "UNKNOWN"))
    estates = facet_rows(dim, "zone_code", "dgp_code")
    active = dim.filter(F.col("is_active") & (F.col("dgp_code") != "UNKNOWN"))
    return {
        "zones": in_order(known.select("zone_code").distinct(), "zone_code", zone_order),
        "estates_by_zone": estates.filter(F.col("zone_code").isin(*zone_order)),
        "all_estates": known.select("dgp_code").distinct().orderBy("dgp_code"),
        "type_codes": known.select("type_code").dropna().distinct().orderBy("type_code"),
        "nature_codes": in_order(
            known.select("nature_code").distinct(), "nature_code", nature_order
        ),
        "schools": active.select(
            F.col("school_name_clean").alias("school_name"), "dgp_code"
        ).orderBy("school_name"),
    }


def predictions_for(predictions: DataFrame, year: int, phase: str | None = None) -> DataFrame:
    out = predictions.filter(F.col("registration_year") == year)
    if phase:
        out = out.filter(F.col("phase") == phase.upper())
    return out.select("school_name", "phase", *PREDICTION_COLUMNS)


def interim_for(
    interim: DataFrame,
    year: int,
    phase: str | None = None,
    zone_code: str | None = None,
    dgp_code: str | None = None,
) -> DataFrame:
    """Latest snapshots of a year with their time as ISO text."""
    out = apply_filters(
        interim.filter(F.col("registration_year") == year), zone_code=zone_code, dgp_code=dgp_code
    )
    if phase:
        out = out.filter(F.col("phase") == phase.upper())
    time = iso_in_zone(F.col("snapshot_timestamp")).alias("snapshot_timestamp")
    return out.select(
        "school_name", "phase", *[time if c == "snapshot_timestamp" else c for c in INTERIM_COLUMNS]
    )


def _nested_records(df: DataFrame, predictions: DataFrame | None, interim: DataFrame | None):
    """Prediction and interim record per school and phase; NULL when switched off or missing."""
    keys = ["school_name_clean", "phase_normalised"]
    for other, columns, alias, kind in (
        (predictions, PREDICTION_COLUMNS, "ml_prediction", PREDICTION_TYPE),
        (interim, INTERIM_COLUMNS, "interim", INTERIM_TYPE),
    ):
        if other is None:
            df = df.withColumn(alias, F.lit(None).cast(kind))
            continue
        renamed = other.withColumnsRenamed(
            {"school_name": "school_name_clean", "phase": "phase_normalised"}
        )
        df = attach_record(df, renamed, keys, columns, alias)
    return df


def _by_place(df: DataFrame, ordered: bool) -> DataFrame:
    """Answers in display order: estate, then school."""
    if not ordered:
        return df
    return df.orderBy(
        F.col("dgp_code").asc_nulls_first(), F.col("school_name_clean").asc_nulls_first()
    )


def recommend_all(
    mart: DataFrame,
    current_year: int,
    predictions: DataFrame | None = None,
    interim: DataFrame | None = None,
    ordered: bool = True,
    **filters,
) -> DataFrame:
    """Active schools with every phase: latest completed year and the current year.

    Pass ``predictions`` and ``interim`` only when their flags are on.
    """
    _checked(filters, location=True)
    keys = ["school_name_clean", "phase_normalised"]
    rows = completed_and_current(
        apply_filters(mart, is_active=True, **filters), keys, "registration_year", current_year, 1
    )
    nested = nest_all(
        rows, ENTITY_COLUMNS, "phase_normalised", "registration_year", YEAR_COLUMNS, current_year
    )
    if predictions is None and interim is None:
        off = [
            F.lit(None).cast(PREDICTION_TYPE).alias("ml_prediction"),
            F.lit(None).cast(INTERIM_TYPE).alias("interim"),
        ]

        def with_nulls(c: Column) -> Column:
            return F.struct(c["category"].alias("category"), c["years"].alias("years"), *off)

        return _by_place(
            nested.withColumn("categories", F.transform("categories", with_nulls)), ordered
        )
    flat = nested.select(*ENTITY_COLUMNS, F.inline_outer("categories")).withColumnRenamed(
        "category", "phase_normalised"
    )
    flat = _nested_records(flat, predictions, interim)
    entry = F.struct(
        F.col("phase_normalised").alias("category"), "years", "ml_prediction", "interim"
    )
    return _by_place(
        flat.groupBy(*ENTITY_COLUMNS).agg(
            F.sort_array(F.collect_list(entry)).alias("categories")
        ),
        ordered,
    )


def recommend_all_rows(nested: DataFrame) -> DataFrame:
    """The nested answer as one row per school, phase and year, with its place."""
    return nested.select("school_name_clean", F.inline_outer("categories")).select(
        "school_name_clean",
        F.col("category").alias("phase_normalised"),
        F.posexplode_outer("years").alias("place", "y"),
    ).select("school_name_clean", "phase_normalised", "place", "y.*")


def recommend_one(
    mart: DataFrame,
    phase: str,
    current_year: int,
    has_balloting_3yr: bool | None = None,
    predictions: DataFrame | None = None,
    interim: DataFrame | None = None,
    ordered: bool = True,
    **filters,
) -> DataFrame:
    """Active schools in one phase: last three completed years, current year and trend.

    A school qualifies on its latest completed row alone; without a completed
    year it does not qualify.
    """
    _checked(filters, location=True)
    phase = phase.upper()
    if phase not in MART_PHASES:
        raise ValueError(f"phase must be one of {MART_PHASES}")
    rows = apply_filters(mart, ["phase_normalised"], is_active=True, phase_normalised=phase, **filters)
    count = F.col("ballot_occurrences_last_3yr")
    wanted = {True: count > 0, False: count == 0, None: F.lit(True)}[has_balloting_3yr]
    key = ["school_name_clean"]
    chosen = with_latest_completed(rows, key, "registration_year", current_year, wanted)
    kept = completed_and_current(chosen, key, "registration_year", current_year, 3)
    nested = nest_one(
        kept, ENTITY_COLUMNS, "registration_year", YEAR_COLUMNS, TREND_COLUMNS, current_year
    )
    nested = nested.withColumn("phase_normalised", F.lit(phase))
    return _by_place(_nested_records(nested, predictions, interim), ordered)


def recommend_one_rows(nested: DataFrame) -> DataFrame:
    """The nested answer as one row per school and history entry, with its trend."""
    return nested.select(
        "school_name_clean",
        "trend.*",
        F.size("reference_years").alias("n_reference_years"),
        F.posexplode_outer("history").alias("place", "y"),
    ).select("school_name_clean", "place", "n_reference_years", *TREND_COLUMNS, "y.*")


def assess_risk(
    mart: DataFrame, current_year: int, name: str | None = None, phase: str | None = None
) -> DataFrame:
    """Up to three completed years per school and phase, with the sentence of the latest.

    Inactive schools are included. Without a name or phase all are assessed.
    """
    rows = mart.filter(F.col("registration_year") < current_year)
    if name is not None:
        rows = rows.filter(F.col("school_name_clean") == name.upper().strip())
    if phase is not None:
        rows = rows.filter(F.col("phase_normalised") == phase.upper())
    keys = ["school_name_clean", "phase_normalised"]
    ranked = top_n(rows, keys, ["registration_year"], 3, rank_col="row_rank")
    text = explain_risk(
        F.col("ballot_risk_level"),
        F.col("ballot_occurrences_last_3yr"),
        F.col("subscription_rate_3yr_avg"),
        F.col("subscription_rate_yoy_change"),
    )
    return ranked.withColumn(
        "risk_explanation", F.when(F.col("row_rank") == 1, text)
    )


def projection_seeds(mart: DataFrame, phases: Sequence[str]) -> DataFrame:
    """Open, fully published rows of active schools in the latest year of the mart."""
    latest = mart.agg(F.max("registration_year").alias("registration_year"))
    return mart.join(latest, "registration_year", "left_semi").filter(
        F.col("phase_normalised").isin(*phases)
        & F.col("is_active")
        & F.col("has_full_figures")
        & (F.col("vacancy") > 0)
    ).select(
        F.col("school_name_clean").alias("school_name"),
        F.col("phase_normalised").alias("phase"),
        "registration_year",
        F.col("vacancy").alias("vacancy_at_open"),
        F.col("applied").alias("final_applied_count"),
        "ballot_risk_level",
    )
