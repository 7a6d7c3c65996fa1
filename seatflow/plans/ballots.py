"""From raw result, school and event tables to dimensions, fact and marts.

Every function returns one lazy plan. Staging stays a view; dimension, fact and
mart are meant to be written with ``write_by_year``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions.cleaning import (
    canonical,
    fill_when,
    recode,
    round_to,
    scrub,
    straight_apostrophe,
    strip,
)
from seatflow.functions.dates import is_active, is_current_year, status_text
from seatflow.functions.keys import surrogate_key
from seatflow.functions.metrics import (
    code_band,
    guarded_ratio,
    has_full_figures,
    is_occurrence,
    prefix_class,
    remaining_places,
    risk_tier,
)
from seatflow.operators import deltas, trends
from seatflow.operators.lookups import attach, map_or_keep, merge_dimension, split_dimension
from seatflow.operators.quality import Gates
from seatflow.operators.ranking import keep_latest
from seatflow.schemas import SCHOOL_CONTACT_COLUMNS, SCHOOL_FLAG_COLUMNS, SCHOOL_TEXT_COLUMNS
from seatflow.session import fresh_path
from seatflow.sources.tables import overwrite_partitioned, replace_values, stored, with_audit

# Fixed values of the admission data.
PRIMARY_LEVELS = ("PRIMARY", "MIXED LEVEL (P1-S4)")
TYPE_NAMES = {"GOVERNMENT-AIDED SCH": "GOVERNMENT-AIDED SCHOOL"}
PHASE_NAMES = {"Phase 1": "1"}
MART_PHASES = ("2B", "2C", "2C(S)", "3")
MART_FIRST_YEAR = 2019
RISK_THRESHOLD = 1.2

SCHOOL_COLUMNS = (
    "postal_code dgp_code zone_code type_code nature_code session_code sap_ind autonomous_ind "
    "gifted_ind ip_ind mothertongue1_code mothertongue2_code mothertongue3_code"
).split()
LIFECYCLE_COLUMNS = (
    "school_status is_active inactive_from_year inactive_to_year merged_into "
    "school_status_description"
).split()


@dataclass(frozen=True)
class Seeds:
    """Small reference tables."""

    phases: DataFrame
    balloting_codes: DataFrame
    name_mapping: DataFrame
    lifecycle: DataFrame


def stage_schools(raw: DataFrame) -> DataFrame:
    """All schools with the missing-value word turned into NULL, and the time of the load."""
    return with_audit(
        raw.select(
            *[scrub(F.col(c)).alias(c) for c in SCHOOL_TEXT_COLUMNS],
            canonical(F.col("school_name")).alias("school_name_clean"),
            "postal_code",
            *SCHOOL_FLAG_COLUMNS,
        )
    )


def stage_primary_schools(raw: DataFrame) -> DataFrame:
    schools = stage_schools(raw).filter(F.col("mainlevel_code").isin(*PRIMARY_LEVELS))
    return schools.withColumn("type_code", recode(F.col("type_code"), TYPE_NAMES)).drop(
        "school_name", "loaded_at"
    )


def stage_ballots(raw: DataFrame, seeds: Seeds) -> DataFrame:
    """Latest load per school, phase and year; names and phases mapped; measures derived."""
    key = ["school_name", "phase", "registration_year"]
    phase, vacancy = F.col("phase"), F.col("vacancy")
    # The fill rules look at the phase as it was loaded, blanks included.
    closed = (phase != "3") & (vacancy == 0)
    base = keep_latest(raw, key, ["scraped_at"]).select(
        canonical(straight_apostrophe(F.col("school_name"))).alias("_name"),
        F.col("school_name").alias("school_name_original"),
        recode(strip(phase), PHASE_NAMES).alias("phase_raw"),
        "total_vacancy",
        fill_when(vacancy, phase == "3", 0).alias("vacancy"),
        fill_when(F.col("applied"), closed, 0).alias("applied"),
        fill_when(F.col("taken"), closed, 0).alias("taken"),
        "ballot_scenario_code",
        "ballot_description",
        "ballot_applicants",
        "ballot_vacancies",
        "ballot_chance_pct",
        "registration_year",
        "scraped_at",
    )
    named = map_or_keep(
        base,
        seeds.name_mapping,
        "_name",
        straight_apostrophe(F.col("listed_name")),
        F.col("official_name"),
        "school_name_clean",
    ).drop("_name")
    phased = attach(
        named, seeds.phases, "phase_raw", ["phase_raw", "phase_normalised"]
    )
    coded = attach(
        phased,
        seeds.balloting_codes,
        "ballot_scenario_code",
        [
            F.col("codes").alias("ballot_scenario_code"),
            F.col("description").alias("ballot_description_mapped"),
        ],
    )
    total = coded.withColumn(
        "_total_taken",
        trends.group_total(F.col("taken"), ["school_name_clean", "registration_year"]),
    )
    published = has_full_figures(F.col("phase_normalised"), F.col("registration_year"))
    capacity = F.col("total_vacancy")
    return total.select(
        "school_name_clean",
        "school_name_original",
        "phase_normalised",
        "phase_raw",
        "total_vacancy",
        "vacancy",
        "applied",
        "taken",
        published.alias("has_full_figures"),
        guarded_ratio(F.col("applied"), vacancy, published).alias("subscription_rate"),
        remaining_places(vacancy, F.col("taken"), published).alias("remaining_places"),
        F.when(capacity.isNotNull(), F.col("_total_taken") > capacity).alias("is_over_enrolled"),
        (F.col("_total_taken") - capacity).alias("over_enrolled_count"),
        "ballot_scenario_code",
        "ballot_description",
        "ballot_description_mapped",
        "ballot_applicants",
        "ballot_vacancies",
        "ballot_chance_pct",
        "registration_year",
        "scraped_at",
    )


def add_lifecycle(dim: DataFrame, lifecycle: DataFrame, key: str, as_of=None) -> DataFrame:
    """Full outer join with the lifecycle table, status, activity and its sentence."""
    merged = merge_dimension(dim, lifecycle, key)
    status = F.coalesce("school_status", F.lit("active"))
    active = is_active(status, F.col("inactive_to_year"), as_of)
    text = status_text(
        active,
        status,
        F.col("inactive_from_year"),
        F.col("inactive_to_year"),
        F.col("merged_into"),
    )
    return merged.withColumns(
        {"school_status": status, "is_active": active, "school_status_description": text}
    )


def dim_school(primary: DataFrame, seeds: Seeds, as_of=None) -> DataFrame:
    """Schools and closed schools; one row per canonical name."""
    stable, _ = split_dimension(primary, "school_name_clean", SCHOOL_CONTACT_COLUMNS)
    dim = add_lifecycle(stable, seeds.lifecycle, "school_name_clean", as_of)
    return dim.select(
        surrogate_key("school_name_clean").alias("school_key"),
        "school_name_clean",
        "address",
        "postal_code",
        F.coalesce("dgp_code", F.lit("UNKNOWN")).alias("dgp_code"),
        F.coalesce("zone_code", F.lit("UNKNOWN")).alias("zone_code"),
        "mainlevel_code",
        *[c for c in SCHOOL_COLUMNS if c not in ("postal_code", "dgp_code", "zone_code")],
        *LIFECYCLE_COLUMNS,
    )


def dim_school_generalinfo(primary: DataFrame) -> DataFrame:
    _, contact = split_dimension(primary, "school_name_clean", SCHOOL_CONTACT_COLUMNS)
    return contact.select(
        surrogate_key("school_name_clean").alias("school_key"), *SCHOOL_CONTACT_COLUMNS
    )


def fact_balloting(staged: DataFrame, dim: DataFrame) -> DataFrame:
    """Staged rows with the school key; rows of unknown schools keep a NULL key."""
    keyed = attach(staged, dim, "school_name_clean", ["school_name_clean", "school_key"])
    return keyed.select(
        surrogate_key("school_name_clean", "registration_year", "phase_normalised").alias(
            "balloting_key"
        ),
        "school_key",
        "school_name_clean",
        "phase_normalised",
        "phase_raw",
        "registration_year",
        "total_vacancy",
        "vacancy",
        "applied",
        "taken",
        "has_full_figures",
        "subscription_rate",
        "remaining_places",
        "is_over_enrolled",
        "over_enrolled_count",
        "ballot_scenario_code",
        F.col("ballot_description_mapped").alias("ballot_description"),
        "ballot_applicants",
        "ballot_vacancies",
        "ballot_chance_pct",
        "scraped_at",
    )


def add_trends(
    df: DataFrame,
    keys: list[str],
    year: str,
    rate: str,
    vacancy: str,
    code: str,
    threshold: float = RISK_THRESHOLD,
) -> DataFrame:
    """Rolling means, changes, ballot counts and the risk tier: one shuffle, one sort."""
    window = trends.by_year(keys, year)
    r, v = F.col(rate), F.col(vacancy)
    ballot = is_occurrence(F.col(code))

    def rounded(col: Column, digits: int = 4) -> Column:
        return round_to(col, digits)

    out = df.withColumns(
        {
            "_avg3": trends.rolling_avg(r, window, 3),
            "_avg5": trends.rolling_avg(r, window, 5),
            "_change": trends.change(r, window),
            "ballot_occurrences_last_3yr": trends.rolling_count(ballot, window, 3),
            "ballot_occurrences_last_5yr": trends.rolling_count(ballot, window, 5),
            "vacancy_yoy_change": trends.change(v, window),
            "_vacancy3": trends.rolling_avg(v, window, 3),
        }
    )
    # The tier compares at ten digits, so it does not hang on the last bit of a mean.
    return out.withColumns(
        {
            "subscription_rate_3yr_avg": rounded(F.col("_avg3")),
            "subscription_rate_5yr_avg": rounded(F.col("_avg5")),
            "subscription_rate_yoy_change": rounded(F.col("_change")),
            "vacancy_3yr_avg": rounded(F.col("_vacancy3"), 2),
            "ballot_risk_level": risk_tier(
                F.col("ballot_occurrences_last_3yr"), rounded(F.col("_avg3"), 10), threshold
            ),
        }
    ).drop("_avg3", "_avg5", "_change", "_vacancy3")


def mart_school_analysis(
    fact: DataFrame, dim: DataFrame, as_of=None, threshold: float = RISK_THRESHOLD, on: str = "school_key"
) -> DataFrame:
    """Scoped fact with school attributes, ballot groups, trends and risk tier.

    The scope filter comes before the windows on purpose: the first scoped year
    must not see earlier ones. Trends run per school name rather than per key,
    so rows of unknown schools, which all share the NULL key, neither mix nor
    pile up in one task. With ``on="school_name_clean"``, of which the key is
    made, join and trends over tables bucketed by the name need no shuffle.
    """
    enriched = attach(
        in_scope(fact), dim, on, [on, *SCHOOL_COLUMNS, *LIFECYCLE_COLUMNS]
    )
    code = F.col("ballot_scenario_code")
    encoded = enriched.withColumns(
        {
            "ballot_citizen_group": prefix_class(code),
            "ballot_distance_band": code_band(code),
            "is_current_year": is_current_year(F.col("registration_year"), as_of),
            "analysis_key": surrogate_key("school_key", "phase_normalised", "registration_year"),
        }
    ).drop("balloting_key", "scraped_at")
    return add_trends(
        encoded,
        ["school_name_clean", "phase_normalised"],
        "registration_year",
        "subscription_rate",
        "vacancy",
        "ballot_scenario_code",
        threshold,
    )


SLOT_KEY = ["school_name", "phase", "registration_year", "simulation_day", "snapshot_type"]


def stage_snapshots(raw: DataFrame) -> DataFrame:
    """Latest message per snapshot slot."""
    return keep_latest(raw, SLOT_KEY, ["snapshot_timestamp"])


def mart_vacancy_interim(snapshots: DataFrame, dim: DataFrame) -> DataFrame:
    """Latest slot per school, phase and year with zone and estate."""
    latest = keep_latest(
        snapshots, ["school_name", "phase", "registration_year"], ["snapshot_timestamp"]
    )
    places = dim.select(
        F.col("school_name_clean").alias("school_name"), "zone_code", "dgp_code"
    )
    return attach(latest, places, "school_name").select(
        "school_name",
        "phase",
        "registration_year",
        "simulation_day",
        "snapshot_type",
        "snapshot_timestamp",
        "vacancy_at_open",
        "vacancy_remaining",
        "applied_count",
        "pct_filled",
        "zone_code",
        "dgp_code",
    )


def build(raw_ballots: DataFrame, raw_schools: DataFrame, seeds: Seeds, as_of=None):
    """(dim_school, dim_school_generalinfo, fact_balloting, mart_school_analysis)."""
    primary = stage_primary_schools(raw_schools)
    dim = dim_school(primary, seeds, as_of)
    fact = fact_balloting(stage_ballots(raw_ballots, seeds), dim)
    return dim, dim_school_generalinfo(primary), fact, mart_school_analysis(fact, dim, as_of)


YEAR, NAME = "registration_year", "school_name_clean"
GROUP = [NAME, "phase_normalised"]


def write_by_year(
    df: DataFrame,
    path: str,
    files: int | None = None,
    years: Sequence[int] | None = None,
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Partitioned by year and sorted by school and phase, so filters skip files and row groups.

    The table is replaced as a whole, so years that are gone from ``df`` leave it. With
    ``years`` only these are replaced; of them, those without rows become empty.
    """
    if years is not None:
        replace_values(df, path, YEAR, years, GROUP, files)
    else:
        overwrite_partitioned(df, path, [YEAR], GROUP, files, watch)


def build_tables(
    raw_ballots: DataFrame,
    raw_schools: DataFrame,
    seeds: Seeds,
    path: str,
    as_of=None,
    threshold: float = RISK_THRESHOLD,
    keep: Sequence[str] = (),
    years: Sequence[int] | None = None,
    gates: Gates | None = None,
) -> dict[str, DataFrame]:
    """Write dimensions, fact and mart below ``path`` and return the stored tables.

    Every table is read back before the next is built from it, so no step is
    computed twice and a lost executor costs at most one table. Tables named in
    ``keep`` are taken as they are stored: after a load of new results the two
    dimensions, for example. ``years`` says that raw results changed, came or went
    in these years only; then the stored tables are refreshed (``refresh_tables``).

    ``gates`` count their rules while the tables are written. If one is broken, the build ends
    with ``GateError`` after its table; with a new ``path`` a build, readers of the last one
    never see it.
    """
    if years is not None and gates is not None:
        raise ValueError("gates watch whole builds")
    if years is not None:
        return refresh_tables(raw_ballots, raw_schools, seeds, path, years, as_of, threshold, keep)
    spark = raw_ballots.sparkSession
    tables: dict[str, DataFrame] = {}

    def store(name: str, df: DataFrame, yearly: bool = False) -> DataFrame:
        place = f"{path}/{name}"
        watch = partial(gates.watch, name) if gates else None
        if name not in keep and yearly:
            write_by_year(df, place, watch=watch)
        elif name not in keep:
            (watch(df) if watch else df).write.mode("overwrite").parquet(place)
        if gates:
            gates.check()
        tables[name] = spark.read.schema(df.schema).parquet(place)
        return tables[name]

    primary = stage_primary_schools(raw_schools)
    dim = store("dim_school", dim_school(primary, seeds, as_of))
    store("dim_school_generalinfo", dim_school_generalinfo(primary))
    staged = stage_ballots(raw_ballots, seeds)
    fact = store("fact_balloting", fact_balloting(staged, dim), yearly=True)
    store(
        "mart_school_analysis", mart_school_analysis(fact, dim, as_of, threshold), yearly=True
    )
    return tables


def in_scope(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("phase_normalised").isin(*MART_PHASES) & (F.col(YEAR) >= MART_FIRST_YEAR))


def touched_groups(
    old_fact: DataFrame, new_fact: DataFrame, schools: DataFrame, new_dim: DataFrame, mart: DataFrame, as_of=None
) -> DataFrame:
    """School, phase and first year of the groups whose mart rows may change.

    Compared are the rows of the two facts (the changed years are enough), all years of
    ``schools`` (one column, names of changed dimension rows), and the flag of the current year.
    """
    measured = [c for c in new_fact.columns if c not in ("balloting_key", "scraped_at")]
    rows = deltas.changed_rows(in_scope(old_fact).select(measured), in_scope(new_fact).select(measured))
    stale = mart.filter(F.col("is_current_year") != is_current_year(F.col(YEAR), as_of))
    known = mart.select(*GROUP, YEAR).join(schools, NAME, "left_semi")
    parts = [x.select(*GROUP, YEAR) for x in (rows, stale, known)]
    return deltas.first_changes(parts[0].unionByName(parts[1]).unionByName(parts[2]), GROUP, YEAR)


def refreshed_mart(
    fact: DataFrame, dim: DataFrame, mart: DataFrame, touched: DataFrame, as_of=None, threshold: float = RISK_THRESHOLD
) -> DataFrame:
    """New rows of the touched groups from their first changed year on. The windows see all rows
    of these groups and none of any other."""
    groups = deltas.of_groups(fact, touched, GROUP)
    made = mart_school_analysis(groups, dim, as_of, threshold).select(mart.columns)
    return deltas.from_first_change(made, touched, GROUP, YEAR)


def refresh_tables(
    raw_ballots: DataFrame,
    raw_schools: DataFrame,
    seeds: Seeds,
    path: str,
    years: Sequence[int],
    as_of=None,
    threshold: float = RISK_THRESHOLD,
    keep: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Bring the stored tables to what a full build over the given raw data would make.

    Raw results may differ from those of the last build in ``years`` only: there they may be
    changed, new or gone. Dimensions may differ in any row, and ``as_of`` may have moved on;
    a new ``threshold``, or seeds that change names, phases or codes of other years, need a full
    build. Old and new rows are compared, and of the mart only
    the groups of school and phase with a difference are computed again, from the first year
    that differs on. Partitions without a difference are not written.

    What is new is first written beside the tables; then mart, fact and dimensions are replaced
    in this order. A run that was interrupted is repeated: whatever it left, the facts and
    dimensions still tell which groups differ.
    """
    spark, years = raw_ballots.sparkSession, list(years)
    primary = stage_primary_schools(raw_schools)

    def at(name: str, like: DataFrame) -> DataFrame:
        return spark.read.schema(like.schema).parquet(f"{path}/{name}")

    def beside(df: DataFrame, name: str) -> DataFrame:
        return stored(df, fresh_path(spark, name))

    made = {"dim_school": dim_school(primary, seeds, as_of), "dim_school_generalinfo": dim_school_generalinfo(primary)}
    old = {name: at(name, df) for name, df in made.items()}
    new = {name: old[name] if name in keep else beside(df, f"new-{name}") for name, df in made.items()}
    dim, known = new["dim_school"], old["dim_school"]
    changed = known.limit(0) if "dim_school" in keep else deltas.changed_rows(known, dim)
    schools = beside(changed.select(NAME).distinct(), "changed-schools")

    # Facts of the years, and of other years those whose school came to be known or is no more.
    loaded = fact_balloting(stage_ballots(raw_ballots, seeds), dim)
    fact = at("fact_balloting", loaded)
    other = fact.filter(~F.col(YEAR).isin(*years))
    keyed = other.join(schools, NAME, "left_semi").drop("school_key")
    keyed = attach(keyed, dim, NAME, [NAME, "school_key"]).select(fact.columns)
    fresh = beside(loaded.filter(F.col(YEAR).isin(*years)).select(fact.columns).unionByName(keyed), "new-facts")
    before = fact.filter(F.col(YEAR).isin(*years)).unionByName(other.join(schools, NAME, "left_semi"))
    now = other.join(schools, NAME, "left_anti").unionByName(fresh)

    like = mart_school_analysis(loaded, dim, as_of, threshold)
    mart = at("mart_school_analysis", like)
    touched = beside(touched_groups(before, fresh, schools, dim, mart, as_of), "touched-groups")
    rows = beside(refreshed_mart(now, dim, mart, touched, as_of, threshold), "new-mart-rows")
    gone = deltas.from_first_change(mart, touched, GROUP, YEAR)
    changed_years = _years(rows.select(YEAR).unionByName(gone.select(YEAR)))
    if changed_years:
        kept = deltas.before_first_change(mart.filter(F.col(YEAR).isin(*changed_years)), touched, GROUP, YEAR)
        whole = beside(kept.unionByName(rows), "new-mart")
        replace_values(whole, f"{path}/mart_school_analysis", YEAR, changed_years, GROUP)
    fact_years = _years(deltas.changed_rows(before, fresh).select(YEAR))
    if fact_years:
        whole = beside(now.filter(F.col(YEAR).isin(*fact_years)), "new-fact")
        replace_values(whole, f"{path}/fact_balloting", YEAR, fact_years, GROUP)
    for name, df in new.items():
        if name not in keep:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    made |= {"fact_balloting": loaded, "mart_school_analysis": like}
    return {name: at(name, df) for name, df in made.items()}


def _years(rows: DataFrame) -> list[int]:
    """The years that are met; no more than the table has partitions."""
    return sorted(r[0] for r in rows.distinct().collect())
