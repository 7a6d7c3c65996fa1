"""The admission pipeline and its serving queries on the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.catalog import standins as S
from seatflow.catalog.columns import EXPLAIN, SHOWN
from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import WITH_DIM, WITH_FACT, WITH_MART
from seatflow.operators.filters import lookup_one
from seatflow.plans import advisor, ballots, serving
from seatflow.session import fresh_path
from seatflow.sources.tables import save_bucketed

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql

CURRENT = S.PIPELINE_CURRENT


def primary(spark, sf):
    return ballots.stage_primary_schools(S.raw_schools(spark, sf))


def dim(spark, sf, seeds=None):
    return ballots.dim_school(
        primary(spark, sf), seeds or S.seeds(spark, sf), S.PIPELINE_AS_OF
    )


def dim_and_fact(spark, sf):
    seeds = S.seeds(spark, sf)
    schools = dim(spark, sf, seeds)
    staged = ballots.stage_ballots(S.raw_ballots(spark, sf), seeds)
    return schools, ballots.fact_balloting(staged, schools)


def general(spark, sf):
    return ballots.dim_school_generalinfo(primary(spark, sf))


def mart(spark, sf):
    schools, fact = dim_and_fact(spark, sf)
    return ballots.mart_school_analysis(fact, schools, S.PIPELINE_AS_OF, S.PIPELINE_RISK)


_TABLES: dict[tuple[str, str], dict] = {}


def tables(spark, sf):
    """The stored tables, built once for a session and folder; the serving queries read them."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _TABLES:
        _TABLES[place] = ballots.build_tables(
            S.raw_ballots(spark, sf),
            S.raw_schools(spark, sf),
            S.seeds(spark, sf),
            fresh_path(spark, "tables"),
            S.PIPELINE_AS_OF,
            S.PIPELINE_RISK,
        )
    return _TABLES[place]


def stored_mart(spark, sf):
    return tables(spark, sf)["mart_school_analysis"]


def stored_dim(spark, sf):
    return tables(spark, sf)["dim_school"]


def stored_general(spark, sf):
    return tables(spark, sf)["dim_school_generalinfo"]


@query(
    "staged_schools",
    """SELECT CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) || ' SCHOOL'
        WHEN s_suppkey % 5 = 0 THEN upper(s_name) || chr(39) || 'S' ELSE upper(s_name) END AS school_name_clean,
      CASE WHEN s_suppkey % 4 <> 0 THEN '6' || s_suppkey END AS telephone_no, true AS loaded_just_now FROM supplier""",
)
def staged_schools(spark, sf):
    """All schools as they are staged, with the time of the load."""
    staged = ballots.stage_schools(S.raw_schools(spark, sf))
    recent = F.col("loaded_at").between(F.current_timestamp() - F.expr("INTERVAL 1 HOUR"), F.current_timestamp())
    return staged.select("school_name_clean", "telephone_no", recent.alias("loaded_just_now"))


DIM_COLUMNS = (
    "school_key school_name_clean address postal_code dgp_code zone_code type_code nature_code "
    "session_code sap_ind autonomous_ind gifted_ind ip_ind mothertongue1_code school_status "
    "is_active inactive_from_year inactive_to_year merged_into school_status_description"
).split()


@query("dim_lifecycle", WITH_DIM + f"SELECT {', '.join(DIM_COLUMNS)} FROM dim")
def dim_lifecycle(spark, sf):
    return dim(spark, sf).select(*DIM_COLUMNS)


FACT_COLUMNS = (
    "balloting_key school_key school_name_clean phase_normalised registration_year total_vacancy "
    "vacancy applied taken has_full_figures subscription_rate remaining_places is_over_enrolled "
    "over_enrolled_count ballot_scenario_code ballot_description ballot_applicants "
    "ballot_vacancies ballot_chance_pct"
).split()


@query("fact_balloting", WITH_FACT + f"SELECT {', '.join(FACT_COLUMNS)} FROM fact")
def fact_balloting(spark, sf):
    return dim_and_fact(spark, sf)[1].select(*FACT_COLUMNS)


MART_COLUMNS = [
    "analysis_key",
    *FACT_COLUMNS[1:],
    *"postal_code dgp_code zone_code type_code nature_code sap_ind is_active school_status "
    "is_current_year ballot_citizen_group ballot_distance_band ballot_risk_level".split(),
    *serving.TREND_COLUMNS,
]


@query("school_mart", WITH_MART + f"SELECT {', '.join(MART_COLUMNS)} FROM mart")
def school_mart(spark, sf):
    return mart(spark, sf).select(*MART_COLUMNS)


def _bucketed(spark, sf, buckets=8):
    """Fact and dimension of the stored tables, hashed by school name into the same buckets."""
    stored, at = tables(spark, sf), fresh_path(spark, "bucketed")
    run = at.rsplit("-", 1)[1]
    return [
        save_bucketed(stored[name], f"{name}_{run}", f"{at}/{name}", ["school_name_clean"], buckets)
        for name in ("fact_balloting", "dim_school")
    ]


@query("mart_bucketed", WITH_MART + f"SELECT {', '.join(MART_COLUMNS)} FROM mart")
def mart_bucketed(spark, sf):
    """The mart over bucketed tables, whose join and trends shuffle nothing."""
    fact, known = _bucketed(spark, sf)
    made = ballots.mart_school_analysis(fact, known, S.PIPELINE_AS_OF, S.PIPELINE_RISK, on="school_name_clean")
    return made.select(*MART_COLUMNS)


@query("mart_refresh", WITH_MART + f"SELECT {', '.join(MART_COLUMNS)} FROM mart")
def mart_refresh(spark, sf):
    """Tables of an earlier load, in which a year was wrong, one was missing and one was too
    many, brought up to date: only what these years touch is computed again."""
    raw, year = S.raw_ballots(spark, sf), F.col("registration_year")
    wrong, missing, bogus = CURRENT - 4, CURRENT - 2, CURRENT + 1
    earlier = raw.filter(year != missing).withColumn(
        "applied", F.when((year == wrong) & (F.length("school_name") % 2 == 0), F.col("applied") + 5).otherwise(F.col("applied"))
    )
    earlier = earlier.unionByName(raw.filter(year == wrong).withColumn("registration_year", F.lit(bogus).cast("bigint")))
    rest = (S.raw_schools(spark, sf), S.seeds(spark, sf), fresh_path(spark, "refreshed"), S.PIPELINE_AS_OF, S.PIPELINE_RISK)
    ballots.build_tables(earlier, *rest)
    found = ballots.build_tables(raw, *rest, years=[wrong, missing, bogus])
    return found["mart_school_analysis"].select(*MART_COLUMNS)


@query(
    "list_entities",
    WITH_DIM
    + """SELECT school_key, school_name_clean AS school_name, dgp_code, zone_code, type_code, nature_code,
      postal_code, school_status, is_active FROM dim
      WHERE upper(type_code) = 'GOVERNMENT-AIDED SCHOOL' AND is_active AND NOT gifted_ind""",
)
def list_entities(spark, sf):
    found = serving.list_schools(
        stored_dim(spark, sf), type_code="government-aided school", gifted_ind=False
    )
    return found.select(
        "school_key", "school_name", "dgp_code", "zone_code", "type_code", "nature_code",
        "postal_code", "school_status", "is_active",
    )


@query(
    "detail_join",
    WITH_DIM
    + """SELECT school_key, school_name_clean, dgp_code, is_active, telephone_no, email_address, mrt_desc,
      principal_name FROM dim""",
)
def detail_join(spark, sf):
    """Every school with its contact details; closed schools have none."""
    return (
        stored_dim(spark, sf)
        .join(stored_general(spark, sf), "school_key", "left")
        .select(
            "school_key", "school_name_clean", "dgp_code", "is_active", "telephone_no",
            "email_address", "mrt_desc", "principal_name",
        )
    )


@query(
    "detail_lookup",
    WITH_DIM
    + """SELECT school_name_clean, principal_name, email_address FROM dim
         WHERE school_name_clean = 'SUPPLIER#000000004'""",
)
def detail_lookup(spark, sf):
    found = serving.school_detail(stored_dim(spark, sf), stored_general(spark, sf), " supplier#000000004")
    return found.select("school_name_clean", "principal_name", "email_address")


@query(
    "result_count",
    WITH_DIM
    + """SELECT count(*) AS count, 'asia' AS zone_code, true AS is_active FROM dim
         WHERE zone_code = 'ASIA' AND is_active""",
)
def result_count(spark, sf):
    found = serving.list_schools(stored_dim(spark, sf), zone_code="asia")
    return serving.result_count(found, zone_code="asia", dgp_code=None, is_active=True)


@query(
    "pick_lists",
    WITH_DIM
    + """, known AS (SELECT * FROM dim WHERE zone_code <> 'UNKNOWN' AND dgp_code <> 'UNKNOWN')
    SELECT 'zones' AS list, zone_code AS value, CAST(NULL AS VARCHAR) AS within FROM known
      WHERE zone_code IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 2
    UNION ALL SELECT 'estates_by_zone', dgp_code, zone_code FROM known
      WHERE zone_code IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 2, 3
    UNION ALL SELECT 'all_estates', dgp_code, NULL FROM known GROUP BY 2
    UNION ALL SELECT 'type_codes', type_code, NULL FROM known WHERE type_code IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'nature_codes', nature_code, NULL FROM known GROUP BY 2
    UNION ALL SELECT 'schools', school_name_clean, dgp_code FROM dim
      WHERE is_active AND dgp_code <> 'UNKNOWN'""",
)
def pick_lists(spark, sf):
    lists = serving.metadata_rows(stored_dim(spark, sf), zone_order=("ASIA", "EUROPE", "AFRICA"))
    columns = {
        "zones": ("zone_code", None),
        "estates_by_zone": ("dgp_code", "zone_code"),
        "all_estates": ("dgp_code", None),
        "type_codes": ("type_code", None),
        "nature_codes": ("nature_code", None),
        "schools": ("school_name", "dgp_code"),
    }
    parts = [
        lists[name].select(
            F.lit(name).alias("list"),
            F.col(value).alias("value"),
            (F.col(within) if within else F.lit(None).cast("string")).alias("within"),
        )
        for name, (value, within) in columns.items()
    ]
    return reduce(DataFrame.unionByName, parts)


YEAR_SQL = ", ".join(c for c in serving.YEAR_COLUMNS)
NULL_YEAR = ", ".join(
    f"{CURRENT}" if c == "registration_year" else "NULL" for c in serving.YEAR_COLUMNS
)

GIRLS_SCHOOLS = "upper(zone_code) = 'AMERICA' AND upper(nature_code) = 'GIRLS'' SCHOOL'"


def recommend_all_sql(where):
    return (
        WITH_MART
        + f""", chosen AS (SELECT * FROM mart WHERE is_active AND {where}),
    kept AS (
      SELECT *, false AS cur FROM (SELECT *, row_number() OVER (PARTITION BY school_name_clean,
          phase_normalised ORDER BY registration_year DESC) AS rn FROM chosen
          WHERE registration_year < {CURRENT}) WHERE rn = 1
      UNION ALL SELECT *, 1 AS rn, true AS cur FROM chosen WHERE registration_year = {CURRENT}),
    padded AS (
      SELECT school_name_clean, phase_normalised, {YEAR_SQL}, cur AS is_current_year, 0 AS pad FROM kept
      UNION ALL SELECT DISTINCT school_name_clean, phase_normalised, {NULL_YEAR}, true, 1 FROM kept k
        WHERE NOT EXISTS (SELECT 1 FROM kept c WHERE c.cur AND c.school_name_clean = k.school_name_clean
          AND c.phase_normalised = k.phase_normalised))
    SELECT * EXCLUDE (pad), CAST(row_number() OVER (PARTITION BY school_name_clean, phase_normalised
      ORDER BY pad, registration_year DESC) - 1 AS INTEGER) AS place FROM padded"""
    )


@query("recommend_all", recommend_all_sql(GIRLS_SCHOOLS))
def recommend_all(spark, sf):
    nested = serving.recommend_all(
        stored_mart(spark, sf), CURRENT, ordered=False, zone_code="america", nature_code="girls' school"
    )
    return serving.recommend_all_rows(nested)


def year_text(y):
    """The values of a nested year that tell it apart."""
    parts = [y[c].cast("string") for c in ("registration_year", "vacancy", "applied", "taken", "is_current_year")]
    return F.concat_ws(",", *[F.coalesce(p, F.lit("-")) for p in parts])


YEAR_TEXT = """concat_ws(',', registration_year, coalesce(vacancy::VARCHAR, '-'), coalesce(applied::VARCHAR, '-'),
    coalesce(taken::VARCHAR, '-'), is_current_year::VARCHAR)"""


@query(
    "nest_all",
    f"""WITH r AS ({recommend_all_sql("upper(zone_code) = 'AMERICA'")}),
    c AS (SELECT school_name_clean, phase_normalised, string_agg({YEAR_TEXT}, ';' ORDER BY place) AS years FROM r GROUP BY ALL)
    SELECT school_name_clean, count(*)::INT AS n_categories,
      string_agg(phase_normalised || ':' || years, '|' ORDER BY phase_normalised) AS categories FROM c GROUP BY 1""",
)
def nest_all(spark, sf):
    """The nested answer, its inner rows and their order written out as text."""
    nested = serving.recommend_all(stored_mart(spark, sf), CURRENT, zone_code="america")
    category = lambda c: F.concat(
        c["category"], F.lit(":"), F.array_join(F.transform(c["years"], year_text), ";")
    )
    return nested.select(
        "school_name_clean", F.size("categories").alias("n_categories"),
        F.array_join(F.transform("categories", category), "|").alias("categories"),
    )


def recommend_one_sql(balloted):
    return (
        WITH_MART
        + f""", chosen AS (SELECT * FROM mart WHERE is_active AND upper(zone_code) = 'ASIA'
        AND phase_normalised = '2C'),
    latest AS (SELECT * FROM chosen WHERE registration_year < {CURRENT} QUALIFY row_number() OVER (
      PARTITION BY school_name_clean ORDER BY registration_year DESC) = 1),
    history AS (SELECT * FROM chosen WHERE registration_year < {CURRENT}
      AND school_name_clean IN (SELECT school_name_clean FROM latest WHERE {balloted})
      QUALIFY row_number() OVER (PARTITION BY school_name_clean ORDER BY registration_year DESC) <= 3),
    entries AS (
      SELECT school_name_clean, {YEAR_SQL}, false AS is_current_year FROM history
      UNION ALL SELECT school_name_clean, {YEAR_SQL}, true FROM chosen
        WHERE registration_year = {CURRENT} AND school_name_clean IN (SELECT school_name_clean FROM history)
      UNION ALL SELECT DISTINCT school_name_clean, {NULL_YEAR}, true FROM history h WHERE NOT EXISTS (
        SELECT 1 FROM chosen c WHERE c.registration_year = {CURRENT}
          AND c.school_name_clean = h.school_name_clean))
    SELECT e.*, {', '.join('l.' + c for c in serving.TREND_COLUMNS)},
      CAST(row_number() OVER (PARTITION BY e.school_name_clean
        ORDER BY e.is_current_year, e.registration_year DESC) - 1 AS INTEGER) AS place,
      CAST((SELECT count(*) FROM history h WHERE h.school_name_clean = e.school_name_clean) AS INTEGER)
        AS n_reference_years
    FROM entries e JOIN latest l ON e.school_name_clean = l.school_name_clean"""
    )


@query("recommend_one", recommend_one_sql("ballot_occurrences_last_3yr > 0"))
def recommend_one(spark, sf):
    nested = serving.recommend_one(
        stored_mart(spark, sf), "2C", CURRENT, has_balloting_3yr=True, ordered=False, zone_code="ASIA"
    )
    return serving.recommend_one_rows(nested)


@query(
    "nest_one",
    f"""WITH r AS ({recommend_one_sql("true")})
    SELECT school_name_clean, '2C' AS phase_normalised, max(registration_year) FILTER (WHERE place = 0) AS latest_year,
      max(vacancy_3yr_avg) AS vacancy_3yr_avg, string_agg({YEAR_TEXT}, ';' ORDER BY place) AS history,
      string_agg(registration_year::VARCHAR, ',' ORDER BY place) FILTER (WHERE NOT is_current_year) AS reference_years
    FROM r GROUP BY 1""",
)
def nest_one(spark, sf):
    """The nested answer for one phase, given in lower case, its lists written out as text."""
    nested = serving.recommend_one(stored_mart(spark, sf), "2c", CURRENT, zone_code="Asia")
    return nested.select(
        "school_name_clean", "phase_normalised", F.col("latest_year.registration_year").alias("latest_year"),
        F.col("trend.vacancy_3yr_avg").alias("vacancy_3yr_avg"),
        F.array_join(F.transform("history", year_text), ";").alias("history"),
        F.array_join(F.transform("reference_years", lambda y: y.cast("string")), ",").alias("reference_years"),
    )


@query(
    "projection_seeds",
    WITH_MART
    + """SELECT school_name_clean AS school_name, phase_normalised AS phase, registration_year,
      vacancy AS vacancy_at_open, applied AS final_applied_count, ballot_risk_level FROM mart
    WHERE registration_year = (SELECT max(registration_year) FROM mart) AND phase_normalised IN ('2B', '2C', '2C(S)')
      AND is_active AND has_full_figures AND vacancy > 0""",
)
def projection_seeds(spark, sf):
    """Open rows of the latest year, the ones a projection would start from."""
    return serving.projection_seeds(stored_mart(spark, sf), ("2B", "2C", "2C(S)"))


@query(
    "assess_risk",
    WITH_MART
    + f""", ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY school_name_clean, phase_normalised
        ORDER BY registration_year DESC) AS INTEGER) AS row_rank, {SHOWN} AS shown FROM mart
        WHERE registration_year < {CURRENT})
    SELECT school_name_clean, phase_normalised, registration_year, is_active, subscription_rate,
      ballot_risk_level, row_rank, CASE WHEN row_rank = 1 THEN {EXPLAIN} END AS risk_explanation
    FROM ranked WHERE row_rank <= 3""",
)
def assess_risk(spark, sf):
    return serving.assess_risk(stored_mart(spark, sf), CURRENT).select(
        "school_name_clean", "phase_normalised", "registration_year", "is_active",
        "subscription_rate", "ballot_risk_level", "row_rank", "risk_explanation",
    )


@query(
    "text_block",
    WITH_MART
    + """, latest AS (SELECT *, max(registration_year) OVER (PARTITION BY school_name_clean) AS top_year
        FROM mart)
    SELECT school_name_clean, registration_year, chr(10) || '## ' || registration_year
      || ' Balloting Data: ' || school_name_clean || chr(10)
      || string_agg('- Phase ' || phase_normalised || ': vacancy=' || coalesce(vacancy::VARCHAR, 'None')
        || ', applied=' || coalesce(applied::VARCHAR, 'None') || ', taken=' || coalesce(taken::VARCHAR, 'None')
        || ', subscription_rate=' || coalesce(subscription_rate::VARCHAR, 'None') || ', ballot_risk='
        || CASE WHEN vacancy = 0 THEN 'N/A' ELSE ballot_risk_level END, chr(10) ORDER BY phase_normalised)
      AS ballot_text
    FROM latest WHERE registration_year = top_year GROUP BY 1, 2""",
)
def text_block(spark, sf):
    return advisor.ballot_blocks(stored_mart(spark, sf))


@query(
    "attribute_block",
    WITH_DIM
    + """SELECT school_name_clean, chr(10) || '## School Attributes: ' || school_name_clean || chr(10)
      || '  Address: ' || coalesce(address, 'None') || ', Singapore '
      || coalesce(postal_code::VARCHAR, 'None') || chr(10)
      || '  Zone: ' || zone_code || ', Estate: ' || dgp_code || chr(10)
      || '  Type: ' || coalesce(type_code, 'None') || ', Nature: ' || coalesce(nature_code, 'None') || chr(10)
      || '  Session: ' || coalesce(session_code, 'None') || chr(10) || '  Special programmes: SAP='
      || CASE WHEN sap_ind THEN 'Yes' ELSE 'No' END || ', GEP=' || CASE WHEN gifted_ind THEN 'Yes' ELSE 'No' END
      || ', Autonomous=' || CASE WHEN autonomous_ind THEN 'Yes' ELSE 'No' END || chr(10)
      || '  Mother tongue: ' || coalesce(mothertongue1_code, 'None') || chr(10)
      || '  Status: ' || coalesce(school_status_description, 'None') AS attribute_text FROM dim""",
)
def attribute_block(spark, sf):
    return advisor.attribute_blocks(stored_dim(spark, sf))


@query(
    "contact_block",
    WITH_DIM
    + """SELECT school_name_clean, chr(10) || '## Contact & Transport: ' || school_name_clean
      || coalesce(chr(10) || '  Principal: ' || principal_name, '')
      || coalesce(chr(10) || '  Phone: ' || telephone_no, '')
      || coalesce(chr(10) || '  Email: ' || email_address, '')
      || CASE WHEN email_address IS NULL THEN ''
         ELSE chr(10) || '  Website: https://example.com/' || regexp_extract(principal_name, '[0-9]+') END
      || coalesce(chr(10) || '  MRT: ' || mrt_desc, '') AS contact_text FROM dim""",
)
def contact_block(spark, sf):
    return advisor.contact_blocks(stored_dim(spark, sf), stored_general(spark, sf))


def _predictions(spark, sf):
    """Next year's rate taken as this year's three-year average."""
    rate = F.col("subscription_rate_3yr_avg")
    return (
        stored_mart(spark, sf)
        .filter(rate.isNotNull())
        .select(
            F.col("school_name_clean").alias("school_name"),
            F.col("phase_normalised").alias("phase"),
            (F.col("registration_year") + 1).alias("registration_year"),
            rate.alias("predicted_subscription_rate"),
            F.least(F.lit(1.0), rate).alias("predicted_ballot_chance_pct"),
        )
    )


@query(
    "prediction_lookup",
    WITH_MART
    + f"""SELECT school_name_clean AS school_name, phase_normalised AS phase,
      subscription_rate_3yr_avg AS predicted_subscription_rate,
      least(1.0, subscription_rate_3yr_avg) AS predicted_ballot_chance_pct
    FROM mart WHERE registration_year = {CURRENT - 1} AND phase_normalised = '2C'
      AND subscription_rate_3yr_avg IS NOT NULL""",
)
def prediction_lookup(spark, sf):
    return serving.predictions_for(_predictions(spark, sf), CURRENT, "2C")


def snapshots(spark, sf):
    """Events as capacity snapshots of suppliers; user and supplier keys are matched."""
    events = S.table(spark, sf, "events")
    n = F.col("event_id")
    return events.select(
        F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("user_id")).cast("string"), 9, "0")).alias(
            "school_name"
        ),
        F.when(F.col("event_type") == "click", "2B")
        .when(F.col("event_type") == "view", "2C")
        .otherwise("2C(S)")
        .alias("phase"),
        F.lit(CURRENT).alias("registration_year"),
        (F.dayofmonth("ts") % 3 + 1).alias("simulation_day"),
        F.when(F.hour("ts") < 12, "midday").otherwise("end_of_day").alias("snapshot_type"),
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
        .cast("timestamp")
        .alias("snapshot_timestamp"),
        n.cast("string").alias("event_id"),
        F.lit(200).alias("vacancy_at_open"),
        (F.lit(200) - n % 150).cast("int").alias("vacancy_remaining"),
        (n % 150).cast("int").alias("applied_count"),
        F.round((n % 150) / 200, 4).alias("pct_filled"),
    )


@query(
    "interim_lookup",
    WITH_DIM
    + """, slots AS (SELECT 'SUPPLIER#' || lpad(user_id::VARCHAR, 9, '0') AS school_name,
        CASE event_type WHEN 'click' THEN '2B' WHEN 'view' THEN '2C' ELSE '2C(S)' END AS phase, ts, event_id,
        CAST(day(ts) % 3 + 1 AS INTEGER) AS simulation_day,
        CASE WHEN hour(ts) < 12 THEN 'midday' ELSE 'end_of_day' END AS snapshot_type FROM events),
    latest AS (SELECT * FROM slots QUALIFY row_number() OVER (PARTITION BY school_name, phase
      ORDER BY ts DESC) = 1)
    SELECT school_name, phase, simulation_day, snapshot_type,
      strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS snapshot_timestamp,
      200 AS vacancy_at_open, CAST(200 - event_id % 150 AS INTEGER) AS vacancy_remaining,
      CAST(event_id % 150 AS INTEGER) AS applied_count, round((event_id % 150) / 200, 4) AS pct_filled
    FROM latest JOIN dim ON school_name = school_name_clean WHERE zone_code = 'EUROPE'""",
)
def interim_lookup(spark, sf):
    staged = ballots.stage_snapshots(snapshots(spark, sf))
    interim = ballots.mart_vacancy_interim(staged, stored_dim(spark, sf))
    return serving.interim_for(interim, CURRENT, zone_code="europe")


@query(
    "recommend_enriched",
    WITH_MART
    + f""", chosen AS (SELECT * FROM mart WHERE is_active AND zone_code = 'EUROPE'
        AND registration_year <= {CURRENT}),
    pairs AS (SELECT school_name_clean, phase_normalised,
        CAST(max(registration_year) FILTER (WHERE registration_year < {CURRENT}) IS NOT NULL AS INTEGER) + 1
          AS n_years FROM chosen GROUP BY 1, 2),
    p AS (SELECT * FROM mart WHERE registration_year = {CURRENT - 1} AND subscription_rate_3yr_avg IS NOT NULL),
    s AS (SELECT 'SUPPLIER#' || lpad(user_id::VARCHAR, 9, '0') AS school_name,
        CASE event_type WHEN 'click' THEN '2B' WHEN 'view' THEN '2C' ELSE '2C(S)' END AS phase, ts, event_id
      FROM events QUALIFY row_number() OVER (PARTITION BY school_name, phase ORDER BY ts DESC) = 1)
    SELECT a.school_name_clean, a.phase_normalised, n_years,
      p.subscription_rate_3yr_avg AS predicted_subscription_rate,
      CAST(event_id % 150 AS INTEGER) AS applied_count, event_id IS NOT NULL AS has_interim
    FROM pairs a LEFT JOIN p ON p.school_name_clean = a.school_name_clean
        AND p.phase_normalised = a.phase_normalised
      LEFT JOIN s ON s.school_name = a.school_name_clean AND s.phase = a.phase_normalised""",
)
def recommend_enriched(spark, sf):
    """Both flags on: predictions and interim counts nested into every phase, then flat."""
    staged = ballots.stage_snapshots(snapshots(spark, sf))
    interim = ballots.mart_vacancy_interim(staged, stored_dim(spark, sf))
    nested = serving.recommend_all(
        stored_mart(spark, sf),
        CURRENT,
        predictions=serving.predictions_for(_predictions(spark, sf), CURRENT),
        interim=serving.interim_for(interim, CURRENT, zone_code="europe"),
        ordered=False,
        zone_code="europe",
    )
    return nested.select("school_name_clean", F.inline_outer("categories")).select(
        "school_name_clean",
        F.col("category").alias("phase_normalised"),
        F.size("years").alias("n_years"),
        F.col("ml_prediction.predicted_subscription_rate").alias("predicted_subscription_rate"),
        F.col("interim.applied_count").alias("applied_count"),
        F.col("interim").isNotNull().alias("has_interim"),
    )


@query("school_mart_stored", SQL["school_mart"])
def school_mart_stored(spark, sf):
    """All tables written one after the other, each built from the stored one before."""
    return stored_mart(spark, sf).select(*MART_COLUMNS)
