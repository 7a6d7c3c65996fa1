"""Cleaning, recoding and derived columns."""

from pyspark.sql import functions as F

from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import (
    AS_OF,
    CELLS,
    RATED,
    WITH_DIM,
    WITH_MART,
    cells,
    raw_schools,
    rated,
    seeds,
    supplier_places,
    table,
)
from seatflow.catalog import standins as S
from seatflow.functions import cleaning as C
from seatflow.functions import metrics as M
from seatflow.functions.dates import iso_in_zone
from seatflow.functions.keys import surrogate_key
from seatflow.operators.filters import apply_filters, in_order, lookup_one
from seatflow.operators.lookups import split_dimension
from seatflow.operators.trends import group_total
from seatflow.plans import ballots

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql


@query(
    "scrub_sentinel",
    """SELECT p_partkey, nullif(trim(CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_type || ' ' ELSE p_type END),
         'PROMO') AS p_type, nullif(trim(p_name), 'na') AS p_name FROM part""",
)
def scrub_sentinel(spark, sf):
    raw = F.when(
        F.col("p_partkey") % 5 == 0, F.concat(F.lit("  "), "p_type", F.lit("\t"))
    ).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select(
        "p_partkey", C.scrub(raw, "PROMO").alias("p_type"), C.scrub(F.col("p_name")).alias("p_name")
    )


@query(
    "canonical_name",
    "SELECT c_custkey, upper(c_name) AS name, upper(c_mktsegment) AS segment FROM customer",
)
def canonical_name(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        C.canonical(F.concat(F.lit(" \t"), F.lower("c_name"), F.lit(" "))).alias("name"),
        C.canonical(F.col("c_mktsegment")).alias("segment"),
    )


@query(
    "fix_apostrophe",
    """SELECT doc_id, md5(replace(replace(text, 'e ', 'e' || chr(8217)), chr(8217), '''')) AS fixed,
         length(text) AS n FROM documents""",
)
def fix_apostrophe(spark, sf):
    curly = F.replace("text", F.lit("e "), F.lit("e’"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(C.straight_apostrophe(curly)).alias("fixed"),
        F.length("text").cast("bigint").alias("n"),
    )


@query(
    "recode_values",
    """SELECT o_orderkey, CASE trim(o_orderpriority) WHEN '1-URGENT' THEN 'URGENT' WHEN '5-LOW' THEN 'LOW'
         ELSE trim(o_orderpriority) END AS priority FROM orders""",
)
def recode_values(spark, sf):
    names = {"1-URGENT": "URGENT", "5-LOW": "LOW"}
    return table(spark, sf, "orders").select(
        "o_orderkey", C.recode(C.strip(F.col("o_orderpriority")), names).alias("priority")
    )


@query(
    "filter_in",
    "SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('PROMO', 'ECONOMY')",
)
def filter_in(spark, sf):
    return (
        table(spark, sf, "part")
        .filter(F.col("p_type").isin("PROMO", "ECONOMY"))
        .select("p_partkey", "p_type", "p_size")
    )


@query(
    "conditional_fill",
    f"""WITH {CELLS}
    SELECT entity, category, year,
      CASE WHEN category = 'R' THEN coalesce(vacancy, 0) ELSE vacancy END AS vacancy,
      CASE WHEN category <> 'R' AND vacancy = 0 THEN coalesce(applied, 0) ELSE applied END AS applied,
      CASE WHEN category <> 'R' AND vacancy = 0 THEN coalesce(taken, 0) ELSE taken END AS taken
    FROM cells""",
)
def conditional_fill(spark, sf):
    closed = (F.col("category") != "R") & (F.col("vacancy") == 0)
    return cells(spark, sf).select(
        "entity",
        "category",
        "year",
        C.fill_when(F.col("vacancy"), F.col("category") == "R", 0).alias("vacancy"),
        C.fill_when(F.col("applied"), closed, 0).alias("applied"),
        C.fill_when(F.col("taken"), closed, 0).alias("taken"),
    )


@query("policy_null_flag", f"WITH {RATED} SELECT entity, category, year, published FROM rated")
def policy_null_flag(spark, sf):
    return rated(spark, sf).select("entity", "category", "year", "published")


@query("guarded_ratio", f"WITH {RATED} SELECT entity, category, year, rate FROM rated")
def guarded_ratio(spark, sf):
    return rated(spark, sf).select("entity", "category", "year", "rate")


@query(
    "remaining_places",
    f"""WITH {RATED} SELECT entity, category, year,
      CASE WHEN published THEN vacancy - taken END AS remaining FROM rated""",
)
def remaining_places(spark, sf):
    left = M.remaining_places(F.col("vacancy"), F.col("taken"), F.col("published"))
    return rated(spark, sf).select("entity", "category", "year", left.alias("remaining"))


@query(
    "over_capacity",
    f"""WITH {CELLS}
    SELECT entity, category, year,
      CAST(sum(taken) OVER (PARTITION BY entity, year) AS BIGINT) AS total_taken,
      CASE WHEN vacancy IS NOT NULL
           THEN sum(taken) OVER (PARTITION BY entity, year) > 3 * vacancy END AS is_over,
      CAST(sum(taken) OVER (PARTITION BY entity, year) - 3 * vacancy AS BIGINT) AS over_by
    FROM cells""",
)
def over_capacity(spark, sf):
    capacity = 3 * F.col("vacancy")
    total = group_total(F.col("taken"), ["entity", "year"]).alias("total_taken")
    return cells(spark, sf).select("*", total).select(
        "entity",
        "category",
        "year",
        "total_taken",
        F.when(capacity.isNotNull(), F.col("total_taken") > capacity).alias("is_over"),
        (F.col("total_taken") - capacity).alias("over_by"),
    )


LIFE_COLUMNS = [
    "school_name_clean", "school_status", "is_active", "inactive_from_year", "inactive_to_year",
    "school_status_description",
]


def _dim(spark, sf):
    primary = ballots.stage_primary_schools(raw_schools(spark, sf))
    return ballots.dim_school(primary, seeds(spark, sf), S.PIPELINE_AS_OF)


@query(
    "lifecycle_active",
    WITH_DIM + "SELECT school_name_clean, school_status, is_active FROM dim",
)
def lifecycle_active(spark, sf):
    return _dim(spark, sf).select("school_name_clean", "school_status", "is_active")


@query(
    "status_text",
    WITH_DIM
    + """SELECT school_name_clean, inactive_from_year, inactive_to_year, merged_into,
           school_status_description FROM dim""",
)
def status_text(spark, sf):
    return _dim(spark, sf).select(
        "school_name_clean",
        "inactive_from_year",
        "inactive_to_year",
        "merged_into",
        "school_status_description",
    )


@query(
    "prefix_class",
    """SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'Brand#1'
         WHEN p_brand LIKE 'Brand#2%' THEN 'Brand#2' END AS brand_group FROM part""",
)
def prefix_class(spark, sf):
    group = M.prefix_class(F.col("p_brand"), ("Brand#1", "Brand#2"))
    return table(spark, sf, "part").select("p_partkey", group.alias("brand_group"))


@query(
    "code_band",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast'
         WHEN o_orderpriority IN ('3-MEDIUM') THEN 'normal' END AS band FROM orders""",
)
def code_band(spark, sf):
    band = M.code_band(
        F.col("o_orderpriority"), {"fast": ("1-URGENT", "2-HIGH"), "normal": ("3-MEDIUM",)}
    )
    return table(spark, sf, "orders").select("o_orderkey", band.alias("band"))


@query(
    "risk_tier",
    f"""WITH {RATED}
    SELECT entity, category, year, CASE WHEN n = 3 AND a > 1.05 THEN 'HIGH'
      WHEN n >= 1 AND a > 1.05 THEN 'MEDIUM' ELSE 'LOW' END AS tier
    FROM (SELECT *, round(CAST(avg(rate) OVER w AS DECIMAL(38, 12)), 10) AS a,
            sum(CASE WHEN code IN ('SC<1', 'PR1-2') THEN 1 ELSE 0 END) OVER w AS n
          FROM rated WINDOW w AS (PARTITION BY entity, category ORDER BY year
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
)
def risk_tier(spark, sf):
    out = ballots.add_trends(
        rated(spark, sf), ["entity", "category"], "year", "rate", "vacancy", "code", 1.05
    )
    return out.select("entity", "category", "year", F.col("ballot_risk_level").alias("tier"))


@query(
    "surrogate_key",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, md5(concat_ws('-', CAST(l_orderkey AS VARCHAR),
      coalesce(CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_linenumber AS VARCHAR) END, '{S.KEY_NULL}'),
      l_returnflag)) AS row_key FROM lineitem""",
)
def surrogate_key_query(spark, sf):
    line = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        surrogate_key("l_orderkey", line, "l_returnflag").alias("row_key"),
    )


@query(
    "dim_split",
    """SELECT p_partkey, p_brand, p_type, p_name, p_size, p_retailprice,
         'part' AS stable_part, 'offer' AS volatile_part FROM part""",
)
def dim_split(spark, sf):
    stable, volatile = split_dimension(
        table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"]
    )
    return stable.withColumn("stable_part", F.lit("part")).join(
        volatile.withColumn("volatile_part", F.lit("offer")), "p_partkey"
    )


@query(
    "dynamic_filter",
    """SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer
       JOIN nation ON c_nationkey = n_nationkey
       WHERE upper(c_mktsegment) = 'BUILDING' AND c_acctbal > 0""",
)
def dynamic_filter(spark, sf):
    joined = (
        table(spark, sf, "customer")
        .withColumn("in_credit", F.col("c_acctbal") > 0)
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return apply_filters(joined, c_mktsegment="building", in_credit=True, n_name=None).select(
        "c_custkey", "c_name", "c_mktsegment", "n_name"
    )


@query(
    "mask_not_open",
    f"""WITH {CELLS} SELECT entity, category, year,
      CASE WHEN vacancy = 0 THEN 'N/A' ELSE code END AS label FROM cells""",
)
def mask_not_open(spark, sf):
    return cells(spark, sf).select(
        "entity", "category", "year", M.mask_not_open(F.col("vacancy"), F.col("code")).alias("label")
    )


@query(
    "iso_in_zone",
    """SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local_time
       FROM events""",
)
def iso_in_zone_query(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", iso_in_zone(F.col("ts"), source="UTC").alias("local_time")
    )


@query(
    "point_lookup",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE upper(trim(c_name)) = 'CUSTOMER#000000077'",
)
def point_lookup(spark, sf):
    found = lookup_one(table(spark, sf, "customer"), "c_name", " customer#000000077 ")
    return found.select("c_custkey", "c_name", "c_acctbal")


@query(
    "flag_gated_join",
    f"""WITH {RATED}
    SELECT entity, category, year, rate, CAST(NULL AS DOUBLE) AS predicted, s_name AS place FROM rated
    LEFT JOIN supplier ON s_suppkey = entity AND s_suppkey % 2 = 0""",
)
def flag_gated_join(spark, sf):
    """Flags come from a table: the region names stand for keys, odd keys are off."""
    from seatflow.plans.serving import flag

    config = table(spark, sf, "region").select(
        F.col("r_name").alias("config_key"), (F.col("r_regionkey") % 2 == 0).alias("config_value")
    )
    out = rated(spark, sf).select("entity", "category", "year", "rate")
    predicted = out.select(
        "entity", "category", "year", (F.col("rate") * 1.01).alias("predicted")
    )
    known = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey"))
    places = table(spark, sf, "supplier").select(
        known.alias("entity"), F.col("s_name").alias("place")
    )
    if flag(config, "AMERICA"):
        out = out.join(predicted, ["entity", "category", "year"], "left")
    else:
        out = out.withColumn("predicted", F.lit(None).cast("double"))
    if flag(config, "ASIA"):
        return out.join(places, "entity", "left")
    return out.withColumn("place", F.lit(None).cast("string"))


@query(
    "chance_from_rate",
    f"""WITH {RATED}
    SELECT entity, category, year, CASE WHEN greatest(rate, 0.0) <= 1 THEN 1.0::DOUBLE
      ELSE CAST(round(CAST(1 / rate AS DECIMAL(38, 12)), 6) AS DOUBLE) END AS chance
    FROM rated WHERE rate IS NOT NULL""",
)
def chance_from_rate(spark, sf):
    chance = C.round_to(M.chance_ratio(F.col("rate")), 6)
    return (
        rated(spark, sf)
        .filter(F.col("rate").isNotNull())
        .select("entity", "category", "year", chance.alias("chance"))
    )


EXPLAIN = """CASE WHEN ballot_risk_level = 'HIGH' THEN
      'Balloted in all 3 of the last 3 years with an average subscription rate of ' || shown
      || CASE WHEN subscription_rate_yoy_change > 0
         THEN '. Demand is increasing year-on-year — competition is intensifying.'
         ELSE '. Demand appears to be stabilising but competition remains high.' END
    WHEN ballot_risk_level = 'MEDIUM' THEN 'Balloted in ' || ballot_occurrences_last_3yr
      || ' of the last 3 years with an average subscription rate of ' || shown
      || '. Monitor closely — this school has shown recent balloting activity.'
    ELSE 'No balloting in the last 3 years. Average subscription rate of '
      || coalesce(shown, 'unavailable') || '. Ballot risk is currently low based on recent trends.' END"""

SHOWN = "printf('%.2fx', subscription_rate_3yr_avg)"


@query(
    "risk_explanation",
    WITH_MART
    + f"""SELECT school_name_clean, phase_normalised, registration_year, {EXPLAIN} AS explanation
    FROM (SELECT *, {SHOWN} AS shown FROM mart)""",
)
def risk_explanation(spark, sf):
    from seatflow.catalog.schools import mart

    text = M.explain_risk(
        F.col("ballot_risk_level"),
        F.col("ballot_occurrences_last_3yr"),
        F.col("subscription_rate_3yr_avg"),
        F.col("subscription_rate_yoy_change"),
    )
    return mart(spark, sf).select(
        "school_name_clean", "phase_normalised", "registration_year", text.alias("explanation")
    )


@query(
    "custom_order",
    """SELECT r_regionkey, r_name, CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2
         WHEN 'AFRICA' THEN 3 END AS rank
       FROM region WHERE r_name IN ('EUROPE', 'ASIA', 'AFRICA') ORDER BY rank""",
)
def custom_order(spark, sf):
    return in_order(table(spark, sf, "region"), "r_name", ("EUROPE", "ASIA", "AFRICA"))
