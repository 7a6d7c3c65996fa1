"""Counts, profiles, distinct values, last known values and error measures."""

from pyspark.sql import functions as F

from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import RATED, rated, table
from seatflow.operators import summaries
from seatflow.operators.lookups import attach, map_or_keep
from seatflow.operators.nesting import facet_lists, facet_rows
from seatflow.session import fresh_path
from seatflow.sources.tables import replace_partitions

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql


@query(
    "count_by_year",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1",
)
def count_by_year(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n")
    )


@query(
    "distinct_tuples",
    """SELECT DISTINCT nullif(p_type, 'SMALL') AS kind, p_brand, p_size FROM part
       WHERE p_brand <> 'Brand#1' AND p_type <> 'SMALL'""",
)
def distinct_tuples(spark, sf):
    part = table(spark, sf, "part").select(
        F.nullif("p_type", F.lit("SMALL")).alias("kind"),
        F.when(F.col("p_brand") == "Brand#1", "UNKNOWN").otherwise(F.col("p_brand")).alias("p_brand"),
        "p_size",
    )
    return summaries.filter_values(part, ["kind", "p_brand"], ["kind", "p_brand", "p_size"])


def _places(spark, sf):
    zone = F.when(F.col("r_name") == "ASIA", "UNKNOWN").otherwise(F.col("r_name"))
    return (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("zone", zone)
    )


PLACES = """customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name <> 'ASIA'"""


@query(
    "facet_lists",
    f"""SELECT r_name AS zone, count(DISTINCT n_name) AS n,
         string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS estates FROM {PLACES} GROUP BY 1""",
)
def facets(spark, sf):
    return facet_lists(_places(spark, sf), "zone", "n_name").select(
        "zone",
        F.size("values").cast("bigint").alias("n"),
        F.array_join("values", "|").alias("estates"),
    )


@query("facet_rows", f"SELECT DISTINCT r_name AS zone, c_name FROM {PLACES}")
def facet_pairs(spark, sf):
    return facet_rows(_places(spark, sf), "zone", "c_name")


@query(
    "last_non_null",
    """SELECT user_id, event_type,
         arg_max(value, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS value,
         arg_max(event_id, (ts, event_id)) FILTER (WHERE event_id % 4 <> 1) AS event_id,
         arg_max(props, (ts, event_id)) FILTER (WHERE event_id % 5 <> 2) AS props
       FROM events GROUP BY user_id, event_type""",
)
def last_non_null(spark, sf):
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "user_id",
        "event_type",
        "ts",
        n.alias("at_id"),
        F.when(n % 3 != 0, F.col("value")).alias("value"),
        F.when(n % 4 != 1, n).alias("event_id"),
        F.when(n % 5 != 2, F.col("props")).alias("props"),
    )
    return summaries.last_non_null(
        rows, ["user_id", "event_type"], ["ts", "at_id"], ["value", "event_id", "props"]
    )


@query(
    "profile",
    """SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities,
         CAST(min(year(o_orderdate)) AS BIGINT) AS min_year,
         CAST(max(year(o_orderdate)) AS BIGINT) AS max_year FROM orders""",
)
def profile(spark, sf):
    return summaries.profile(table(spark, sf, "orders"), "o_custkey", F.year("o_orderdate"))


@query(
    "profile_merged",
    """SELECT count(*) AS n_rows, count(o_custkey) AS known, true AS distinct_near,
      count(DISTINCT year(o_orderdate)) AS years FROM orders""",
)
def profile_merged(spark, sf):
    """Profiles of the years put together: one year is appended, another one profiled again,
    without a look at the rest."""
    path, cols = fresh_path(spark, "profiles"), ["o_custkey"]
    rows = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    last = rows.agg(F.max("year")).scalar()
    for condition in (F.col("year") != last, F.col("year") == last, F.col("year") == 1996):
        replace_partitions(summaries.profile_parts(rows.filter(condition), "year", cols), path, ["year"])
    parts = spark.read.parquet(path)
    exact = rows.agg(F.countDistinct("o_custkey")).scalar()
    near = F.abs(F.col("o_custkey_distinct") - exact) <= F.greatest(F.lit(2), 0.05 * exact)
    years = parts.agg(F.countDistinct("year")).scalar().alias("years")
    return summaries.merged_profile(parts, cols).select(
        "n_rows", F.col("o_custkey_known").alias("known"), near.alias("distinct_near"), years
    )


GUESS = "(0.9 * l_quantity + 2.0)"


def _guessed(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_quantity", (F.lit(0.9) * F.col("l_quantity") + F.lit(2.0)).alias("guess")
    )


def _dec(expr):
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 12)), 6) AS DOUBLE)"


@query(
    "regression_metrics",
    f"""SELECT count(*) AS n, {_dec(f'avg(abs(l_quantity - {GUESS}))')} AS mae,
         {_dec(f'sqrt(avg(pow(l_quantity - {GUESS}, 2)))')} AS rmse,
         {_dec(f'1 - sum(pow(l_quantity - {GUESS}, 2)) / (var_pop(l_quantity) * count(*))')} AS r2
       FROM lineitem""",
)
def regression_metrics(spark, sf):
    return summaries.regression_metrics(_guessed(spark, sf), "l_quantity", "guess")


@query(
    "mae_by_group",
    f"""SELECT l_returnflag, count(*) AS n, {_dec(f'avg(abs(l_quantity - {GUESS}))')} AS mae
       FROM lineitem GROUP BY 1""",
)
def mae_by_group(spark, sf):
    return summaries.mae_by(_guessed(spark, sf), "l_returnflag", "l_quantity", "guess")


# --- reference joins ----------------------------------------------------------------------


@query(
    "lookup_fallback",
    """SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'LAND ' || n_nationkey ELSE n_name END AS place
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def lookup_fallback(spark, sf):
    nation = table(spark, sf, "nation")
    # Every second name is blank in the mapping and so stays as it is.
    mapping = nation.select(
        F.when(
            F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"))
        ).alias("known_as"),
        F.concat(F.lit("LAND "), F.col("n_nationkey").cast("string")).alias("official"),
    )
    named = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return map_or_keep(
        named, mapping, "n_name", F.upper(F.trim("known_as")), F.col("official"), "place"
    ).select("c_custkey", "place")


@query(
    "lookup_validate",
    """SELECT n_nationkey, n_name, CASE WHEN r_regionkey < 3 THEN r_name END AS category
       FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def lookup_validate(spark, sf):
    key = F.when(F.col("r_regionkey") < 3, F.col("r_regionkey"))
    return attach(
        table(spark, sf, "nation"),
        table(spark, sf, "region"),
        "n_regionkey",
        [key.alias("n_regionkey"), F.col("r_name").alias("category")],
    ).select("n_nationkey", "n_name", "category")


@query(
    "lookup_codes",
    """SELECT p_partkey, nullif(p_type, 'PROMO') AS code,
         CASE p_type WHEN 'ECONOMY' THEN 'ECONOMY parts' WHEN 'SMALL' THEN 'SMALL parts' END AS meaning
       FROM part""",
)
def lookup_codes(spark, sf):
    part = table(spark, sf, "part")
    meanings = (
        part.filter(F.col("p_type").isin("ECONOMY", "SMALL"))
        .select(F.col("p_type").alias("code"))
        .distinct()
        .withColumn("meaning", F.concat("code", F.lit(" parts")))
    )
    coded = part.select("p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("code"))
    return attach(coded, meanings, "code").select("p_partkey", "code", "meaning")


@query(
    "fact_attach_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN s_suppkey % 4 > 0 THEN md5(s_name) END AS supplier_key
       FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""",
)
def fact_attach_key(spark, sf):
    from seatflow.functions.keys import surrogate_key

    known = F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey"))
    dim = table(spark, sf, "supplier").select(
        known.alias("l_suppkey"), surrogate_key("s_name").alias("supplier_key")
    )
    fact = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return attach(fact, dim, "l_suppkey")


@query(
    "inner_using",
    """SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus <> 'P' AND c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def inner_using(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust_key"), "c_mktsegment"
    )
    return (
        table(spark, sf, "orders")
        .withColumnRenamed("o_custkey", "cust_key")
        .join(customer, "cust_key")
        .filter(
            (F.col("o_orderstatus") != "P") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
        )
        .select("o_orderkey", "o_totalprice", "c_mktsegment")
    )


@query(
    "attach_by_pair",
    f"""WITH {RATED}, latest AS (SELECT user_id, event_type, value, event_id FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
      SELECT entity, category, year, rate, value AS last_value, event_id AS last_event,
        event_id IS NOT NULL AS has_event
      FROM rated LEFT JOIN latest ON entity = user_id
        AND event_type = CASE category WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' ELSE 'none' END""",
)
def attach_by_pair(spark, sf):
    from seatflow.operators.lookups import attach_record
    from seatflow.operators.ranking import keep_latest

    latest = keep_latest(
        table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"),
        ["user_id", "event_type"],
        ["ts", "event_id"],
    ).withColumnRenamed("user_id", "entity")
    kind = F.when(F.col("category") == "A", "click").when(F.col("category") == "N", "view")
    rows = rated(spark, sf).withColumn("event_type", kind.otherwise("none"))
    out = attach_record(rows, latest, ["entity", "event_type"], ["value", "event_id"], "event")
    return out.select(
        "entity",
        "category",
        "year",
        "rate",
        F.col("event.value").alias("last_value"),
        F.col("event.event_id").alias("last_event"),
        F.col("event").isNotNull().alias("has_event"),
    )
