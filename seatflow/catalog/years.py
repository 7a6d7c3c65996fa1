"""Latest rows, rolling measures and year offsets."""

from pyspark.sql import functions as F

from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import (
    AS_OF,
    CELLS,
    CURRENT,
    RATED,
    SPARSE,
    rated,
    sparse_cells,
    supplier_places,
    table,
)
from seatflow.functions.cleaning import round_to
from seatflow.functions.dates import is_current_year
from seatflow.functions.keys import surrogate_key
from seatflow.functions.metrics import code_band, is_occurrence, prefix_class
from seatflow.operators import periods, ranking, trends
from seatflow.plans.ballots import add_trends

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql


KEYS = ["entity", "category"]


@query(
    "dedupe_latest",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         strftime(l_shipdate, '%Y-%m-%d') AS ship_day
       FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
               l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def dedupe_latest(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate",
    )
    latest = ranking.keep_latest(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return latest.withColumn("ship_day", F.date_format("l_shipdate", "yyyy-MM-dd")).drop(
        "l_shipdate"
    )


def slots(spark, sf):
    """Events with their day; user, type and day name a slot."""
    return table(spark, sf, "events").select(
        "user_id", "event_type", F.to_date("ts").alias("day"), "ts", "event_id", "value"
    )


SLOTS = "slots AS (SELECT *, CAST(ts AS DATE) AS day FROM events)"


@query(
    "dedupe_slots",
    f"""WITH {SLOTS} SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, event_id, value
      FROM slots QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day
        ORDER BY ts DESC, event_id DESC) = 1""",
)
def dedupe_slots(spark, sf):
    latest = ranking.keep_latest(slots(spark, sf), ["user_id", "event_type", "day"], ["ts", "event_id"])
    return latest.drop("ts").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "interim_latest",
    f"""WITH {SLOTS} SELECT user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, event_id, value,
        c_name, n_name
      FROM (SELECT * FROM slots QUALIFY row_number() OVER (PARTITION BY user_id, event_type
        ORDER BY ts DESC, event_id DESC) = 1)
      LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def interim_latest(spark, sf):
    latest = ranking.keep_latest(
        ranking.keep_latest(slots(spark, sf), ["user_id", "event_type", "day"], ["ts", "event_id"]),
        ["user_id", "event_type"],
        ["ts", "event_id"],
    )
    places = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("c_custkey").alias("user_id"), "c_name", "n_name")
    )
    return latest.join(places, "user_id", "left").select(
        "user_id",
        "event_type",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        "event_id",
        "value",
        "c_name",
        "n_name",
    )


def _rolling(rows):
    return f"""WITH {RATED} SELECT entity, category, year,
      CAST(round(CAST(avg(rate) OVER (PARTITION BY entity, category ORDER BY year
        ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS rolling
      FROM rated"""


def _rolling_avg(rows):
    def run(spark, sf):
        col = trends.rolling_avg(F.col("rate"), trends.by_year(KEYS, "year"), rows)
        return rated(spark, sf).select(*KEYS, "year", round_to(col, 4).alias("rolling"))

    return run


query("rolling_avg_3", _rolling(3))(_rolling_avg(3))
query("rolling_avg_5", _rolling(5))(_rolling_avg(5))


@query(
    "yoy_delta",
    f"""WITH {RATED} SELECT entity, category, year,
      CAST(round(CAST(rate - lag(rate) OVER w AS DECIMAL(38, 12)), 4) AS DOUBLE) AS rate_change,
      vacancy - lag(vacancy) OVER w AS vacancy_change
      FROM rated WINDOW w AS (PARTITION BY entity, category ORDER BY year)""",
)
def yoy_delta(spark, sf):
    window = trends.by_year(KEYS, "year")
    return rated(spark, sf).select(
        *KEYS,
        "year",
        round_to(trends.change(F.col("rate"), window), 4).alias("rate_change"),
        trends.change(F.col("vacancy"), window).alias("vacancy_change"),
    )


@query(
    "rolling_count",
    f"""WITH {CELLS} SELECT entity, category, year,
      CAST(sum(hit) OVER (PARTITION BY entity, category ORDER BY year
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last3,
      CAST(sum(hit) OVER (PARTITION BY entity, category ORDER BY year
        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS last5
      FROM (SELECT *, CASE WHEN right(code, 1) <> '#' THEN 1 ELSE 0 END AS hit FROM cells)""",
)
def rolling_count(spark, sf):
    window = trends.by_year(KEYS, "year")
    hit = is_occurrence(F.col("code"))
    return rated(spark, sf).select(
        *KEYS,
        "year",
        trends.rolling_count(hit, window, 3).alias("last3"),
        trends.rolling_count(hit, window, 5).alias("last5"),
    )


@query(
    "top_n_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, rn AS place FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
           AS INTEGER) AS rn FROM orders) WHERE rn <= 3""",
)
def top_n_per_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    top = ranking.top_n(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3, rank_col="place")
    return top.drop("o_orderdate")


@query(
    "offset_lag",
    f"""WITH {SPARSE} SELECT a.entity, a.category, a.year, b.rate AS lag1, c.rate AS lag2,
        d.rate AS lag3, b.vacancy AS lag1_vacancy
      FROM sparse a
      LEFT JOIN sparse b ON a.entity = b.entity AND a.category = b.category AND b.year = a.year - 1
      LEFT JOIN sparse c ON a.entity = c.entity AND a.category = c.category AND c.year = a.year - 2
      LEFT JOIN sparse d ON a.entity = d.entity AND a.category = d.category AND d.year = a.year - 3""",
)
def offset_lag(spark, sf):
    lags = {"lag1": ("rate", 1), "lag2": ("rate", 2), "lag3": ("rate", 3), "lag1_vacancy": ("vacancy", 1)}
    out = trends.offset_lag(sparse_cells(spark, sf), KEYS, "year", lags)
    return out.select(*KEYS, "year", *lags)


@query(
    "qualify_then_fetch",
    f"""WITH {CELLS}, latest AS (SELECT * FROM cells WHERE year < {CURRENT}
        QUALIFY row_number() OVER (PARTITION BY entity, category ORDER BY year DESC) = 1)
      SELECT entity, category, year, applied, vacancy, code FROM cells
      WHERE (entity, category) IN (SELECT (entity, category) FROM latest WHERE code IS NOT NULL)""",
)
def qualify_then_fetch(spark, sf):
    rows = rated(spark, sf)
    completed = rows.filter(F.col("year") < CURRENT)
    out = ranking.qualify(rows, completed, KEYS, "year", F.col("code").isNotNull())
    return out.select(*KEYS, "year", "applied", "vacancy", "code")


@query(
    "rows_at_latest",
    """SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year,
         'customer' AS scope FROM orders o
       WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders i WHERE i.o_custkey = o.o_custkey)
       UNION ALL SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER), 'table' FROM orders
       WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)""",
)
def rows_at_latest(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")
    )
    own = ranking.rows_at_latest(rows, ["o_custkey"], "year")
    whole = ranking.rows_at_latest(rows, [], "year")
    return own.withColumn("scope", F.lit("customer")).unionByName(
        whole.withColumn("scope", F.lit("table"))
    )


@query(
    "union_history_current",
    f"""WITH y AS (SELECT o_custkey, o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS year,
          count(*) AS n FROM orders GROUP BY 1, 2, 3)
      SELECT o_custkey, o_orderpriority, year, n FROM (SELECT *, row_number() OVER (
        PARTITION BY o_custkey, o_orderpriority ORDER BY year DESC) AS rn FROM y WHERE year < {CURRENT})
      WHERE rn <= 2
      UNION ALL SELECT o_custkey, o_orderpriority, year, n FROM y WHERE year = {CURRENT}""",
)
def union_history_current(spark, sf):
    yearly = (
        table(spark, sf, "orders")
        .groupBy(
            "o_custkey", "o_orderpriority", F.year("o_orderdate").cast("bigint").alias("year")
        )
        .agg(F.count("*").alias("n"))
    )
    return periods.completed_and_current(yearly, ["o_custkey", "o_orderpriority"], "year", CURRENT, 2)


@query(
    "pad_missing_period",
    f"""WITH {SPARSE} SELECT entity, category, year, rate, vacancy FROM sparse
      UNION ALL SELECT DISTINCT entity, category, {CURRENT}, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT)
      FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM sparse c WHERE c.entity = s.entity
        AND c.category = s.category AND c.year = {CURRENT})""",
)
def pad_missing_period(spark, sf):
    rows = sparse_cells(spark, sf).select(*KEYS, "year", "rate", "vacancy")
    return periods.pad_current_year(rows, KEYS, "year", CURRENT)


@query(
    "mart_trends",
    f"""WITH {RATED}, scoped AS (
      SELECT r.*, n_name, r_name, CASE WHEN starts_with(code, 'SC') THEN 'SC'
          WHEN starts_with(code, 'PR') THEN 'PR' END AS citizen_group,
        CASE code WHEN 'SC<1' THEN 'within_1km' WHEN 'SC<1#' THEN 'within_1km_no_leftover'
          WHEN 'PR1-2' THEN '1_to_2km' END AS band,
        CASE WHEN right(code, 1) <> '#' THEN 1 ELSE 0 END AS hit
      FROM rated r LEFT JOIN supplier ON s_suppkey = entity LEFT JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey
      WHERE category IN ('A', 'N') AND year >= 1996),
    trended AS (
      SELECT *, avg(rate) OVER w3 AS a3, avg(rate) OVER w5 AS a5, rate - lag(rate) OVER w AS ch,
        sum(hit) OVER w3 AS h3, sum(hit) OVER w5 AS h5, vacancy - lag(vacancy) OVER w AS vch,
        avg(vacancy) OVER w3 AS v3
      FROM scoped WINDOW w AS (PARTITION BY entity, category ORDER BY year),
        w3 AS (PARTITION BY entity, category ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        w5 AS (PARTITION BY entity, category ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT md5(entity || '-' || category || '-' || year) AS analysis_key, entity, category, year,
      n_name AS estate, r_name AS zone, applied, vacancy, taken, rate, citizen_group, band,
      CAST(round(CAST(a3 AS DECIMAL(38, 12)), 4) AS DOUBLE) AS rate_avg3,
      CAST(round(CAST(a5 AS DECIMAL(38, 12)), 4) AS DOUBLE) AS rate_avg5,
      CAST(round(CAST(ch AS DECIMAL(38, 12)), 4) AS DOUBLE) AS rate_change,
      CAST(h3 AS BIGINT) AS ballots3, CAST(h5 AS BIGINT) AS ballots5, vch AS vacancy_change,
      CAST(round(CAST(v3 AS DECIMAL(38, 12)), 2) AS DOUBLE) AS vacancy_avg3,
      CASE WHEN round(CAST(a3 AS DECIMAL(38, 12)), 10) > 1.05
        THEN CASE WHEN h3 = 3 THEN 'HIGH' WHEN h3 >= 1 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'LOW' END AS tier,
      year = 2001 AS is_current_year
    FROM trended""",
)
def mart_trends(spark, sf):
    """Risk per entity and category: scope, enrich, trends, tier, key."""
    scoped = rated(spark, sf).filter(F.col("category").isin("A", "N") & (F.col("year") >= 1996))
    places = supplier_places(spark, sf).select(
        F.col("s_suppkey").alias("entity"), F.col("n_name").alias("estate"), F.col("r_name").alias("zone")
    )
    out = add_trends(
        scoped.join(places, "entity", "left"), KEYS, "year", "rate", "vacancy", "code", 1.05
    )
    return out.select(
        surrogate_key("entity", "category", "year").alias("analysis_key"),
        "entity",
        "category",
        "year",
        "estate",
        "zone",
        "applied",
        "vacancy",
        "taken",
        "rate",
        prefix_class(F.col("code")).alias("citizen_group"),
        code_band(F.col("code")).alias("band"),
        F.col("subscription_rate_3yr_avg").alias("rate_avg3"),
        F.col("subscription_rate_5yr_avg").alias("rate_avg5"),
        F.col("subscription_rate_yoy_change").alias("rate_change"),
        F.col("ballot_occurrences_last_3yr").alias("ballots3"),
        F.col("ballot_occurrences_last_5yr").alias("ballots5"),
        F.col("vacancy_yoy_change").alias("vacancy_change"),
        F.col("vacancy_3yr_avg").alias("vacancy_avg3"),
        F.col("ballot_risk_level").alias("tier"),
        is_current_year(F.col("year"), AS_OF).alias("is_current_year"),
    )
