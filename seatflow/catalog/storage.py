"""Sources and sinks: every query writes through one and reads the result back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import table
from seatflow.schemas import struct
from seatflow.session import fresh_path
from seatflow.sources import tables as io
from seatflow.sources.documents import read_documents
from seatflow.streaming.events import encode_events, parse_events

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql


@query("src_csv_snapshot", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src_csv_snapshot(spark, sf):
    path = fresh_path(spark, "snapshot")
    source = table(spark, sf, "supplier")
    source.write.mode("overwrite").option("header", True).csv(path)
    return io.load_snapshot_csv(spark, path, source.schema)


@query(
    "src_csv_inferred",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def src_csv_inferred(spark, sf):
    path = fresh_path(spark, "inferred")
    table(spark, sf, "customer").write.mode("overwrite").option("header", True).csv(path)
    return io.load_snapshot_csv(spark, path).withColumns(
        {"c_custkey": F.col("c_custkey").cast("bigint")}
    )


LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity"


@query(
    "src_parquet_append",
    f"""SELECT {LINE}, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem
        UNION ALL SELECT {LINE}, CAST(year(l_shipdate) AS INTEGER) FROM lineitem WHERE l_returnflag = 'R'""",
)
def src_parquet_append(spark, sf):
    path = fresh_path(spark, "append")
    rows = table(spark, sf, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    columns = [*LINE.split(", "), "ship_year"]
    io.append_partitioned(rows.select(columns), path, ["ship_year"], ["l_partkey"])
    again = rows.filter("l_returnflag = 'R'").select(columns)
    io.append_partitioned(again, path, ["ship_year"], ["l_partkey"])
    schema = T.StructType([f for f in rows.select(columns).schema.fields])
    return spark.read.schema(schema).parquet(path)


@query(
    "coerce_schema",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         TRY_CAST(CASE WHEN event_id % 4 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS amount,
         CAST(NULL AS VARCHAR) AS note FROM events""",
)
def coerce_schema(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_type"))
        .otherwise(F.col("value").cast("string"))
        .alias("amount"),
    )
    schema = struct("event_id bigint, k int, amount double, note string")
    return io.coerce_schema(raw, schema)


@query(
    "seed_load",
    """SELECT n_name, n_regionkey AS priority, n_nationkey % 2 = 0 AS has_balloting,
         CASE WHEN n_nationkey % 3 > 0 THEN r_name || ', "' || n_name || '"' END AS note
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def seed_load(spark, sf):
    path = fresh_path(spark, "seed")
    seed = (
        table(spark, sf, "nation")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "n_name",
            F.col("n_regionkey").alias("priority"),
            F.upper((F.col("n_nationkey") % 2 == 0).cast("string")).alias("has_balloting"),
            F.when(
                F.col("n_nationkey") % 3 > 0,
                F.concat("r_name", F.lit(', "'), "n_name", F.lit('"')),
            ).alias("note"),
        )
    )
    seed.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    schema = struct("n_name string, priority int, has_balloting boolean, note string")
    return io.load_seed(spark, path, schema)


@query(
    "event_json_encode",
    """SELECT user_id || '_' || event_type AS key, '{"user_id":' || user_id || ',"event_type":"' || event_type
         || '","event_id":' || event_id || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}' AS value
       FROM events""",
)
def event_json_encode(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id",
        "event_type",
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
    )
    return encode_events(rows, ["user_id", "event_type"])


@query(
    "event_json_parse",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(NULL AS VARCHAR) AS missing FROM events""",
)
def event_json_parse(spark, sf):
    events = table(spark, sf, "events")
    decoded = parse_events(
        events.select(
            F.regexp_replace(
                "props",
                r"\{",
                F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(",")),
            ).alias("value")
        ),
        struct("event_id bigint, k int, missing string"),
    )
    return decoded


@query(
    "partition_replace",
    """SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE WHEN year(o_orderdate) = 1999 THEN 'second' ELSE 'first' END AS load
       FROM orders WHERE year(o_orderdate) <> 1999 OR o_orderstatus = 'F'""",
)
def partition_replace(spark, sf):
    path = fresh_path(spark, "replace")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus"
    )
    first = rows.withColumn("load", F.lit("first")).drop("o_orderstatus")
    io.append_partitioned(first, path, ["year"], ["o_custkey"])
    second = rows.filter("year = 1999 AND o_orderstatus = 'F'").withColumn("load", F.lit("second"))
    io.replace_partitions(second.drop("o_orderstatus"), path, ["year"], ["o_custkey"])
    return spark.read.schema(first.schema).parquet(path)


@query(
    "overwrite_reload",
    """SELECT o_custkey, count(*) AS n, 'v2' AS model_version, true AS has_time
       FROM orders GROUP BY o_custkey""",
)
def overwrite_reload(spark, sf):
    path = fresh_path(spark, "reload")
    orders = table(spark, sf, "orders")
    io.overwrite_table(orders.groupBy("o_custkey").agg(F.count("*").alias("n")), path, "v1")
    io.overwrite_table(orders.groupBy("o_custkey").agg(F.count("*").alias("n")), path, "v2")
    return spark.read.parquet(path).select(
        "o_custkey", "n", "model_version", F.col("trained_at").isNotNull().alias("has_time")
    )


@query("ensure_table", "SELECT p_partkey, p_name, p_size FROM part")
def ensure_table(spark, sf):
    """Made twice, filled once, and taken out of the catalog again; the files are read."""
    path = fresh_path(spark, "table")
    name = "seatflow_" + path.rsplit("-", 1)[1]
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    schema = struct("p_partkey bigint not null, p_name string, p_size int")
    io.ensure_table(spark, name, schema, path)
    io.ensure_table(spark, name, schema, path)
    io.insert_rows(rows.select("p_size", "p_partkey", "p_name"), name)
    found = spark.table(name).schema
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(found).parquet(path)


@query(
    "doc_source",
    """SELECT item_id, md5(text) AS text_hash, CAST(length(text) AS BIGINT) AS n FROM benchmark
       WHERE item_id % 10 <> 3""",
)
def doc_source(spark, sf):
    """Every benchmark text as a document of its own; names with a skip word are left out.

    The given table holds the benchmark items of an evaluation, a list that does not grow
    with the corpus, so a folder per document stays small.
    """
    path = fresh_path(spark, "documents")
    kind = F.when(F.col("item_id") % 10 == 3, "copy").otherwise("page")
    name = F.concat(kind, F.lit("-"), F.col("item_id").cast("string"))
    table(spark, sf, "benchmark").select(
        F.col("text").alias("value"), name.alias("doc")
    ).write.mode("overwrite").partitionBy("doc").text(path)
    doc = F.regexp_extract(F.col("_metadata.file_path"), r"doc=([a-z]+-[0-9]+)", 1)
    found = read_documents(spark, path, skip=["copy"], suffix="", name=doc)
    text = F.regexp_replace("text", r"\n\z", "")
    return found.select(
        F.regexp_extract("source_file", "[0-9]+", 0).cast("bigint").alias("item_id"),
        F.md5(text).alias("text_hash"),
        F.length(text).cast("bigint").alias("n"),
    )
