"""Snapshots, partitioned tables, seeds and typed columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Table property with the names of the fields that must be known.
REQUIRED = "required.fields"


def load_snapshot_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV snapshot with a header. Types are inferred, at the price of a second
    scan, only when no schema is given. ``multi_line`` allows line breaks inside
    quotes; then each file is read by one task, otherwise files are split."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def load_seed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """A small typed CSV; the reader skips a byte order mark itself.

    ``names`` gives the header of each column of the schema; columns are then found by
    header, whatever their order, and a header that is missing raises. Without it they
    are taken by position.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if names is None:
        return reader.schema(schema).csv(path)
    found = reader.csv(path)
    missing = [names[f.name] for f in schema.fields if names[f.name] not in found.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {found.columns}")
    return found.select(
        *[F.col(f"`{names[f.name]}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def coerce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to their declared types; values that do not fit become NULL."""
    cols: list[Column] = []
    for field in schema.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def with_audit(df: DataFrame, alias: str = "loaded_at") -> DataFrame:
    return df.withColumn(alias, F.current_timestamp())


def _clustered(df: DataFrame, by: Sequence[str], sort: Sequence[str], files: int | None) -> DataFrame:
    """Rows spread for writing: a few files per partition value, sorted within a file.

    With ``files`` set, a partition value is split into that many parts, so a
    value with a third of all rows is still written by several tasks. Without
    it, the adaptive ``rebalance`` hint splits large values by size.
    """
    if files:
        salt = F.pmod(F.xxhash64(*(sort or df.columns)), F.lit(files))
        df = df.repartition(*by, salt)
    else:
        df = df.hint("rebalance", *by)
    return df.sortWithinPartitions(*by, *sort)


def append_partitioned(
    df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = (), files: int | None = None
) -> None:
    _clustered(df, by, sort, files).write.mode("append").partitionBy(*by).parquet(path)


def overwrite_partitioned(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    sort: Sequence[str] = (),
    files: int | None = None,
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Replace the whole table: partitions that ``df`` does not hold are gone afterwards.

    ``watch`` gets the rows as they go into the files, to count them on the way.
    """
    rows = _clustered(df, by, sort, files)
    (
        (watch(rows) if watch else rows)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*by)
        .parquet(path)
    )


def replace_partitions(
    df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = (), files: int | None = None
) -> None:
    """Replace exactly the partitions that ``df`` holds; all others stay."""
    (
        _clustered(df, by, sort, files)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def replace_values(
    df: DataFrame,
    path: str,
    by: str,
    values: Sequence,
    sort: Sequence[str] = (),
    files: int | None = None,
) -> None:
    """Replace the partitions of these values of ``by`` with the rows that ``df`` has of them.

    A stored partition of a value that ``df`` lacks becomes empty. ``df`` is read twice, so it
    should be a stored table, and not the one at ``path``. A write that failed is repeated.
    """
    rows = df.filter(F.col(by).isin(*values))
    replace_partitions(rows, path, [by], sort, files)
    held = {r[0] for r in rows.select(by).distinct().collect()}  # no more than there are values
    empty = df.drop(by).limit(0)
    known = df.sparkSession.read.schema(df.schema).parquet(path)
    known = known.filter(F.col(by).isin(*[v for v in values if v not in held]))
    for value in sorted(r[0] for r in known.select(by).distinct().collect()):
        empty.write.mode("overwrite").parquet(f"{path}/{by}={value}")


def save_bucketed(
    df: DataFrame, name: str, path: str, by: Sequence[str], buckets: int, sort: Sequence[str] = ()
) -> DataFrame:
    """Replace the catalog table ``name`` at ``path``, hashed into buckets by ``by``; one shuffle.

    Joins and windows over tables with the same buckets, on ``by`` and maybe more columns, then
    need none: what is stored once is read many times. The number of buckets is that of the
    tasks of such a join, so it should follow the size of the largest of the tables.
    """
    rows = df.repartition(buckets, *by)
    (
        rows.write.mode("overwrite")
        .bucketBy(buckets, *by)
        .sortBy(*(sort or by))
        .option("path", path)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def overwrite_table(df: DataFrame, path: str, version: str | None = None) -> None:
    """Truncate and reload; ``version`` adds the run columns."""
    if version is not None:
        df = df.withColumn("model_version", F.lit(version)).withColumn(
            "trained_at", F.current_timestamp()
        )
    df.write.mode("overwrite").parquet(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame written to ``path`` and read back: a short lineage for what is read often."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str) -> None:
    """Create a table over ``path`` unless it exists.

    Spark takes every column of a file table as nullable, so the fields that must be known are
    kept as a property of the table, which ``insert_rows`` obeys.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    required = ",".join(f.name for f in schema.fields if not f.nullable)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'"
        f" TBLPROPERTIES ('{REQUIRED}' = '{required}')"
    )


def insert_rows(df: DataFrame, name: str) -> None:
    """Append rows, by column name, to a table made by ``ensure_table``.

    A NULL in a required field ends the job before anything is committed.
    """
    spark = df.sparkSession
    found = spark.sql(f"SHOW TBLPROPERTIES {name}").filter(F.col("key") == REQUIRED).first()
    required = [c for c in (found["value"] if found else "").split(",") if c]
    checked = {
        c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} of {name} must be known"))).otherwise(F.col(c))
        for c in required
    }
    df.withColumns(checked).select(spark.table(name).columns).write.insertInto(name)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows when it has not been built yet."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)
