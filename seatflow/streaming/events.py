"""JSON events in and out, and the streaming sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def encode_events(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """``key, value``: joined key columns and the whole row as JSON."""
    return df.select(
        F.concat_ws("_", *[F.col(c).cast("string") for c in key_cols]).alias("key"),
        F.to_json(F.struct(*df.columns)).alias("value"),
    )


CORRUPT = "_corrupt"


def _decoded(df: DataFrame, schema: T.StructType, value: str) -> tuple[DataFrame, Column]:
    """The frame with the decoded text as ``e``, and what is wrong with it (NULL if nothing)."""
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    relaxed = T.StructType([*fields, T.StructField(CORRUPT, T.StringType(), True)])
    text = F.col(value).cast("string")
    decoded = df.withColumn("e", F.from_json(text, relaxed, {"columnNameOfCorruptRecord": CORRUPT}))
    malformed = F.col("e").isNull() | F.col(f"e.{CORRUPT}").isNotNull()
    problem = F.when(malformed, F.lit("malformed"))
    for f in schema.fields:
        if not f.nullable:
            problem = problem.when(F.col(f"e.{f.name}").isNull(), F.lit(f"no {f.name}"))
    return decoded, problem


def parse_events(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Typed columns of the valid events in a JSON text column; for streams and tables alike.

    An event is valid if its text can be read and no required field (one that the schema says
    is not null) is missing. The others are those of ``rejected_events``.
    """
    decoded, problem = _decoded(df, schema, value)
    return decoded.filter(problem.isNull()).select(*[F.col(f"e.{f.name}") for f in schema.fields])


def rejected_events(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """``value, problem``: the text of every event that is not valid, and why."""
    decoded, problem = _decoded(df, schema, value)
    rejected = decoded.select(F.col(value).cast("string").alias("value"), problem.alias("problem"))
    return rejected.filter(F.col("problem").isNotNull())


def _versioned(df: DataFrame, schema: T.StructType, paths: Mapping[str, Sequence[str]], value: str) -> tuple[DataFrame, Column]:
    """The frame with the fields as columns ``f0``..., and what is wrong with the event."""
    decoded = df.withColumn("v", F.try_parse_json(F.col(value).cast("string")))
    fields = [
        F.coalesce(*[F.try_variant_get("v", p, f.dataType.simpleString()) for p in paths.get(f.name, [f"$.{f.name}"])])
        for f in schema.fields
    ]
    decoded = decoded.withColumns({f"f{i}": c for i, c in enumerate(fields)})
    problem = F.when(F.col("v").isNull(), F.lit("malformed"))
    for i, f in enumerate(schema.fields):
        if not f.nullable:
            problem = problem.when(F.col(f"f{i}").isNull(), F.lit(f"no {f.name}"))
    return decoded, problem


def parse_versions(
    df: DataFrame, schema: T.StructType, paths: Mapping[str, Sequence[str]] | None = None, value: str = "value"
) -> DataFrame:
    """Typed columns of JSON events whose layout changed over time; for streams and tables.

    Each text is parsed once into a VARIANT. A field is taken from the first of its ``paths``
    (``$.name`` unless given) that holds a value of its type, or one that can be read as such:
    a number given as text, for example. Fields that are not asked for do no harm, and missing
    ones are NULL, which only a required field may not be; see ``rejected_versions``.
    """
    decoded, problem = _versioned(df, schema, paths or {}, value)
    return decoded.filter(problem.isNull()).select(*[F.col(f"f{i}").alias(f.name) for i, f in enumerate(schema.fields)])


def rejected_versions(
    df: DataFrame, schema: T.StructType, paths: Mapping[str, Sequence[str]] | None = None, value: str = "value"
) -> DataFrame:
    """``value, problem`` of the events that ``parse_versions`` leaves out."""
    decoded, problem = _versioned(df, schema, paths or {}, value)
    rejected = decoded.select(F.col(value).cast("string").alias("value"), problem.alias("problem"))
    return rejected.filter(F.col("problem").isNotNull())


def read_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of JSON lines that arrive as files below ``path``.

    ``max_files`` limits what a micro-batch takes, so that a backlog is worked off in parts.
    """
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def read_events(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Stream of the valid, typed events among the JSON lines below ``path``."""
    return parse_events(read_lines(spark, path, max_files), schema)


def read_queue(
    spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000
) -> DataFrame:
    """Stream of messages of a Kafka topic; needs the Kafka connector of Spark.

    Give it to ``parse_events`` and ``rejected_events``. A micro-batch takes ``max_offsets``
    messages at most.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )


def write_queue(df: DataFrame, servers: str, topic: str, key_cols: Sequence[str]) -> None:
    """Keyed JSON messages to a Kafka topic; needs the Kafka connector of Spark."""
    (
        encode_events(df, key_cols)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def run_append(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append to a table. Offsets advance only after the files of a batch are committed.

    Run it once for the valid events and once, with a checkpoint of its own, for the rejected ones.
    """
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
