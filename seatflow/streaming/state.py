"""Latest record per key out of streams: an append-only table of changes, and the latest over it.

Below ``path`` lie two plain tables. ``changes`` takes what streams bring, each micro-batch as
one append, in a folder for each stream and generation. ``base`` holds one record per key as of
the last compaction. Readers take the latest over both, so a record that was appended twice (a
batch that is replayed, a stream that starts again without its checkpoint, a second stream over
the same events) counts once, and no batch number has to be remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seatflow.operators.lookups import attach
from seatflow.operators.ranking import keep_latest
from seatflow.session import fresh_path
from seatflow.sources.tables import stored

STREAM, GENERATION = "stream", "generation"


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _base(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(_nullable(schema)).parquet(f"{path}/base")


def _changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = [T.StructField(STREAM, T.StringType()), T.StructField(GENERATION, T.IntegerType())]
    return spark.read.schema(T.StructType([*_nullable(schema).fields, *fields])).parquet(f"{path}/changes")


def _folder(path: str, stream: str, generation: int) -> str:
    return f"{path}/changes/{STREAM}={stream}/{GENERATION}={generation}"


def make_table(spark: SparkSession, path: str, schema: T.StructType, stream: str = "main", generation: int = 0) -> None:
    """Empty tables to append to and to read, unless there are some."""
    empty = spark.createDataFrame([], _nullable(schema)).coalesce(1)
    for folder in (f"{path}/base", _folder(path, stream, generation)):
        empty.write.mode("append").parquet(folder)


def append_batch(
    path: str, stream: str = "main", generation: int = 0, enrich: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends a micro-batch, without a shuffle.

    Spark commits the files of a batch as one job. Streams that run at the same time need names
    of their own, since two jobs must not commit into one folder. ``enrich`` is called for each
    micro-batch, so tables that it reads are seen as they are by then.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = enrich(batch) if enrich else batch
        rows.write.mode("append").parquet(_folder(path, stream, generation))

    return run


def attach_stored(path: str, schema: T.StructType, on: Sequence[str] | str) -> Callable[[DataFrame], DataFrame]:
    """``enrich`` function: left join with the stored table at ``path`` as it is when a
    micro-batch runs, so a dimension that was replaced meanwhile is seen by the next batch."""

    def enrich(batch: DataFrame) -> DataFrame:
        return attach(batch, batch.sparkSession.read.schema(schema).parquet(path), on)

    return enrich


def run_changes(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    stream: str = "main",
    generation: int = 0,
    mode: str = "append",
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    schema: T.StructType | None = None,
) -> StreamingQuery:
    """Append a stream's rows to the changes, one micro-batch after the other, to the end of what
    has arrived. ``schema`` is that of the enriched rows."""
    make_table(rows.sparkSession, path, schema or rows.schema, stream, generation)
    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(append_batch(path, stream, generation, enrich))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One record per key: the one that sorts last by ``order``, over base and changes.

    Each task cuts its rows to one a key before they are shuffled.
    """
    rows = _base(spark, path, schema).unionByName(_changes(spark, path, schema).drop(STREAM, GENERATION))
    return keep_latest(rows, keys, order)


def compact(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], upto: int
) -> None:
    """Take the changes of the generations up to ``upto`` into the base and empty them.

    No running stream may write to these generations: start streams anew with the next one
    first. A compaction that was interrupted is repeated; what it left counts once.
    """
    changes = _changes(spark, path, schema).filter(F.col(GENERATION) <= upto)
    merged = keep_latest(_base(spark, path, schema).unionByName(changes.drop(STREAM, GENERATION)), keys, order)
    merged = stored(merged, fresh_path(spark, "compacted"))
    merged.write.mode("overwrite").parquet(f"{path}/base")
    for stream, generation in changes.select(STREAM, GENERATION).distinct().collect():
        merged.limit(0).write.mode("overwrite").parquet(_folder(path, stream, generation))


ROW, STATE_MS = "_row", "_state_ms"


def _keep_latest(
    order: Sequence[str], state: T.StructType, idle_ms: int
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The latest record of a key as one value of state, given out when it changes.

    A time-out clears the state of a key once the watermark is ``idle_ms`` past its latest record.
    Spark forgets the time-out whenever rows of the key come, so each call sets it.
    """
    names = state.fieldNames()

    def rank(record: dict[str, Any]) -> list[tuple]:
        return [(record[c] is not None, record[c]) for c in order]

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        rows = (
            (rank(row), row, ms) for frame in frames for row, ms in zip(frame[ROW], frame[STATE_MS], strict=True)
        )
        top, best, ms = max(rows, key=lambda r: r[0])
        known = dict(zip(names, group.get, strict=True)) if group.exists else None
        later = known is None or rank(known) < top
        if later:
            group.update((*[best[c] for c in names[:-1]], int(ms)))
        due = (int(ms) if later else known[STATE_MS]) + idle_ms
        group.setTimeoutTimestamp(max(due, group.getCurrentWatermarkMs() + 1))
        if later:
            yield pd.DataFrame({ROW: [best]})

    return run


def latest_changes(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, delay: str, idle_ms: int
) -> DataFrame:
    """The records of a stream that are later, by ``order``, than all of their key before.

    ``time`` is a timestamp column, or text of one. The state holds a row a key, and none of
    keys without an event for ``idle_ms`` of event time; events that come ``delay`` late do not
    count any more. ``order`` ends in a unique column, so a restart gives the same answer.

    The function runs in tasks alone, where a package shipped with ``--py-files`` is known. A
    record travels as one struct, so that pandas leaves whole numbers and NULLs as they are.
    """
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    timed = timed.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], "_time",
        F.unix_millis("_time").alias(STATE_MS), F.struct(*stream.columns).alias(ROW),
    )
    state = T.StructType([*[stream.schema[c] for c in order], T.StructField(STATE_MS, T.LongType())])
    found = timed.groupBy(*[f"_key{i}" for i in range(len(keys))]).applyInPandasWithState(
        _keep_latest(list(order), _nullable(state), idle_ms),
        T.StructType([T.StructField(ROW, _nullable(stream.schema))]),
        _nullable(state),
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(f"{ROW}.*")


def run_latest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    time: str,
    delay: str,
    idle_ms: int,
    **more: Any,
) -> StreamingQuery:
    """Append to the changes only what the state store takes for later than all before it."""
    return run_changes(latest_changes(stream, keys, order, time, delay, idle_ms), path, checkpoint, mode="update", **more)


def once(stream: DataFrame, ids: Sequence[str], time: str, delay: str) -> DataFrame:
    """The stream's events without those whose ids were there before, for ``delay`` at least.

    The state holds the ids of the last ``delay`` of event time. Events that come later than
    that are left out, since nobody could tell if they came before; see ``late_events``.
    """
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    return timed.dropDuplicatesWithinWatermark(list(ids)).drop("_time")


def late_events(arrived: DataFrame, taken: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The arrived events, each once, that no event taken has the ids of: they came too late."""
    return arrived.join(taken.select(*ids), list(ids), "left_anti").dropDuplicates(list(ids))
