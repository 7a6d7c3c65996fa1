"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatflow.session import fresh_path

#: A word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Labels whose counts are sent to all tasks at most.
SENT_LABELS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again.

    Cuts lineage: later steps, and retries after a lost executor, start from the files.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(by))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def label_sample(labelled: DataFrame, per_label: int, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``doc_id, label``, the first ``per_label`` of each label in a
    hashed order of the ids. Each label gets its first row before any gets its second. Rows
    without an id or a label are left out.

    Only ids whose hash lies in a first part of the range are ranked. The part is so large that
    the rows wanted lie in it (more of them by six times the spread of their number), so a
    frequent label is not shuffled or ranked whole: the labels' counts, a row each, are sent to
    all tasks, and each task leaves out the other ids as it reads them.
    """
    key = F.md5(F.col("doc_id").cast("string"))
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known.select("doc_id", "label", key.alias("key"))
    wanted = float(per_label + 6 * per_label**0.5 + 50)
    part = known.groupBy("label").agg((F.lit(wanted) / F.count("*")).alias("part"))
    part = stored(part, "label-parts")
    part = F.broadcast(part) if part.count() <= SENT_LABELS else part
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32
    order = W.partitionBy("label").orderBy("key", "doc_id")
    return (
        known.join(part, "label")
        .where(place < F.col("part"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_label)
        .select("doc_id", "label", "key", "place")
        .orderBy("place", "key", "label")
        .limit(rows)
    )


def with_text(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """``text, label, key`` of the sampled documents. The sample is broadcast: its rows are bounded."""
    texts = documents.select("doc_id", "text")
    return texts.join(F.broadcast(sample), "doc_id").select("text", "label", "key")


def scored_rows(
    documents: DataFrame, keep: Sequence[str], new: Sequence[str], of_texts: Callable
) -> tuple[DataFrame, list[Column]]:
    """Columns made from the text alone, beside the columns named in ``keep``.

    ``of_texts`` turns an Arrow batch of texts into one array per type in ``new``. The frame
    has names of its own, ``c0``... for the kept columns and ``n0``... for the new ones, so that
    no name of the documents can clash; the second value gives the kept ones their names back.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    at = columns.index("text")
    kinds = [documents.schema[c].dataType.simpleString() for c in keep]
    rows = documents.select(*[documents[c].alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(keep))] + [f"n{i}" for i in range(len(new))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, [*kinds, *new], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = of_texts(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names)

    return rows.mapInArrow(run, schema), [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
