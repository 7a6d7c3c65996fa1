"""Markdown documents with front matter."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.functions.cleaning import strip
from seatflow.operators.chunking import OVERLAP, SIZE, chunk
from seatflow.schemas import KNOWLEDGE_CHUNKS
from seatflow.sources.tables import overwrite_table

SKIP = ("document_template.md", "copy")
FRONT_FIELDS = ("topic", "source_url", "policy_year", "canonical_source")


def read_documents(
    spark: SparkSession,
    path: str,
    skip: Sequence[str] = SKIP,
    suffix: str = ".md",
    name: Column | None = None,
) -> DataFrame:
    """``source_file, text``: whole files, without those whose name holds a skip word.

    ``name`` takes a document name out of ``_metadata.file_path``; it is the file
    name unless given.
    """
    name = F.col("_metadata.file_name") if name is None else name
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        .select(name.alias("source_file"), F.col("value").alias("text"))
        .filter(F.col("source_file").endswith(suffix))
    )
    for word in skip:
        files = files.filter(~F.contains(F.lower("source_file"), F.lit(word)))
    return files


def _close(text: Column) -> Column:
    """1-based place of the closing fence, 0 if the text has no front matter."""
    return F.when(text.startswith("---"), F.locate("---", text, 4)).otherwise(F.lit(0))


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines between the fences; an empty value is NULL.

    Of a repeated key the last line counts. A comment behind a value is dropped, and quotes
    around one; inside quotes a number sign is text.
    """
    head = F.when(_close(text) > 0, F.substring(text, F.lit(5), _close(text) - 5))
    lines = F.filter(F.split(head, r"\r?\n"), lambda line: line.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("key"),
            F.nullif(_plain_value(strip(F.regexp_replace(line, r"^[^:]*:", ""))), F.lit("")).alias("value"),
        ),
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.aggregate(
        F.coalesce(pairs, none),
        F.map_from_entries(none),
        lambda found, p: F.map_concat(
            F.map_filter(found, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])
        ),
    )


def _plain_value(value: Column) -> Column:
    quoted = r"""^(["'])(.*?)\1\s*(?:#.*)?$"""
    return F.when(value.rlike(quoted), F.regexp_extract(value, quoted, 2)).otherwise(
        strip(F.regexp_replace(value, r"(?:^|\s)#.*$", ""))
    )


def body(text: Column) -> Column:
    """The text without its front matter."""
    return F.when(
        _close(text) > 0, strip(F.substring(text, _close(text) + 3, F.length(text)))
    ).otherwise(text)


def split_front_matter(df: DataFrame, text: str = "text") -> DataFrame:
    """Front-matter fields as columns and the text replaced by its body."""
    meta = df.withColumn("_meta", front_matter(F.col(text)))
    out = meta.withColumns({f: F.try_element_at("_meta", F.lit(f)) for f in FRONT_FIELDS})
    return out.withColumn(text, body(F.col(text))).drop("_meta")


def build_chunks(
    df: DataFrame,
    domain: str,
    size: int = SIZE,
    overlap: int = OVERLAP,
    headings: bool = True,
) -> DataFrame:
    """Chunk rows of documents; the topic defaults to the file name without its ending.

    Documents with an empty body give no rows.
    """
    docs = split_front_matter(df).withColumn(
        "topic",
        F.coalesce("topic", F.regexp_replace("source_file", r"\.[^.]*$", "")),
    )
    chunks = chunk(docs, "text", "source_file", size, overlap, headings)
    return chunks.select(
        F.col("chunk_id").alias("doc_id"),
        F.lit(domain).alias("domain"),
        "topic",
        "source_file",
        "source_url",
        F.col("policy_year").try_cast("int").alias("policy_year"),
        "canonical_source",
        "chunk_index",
        "content",
    )


def build_chunk_table(
    domains: Mapping[str, DataFrame],
    encode: Callable[[DataFrame], DataFrame],
    path: str,
    size: int = SIZE,
    overlap: int = OVERLAP,
    headings: bool = True,
) -> DataFrame:
    """Split, embed and store the documents of each domain; the table at ``path`` is replaced.

    ``encode`` adds the column ``embedding`` to a frame with the column ``content``. Returns
    the stored table in the layout of ``KNOWLEDGE_CHUNKS``; each document is split once.
    """
    parts = [build_chunks(df, domain, size, overlap, headings) for domain, df in domains.items()]
    chunks = encode(reduce(DataFrame.unionByName, parts))
    overwrite_table(chunks.select(*KNOWLEDGE_CHUNKS.fieldNames()), path)
    return chunks.sparkSession.read.schema(KNOWLEDGE_CHUNKS).parquet(path)
