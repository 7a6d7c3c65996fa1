"""Documents to overlapping chunks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions.cleaning import strip

SIZE = 4000
OVERLAP = 600

# Where a text may be cut, best place first: headings, paragraphs, lines, words.
# Lookarounds keep the separator with the text that follows it.
BREAKS = [re.compile(p) for p in (r"(?<=\n)(?=#{1,6} )", r"(?=\n\n)", r"(?=\n)", r"(?= )")]


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of windows of ``size`` characters, each ``overlap`` into the one before."""
    _check(size, overlap)
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1)) - 1
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda i: F.substring(text, i * step + 1, F.lit(size)),
    )


def _pieces(text: str, size: int, level: int = 0) -> Iterator[int]:
    """Lengths of pieces no longer than ``size``, cut at the best break that makes them fit."""
    if len(text) <= size:
        yield len(text)
    elif level == len(BREAKS):
        yield from (min(size, len(text) - at) for at in range(0, len(text), size))
    else:
        for part in BREAKS[level].split(text):
            yield from _pieces(part, size, level + 1)


def pack(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text, in time that grows with its length.

    Pieces lie end to end in the text, so packing works on their lengths alone. ``near`` holds
    the starts of the pieces that end a chunk, as far as they fit into ``overlap``.
    """
    spans: list[tuple[int, int]] = []
    near: deque[int] = deque()
    first = last = 0
    for length in _pieces(text, size):
        if last + length - first > size and last > first:
            spans.append((first, last))
            room = min(overlap, size - length)
            while near and near[0] < last - room:
                near.popleft()
            first = near[0] if near else last
        near.append(last)
        last += length
        while near and near[0] < last - overlap:
            near.popleft()
    spans.append((first, last))
    return spans


def heading_spans(text: Column, size: int, overlap: int) -> Column:
    """Array of (a, b): where the chunks of a text start and end.

    Chunks are cut at headings, paragraphs, lines or words. Pieces are packed until ``size``
    is reached; a new chunk starts with the last whole pieces of the one before, as far as
    they fit into ``overlap``. Each text is read once, in batches of texts.
    """
    _check(size, overlap)

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else [{"a": a, "b": b} for a, b in pack(t, size, overlap)] for t in texts],
            index=texts.index, dtype=object,
        )

    return run(text)


def heading_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of the chunks between ``heading_spans``, stripped; those of white space are left out."""
    spans = heading_spans(text, size, overlap)
    chunks = F.transform(spans, lambda c: strip(F.substring(text, c["a"] + 1, c["b"] - c["a"])))
    return F.filter(chunks, lambda c: c != "")


def chunk(
    df: DataFrame,
    text: str,
    id_col: str,
    size: int = SIZE,
    overlap: int = OVERLAP,
    headings: bool = False,
) -> DataFrame:
    """One row per chunk of every non-empty text.

    ``chunk_id`` hashes document, place and content, so a re-run gives the same
    ids. Nothing is shuffled. The outer explode keeps Spark from computing the
    windows a second time in a filter of its own.
    """
    windows = heading_windows if headings else fixed_windows
    return (
        df.select(
            *[c for c in df.columns if c != text],
            F.posexplode_outer(windows(F.col(text), size, overlap)).alias(
                "chunk_index", "content"
            ),
        )
        .filter(F.col("content") != "")
        .withColumn(
            "chunk_id",
            F.md5(
                F.concat_ws(
                    "-", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"), "content"
                )
            ),
        )
    )
