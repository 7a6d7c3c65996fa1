"""Text to vector: a built-in hashed term vector, or a model plugged in by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_hashed(
    df: DataFrame, text: str, alias: str = "embedding", width: int = 256
) -> DataFrame:
    """Unit-length hashed term counts; deterministic and without Python per row."""
    words = RegexTokenizer(
        inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True
    )
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    out = df.withColumn(text, F.coalesce(text, F.lit("")))
    out = unit.transform(counts.transform(words.transform(out)))
    return out.withColumn(alias, vector_to_array("_unit")).drop("_words", "_counts", "_unit")


#: What an encoder is asked for: some models treat a question unlike the text it looks for.
QUERY, DOCUMENT = "query", "document"
BATCH = 64

Encoder = Callable[[list[str], str], Sequence[Sequence[float]]]


def embed_with(
    df: DataFrame,
    text: str,
    load: Callable[[], Encoder],
    mode: str = DOCUMENT,
    alias: str = "embedding",
    batch: int = BATCH,
) -> DataFrame:
    """Vectors of a model that the user plugs in.

    ``load`` is called once in each task and gives a function of a list of texts, at most
    ``batch`` of them, and the mode. A null text is encoded as an empty one.
    """
    if mode not in (QUERY, DOCUMENT):
        raise ValueError(f"mode must be {QUERY} or {DOCUMENT}")

    @F.pandas_udf("array<double>")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in columns:
            given = texts.fillna("").tolist()
            found = [
                [float(x) for x in v]
                for at in range(0, len(given), batch)
                for v in encode(given[at : at + batch], mode)
            ]
            yield pd.Series(found, index=texts.index, dtype=object)

    column: Column = run(F.col(text))
    return df.withColumn(alias, column)


def letter_encoder() -> Encoder:
    """A model without training: how often each letter from a to z occurs, in any case."""
    letters = [chr(c) for c in range(97, 123)]

    def encode(texts: list[str], mode: str) -> list[list[float]]:
        return [[float(t.count(c)) for c in letters] for t in map(str.lower, texts)]

    return encode
