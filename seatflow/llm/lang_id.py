"""Language identification by a byte convolutional network (see ``byte_cnn``).

It is trained in numpy on labelled texts and applied, inside Spark's tasks, to batches of
fixed-length windows that cover each text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm import byte_cnn
from seatflow.llm.common import label_sample, scored_rows, with_text

UNDETERMINED = "und"


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample: documents of a language and in all, windows of a text."""

    per_language: int = 1000
    documents: int = 50_000
    windows: int = 4
    steps: int = 500


SHAPE = byte_cnn.Shape()


def train(documents: DataFrame, training: Training = Training(), shape: byte_cnn.Shape = SHAPE) -> byte_cnn.Network | None:
    """A network from ``doc_id, text, lang``; None if no row has a text and a language.

    Learns from a bounded sample (see ``Training``), the same number of documents of each
    language, so that no language is favoured by its share. Null languages teach nothing.
    """
    labelled = documents.select("doc_id", "text", F.col("lang").alias("label"))
    sample = label_sample(labelled, training.per_language, training.documents)
    windows, bags, labels = byte_cnn.training_windows(with_text(documents, sample), shape, training.windows)
    if not labels:
        return None
    classes = sorted(set(labels))
    index = np.array([classes.index(x) for x in labels])[bags]
    return byte_cnn.fit(
        windows, np.arange(len(windows)), index, classes, shape, prior=np.zeros(len(classes)), steps=training.steps
    )


def identify(documents: DataFrame, network: byte_cnn.Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone.

    The score is the probability of the language, 0 to 1. Texts that are null, empty or hold
    no letter are ``und`` with score 0, as is everything without a network; ties go to the
    first language by name. Rows are judged one by one, so repeated ids give repeated rows;
    an empty table gives none. Other columns are not looked at.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    classes = network.classes if network else [UNDETERMINED]

    def best(texts: pa.Array) -> list[pa.Array]:
        chance = byte_cnn.softmax(byte_cnn.text_logits(network, texts))
        top = chance.argmax(axis=1)
        return [pa.array([classes[i] for i in top], pa.string()), pa.array(chance[np.arange(len(top)), top])]

    rows = documents.select("doc_id", letter.alias("letter"), "text")
    found, kept = scored_rows(rows, ["doc_id", "letter"], ["string", "double"], best)
    found = found.select(*kept, "n0", "n1")
    known = F.col("letter") & F.lit(network is not None)
    return found.select(
        "doc_id",
        F.when(known, F.col("n0")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, F.col("n1")).otherwise(0.0).alias("score"),
    )
