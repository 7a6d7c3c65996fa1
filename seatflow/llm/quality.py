"""Quality classification by a byte convolutional network over overlapping chunks.

The filters are learned from labelled texts; each keeps its maximum within a chunk, chunks
overlap and cover the whole document, and their means are combined into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm import byte_cnn
from seatflow.llm.common import label_sample, scored_rows, with_text


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample: documents of a label and in all, chunks of a text."""

    per_label: int = 2500
    documents: int = 5000
    chunks: int = 8
    steps: int = 400


SHAPE = byte_cnn.Shape(window=256, hop=192)
#: Documents scored below this are rejected.
THRESHOLD = 0.3


def train(
    documents: DataFrame, labels: DataFrame, training: Training = Training(), shape: byte_cnn.Shape = SHAPE
) -> byte_cnn.Network | None:
    """A network from ``doc_id, text`` and ``doc_id, quality``; None if no text has a label.

    Learns from a bounded sample, half of it of each label. The prior of the scores is the
    share of the labels over all labelled rows. Null labels teach nothing; a document that is
    labelled more than once counts with each label.
    """
    labelled = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    sample = label_sample(labelled, training.per_label, training.documents)
    windows, bags, found = byte_cnn.training_windows(with_text(documents, sample), shape, training.chunks)
    if not found:
        return None
    count = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    share = np.array([count.get(c, 0) + 1.0 for c in (0, 1)])
    return byte_cnn.fit(
        windows, bags, np.array(found), [0, 1], shape, prior=np.log(share / share.sum()), steps=training.steps
    )


def _chances(network: byte_cnn.Network | None):
    def chance(texts: pa.Array) -> list[pa.Array]:
        logits = byte_cnn.text_logits(network, texts)
        return [pa.array(byte_cnn.softmax(logits)[:, 1] if network else np.full(len(texts), 0.5))]

    return chance


def score(documents: DataFrame, network: byte_cnn.Network | None) -> DataFrame:
    """``doc_id, score``: the chance of label 1, 0 to 1.

    Every row is scored from its whole text alone. Null and empty texts get the share of
    label 1 among the labelled; without a network all scores are 0.5. Repeated ids give
    repeated rows; an empty table gives none.
    """
    found, kept = scored_rows(documents, ["doc_id"], ["double"], _chances(network))
    return found.select(*kept, F.col("n0").alias("score"))


def accepted(documents: DataFrame, network: byte_cnn.Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score ``threshold`` or more."""
    found, kept = scored_rows(documents, documents.columns, ["double"], _chances(network))
    return found.where(F.col("n0") >= threshold).select(*kept)
