"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

A source's target is its share of all words; no source is read more than ``max_epochs``
times, and what that cuts off is shared anew, by weight, among the others. A source is then
taken in whole repetitions, and the rest of its target by the documents that come first in
a seeded order, up to a cut key found from a histogram of that order: the decision for a row
needs only the few figures of its source, and a hot source is never sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatflow.llm.common import WORD, stored

#: Hex digits of the key that name a bucket of the histogram: at most 65,536 for a source.
BUCKET_DIGITS = 4
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    marks = F.translate(F.regexp_replace(text, WORD + "+", "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    """Place of a document in the seeded order; rows that share an id share a place."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("/" + seed)))


def weigh(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``weight`` by the rank of the source, by code point, null last, over repeating weights.

    The rank is taken part by part of a range partitioning, so it needs no single task.
    """
    last = F.col("source").isNull()
    parts = sources.repartitionByRange(last, F.col("source")).withColumn("part", F.spark_partition_id())
    parts = stored(parts, "mix-sources")
    inside = W.partitionBy("part").orderBy(last, "source")
    before = parts.groupBy("part").count()
    before = before.withColumn(
        "before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("count")
    ranked = parts.withColumn("inside", F.row_number().over(inside)).join(before, "part")
    rank = F.col("before") + F.col("inside") - 1
    values = F.array(*[F.lit(int(w)) for w in weights])
    return ranked.select(
        "source", "source_size", F.get(values, F.pmod(rank, F.lit(len(weights))).cast("int")).cast("long").alias("weight")
    )


def fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """``target`` per source by capped water-filling.

    The level is what one unit of weight gets. Each round clamps the sources whose cap lies
    below their share and raises the level for the rest; it ends when nothing more clamps.
    A round brings back three sums, all of them exact integers.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = (cap < F.col("weight") * F.lit(level)) if clamped >= 0 else F.lit(False)
        n, spent, weight = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == clamped or not weight:
            break
        level, clamped = (total - (spent or 0)) / weight, n
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.least(share, cap.cast("double")))


def mixing_plan(
    documents: DataFrame, max_epochs: int = 3, weights: Sequence[int] = (1, 2, 3), seed: str = SEED
) -> tuple[DataFrame, DataFrame]:
    """(sizes of all documents, one row of figures per source), both stored.

    The second holds source, source_size, target, ``whole`` repetitions, and the bucket and
    the key up to which one more repetition is taken.
    """
    sized = stored(
        documents.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("key")
        ),
        "mix-sizes",
    )
    bucket = F.substring("key", 1, BUCKET_DIGITS).alias("bucket")
    hist = stored(sized.groupBy("source", bucket).agg(F.sum("size").alias("size")), "mix-buckets")
    sources = hist.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = fill(stored(weigh(sources, weights), "mix-weights"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long"))
    targets = targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # The bucket in which the running size passes what is still needed.
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    running = hist.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    at = (
        running.join(targets, same(running, targets))
        .where(F.col("before") <= F.col("need"))
        .groupBy(running["source"])
        .agg(F.max(F.struct("bucket", "before", "need")).alias("at"))
        .select("source", "at.*")
    )
    at = stored(at, "mix-edges")
    # Inside that bucket, document by document; rows that share a key go together.
    edge = sized.withColumn("bucket", bucket)
    edge = (
        edge.join(at, same(edge, at) & (edge["bucket"] == at["bucket"]))
        .groupBy(edge["source"], "key", "before", "need")
        .agg(F.sum("size").alias("size"))
    )
    run = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    passed = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    cuts = (
        edge.withColumn("passed", passed)
        .where(2 * F.col("passed") + F.col("size") <= 2 * F.col("need"))
        .groupBy("source")
        .agg(F.max("key").alias("cut"))
    )
    plan = targets.join(at.drop("before", "need"), same(targets, at), "left").select(
        targets["source"], "source_size", "target", "whole", "bucket"
    )
    plan = plan.join(cuts, same(plan, cuts), "left").select(
        plan["source"], "source_size", "target", "whole", "bucket", "cut"
    )
    return sized, stored(plan, "mix-plan")


def _repeats(key: Column, plan: Column) -> Column:
    more = (F.substring(key, 1, BUCKET_DIGITS) < plan["bucket"]) | (key <= plan["cut"])
    return plan["whole"] + F.coalesce(more, F.lit(False)).cast("long")


def mix_sizes(documents: DataFrame, max_epochs: int = 3, weights: Sequence[int] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, repeats, taken (words).

    The size is the number of words; null and empty texts have none and add nothing. Sources
    are ranked by code point, null last, and get the weights in turn. Rows are judged one by
    one: repeated rows count each time and share their fate, as do rows without an id. A very
    long text counts with all its words and is taken whole or not at all, so its source may miss
    its target by as much. An empty table gives no rows. Other columns are not looked at.
    """
    sized, plan = mixing_plan(documents, max_epochs, weights, seed)
    plan = plan.select(F.struct("*").alias("figures"))
    figures = plan["figures"]
    repeats = _repeats(sized["key"], figures)
    return sized.join(plan, sized["source"].eqNullSafe(figures["source"])).select(
        "doc_id",
        sized["source"],
        "size",
        figures["source_size"].alias("source_size"),
        figures["target"].alias("target"),
        repeats.alias("repeats"),
        (repeats * F.col("size")).alias("taken"),
    )


def mix(documents: DataFrame, max_epochs: int = 3, weights: Sequence[int] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row as often as ``mix_sizes`` says, all its columns kept."""
    _, plan = mixing_plan(documents, max_epochs, weights, seed)
    plan = plan.select(F.struct("*").alias("figures"))
    figures = plan["figures"]
    repeats = _repeats(order_key(documents["doc_id"], seed), figures)
    copies = F.when(repeats > 0, F.sequence(F.lit(1).cast("long"), repeats))
    return (
        documents.join(plan, documents["source"].eqNullSafe(figures["source"]))
        .select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), F.explode(copies).alias("copy"))
        .select("row.*")
    )
