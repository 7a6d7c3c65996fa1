"""Similarity self-join on shingle sets by T-occurrence search over inverted lists.

Two sets whose Jaccard similarity reaches the threshold have T shingles in common, T following
from their sizes. Texts with equal sets are one. The shingles are hashes, so the first of a
set in their order are a random part of it: with a prefix long enough two similar sets are
sure to have at least so many shingles of their prefixes in common as a known share of their
sizes. A set with fewer shared ones is similar to none and goes no further; the others leave
out their most frequent shared shingles, all but one of those they must have in common, and
still meet in the rarest. So a passage that many texts hold brings them together only where it
is most of a text. Texts that meet hang together and are searched together, as far as a task
can.

In a unit the texts are indexed by inverted lists. For a text the long lists of its shingles
are put aside, the short ones are merged, counting how often each other text occurs; those
that occur often enough are probed in the long lists (DivideSkip); those that reach the
overlap are linked. Pairs known to be connected are skipped, and a unit gives only the edges
of a spanning forest, never all pairs. A unit too big for one task is split into parts that
meet two at a time, so nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatflow.llm.common import scored_rows, stored, text_bytes
from seatflow.llm.components import component_roots
from seatflow.llm.shingles import WIDTH, mix, shingle_sets

#: Least similarity, in percent.
PERCENT = 90
#: Shingles that the prefixes of similar sets share at least, in percent of the smaller size.
PREFIX_PERCENT = 10
#: Ids that are sent to all tasks at most, some 32 MB; beyond that a join shuffles both sides.
SENT_IDS = 1 << 21
#: Shingles of a part of a unit, about: 8 MB.
BLOCK_SHINGLES = 1 << 20
#: Weight of the long lists' length in DivideSkip's choice of how many to put aside.
MU = 0.0085

KEYS = ["a", "b"]
_A, _B = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x8CB92BA72F3D8DD7)


def overlap(nx, ny, percent: int = PERCENT):
    """Least common shingles of sets of these sizes whose similarity reaches the threshold."""
    return -(-percent * (nx + ny) // (100 + percent))


def _set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a, b = mix(found ^ _A).sum(dtype=np.uint64), mix(found ^ _B).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def smallest_partner(n, percent: int):
    """Least size of a set that is similar to one of n; also the least overlap with any."""
    return -(-percent * n // 100)


def shared_of(n):
    """Shingles that the prefixes share, for sets of n at least."""
    return 1 + PREFIX_PERCENT * n // 100


def prefix_of(found: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a sorted set.

    A set of n lacks at most d = n - smallest_partner(n) of its shingles in a similar set. So
    the first k shingles common to both are among its first d + k, and a prefix of
    d + shared_of(n) has at least shared_of(m) of them, m being the smaller of the two sizes.
    """
    n = len(found)
    return found[: n - smallest_partner(n, percent) + shared_of(n)]


def _keyed(width: int, percent: int):
    """Size, key and prefix of the set of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            lists = [np.zeros(0, np.uint64)] * batch.num_rows
            for text, found in shingle_sets(*text_bytes(batch.column(1)), width):
                n[text] = len(found)
                a[text], b[text] = _set_key(found)
                lists[text] = prefix_of(found, percent)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            hashes = np.concatenate([np.zeros(0, np.uint64), *lists]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (n, a, b)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes))],
                ["doc_id", "n", "a", "b", "prefix"],
            )

    return run


def _by_ids(df: DataFrame, ids: DataFrame, on, how: str) -> DataFrame:
    """Join with a stored table of ids, which is sent to all tasks if its size allows it."""
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, on, how)


def _sets(width: int):
    """Whole sets, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sets = [], [], []
            for _, found in shingle_sets(*text_bytes(batch.column(0)), width):
                key = _set_key(found)
                a.append(key[0])
                b.append(key[1])
                sets.append(found.tobytes())
                if len(sets) >= 512:
                    yield _set_batch(a, b, sets)
                    a, b, sets = [], [], []
            yield _set_batch(a, b, sets)

    return run


def _set_batch(a: list[int], b: list[int], sets: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sets, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "shingles"])


class Index:
    """Inverted lists of the texts of a unit, numbered by size."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        texts = np.repeat(np.arange(len(sets)), self.sizes)
        _, lists = np.unique(np.concatenate(sets), return_inverse=True)
        self.count = np.bincount(lists)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.texts = texts[np.argsort(lists, kind="stable")]
        ends = np.cumsum(self.sizes)
        self.lists = [lists[e - n : e] for e, n in zip(ends, self.sizes, strict=True)]
        # Long lists are kept as rows of bits too: there a probe is one look.
        dense = np.flatnonzero((self.count >= 3) & (8 * self.count >= len(sets)))
        self.row = np.full(len(self.count), -1, np.int64)
        self.row[dense] = np.arange(len(dense))
        self.bits = np.zeros((len(dense), len(sets)), bool)
        for i, x in enumerate(dense):
            self.bits[i, self.texts[self.first[x] : self.first[x + 1]]] = True

    def partners(self, x: int, candidates: np.ndarray, percent: int) -> np.ndarray:
        """Those of the candidates (a mask over texts) that are similar enough to text x.

        DivideSkip: candidates must occur in T lists; they occur in at most L of the L longest,
        so in T - L of the others, which are merged by counting.
        """
        lists = self.lists[x][self.count[self.lists[x]] >= 2]
        nx, others = self.sizes[x], np.flatnonzero(candidates)
        if not len(others):
            return others
        least = int(overlap(nx, self.sizes[others].min(), percent))
        if len(lists) < least:
            return others[:0]
        lists = lists[np.argsort(self.count[lists], kind="stable")]
        aside = min(int(least / (MU * np.log2(self.count[lists[-1]] + 1) + 1)), least - 1)
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        seen = np.zeros(len(self.sizes), np.int64)
        merged = np.concatenate([self.texts[self.first[i] : self.first[i + 1]] for i in short])
        seen += np.bincount(merged, minlength=len(seen))
        others = others[seen[others] >= least - aside]
        if not len(others):
            return others
        common = seen[others]
        rows = self.row[long]
        common += self.bits[rows[rows >= 0]][:, others].sum(axis=0)
        for i in long[rows < 0]:
            probe = self.texts[self.first[i] : self.first[i + 1]]
            at = np.searchsorted(probe, others)
            common += (at < len(probe)) & (probe[np.minimum(at, len(probe) - 1)] == others)
        return others[common >= overlap(nx, self.sizes[others], percent)]


def forest(sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the similar pairs of a unit connect; ``sets`` come by size.

    With ``sides``, two blocks meet and only pairs of different sides are of interest, as the
    others are found where a block meets itself.
    """
    index = Index(sets)
    sizes, n = index.sizes, len(sets)
    root = np.arange(n)
    edges = []
    for x in range(n):
        # A partner of x is at least as big, and no bigger than the threshold lets it be.
        last = int(np.searchsorted(sizes, 100 * sizes[x] // percent, "right"))
        mask = np.zeros(n, bool)
        mask[x + 1 : last] = root[x + 1 : last] != root[x]
        if sides is not None:
            mask &= sides != sides[x]
        for y in index.partners(x, mask, percent):
            if root[x] != root[y]:
                edges.append((x, int(y)))
                low, high = sorted((root[x], root[y]))
                root[root == high] = low
    return edges


def _search(percent: int):
    """Units, whose members come one after the other, to edges."""

    def edges_of(unit: list[tuple]) -> list[tuple[int, int]]:
        sides = np.array([x[1] for x in unit])
        sets = [np.frombuffer(x[2], np.uint64) for x in unit]
        found = forest(sets, sides if sides.min() != sides.max() else None, percent)
        return [(unit[x][0], unit[y][0]) for x, y in found]

    def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            edges = []
            unit, left, right, node, side = (batch.column(i).to_numpy() for i in range(5))
            shingles = batch.column(5)
            for i in range(batch.num_rows):
                here = (unit[i], left[i], right[i])
                if here != at:
                    if len(held) > 1:
                        edges += edges_of(held)
                    held, at = [], here
                held.append((int(node[i]), int(side[i]), shingles[i].as_py()))
            yield batch_of(edges)
        if len(held) > 1:
            yield batch_of(edges_of(held))

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """What a task has to search at a time: unit, left, right, block, n and key of each member.

    Units that hang together by their members are searched as one, so that a set is sent once.
    If the whole is too big for a task, its members are dealt to parts, and each is sent to all
    pairs of parts that its own part is one of. Where that would send more than each unit by
    itself (of equal units only one, and in parts if need be), the units stay as they are.
    """
    first = members.groupBy("unit").agg(F.min("node").alias("v"))
    edges = members.join(first, "unit").select(F.col("node").alias("u"), "v").where("u <> v").distinct()
    roots = component_roots(edges).withColumnRenamed("root", "whole")
    members = members.join(roots, "node", "left").withColumn("whole", F.coalesce("whole", "node"))
    members = stored(members.select("whole", "unit", "node", "n"), "join-linked")
    parts = F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int")
    sets = members.select("whole", "node", "n").distinct()
    sizes = sets.groupBy("whole").agg(F.sum("n").alias("shingles"))
    sizes = stored(sizes.select("whole", "shingles", parts.alias("parts")), "join-wholes")
    big = members.join(sizes.where("parts > 1").select("whole"), "whole")
    units = big.groupBy("whole", "unit").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("nodes"), F.sum("n").alias("shingles")
    )
    units = units.where("size > 1").groupBy("whole", "size", "nodes", "shingles").agg(F.min("unit").alias("unit"))
    units = stored(units.select("whole", "unit", "shingles", parts.alias("parts")), "join-single")
    apart = units.groupBy("whole").agg(F.sum(F.col("shingles") * F.col("parts")).alias("sent"))
    sizes = sizes.join(apart, "whole", "left").withColumn(
        "together", (F.col("parts") == 1) | (F.col("shingles") * F.col("parts") <= F.col("sent"))
    )
    whole = sets.join(sizes.where("together").select("whole", "parts"), "whole").select(
        F.xxhash64("whole").alias("unit"), "parts", "n", "node"
    )
    left = units.join(sizes.where("not together").select("whole"), "whole").select("unit", "parts")
    single = big.select("unit", "n", "node").join(left, "unit").select("unit", "parts", "n", "node")
    dealt = whole.unionByName(single).withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(
        "unit", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        "block", "n", "node",
    )


def _keys(width: int):
    """Both halves of the set's key of every text."""

    def of_texts(column: pa.Array) -> list[pa.Array]:
        a, b = (np.zeros(len(column), np.int64) for _ in range(2))
        for text, found in shingle_sets(*text_bytes(column), width):
            a[text], b[text] = _set_key(found)
        return [pa.array(a), pa.array(b)]

    return of_texts


def join_groups(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Per row of ``doc_id, text``: doc_id, n_shingles, component_id.

    Two documents are linked when the Jaccard similarity of their shingle sets reaches
    ``percent``; ``component_id`` is the smallest id that can be reached over links, its own
    included. Null and empty texts, and texts of white space, have no shingles and are linked
    with nothing. Repeated rows have equal sets, so they are linked and each is returned; null
    ids are returned and never the smallest. An empty table gives no rows; other columns are
    not looked at. Very long texts are taken whole: a set is held by a task as eight bytes a
    shingle.
    """
    return _joined(documents, percent, width).select("doc_id", "n_shingles", "component_id")


def _joined(documents: DataFrame, percent: int, width: int) -> DataFrame:
    """The same, and the key of the row's set."""
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(_keyed(width, percent), f"doc_id {kind}, n long, a long, b long, prefix array<long>")
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "join-keys")
    # Equal sets count once, however many copies there are; one of their rows stands for them.
    sets = rows.where("n > 0").groupBy(*KEYS).agg(F.min("node").alias("node"), F.min("doc_id").alias("least"))
    sets = stored(sets, "join-sets")

    # Shingles of prefixes that different sets share. Counts are gathered before the shuffle,
    # and the join back can be split where a shingle is frequent.
    first = _by_ids(rows.select("node", "n", "prefix"), sets.select("node"), "node", "left_semi")
    prefixes = first.select("node", "n", F.explode("prefix").alias("unit"))
    counts = prefixes.groupBy("unit").agg(F.count("*").alias("times")).where("times > 1")
    shared = prefixes.join(counts, "unit")
    own = W.partitionBy("node")
    must = F.lit(1) + F.floor(PREFIX_PERCENT * F.ceil(F.col("n") * percent / 100) / 100)
    place = F.row_number().over(own.orderBy(F.desc("times"), F.desc("unit")))
    members = shared.select("node", "n", "unit", F.count("*").over(own).alias("held"), place.alias("place"))
    members = members.where((F.col("held") >= must) & (F.col("place") >= must)).select("unit", "n", "node")
    dealt = stored(_dealt(stored(members, "join-members")), "join-dealt")

    # Whole sets of the members only, found by the ids of their documents.
    wanted = stored(dealt.select("node").distinct().join(sets, "node"), "join-wanted")
    ids = stored(wanted.select(F.col("least").alias("id")).distinct(), "join-ids")
    whole = _by_ids(docs, ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    whole = stored(whole.mapInArrow(_sets(width), "a long, b long, shingles binary"), "join-whole").dropDuplicates(KEYS)
    ready = dealt.join(wanted.select("node", *KEYS), "node").join(whole, KEYS)
    ready = ready.select("unit", "left", "right", "node", "block", "shingles", "n")
    ready = ready.repartition("unit", "left", "right").sortWithinPartitions("unit", "left", "right", "n", "node")
    edges = ready.drop("n").mapInArrow(_search(percent), "u long, v long")
    roots = component_roots(edges)

    # The smallest id of each component, and from there to the rows.
    least = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(names, "root").select(*KEYS, "component_id")
    found = rows.select("doc_id", "n", *KEYS).join(named, KEYS, "left")
    return found.select(
        *KEYS,
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def first_of_groups(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The documents, with all their columns, that are the smallest id of their group.

    Rows that repeat both id and text are one document. Documents without words stay, and of
    a group that has no ids at all every text stays once.
    """
    groups = stored(_joined(documents, percent, width), "join-groups")
    names = documents.columns
    row = F.struct(*[documents[c] for c in names]).alias("row")
    docs = documents.where(F.col("doc_id").isNotNull()).select(row, "doc_id", "text")
    own = F.max(F.col("doc_id") == F.col("component_id")).alias("first")
    by_id = groups.where("doc_id is not null").groupBy("doc_id").agg(own, F.count("*").alias("rows"))
    by_id = stored(by_id, "join-by-id")
    kept = _by_ids(docs, by_id.where("not first").select("doc_id"), "doc_id", "left_anti")
    # Only ids that are there more than once can repeat a text; the other texts stay in place.
    often = by_id.where("rows > 1").select("doc_id")
    single = _by_ids(kept, often, "doc_id", "left_anti").select("row")
    repeated = _by_ids(kept, often, "doc_id", "left_semi").select("row", "doc_id", "text")
    # Without ids, a text stays if its group has none either.
    taken = groups.where("doc_id is null and component_id is not null").select(*KEYS).distinct()
    nulls, columns = scored_rows(documents.where(F.col("doc_id").isNull()), names, ["long", "long"], _keys(width))
    nulls = nulls.select(F.struct(*columns).alias("row"), F.col("n0").alias("a"), F.col("n1").alias("b"))
    nulls = nulls.join(taken, KEYS, "left_anti").select("row", "row.doc_id", "row.text")
    sortable = [f.name for f in documents.schema.fields if not re.search("map|variant", f.dataType.simpleString())]
    order = [F.col("row").getField(c) for c in sortable]
    same = W.partitionBy("doc_id", F.coalesce("text", F.lit(""))).orderBy(*order)
    repeated = repeated.unionByName(nulls).withColumn("place", F.row_number().over(same)).where("place = 1")
    return single.unionByName(repeated.select("row")).select(*[F.col("row").getField(c).alias(c) for c in names])
