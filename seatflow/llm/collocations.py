"""Phrase collocations from an FM-index per shard over word numbers.

A shard is some millions of words: the pieces of its texts one after the other, each closed by
an end mark. Its index is the Burrows-Wheeler transform of that sequence. A phrase of d words
is an interval of rows, those whose suffixes start with it. From the intervals of depth d come
those of depth d + 1, all at once and in both directions: a row's own interval of depth d is
extended to the right by one word, and that of the row its suffix goes on in (a step of the
index) is extended to the left. No phrase reaches over an end mark.

Counts of a phrase are summed across the shards that hold it. First come the words, then all
pairs (to leave out those of rare words saves the less the larger the corpus is), and then
only what is frequent in the whole corpus is extended: triples and fours, in one go, whose
pairs are all frequent. A phrase is named by the least place (shard and interval) where it
stands, so no numbering is needed and nothing but rows of shards and phrases is shuffled: a
frequent word gives one row a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatflow.llm.common import stored, text_bytes
from seatflow.llm.suffixes import byte_set, numbered, runs, suffix_order

PIECE_END = byte_set(b".,;:!?\x0a\x0b\x0c\x0d")
OUTSIDE = PIECE_END | byte_set(b"\x20\x09")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Language of texts that have none.
UNKNOWN = "und"
#: A phrase of fewer occurrences is no candidate.
LEAST = 30
#: A candidate is dropped if a longer one has at least this share of its occurrences, in percent.
INSIDE_PERCENT = 80
#: Phrases reported of a language.
TOP = 2000
#: Words of a shard, about; a longer text is a shard of its own.
SHARD_WORDS = 3 << 19
#: Bytes of texts that are split at a time, and symbols of a row of a stored index.
SLICE_BYTES = 1 << 21
ROW_SYMBOLS = 1 << 16
#: Shards of a task at most; with the number of the task they name a shard in 31 bits.
TASK_SHARDS = 1 << 12
#: Parts of a language that are cut to TOP before they meet.
PARTS = 64

_ROWS = "shard long, part int, bwt binary, place long, lang string, word string, n long"
_NAMES = ["shard", "part", "bwt", "place", "lang", "word", "n"]


class Index:
    """Rows of an FM-index: first symbols, and the row in which a row's suffix goes on."""

    def __init__(self, bwt: np.ndarray) -> None:
        self.first = np.repeat(np.arange(int(bwt.max()) + 1, dtype=np.int32), np.bincount(bwt))
        self.next = np.argsort(bwt, kind="stable").astype(np.int32)

    def extended(self, intervals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals one word deeper: number of each row's, and the row each starts at."""
        tail = intervals[self.next]
        new = np.ones(len(tail), bool)
        new[1:] = (self.first[1:] != self.first[:-1]) | (tail[1:] != tail[:-1])
        return np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new)


def transform(symbols: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of a sequence whose end marks are 0; each mark is a symbol of
    its own in the order of suffixes, so comparisons end there."""
    keys = symbols.astype(np.int64)
    ends = np.flatnonzero(symbols == 0)
    keys[ends] = np.arange(len(ends)) - len(ends)
    order, _ = suffix_order(keys)
    return symbols[order - 1]


def _packed(symbols: np.ndarray) -> bytes:
    """First bytes, then second bytes and so on, compressed: the high ones are mostly 0."""
    planes = symbols.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


class _Shard:
    """Words of texts that are gathered for one index."""

    def __init__(self) -> None:
        self.n = 0
        self.data: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.last: list[np.ndarray] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        begin, end = runs(data, offsets, OUTSIDE)
        if not len(begin):
            return
        text = np.searchsorted(offsets, begin, "right") - 1
        marks = np.concatenate([[0], np.cumsum(PIECE_END[data])])
        last = np.ones(len(begin), bool)
        last[:-1] = (marks[begin[1:]] != marks[end[:-1]]) | (text[1:] != text[:-1])
        self.n += len(begin)
        self.data.append(LOWER[data[~OUTSIDE[data]]])
        self.sizes.append(end - begin)
        self.langs.append(langs[text])
        self.last.append(last)

    def rows(self, shard: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The index in parts, and the words of the shard with their symbols and counts."""
        ids, words = numbered(np.concatenate(self.data), np.concatenate(self.sizes))
        self.data, self.sizes = [], []
        pairs = np.concatenate(self.langs) * len(words) + ids
        found, symbols, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        # Frequent words get small symbols, which take few bytes in a stored index.
        order = np.argsort(-counts, kind="stable")
        found, counts = found[order], counts[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        last = np.concatenate(self.last)
        sequence = np.zeros(self.n + int(last.sum()), np.int32)
        sequence[np.arange(self.n) + np.cumsum(last) - last] = place[symbols]
        del ids, pairs, symbols, last
        bwt = transform(sequence)
        parts = [_packed(bwt[i : i + ROW_SYMBOLS]) for i in range(0, len(bwt), ROW_SYMBOLS)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard)), pa.array(np.arange(n, dtype=np.int32)), pa.array(parts, pa.binary()),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
            ], _NAMES,
        )
        n = len(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                pa.array((shard << 32) + np.arange(1, n + 1)),
                pa.array(names, pa.string()).take(pa.array(found // len(words))),
                words.take(pa.array(found % len(words))).cast(pa.large_string()).cast(pa.string()),
                pa.array(counts),
            ], _NAMES,
        )


def _shards(words: int):
    """Batches of lang and text to the rows of the shards that a task makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, names = TaskContext.get().partitionId(), 0, {}
        shard = _Shard()

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal shard, made
            if made == TASK_SHARDS:
                raise ValueError("too many shards in a task: read the documents in smaller splits")
            if shard.n:
                yield from shard.rows(task * TASK_SHARDS + made, list(names))
                made, shard = made + 1, _Shard()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes = np.array([names.setdefault(x, len(names)) for x in langs.dictionary.to_pylist()], np.int64)
            codes = codes[langs.indices.to_numpy()]
            data, offsets = text_bytes(batch.column(1))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
                here = offsets[at : upto + 1]
                shard.add(data[here[0] : here[-1]], here - here[0], codes[at:upto])
                at = upto
                if shard.n >= words:
                    yield from closed()
        yield from closed()

    return run


def _index(rows: pa.Table) -> Index:
    rows = rows.sort_by("part")
    return Index(np.concatenate([_unpacked(x.as_py()) for x in rows["bwt"]]))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of words of a shard: names of the words, place and count."""
    if not len(left) or not len(right):
        return pa.table({c: pa.array([], pa.int64()) for c in ("w1", "w2", "place", "n")})
    index, shard = _index(left), left["shard"][0].as_py()
    name = np.full(index.first[-1] + 1, -1, np.int64)
    name[_column(right, "place") & 0xFFFFFFFF] = _column(right, "id")
    one, two = name[index.first], name[index.first[index.next]]
    _, starts = index.extended(index.first)
    sizes = np.diff(np.append(starts, len(one)))
    kept = np.flatnonzero((one[starts] >= 0) & (two[starts] >= 0))
    rows = starts[kept]
    columns = [one[rows], two[rows], (shard << 32) + kept, sizes[kept]]
    return pa.table([pa.array(x) for x in columns], ["w1", "w2", "place", "n"])


def _longer(left: pa.Table, right: pa.Table) -> pa.Table:
    """Triples and fours of a shard whose pairs are all frequent: names of the pairs (the
    third is null in a triple) and count."""
    names = ["b1", "b2", "b3", "n"]
    if not len(left) or not len(right):
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    index = _index(left)
    deep, starts = index.extended(index.first)
    name = np.full(len(starts), -1, np.int64)
    name[_column(right, "place") & 0xFFFFFFFF] = _column(right, "id")
    pair, step = name[deep], index.next
    whole, out = pair >= 0, []
    for depth in (3, 4):
        deep, starts = index.extended(deep)
        whole = whole & whole[step]
        sizes = np.diff(np.append(starts, len(whole)))
        kept = whole[starts]
        rows, sizes = starts[kept], sizes[kept]
        third = pa.array(pair[step[step[rows]]]) if depth == 4 else pa.nulls(len(rows), pa.int64())
        out.append(pa.table([pa.array(pair[rows]), pa.array(pair[step[rows]]), third, pa.array(sizes)], names))
    return pa.concat_tables(out)


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of phrases with the phrase's name and its count in all shards together. A phrase has
    one row a shard; the one whose place is the name stands for it."""
    same = W.partitionBy(*keys)
    return rows.select("*", F.sum("n").over(same).alias("f"), F.min("place").over(same).alias("id")).drop("n")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)) in whole numbers that do not overflow."""
    wide = [x.cast("decimal(20,0)") for x in (a, l, r)]
    return F.call_function("div", wide[0] * F.lit(2_000_000).cast("decimal(7,0)"), wide[1] + wide[2])


def _cuts(*sides: tuple[str, str]) -> Column:
    """The lowest score of the cuts, the first of equal ones, with both sides' counts."""
    a = F.col("a")
    found = [
        F.struct(_score(a, F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
        for k, (x, y) in enumerate(sides)
    ]
    return F.array_min(F.array(*found)).alias("cut")


def _not_inside(phrases: DataFrame, keys: list[str], longer: DataFrame, percent: int) -> DataFrame:
    """The phrases of which no longer one has too large a share of the occurrences."""
    most = longer.groupBy(*keys).agg(F.max("f").alias("longer"))
    joined = phrases.join(most, keys, "left")
    return joined.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(
    documents: DataFrame,
    least: int = LEAST,
    inside_percent: int = INSIDE_PERCENT,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per language the ``top`` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    Texts of ``lang, text`` are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line
    breaks, and those into words. ``a`` counts the phrase, ``l`` and ``r`` the two sides of the
    cut with the lowest score floor(2000000 a / (l + r)), ``n`` all words of the language.
    Candidates occur ``least`` times; one that a longer candidate covers to ``inside_percent``
    is dropped. Order: score, then a, both descending, then the phrase's bytes.

    Null and empty texts and texts of marks have no words. A null language is ``und``. Repeated
    rows count as often as they are there. Very long texts are taken whole, in an index of
    their own. No rows give no rows; other columns are not looked at.
    """
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    rows = stored(texts.mapInArrow(_shards(shard_words), _ROWS), "phrase-index")
    index = rows.where("part is not null").select("shard", "part", "bwt").groupBy("shard")
    words = rows.where("part is null").select("place", "lang", "word", "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))

    own, frequent = F.col("id") == F.col("place"), F.col("f") >= least
    known = _named(words, ["lang", "word"])
    told = [F.when(own & frequent, F.col(c)).alias(c) for c in ("lang", "word")]
    known = stored(known.select("place", "id", "f", *told), "phrase-words")
    shard = F.shiftright("place", 32).alias("shard")
    pairs = index.cogroup(known.select(shard, "place", "id").groupBy("shard"))
    pairs = pairs.applyInArrow(_pairs, "w1 long, w2 long, place long, n long")
    pairs = stored(_named(pairs, ["w1", "w2"]).where(frequent), "phrase-pairs")
    longer = index.cogroup(pairs.select(shard, "place", "id").groupBy("shard"))
    longer = longer.applyInArrow(_longer, "b1 long, b2 long, b3 long, n long")
    longer = longer.groupBy("b1", "b2", "b3").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    longer = stored(longer, "phrase-longer")

    words = known.where("word is not null").select("id", "lang", "word", "f")
    twos = (
        pairs.where(own).select("id", "w1", "w2", "f")
        .join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("p"), F.col("f").alias("fp")), "w1")
        .join(words.select(F.col("id").alias("w2"), F.col("word").alias("q"), F.col("f").alias("fq")), "w2")
        .select("id", "lang", "p", "q", "f", "fp", "fq")
    )
    twos = stored(twos, "phrase-twos")
    threes = longer.where("b3 is null").select("b1", "b2", "f")
    fours = longer.where("b3 is not null")

    def pair(key: str, to: str, *columns: str) -> DataFrame:
        return twos.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}{to}") for c in columns])

    two = twos.select("id", "lang", F.concat_ws(" ", "p", "q").alias("phrase"), F.col("f").alias("a"), "fp", "fq")
    held = threes.select(F.col("b1").alias("id"), "f").unionByName(threes.select(F.col("b2").alias("id"), "f"))
    two = _not_inside(two, ["id"], held, inside_percent).select("lang", "phrase", "a", _cuts(("fp", "fq")))
    three = threes.withColumnRenamed("f", "a").join(pair("b1", "1", "lang", "p", "q", "f", "fp"), "b1")
    three = three.join(pair("b2", "2", "q", "f", "fq"), "b2")
    held = fours.select("b1", "b2", "f").unionByName(fours.select(F.col("b2").alias("b1"), F.col("b3").alias("b2"), "f"))
    three = _not_inside(three, ["b1", "b2"], held, inside_percent).select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", "p1", "q1", "q2").alias("phrase"), "a",
        _cuts(("fp1", "f2"), ("f1", "fq2")),
    )
    four = fours.withColumnRenamed("f", "a").join(pair("b1", "1", "lang", "p", "q", "f", "fp"), "b1")
    four = four.join(pair("b3", "3", "p", "q", "f", "fq"), "b3")
    four = four.join(threes.withColumnRenamed("f", "left"), ["b1", "b2"])
    four = four.join(threes.select(F.col("b1").alias("b2"), F.col("b2").alias("b3"), F.col("f").alias("right")), ["b2", "b3"])
    four = four.select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", "p1", "q1", "p3", "q3").alias("phrase"), "a",
        _cuts(("fp1", "right"), ("f1", "f3"), ("left", "fq3")),
    )

    # The best of each part of a language first, so that no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = two.unionByName(three).unionByName(four).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    found = found.select("*", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    found = found.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    found = found.where(F.col("rank") <= top).join(totals, "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
