"""Toxicity: a noisy-channel decoder undoes disguised spelling, then the restored text is scored.

The channel knows three disguises: letters replaced by look-alike signs (leetspeak), letters
set apart by spaces or marks, and letters repeated three times or more, also all at once. A token
in which any may be at work spans a lattice of readings; Viterbi takes the likeliest under a
character trigram model counted over the whole corpus. All other tokens have one reading.
The restored words are then looked up in a lexicon learned from labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm.common import label_sample, scored_rows, with_text

#: Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c",
}
#: Marks that may be set between single letters.
APART = set(" .-_*~/\\,:;'`^")
_APART = "".join(sorted(APART))
#: Marks dropped at the ends of a token: these end sentences and quote, they spell nothing.
EDGE = ".,;:!?\"'()[]{}<>*#%&|~^`_-=/\\…«»„“”’‘–—"
#: Those of them, and the space, that are no look-alikes.
_BARE = "".join(c for c in EDGE if c not in LOOKALIKES) + " "
#: Look-alikes that a token without letters must have to be read as a word.
LEAST_SIGNS = 3

#: Symbols of the character model: 0 for anything between words, 1 to 26 for a to z, other
#: letters by code point in the rest.
SYMBOLS = 64
#: Log costs in the channel.
REPLACED, REMOVED, COLLAPSED = -1.5, -1.0, -0.3
#: Of a look-alike that stands for nothing, beside letters.
KEPT = -8.0
THRESHOLD = 0.5
CACHED = 300_000

_RUN = re.compile(r"(.)\1\1")
_EDGE_RUN = re.compile(r"^([^\w\s@$+€])\1{2,}|([^\w\s])\2{2,}$")
#: Single letters, digits or look-alikes, also repeated, with any number of marks between them.
_SIGNS, _MARKS = (re.escape("".join(x)) for x in ([c for c in LOOKALIKES if not c.isdigit()], _APART))
_SPELLED = re.compile(rf"^(?:([^\W_]|[{_SIGNS}])\1*(?:[{_MARKS}]+|$)){{3,}}$")


def symbol(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) % (SYMBOLS - 27) if char.isalpha() else 0


_TABLE: list[np.ndarray] = []


def _symbols(text: str) -> np.ndarray:
    """Symbols of a text, whatever its case."""
    if not _TABLE:
        _TABLE.append(np.array([symbol(chr(i).lower()[0]) for i in range(0xD800)], np.int32))
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[0][np.where(codes < 0xD800, codes, 0)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            value = text.as_py()
            if value:
                s = np.concatenate([[0, 0], _symbols(value), [0, 0]])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])


def character_model(documents: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, counted over all texts.

    At most ``SYMBOLS`` cubed sums come to the driver, whatever the size of the corpus.
    """
    cells = documents.select("text").mapInArrow(_count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = cells.toPandas()
    count = np.zeros(SYMBOLS**3)
    count[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    three = count.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each character: ("" or a letter or " ", log cost).

    Marks in a row are removed at the cost of one.
    """
    spelled = bool(_SPELLED.match(token))
    repeated = _repeated(token, spelled)
    out = []
    for i, c in enumerate(token):
        if c.isalpha():
            ways = [(c, 0.0)]
        else:
            ways = [(" ", KEPT if c in LOOKALIKES else 0.0)]
            ways += [(x, REPLACED) for x in LOOKALIKES.get(c, "")]
            if spelled and c in APART:
                ways.append(("", 0.0 if i and token[i - 1] in APART else REMOVED))
        if i in repeated:
            ways.append(("", COLLAPSED))
        out.append(ways)
    return out


def _repeated(token: str, spelled: bool) -> set[int]:
    """Places of letters and look-alikes in a run of three or more, but for its first; in a word
    that is spelled out, the marks between do not end a run."""
    places = [i for i, c in enumerate(token) if not (spelled and c in APART)]
    out, start = set(), 0
    for k in range(1, len(places) + 1):
        c = token[places[start]]
        if k == len(places) or token[places[k]] != c:
            if k - start >= 3 and (c.isalpha() or c in LOOKALIKES):
                out.update(places[start + 1 : k])
            start = k
    return out


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-case token; words in it are set apart by spaces.

    Viterbi over the lattice: a state is the last two symbols, which is all the model sees.
    Ties go to the reading that comes first in the lattice.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ways in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for out, cost in ways:
                if out == "" or (out == " " and b == 0):
                    to, total, chain = (a, b), score + cost, path
                else:
                    s = 0 if out == " " else symbol(out)
                    to, total, chain = (b, s), score + cost + float(model[a, b, s]), (out, path)
                if to not in after or total > after[to][0]:
                    after[to] = (total, chain)
        states = after
    ends = ((score + float(model[a, b, 0]), path) for (a, b), (score, path) in states.items())
    path = max(ends, key=lambda x: x[0])[1]
    letters = []
    while path is not None:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters)).strip()


def tokens_of(text: str) -> list[str]:
    """Distinct lower-case tokens; three or more single characters in a row, also repeated or with
    marks, are one token."""
    words = text.lower().split()
    found = set(words)
    single = [i for i, w in enumerate(words) if len(w) == 1 or _single(w.strip(_APART))]
    start = 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - start >= 3:
                found.add(" ".join(words[single[start] : single[k - 1] + 1]))
            start = k
    return sorted(found)


def _single(word: str) -> bool:
    return len(word) <= 1 or (len(word) > 2 and word == word[0] * len(word))


def words_of(token: str, model: np.ndarray) -> list[str]:
    """The restored words of a token.

    Look-alikes at its ends are punctuation, but of a word that is spelled out or has no letters
    they may as well be letters: it is read both with and without them.
    """
    bare = _EDGE_RUN.sub("", token).strip(_BARE)
    core = bare.strip(EDGE + " ")
    if core.isalpha() and not _RUN.search(core):
        return [core]
    found: list[str] = []
    for way in dict.fromkeys((core, bare)):
        letters = any(c.isalpha() for c in way)
        if not letters and sum(c in LOOKALIKES for c in way) < LEAST_SIGNS:
            continue
        if way == core or not letters or _SPELLED.match(way):
            found += [w for w in restore(way, model).split() if w not in found]
    return found


def features_of(word: str) -> list[str]:
    """The word and its beginnings, which hold for its inflected forms."""
    return [f"{word}$", *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


@dataclass
class Scorer:
    """The character model, the weights of features, and the line from evidence to log odds."""

    model: np.ndarray
    weights: dict[str, float]
    slope: float = 1.0
    level: float = -2.0
    strongest: int = 3  # words of a text that count

    def evidence(self, texts: Iterable[str | None]) -> np.ndarray:
        """The sum of the strongest words of each text, so that length alone is no evidence."""
        cache: dict[str, float] = {}
        out = []
        for text in texts:
            if len(cache) > CACHED:
                cache.clear()
            found = []
            for token in tokens_of(text or ""):
                weight = cache.get(token)
                if weight is None:
                    weights, get = [0.0], self.weights.get
                    for word in words_of(token, self.model):
                        weights += [get(f, 0.0) for f in features_of(word)]
                    weight = cache[token] = max(weights)
                if weight > 0:
                    found.append(weight)
            out.append(sum(sorted(found)[-self.strongest :]))
        return np.array(out, np.float64)

    def chance(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.evidence(texts) + self.level)))


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample and of the lexicon.

    ``surety`` is how many standard errors a feature's log odds are lowered by.
    """

    per_label: int = 4000
    documents: int = 8000
    features: int = 50_000
    least_documents: int = 3
    surety: float = 2.0
    strongest: int = 3  # words of a text that count; a long text gets no higher score by more


def _weights(rows: list[tuple], toxic: float, clean: float, training: Training) -> dict[str, float]:
    """Features whose lowered log odds stay above 0, the strongest first."""
    found = {}
    for name, t, c in rows:
        if t >= training.least_documents:
            odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
            sure = odds - training.surety * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
            if sure > 0:
                found[name] = float(sure)
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[: training.features])


def train(documents: DataFrame, labels: DataFrame, training: Training = Training()) -> Scorer:
    """A scorer from ``doc_id, text`` (all of them for the character model) and ``doc_id, toxic``.

    The lexicon comes from a bounded sample of the labelled texts. The line from evidence to
    log odds is fitted on texts scored by the lexicon of the other half, so that words which
    by chance stand only in toxic texts of the sample earn no trust; its level is moved to
    the share of toxic rows among all that are labelled. Null labels teach nothing.
    """
    model = character_model(documents)
    labelled = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    sample = with_text(documents, label_sample(labelled, training.per_label, training.documents))
    half = F.conv(F.substring("key", 1, 1), 16, 10).cast("int") % 2
    sample = sample.select("text", "label", half.alias("half")).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = {}
            texts, label, part = (c.to_pylist() for c in batch.columns)
            for text, y, h in zip(texts, label, part, strict=True):
                features = {f for t in tokens_of(text or "") for w in words_of(t, model) for f in features_of(w)}
                for f in features:
                    total.setdefault(f, [0, 0, 0, 0])[2 * h + y] += 1
            columns = zip(*total.values(), strict=True) if total else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
                ["feature", "c0", "t0", "c1", "t1"],
            )

    counted = sample.mapInArrow(count, "feature string, c0 long, t0 long, c1 long, t1 long")
    counted = counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    rows = counted.where(F.col("t0") + F.col("t1") >= training.least_documents).collect()
    size = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    n = lambda h, y: float(size.get((h, y), 0))
    halves = [
        _weights([(r["feature"], r[f"t{h}"], r[f"c{h}"]) for r in rows], n(h, 1), n(h, 0), training) for h in (0, 1)
    ]
    halves = [Scorer(model, weights, strongest=training.strongest) for weights in halves]
    both = [(r["feature"], r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in rows]
    weights = _weights(both, n(0, 1) + n(1, 1), n(0, 0) + n(1, 0), training)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, part = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            found = np.zeros(batch.num_rows)
            for h in (0, 1):
                own = np.flatnonzero(part == h)
                found[own] = halves[1 - h].evidence([texts[i] for i in own])
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(1)], ["evidence", "label"])

    points = sample.mapInArrow(judged, "evidence double, label int").toPandas()
    sample.unpersist()
    share = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    slope, level = _line(points["evidence"].to_numpy(np.float64), points["label"].to_numpy(np.float64))
    sampled = np.log((n(0, 1) + n(1, 1) + 1) / (n(0, 0) + n(1, 0) + 1))
    level += np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1)) - sampled
    return Scorer(model, weights, slope, level, training.strongest)


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit by Newton steps, drawn slightly towards slope 1 and level -2."""
    at = np.array([1.0, -2.0])
    rows, middle = np.stack([x, np.ones_like(x)], 1), at.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -30, 30)))
        slope = rows.T @ (p - y) + 0.5 * (at - middle)
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + 0.5 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - np.clip(step, -1, 1)
    return max(float(at[0]), 0.05), float(at[1])


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score``: the chance of being toxic, 0 to 1.

    Every row is restored and scored from its whole text alone. Null and empty texts have no
    evidence, which scores low. Repeated ids give repeated rows; an empty table gives none.
    """
    found, kept = scored_rows(documents, ["doc_id"], ["double"], lambda x: [pa.array(scorer.chance(x.to_pylist()))])
    return found.select(*kept, F.col("n0").alias("score"))


def accepted(documents: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below ``threshold``."""
    columns = documents.columns
    found, kept = scored_rows(documents, columns, ["double"], lambda x: [pa.array(scorer.chance(x.to_pylist()))])
    return found.where(F.col("n0") < threshold).select(*kept)
