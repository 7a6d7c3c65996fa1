"""Quality rules on repetition: a suffix array over the words of each text.

Neighbours in the suffix array share their longest common prefix. The innermost interval of
common prefixes that holds a suffix has the larger of the prefixes on its two sides as its
length: the longest string of words that starts there and occurs again. Such a string is a
maximal repeat unless the suffix one word before carries it in a longer one. The spans of the
maximal repeats are united, and a text is rejected if too large a share of its words lies in
them, or if the longest one is too long.

Texts are independent, so nothing is shuffled; a task holds a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.llm.common import scored_rows, text_bytes
from seatflow.llm.suffixes import byte_set, common_prefixes, numbered, runs, suffix_order

SPACE = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
SYMBOLS = byte_set(b"#*$%&|<>")
LINE_END = byte_set(b"\n")
#: Bytes whose texts are solved together; a longer text is solved alone.
SLICE_BYTES = 1 << 21


@dataclass(frozen=True)
class Rules:
    """Limits of a text, in words."""

    window: int = 3  # of the base rule
    fewest: int = 50  # words of a text
    most_in_windows: int = 50  # percent of the words in windows that are found twice or more
    repeat: int = 10  # shortest repeat that counts
    most_covered: int = 25  # percent of the words in repeats
    longest: int = 100  # words of the longest repeat


#: Columns that ``repetition`` adds.
COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_covered": "long",
    "longest_repeat": "long",
    "spans": "array<struct<first:bigint,words:bigint>>",
}


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    opened, closed = np.bincount(starts, minlength=n + 1), np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(opened - closed)[:-1] > 0


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    n = len(offsets) - 1
    first, end = runs(data, offsets, LINE_END)
    if not len(first):
        return np.zeros(n, np.int64)
    ids, _ = numbered(data[~LINE_END[data]], end - first)
    words = np.concatenate([[0], np.cumsum(~SPACE[data])])
    kept = words[end] > words[first]
    text = np.searchsorted(offsets, first[kept], "right") - 1
    found, times = np.unique(text * (int(ids.max()) + 1) + ids[kept], return_counts=True)
    return np.bincount(found // (int(ids.max()) + 1), times - 1, n).astype(np.int64)


def repeats_of(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], tuple]:
    """Figures per text, and text, first word and number of words of every united span."""
    n = len(offsets) - 1

    def sums(what: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(what, dtype=np.int64)])[offsets])

    begin, end = runs(data, offsets, SPACE)
    text = np.searchsorted(offsets, begin, "right") - 1
    counts = np.bincount(text, minlength=n)
    out = {
        "n_words": counts,
        "word_chars": sums(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": sums(SYMBOLS[data]),
        "n_dup_lines": _repeated_lines(data, offsets),
    }
    # Words of a text, then a key of its own; keys of a text lie together, so the suffix array
    # is the suffix arrays of the texts, one after the other.
    ids, _ = numbered(data[~SPACE[data]], end - begin)
    place = np.arange(len(ids)) + text
    ends = np.cumsum(counts) + np.arange(n)
    size = (int(ids.max()) if len(ids) else 0) + 2
    keys = np.empty(len(ids) + n, np.int64)
    keys[place] = text * size + ids + 1
    keys[ends] = np.arange(n) * size
    order, levels = suffix_order(keys, keep_levels=True)
    common = common_prefixes(order, levels)
    longest = np.zeros(len(keys), np.int64)
    longest[order] = np.maximum(common, np.append(common[1:], 0))
    # A repeat that starts a word earlier and ends at the same word holds this one.
    maximal = np.ones(len(keys), bool)
    maximal[1:] = longest[1:] != longest[:-1] - 1
    owner = np.empty(len(keys), np.int64)
    owner[place], owner[ends] = text, np.arange(n)

    at = np.flatnonzero(longest >= rules.window)
    inside = _covered(at, np.full(len(at), rules.window), len(keys))
    out["n_repeat_words"] = np.bincount(owner[inside], minlength=n)
    at = np.flatnonzero(maximal & (longest >= rules.repeat))
    inside = _covered(at, longest[at], len(keys))
    out["n_covered"] = np.bincount(owner[inside], minlength=n)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], owner, longest)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    starts = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]) if n else np.zeros(0, np.int64)
    return out, (owner[first], first - starts[owner[first]], last + 1 - first)


def _arrays(rules: Rules):
    """An Arrow batch of texts to the columns of ``COLUMNS``."""

    def of_texts(column: pa.Array) -> list[pa.Array]:
        data, offsets = text_bytes(column)
        parts, spans, at = [], [], 0
        while at < len(offsets) - 1:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            here = offsets[at : upto + 1]
            figures, (text, first, words) = repeats_of(data[here[0] : here[-1]], here - here[0], rules)
            parts.append(figures)
            spans.append((text + at, first, words))
            at = upto
        n = len(offsets) - 1
        figures = [np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)]) for c in list(COLUMNS)[:-1]]
        text, first, words = (np.concatenate([s[i] for s in spans] or [np.zeros(0, np.int64)]) for i in range(3))
        items = pa.StructArray.from_arrays([pa.array(first), pa.array(words)], ["first", "words"])
        ends = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
        return [*(pa.array(x.astype(np.int64)) for x in figures), pa.ListArray.from_arrays(pa.array(ends), items)]

    return of_texts


def _verdict(rules: Rules) -> tuple[Column, Column]:
    """base_failed and kept, from the columns that ``scored_rows`` made."""
    at = list(COLUMNS).index
    n, windows, covered, longest = (
        F.col(f"n{at(c)}") for c in ("n_words", "n_repeat_words", "n_covered", "longest_repeat")
    )
    failed = (n < rules.fewest) | (100 * windows > rules.most_in_windows * n)
    return failed, ~failed & (100 * covered <= rules.most_covered * n) & (longest <= rules.longest)


def repetition(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``doc_id``, the figures of ``COLUMNS``, base_failed and kept per row of ``doc_id, text``.

    ``spans`` are the united spans of the maximal repeats of ``rules.repeat`` words or more.
    ``base_failed``: too few words, or too many of them in windows that are found twice.
    ``kept``: not failed, no more than the allowed share in repeats, none of them too long.
    Null, empty and white texts have no words and fail. Very long texts are taken whole, in
    memory that grows with their words times the logarithm of their longest repeat. Repeated
    rows each get their answer; other columns are not looked at; no rows give no rows.
    """
    rows, kept = scored_rows(documents, ["doc_id"], list(COLUMNS.values()), _arrays(rules))
    failed, passed = _verdict(rules)
    columns = [F.col(f"n{i}").alias(c) for i, c in enumerate(COLUMNS)]
    return rows.select(*kept, *columns, failed.alias("base_failed"), passed.alias("kept"))


def accepted(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The documents, with all their columns, whose text passes the rules."""
    rows, kept = scored_rows(documents, documents.columns, list(COLUMNS.values()), _arrays(rules))
    return rows.where(_verdict(rules)[1]).select(*kept)
