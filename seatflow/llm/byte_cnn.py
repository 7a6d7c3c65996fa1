"""A byte-level convolutional network in numpy, shared by the language and quality operators.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter
keeps its maximum over the window, and a linear layer gives class logits. The logits of a
text are the length-weighted mean over its windows, which cover all of it.

Filters of all widths are zero-padded to the widest, so that one matrix product does them
all. Bias and ReLU follow the maximum, which gives the same values and costs less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seatflow.llm.common import text_bytes

#: Windows that are convolved at a time, so that buffers stay in the processor's cache.
BLOCK = 16


@dataclass(frozen=True)
class Shape:
    """Sizes of the network: window and hop in bytes, filter widths, filters of each width."""

    window: int = 256
    hop: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8


@dataclass
class Network:
    shape: Shape
    classes: list
    table: np.ndarray  # 256 x embedding; row 0 is the padding and stays 0
    kernel: np.ndarray  # widest * embedding x filters of all widths
    bias: np.ndarray
    out: np.ndarray  # filters x classes
    prior: np.ndarray

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Class logits of windows, n x (window + widest - 1) bytes, without the prior."""
        pooled = np.empty((len(windows), self.kernel.shape[1]), np.float32)
        for i in range(0, len(windows), BLOCK):
            pooled[i : i + BLOCK] = _convolved(self.table, self.kernel, windows[i : i + BLOCK])[0].max(axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.out

    def text_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Class logits of each text of a batch, with the prior; empty texts get the prior."""
        total = np.zeros((len(offsets) - 1, len(self.classes)))
        weight = np.zeros(len(offsets) - 1)
        for texts, sizes, windows in windows_of(data, offsets, self.shape):
            np.add.at(total, texts, self.logits(windows) * sizes[:, None])
            np.add.at(weight, texts, sizes)
        return total / np.maximum(weight, 1)[:, None] + self.prior


def windows_of(data: np.ndarray, offsets: np.ndarray, shape: Shape, at_once: int = 4096):
    """(text number, bytes in the window, window) of all windows of all texts, piece by piece.

    Windows start every ``hop`` bytes until one reaches the end of its text, so that together
    they cover it. A window also sees the few bytes after it that its last filters reach, as
    far as they belong to the text; beyond the end it is padded with zeros.
    """
    sizes = np.diff(offsets)
    count = np.where(sizes > 0, 1 + -(-np.maximum(sizes - shape.window, 0) // shape.hop), 0)
    ends = np.cumsum(count)
    reach = shape.window + max(shape.widths) - 1
    padded = np.concatenate([data, np.zeros(reach, np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, reach)
    for first in range(0, int(ends[-1]) if len(ends) else 0, at_once):
        number = np.arange(first, min(first + at_once, int(ends[-1])))
        text = np.searchsorted(ends, number, "right")
        start = (number - (ends[text] - count[text])) * shape.hop
        left = sizes[text] - start
        windows = views[offsets[text] + start]
        short = np.flatnonzero(left < reach)
        if len(short):
            windows[short] *= np.arange(reach)[None, :] < left[short, None]
        yield text, np.minimum(left, shape.window), windows


def _convolved(table: np.ndarray, kernel: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filter values n x window x filters, the patches they were computed from)."""
    n, reach = windows.shape
    size = table.shape[1]
    wide = kernel.shape[0] // size
    embedded = table[windows]
    step = embedded.strides
    patches = np.lib.stride_tricks.as_strided(
        embedded, (n, reach - wide + 1, wide * size), (step[0], step[1], step[2])
    ).reshape(-1, wide * size)
    return (patches @ kernel).reshape(n, reach - wide + 1, -1), patches


def fit(
    windows: np.ndarray, bags: np.ndarray, labels: np.ndarray, classes: list, shape: Shape,
    prior: np.ndarray | None = None, steps: int = 500, batch: int = 64, rate: float = 0.004, seed: int = 7,
) -> Network:
    """Train on bags of windows (``bags`` sorted, one label index per bag) by Adam on the log loss.

    ``prior`` is added to the logits in training and kept for scoring: with the log shares of
    the classes in the sample during training and those of all labelled rows afterwards, a
    sample that is even by class does not shift the scores.
    """
    rng = np.random.default_rng(seed)
    wide, size = max(shape.widths), shape.embedding
    n_filters = shape.filters * len(shape.widths)
    mask = np.repeat(
        np.concatenate([np.tile(np.arange(wide)[:, None] < w, (1, shape.filters)) for w in shape.widths], 1), size, 0
    ).astype(np.float32)
    p = {
        "table": rng.normal(0, 0.5, (256, size)).astype(np.float32),
        "kernel": rng.normal(0, 1.2 / np.sqrt(wide * size), (wide * size, n_filters)).astype(np.float32) * mask,
        "bias": np.zeros(n_filters, np.float32),
        "out": rng.normal(0, 0.1, (n_filters, len(classes))).astype(np.float32),
    }
    p["table"][0] = 0
    share = np.bincount(labels, minlength=len(classes)) + 1.0
    sample_prior = np.log(share / share.sum())
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    first = np.searchsorted(bags, np.arange(len(labels) + 1))
    by_class = [np.flatnonzero(labels == c) for c in range(len(classes))]
    by_class = [x for x in by_class if len(x)]
    for t in range(1, steps + 1):
        # Each class the same number of times; the prior makes up for it.
        picked = np.concatenate([rng.choice(x, max(1, batch // len(by_class))) for x in by_class])
        even = np.zeros(len(classes))
        rows = [np.arange(first[b], first[b + 1]) for b in picked]
        bag = np.repeat(np.arange(len(picked)), [len(r) for r in rows])
        x = windows[np.concatenate(rows)]
        values, patches = _convolved(p["table"], p["kernel"], x)
        best = values.argmax(axis=1)
        top = np.take_along_axis(values, best[:, None], 1)[:, 0]
        pooled = np.maximum(top + p["bias"], 0)
        n = np.bincount(bag, minlength=len(picked)).astype(np.float32)
        bagged = np.zeros((len(picked), n_filters), np.float32)
        np.add.at(bagged, bag, pooled)
        bagged /= n[:, None]
        score = softmax(bagged @ p["out"] + even)
        score[np.arange(len(picked)), labels[picked]] -= 1
        score = (score / len(picked)).astype(np.float32)
        g = {"out": bagged.T @ score + 1e-4 * p["out"]}
        back = ((score @ p["out"].T) / n[:, None])[bag] * (pooled > 0)
        g["bias"] = back.sum(0)
        per = values.shape[1]
        patch = patches[best + per * np.arange(len(x))[:, None]]
        g["kernel"] = np.einsum("nf,nfk->kf", back, patch, optimize=True) * mask + 1e-5 * p["kernel"]
        down = (back[:, :, None] * p["kernel"].T[None]).reshape(len(x), n_filters, wide, size)
        place = best[:, :, None] + np.arange(wide)
        code = np.take_along_axis(x, place.reshape(len(x), -1), 1).reshape(-1)
        g["table"] = np.stack([np.bincount(code, down[..., j].reshape(-1), 256) for j in range(size)], 1).astype(np.float32)
        g["table"][0] = 0
        lr = rate * min(1.0, t / 30) * (1.0 if t < 0.6 * steps else 0.3 if t < 0.85 * steps else 0.1)
        for k in p:
            mean[k] = 0.9 * mean[k] + 0.1 * g[k]
            square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
            p[k] -= lr * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-7)
    prior = np.asarray(sample_prior if prior is None else prior, np.float64)
    return Network(shape, classes, p["table"], p["kernel"], p["bias"], p["out"], prior)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_windows(texts: DataFrame, shape: Shape, per_text: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(windows, sorted bag numbers, label of each bag) of ``text, label, key`` rows.

    A text gives ``per_text`` windows at most, spread evenly from its first to its last; so
    what comes to the driver is bounded by the rows of the sample, not by their length.
    """
    reach = shape.window + max(shape.widths) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            out = [[] for _ in range(batch.num_rows)]
            for text, _, windows in windows_of(data, offsets, shape):
                for t, w in zip(text.tolist(), windows, strict=True):
                    out[t].append(w.tobytes())
            spread = [
                b"".join(ws[round(i * (len(ws) - 1) / max(per_text - 1, 1))] for i in range(per_text))
                if len(ws) > per_text else b"".join(ws)
                for ws in out
            ]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(spread, pa.binary())], NAMES)

    kind = texts.schema["label"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"label {kind}, key string, windows binary").collect()
    rows = sorted((r for r in rows if r["windows"]), key=lambda r: (str(r["label"]), r["key"], bytes(r["windows"])))
    windows = np.frombuffer(b"".join(bytes(r["windows"]) for r in rows), np.uint8).reshape(-1, reach)
    bags = np.repeat(np.arange(len(rows)), [len(r["windows"]) // reach for r in rows])
    return windows, bags, [r["label"] for r in rows]


def text_logits(network: Network | None, texts: pa.Array) -> np.ndarray:
    """Logits of a batch of texts; without a network zeros of one class."""
    return network.text_logits(*text_bytes(texts)) if network else np.zeros((len(texts), 1))


NAMES = ["label", "key", "windows"]
