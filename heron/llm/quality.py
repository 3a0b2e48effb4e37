"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes, whole text. Each passage is encoded from the shares of
character classes, word lengths and repeated words; gated attention weighs the passages, and the
weighted sum is scored. Encoder, attention and scorer are trained together on document labels
(numpy, full batches, Adam, fixed seed), on a bounded labelled sample.

Cases: null counts as empty; an empty text is one empty passage and is scored like any other. Very
long texts are all of their passages, in pieces of a batch.
Without labels, or with one label only, every score is the share of label 1 (0.5 without labels).
Repeated rows give equal rows; null ids are kept and never held out; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import pieces
from heron.llm.textcodec import chunks, word_hashes
from heron.llm.training import SAMPLE_ROWS, held_out, labelled_sample
from heron.session import ship

PASSAGE = 320
HIDDEN, GATES, STEPS, RATE, DECAY = 16, 8, 250, 0.03, 1e-4
KEEP_FROM = 0.3

#: Character classes: small, capital, digit, blank, line end, stop, comma, bar, bang, mark, other sign, beyond ASCII.
_CLASS = np.full(256, 11, np.uint8)
_CLASS[:128] = 10
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[[46, 63]], _CLASS[44], _CLASS[124], _CLASS[33] = 3, 4, 5, 6, 7, 8
_CLASS[[35, 36, 37, 38, 42, 64, 94, 126]] = 9
CLASSES = 12
FEATURES = CLASSES + 4


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of passages, first passage of each text) for runs of texts."""
    for _, offsets, data in chunks(texts):
        sizes = np.diff(offsets)
        per = np.maximum(1, -(-sizes // PASSAGE))
        first = np.concatenate([[0], np.cumsum(per)])
        starts = np.repeat(offsets[:-1] - first[:-1] * PASSAGE, per) + np.arange(first[-1]) * PASSAGE
        ends = np.minimum(starts + PASSAGE, np.repeat(offsets[1:], per))
        x = np.zeros((len(starts), FEATURES), np.float32)
        n = np.maximum(ends - starts, 1)
        kinds = _CLASS[data]
        for k in range(CLASSES):
            if len(data):
                held = np.add.reduceat(kinds == k, np.minimum(starts, len(data) - 1), dtype=np.int64)
                x[:, k] = np.where(ends > starts, held, 0) / n
        words, begin, _ = word_hashes(offsets, data)
        lo, hi = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
        count = np.maximum(hi - lo, 1)
        place = np.repeat(np.arange(len(starts)), hi - lo)
        order = np.lexsort((words, place))
        w, p = words[order], place[order]
        again = np.zeros(len(w), bool)
        again[1:] = (w[1:] == w[:-1]) & (p[1:] == p[:-1])
        x[:, CLASSES] = np.bincount(p, again, len(starts)) / count
        x[:, CLASSES + 1] = np.log1p(n / count) / 4
        x[:, CLASSES + 2] = (ends - starts) / PASSAGE
        x[:, CLASSES + 3] = np.log1p(np.repeat(sizes, per)) / 10
        yield x, first


def _sums(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v, first[:-1], axis=0)


@dataclass
class Model:
    params: dict[str, np.ndarray] | None
    mean: np.ndarray
    scale: np.ndarray
    share: float = 0.5

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        q = self.params
        h = np.tanh(x @ q["w1"] + q["b1"])
        t, s = np.tanh(h @ q["v"]), 1 / (1 + np.exp(-(h @ q["u"])))
        e = (t * s) @ q["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / _sums(e, first)[bag]
        z = _sums(a[:, None] * h, first)
        return h, t, s, a, z, bag, 1 / (1 + np.exp(-np.clip(z @ q["c"] + q["d"][0], -30, 30)))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.params is None:
            return np.full(len(texts), self.share)
        return np.concatenate([np.zeros(0), *(self.forward((x - self.mean) / self.scale, first)[-1] for x, first in passages(texts))])


def learn(sample: list[tuple[str, int]]) -> Model:
    y = np.array([label for _, label in sample], float)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Model(None, np.zeros(FEATURES), np.ones(FEATURES), share)
    found = list(passages(pa.array([t for t, _ in sample], pa.large_string())))
    x = np.concatenate([f for f, _ in found])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in found]))])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(7)
    shapes = {"w1": (FEATURES, HIDDEN), "b1": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,), "d": (1,)}
    model = Model({k: rng.normal(0, 0.3, n) for k, n in shapes.items()}, mean, scale, share)
    q = model.params
    m, v = ({k: np.zeros_like(p) for k, p in q.items()} for _ in range(2))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # the rarer label counts somewhat more
    for step in range(1, STEPS + 1):
        h, t, s, a, z, bag, p = model.forward(x, first)
        ds = weight * (p - y) / len(y)
        dz = np.outer(ds, q["c"])[bag]
        da = (h * dz).sum(1)
        de = a * (da - _sums(a * da, first)[bag])
        dg = np.outer(de, q["w"])
        dt, du = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ q["v"].T + du @ q["u"].T) * (1 - h * h)
        grads = {"w1": x.T @ dh, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ du, "w": (t * s).T @ de, "c": z.T @ ds, "d": np.array([ds.sum()])}
        for k, g in grads.items():
            g = g + DECAY * q[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            q[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most `rows` labelled documents outside the held-out fold."""
    return learn(labelled_sample(docs, labels, "quality", rows))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            s = model.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= KEEP_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
