"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. A passage is encoded by how often
its characters' classes and pairs of classes occur; a tanh layer, gated attention and
a logistic output are learned from document labels alone. The score of a document is
that of its passages' weighted mean. Fitted on at most SAMPLE labelled documents of up
to LONGEST bytes; every passage of every document is scored.

Defined results: empty and null texts are bags of one empty passage and have the
score the model gives that. Very long texts are scored whole. Without labels of both
kinds, every score is the share of 1 among the labels, 0.5 if there are none. Rows without
id are scored, never learned; of several texts of an id the one with the least hash is
learned, and the highest label counts. Repeated rows and ties have equal scores: sums are taken without rounding, so that a
score doesn't depend on the rows beside it. An empty
table gives no rows. Extra columns play no part in a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import SLICE, Adam, bounded, flat, fold, freed, labelled, release, sampled, sigmoid, slices, text_of

PASSAGE = 1024
SAMPLE = 8000
#: Bytes of a text that is learned from at most; longer ones are scored only.
LONGEST = 1 << 20
HIDDEN, GATE = 24, 12
FOLDS = 5
THRESHOLD = 0.3
#: Binary places of weights and of what they are multiplied with: 2 * GRID and the bits of the largest sum are below 53.
GRID = 16

_CLASS = np.full(256, 15, np.int64)
_CLASS[128:] = 1
for _i, _c in enumerate(("abcdefghijklmnopqrstuvwxyz", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\v\f", ".", ",", "!?", "|", "#&$%*", "@", ":/\\;=", "\"'()[]{}", "<>")):
    _CLASS[list(_c.encode())] = _i
FEATURES = 16 + 256 + 2


def passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the passages; a text without bytes has one that is empty."""
    n = np.maximum(1, -(-np.diff(offsets) // PASSAGE))
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[of] + inside * PASSAGE
    return starts, np.minimum(starts + PASSAGE, offsets[of + 1]), of


def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of features for each passage; passages follow one another without gaps."""
    n, size = len(starts), ends - starts
    if not len(data):
        return np.zeros((n, FEATURES), np.float32)
    c = _CLASS[data]
    of = np.repeat(np.arange(n), size)
    one = np.bincount(of * 16 + c, minlength=n * 16).reshape(n, 16)
    pair = of[:-1] * 256 + c[:-1] * 16 + c[1:]
    two = np.bincount(pair[of[:-1] == of[1:]], minlength=n * 256).reshape(n, 256)
    whole = np.maximum(size, 1)[:, None]
    return np.concatenate([np.sqrt(one / whole), np.sqrt(two / whole), np.log1p(size)[:, None] / 7, (size == 0)[:, None]], axis=1).astype(np.float32)


def on_grid(x: np.ndarray, most: float) -> np.ndarray:
    """Doubles of at most `most` in size, rounded to GRID binary places."""
    return np.rint(np.clip(np.asarray(x, np.float64), -most, most) * 2.0**GRID) / 2.0**GRID


class Model:
    """Weights of the network; mean and scale of the features."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.w = [g(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), g(HIDDEN, GATE), g(HIDDEN, GATE), g(GATE, 1)[:, 0], g(HIDDEN, 1)[:, 0], np.zeros(1, np.float32)]
        self.mean, self.scale, self.prior = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), None

    def exact(self) -> list[np.ndarray]:
        """Weights on a grid of whole multiples of 2**-GRID, with which sums of products of numbers on such grids have no rounding, in whatever order they are taken."""
        return [on_grid(w, 32.0) for w in (self.w[0], *self.w[2:4])]

    def passages(self, x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and attention of each passage, by itself: instances() for scoring, where a passage must not depend on those it is batched with."""
        w1, v, u = weights
        h = on_grid(np.tanh(on_grid((x.astype(np.float64) - self.mean) * self.scale, 256.0) @ w1 + self.w[1]), 1.0)
        gated = np.tanh(h @ v) * sigmoid(h @ u)
        return h, np.exp((gated * self.w[4]).sum(1))

    def instances(self, x: np.ndarray):
        w1, b1, v, u, a, _, _ = self.w
        h = np.tanh((x - self.mean) * self.scale @ w1 + b1)
        t, s = np.tanh(h @ v), sigmoid(h @ u)
        return h, t, s, np.exp((t * s) @ a)

    def scores(self, h: np.ndarray, e: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.zeros((n, HIDDEN), np.float64)
        np.add.at(z, of, h * e[:, None])
        total = np.bincount(of, e, minlength=n)
        z /= np.maximum(total, 1e-30)[:, None]
        return z, total, sigmoid(z @ self.w[5] + self.w[6][0])

    def fit(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, epochs: int = 30, size: int = 128, decay: float = 1e-4) -> Model:
        if len(np.unique(y)) < 2:
            self.prior = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), (1 / (x.std(0) + 0.02)).astype(np.float32)
        first = np.searchsorted(of, np.arange(len(y) + 1))
        adam, rng = Adam(self.w), np.random.default_rng(2)
        for epoch in range(epochs):
            adam.rate = 0.004 * (1 - epoch / epochs) + 0.0002
            order = rng.permutation(len(y))
            for lo in range(0, len(y), size):
                pick = order[lo : lo + size]
                n = first[pick + 1] - first[pick]
                rows = np.repeat(first[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())
                self._step(adam, x[rows], np.repeat(np.arange(len(pick)), n), y[pick], decay)
        return self

    def _step(self, adam: Adam, x: np.ndarray, of: np.ndarray, y: np.ndarray, decay: float) -> None:
        _, _, v, u, a, o, _ = self.w
        h, t, s, e = self.instances(x)
        z, total, p = self.scores(h, e, of, len(y))
        d = ((p - y) / len(y)).astype(np.float32)
        dz = d[:, None] * o
        share = (e / total[of])[:, None].astype(np.float32)
        dh = share * dz[of]
        de = share[:, 0] * (dz[of] * (h - z[of])).sum(1)
        dg = de[:, None] * a
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh += dt @ v.T + ds @ u.T
        dx = dh * (1 - h * h)
        xs = (x - self.mean) * self.scale
        grads = [xs.T @ dx, dx.sum(0), h.T @ dt, h.T @ ds, ((t * s) * de[:, None]).sum(0), z.T @ d, d.sum(keepdims=True)]
        adam.step([(g + decay * w).astype(np.float32) for g, w in zip(grads, self.w, strict=True)])


def _bags(data: np.ndarray, offsets: np.ndarray):
    """Encoded passages slice by slice: (features, texts); one long text is encoded in parts."""
    starts, ends, of = passages(offsets)
    edge = np.concatenate([starts, ends[-1:]])
    for lo, hi in slices(edge, SLICE) if len(starts) else ():
        own = data[starts[lo] : ends[hi - 1]]
        yield encode(own, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]), of[lo:hi]


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if model.prior is not None:
        return np.full(n, model.prior)
    top, total, weights = np.zeros((n, HIDDEN)), np.zeros(n), model.exact()
    for x, of in _bags(data, offsets):
        h, e = model.passages(x, weights)
        np.add.at(top, of, h * e[:, None])  # passage after passage, wherever a slice ends
        np.add.at(total, of, e)
    return sigmoid((top / np.maximum(total, 1e-30)[:, None] * model.w[5]).sum(1) + model.w[6][0])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_of(batch)
        for x, of in _bags(data, offsets):
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ids = labelled(labels, "quality", sample, fold(F.col("doc_id"), FOLDS) != 0)
    t = sampled(bounded(docs), ids, LONGEST).select("doc_id", "text", "label").mapInArrow(freed(_features), "doc_id long, label int, x binary").toArrow()
    if not t.num_rows:
        return Model().fit(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0))
    data, _ = flat(t["x"])
    x = data.view(np.float16).reshape(-1, FEATURES).astype(np.float32)
    order = np.lexsort((*x.T[:4], t["doc_id"].to_numpy()))
    doc, y = t["doc_id"].to_numpy()[order], t["label"].to_numpy()[order]
    _, first, of = np.unique(doc, return_index=True, return_inverse=True)
    x = x[order]
    del t, data
    model = Model().fit(x, of, y[first].astype(np.float64))
    del x
    release()  # the driver goes on with other stages
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(predict(model, data, offsets), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    scored = docs.select("doc_id", "text").mapInArrow(freed(_score(train(docs, labels, sample))), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns; one pass, no join."""
    model = train(docs, labels, sample)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(predict(model, *text_of(batch)) >= THRESHOLD))

    return docs.mapInArrow(freed(keep), docs.schema)
