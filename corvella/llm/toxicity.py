"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters. Training tokens are labelled from the documents' labels:
a token of a toxic document is toxic if its word or its beginning is found
mostly in toxic documents, after words as many as FREQUENT of these. A two-state chain (word, its
beginnings, shape, neighbours; transitions) is fitted to
these labels by its likelihood; forward-backward marginals give each token's chance of
being toxic, a document's marginals are pooled and calibrated to a document score, and
runs of likely tokens are the offending spans. Fitted on at most SAMPLE labelled
documents of up to LONGEST bytes; a document's whole text is one chain, whose messages
pass from each WINDOW tokens to the next.

Defined results: null and empty texts, and others without letters, have the calibrated
score of no evidence. Without labels of both kinds every score is the share of 1, 0 if
there are none. Very long texts are tagged whole. Rows without id are scored, never
learned; of several texts of an id the one with the least hash is learned, and the highest
label counts. Repeated rows have equal scores, ties are as they fall. An empty table gives
no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import SLICE, Adam, _lut, fold, group_starts, labelled, sampled, sigmoid, slices, span_hashes, text_of, word_bounds, bounded, freed

SAMPLE = 4000
#: Bytes of a text that is learned from at most; longer ones are scored only.
LONGEST = 1 << 20
#: Texts whose messages are in memory at once in training.
TEXTS = 500
WINDOW = 64
WORDS, CONTEXT = 1 << 17, 1 << 14
SHAPES = 4
#: Numbers of first bytes of a word that are features beside the word.
HEADS = (4, 5, 6, 7)
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
SPAN = 0.5
#: Different words before a toxic word at least, by the number of toxic training documents; others come from copies of a few documents.
FREQUENT = 0.01

_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[65:91] = _GAP[97:123] = False
_LOWER = _lut(9)
_LOWER[65:91] = _LOWER[97:123]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (WORDS - 1)


class Tokens:
    """Tokens of a slice of texts: place, text, buckets of the word and of its first bytes, shape."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.of = word_bounds(data, offsets, _GAP)
        heads = [np.minimum(self.ends, self.starts + n) for n in HEADS]
        h = span_hashes(data, self.starts, self.ends, *heads, lut=_LOWER)
        self.word, self.parts = _bucket(h[0]), [_bucket(x + np.uint64(i + 1)) for i, x in enumerate(h[1:])]
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        n = upper[self.ends] - upper[self.starts]
        self.shape = np.where(n == 0, 0, np.where(n == self.ends - self.starts, np.where(n > 1, 3, 1), np.where(n == 1, 1, 2)))


def chains(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each token in a matrix of windows (row, column); a window holds tokens of one text."""
    if not len(of):
        z = np.zeros(0, np.int64)
        return z, z
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    inside = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
    return np.cumsum(inside % WINDOW == 0) - 1, inside % WINDOW


def _places(of: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of each window among those of its text."""
    start = group_starts(row)[:-1]
    text = of[start]
    return np.arange(len(text)) - np.searchsorted(text, text, "left")


def _steps(place: np.ndarray) -> list[np.ndarray]:
    """Windows that are the second of their text, the third, and so on."""
    order = np.argsort(place, kind="stable")
    return np.split(order, np.searchsorted(place[order], np.arange(1, place.max() + 1)))[1:] if len(place) else []


class Field:
    """Weights are those of state 1 against state 0."""

    def __init__(self):
        self.heads = np.zeros((len(HEADS), WORDS))
        self.word, self.before, self.after = np.zeros(WORDS), np.zeros(CONTEXT), np.zeros(CONTEXT)
        self.shape, self.bias, self.move = np.zeros(SHAPES), np.array([-5.0]), np.array([[0.0, 0.0], [0.0, 0.0]])
        self.calibration, self.prior = np.array([-3.0, 0.0, 0.0]), None

    def shrink(self) -> Field:
        for k in ("word", "heads", "before", "after"):
            setattr(self, k, getattr(self, k).astype(np.float32))
        return self

    def emission(self, word: np.ndarray, parts: list[np.ndarray], shape: np.ndarray, of: np.ndarray) -> np.ndarray:
        e = self.word[word] + self.shape[shape] + self.bias[0]
        for head, part in zip(self.heads, parts, strict=True):
            e += head[part]
        if len(word) > 1:
            same = of[1:] == of[:-1]
            e[1:] += np.where(same, self.before[word[:-1] % CONTEXT], 0)
            e[:-1] += np.where(same, self.after[word[1:] % CONTEXT], 0)
        return e

    def forward_backward(self, e: np.ndarray, row: np.ndarray, col: np.ndarray, want_moves: bool = False, place: np.ndarray | None = None):
        """Chance of state 1 for each token, the log of the partition function of each window's chain up to its end less that up to its start, and expected moves.

        place: number of each window in its text, whose windows follow one another; each window is a text of its own without it.
        Windows advance together. A first pass gives each window's messages for both states that may come before it; a scan over the
        windows of a text links them, so that the chain of a text is whole."""
        n = int(row[-1]) + 1 if len(row) else 0
        place = np.zeros(n, np.int64) if place is None else place
        grid, full = np.zeros((WINDOW, n)), np.zeros((WINDOW, n), bool)
        grid[col, row], full[col, row] = e, True
        m = np.exp(self.move)
        odds = np.exp(np.clip(grid, -30, 30))
        begins = place == 0
        # f[t][i][j]: from state i before the window to state j at t, both i to one scale; before a text's first token stands state 0, for nothing
        f = np.empty((WINDOW, 2, 2, n))
        f[0] = [[np.where(begins, 1, m[0, 0]), np.where(begins, 1, m[0, 1]) * odds[0]], [np.where(begins, 0, m[1, 0]), np.where(begins, 0, m[1, 1]) * odds[0]]]
        scale = np.zeros(n)
        for t in range(WINDOW):
            if t:
                live = full[t]
                f[t, :, 0] = np.where(live, f[t - 1, :, 0] * m[0, 0] + f[t - 1, :, 1] * m[1, 0], f[t - 1, :, 0])
                f[t, :, 1] = np.where(live, (f[t - 1, :, 0] * m[0, 1] + f[t - 1, :, 1] * m[1, 1]) * odds[t], f[t - 1, :, 1])
            total = f[t].sum((0, 1))
            f[t] /= total
            scale += np.log(total)
        steps = _steps(place)
        before = np.stack([np.ones(n), np.zeros(n)])
        for now in steps:
            x = np.einsum("in,ijn->jn", before[:, now - 1], f[-1][:, :, now - 1])
            before[:, now] = x / x.sum(0)
        a = np.einsum("in,tijn->tjn", before, f)
        log_z = scale + np.log(a[-1].sum(0))
        after = np.ones((2, n))
        for now in steps[::-1]:
            x = np.einsum("ijn,jn->in", f[-1][:, :, now], after[:, now])
            after[:, now - 1] = x / x.sum(0)
        b0, b1 = after
        out, moves = np.empty((WINDOW, n)), np.zeros((2, 2))
        for t in range(WINDOW - 1, -1, -1):
            g0, g1 = a[t, 0] * b0, a[t, 1] * b1
            out[t] = g1 / (g0 + g1)
            live, w = full[t], b1 * odds[t]
            if want_moves:
                p = a[t - 1] if t else before
                x = [[p[0] * m[0, 0] * b0, p[0] * m[0, 1] * w], [p[1] * m[1, 0] * b0, p[1] * m[1, 1] * w]]
                s = np.where(live if t else ~begins, 1 / (x[0][0] + x[0][1] + x[1][0] + x[1][1]), 0)
                moves += [[(x[i][j] * s).sum() for j in (0, 1)] for i in (0, 1)]
            if t:
                c0, c1 = m[0, 0] * b0 + m[0, 1] * w, m[1, 0] * b0 + m[1, 1] * w
                s = c0 + c1
                b0, b1 = np.where(live, c0 / s, b0), np.where(live, c1 / s, b1)
        return out[col, row], log_z, moves

    def fit(self, word: np.ndarray, parts: list[np.ndarray], shape: np.ndarray, of: np.ndarray, tag: np.ndarray, rounds: int = 50) -> Field:
        """Full-batch ascent of the likelihood over all texts, TEXTS at a time."""
        row, col = chains(of)
        edges = np.unique([*np.searchsorted(of, np.arange(0, (of[-1] if len(of) else 0) + 1, TEXTS)), len(of)])
        names = ("word", "heads", "before", "after", "shape", "bias", "move")
        adam = Adam([getattr(self, k) for k in names])
        for r in range(rounds):
            adam.rate = 0.6 * (1 - r / rounds) + 0.02
            grads = [0.05 * getattr(self, k) for k in names]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                w, s, o, y, heads = word[lo:hi], shape[lo:hi], of[lo:hi], tag[lo:hi], [x[lo:hi] for x in parts]
                p, _, moves = self.forward_backward(self.emission(w, heads, s, o), row[lo:hi] - row[lo], col[lo:hi], True, _places(o, row[lo:hi]))
                d = p - y
                grads[0] += np.bincount(w, d, minlength=WORDS)
                for g, x in zip(grads[1], heads, strict=True):
                    g += np.bincount(x, d, minlength=WORDS)
                same = o[1:] == o[:-1]
                grads[2] += np.bincount(w[:-1][same] % CONTEXT, d[1:][same], minlength=CONTEXT)
                grads[3] += np.bincount(w[1:][same] % CONTEXT, d[:-1][same], minlength=CONTEXT)
                grads[4] += np.bincount(s, d, minlength=SHAPES)
                grads[5] += d.sum()
                grads[6] += moves - np.bincount(2 * y[:-1][same] + y[1:][same], minlength=4).reshape(2, 2)
            for i, k in ((2, "before"), (3, "after")):
                grads[i] += 0.5 * getattr(self, k)
            adam.step(grads)
        return self

    def marginals(self, t: Tokens) -> np.ndarray:
        return self.chances(t.word, t.parts, t.shape, t.of)

    def chances(self, word: np.ndarray, parts: list[np.ndarray], shape: np.ndarray, of: np.ndarray) -> np.ndarray:
        row, col = chains(of)
        return self.forward_backward(self.emission(word, parts, shape, of), row, col, place=_places(of, row))[0] if len(row) else np.zeros(0)


def pooled(p: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Columns: 1, the largest marginal, the log of the sum of squared marginals: the small ones of a long text don't add up to a large one."""
    top = np.zeros(n)
    np.maximum.at(top, of, p)
    return np.stack([np.ones(n), top, np.log1p(np.bincount(of, p * p, minlength=n))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.01 * w)
    return w


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_of(batch)
        for lo, hi in slices(offsets, SLICE):
            own = offsets[lo : hi + 1]
            t = Tokens(data[own[0] : own[-1]], own - own[0])
            at = pa.array(np.searchsorted(t.of, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array((x * SHAPES + t.shape).astype(np.int32))) for x in (t.word, *t.parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists], names=["doc_id", "label", *_CODES])


_CODES = ("word", *(f"head{n}" for n in HEADS))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    ids = labelled(labels, "toxic", sample, fold(F.col("doc_id"), FOLDS) != HELD)
    schema = "doc_id long, label int" + "".join(f", {c} array<int>" for c in _CODES)
    t = sampled(bounded(docs), ids, LONGEST).select("doc_id", "text", "label").mapInArrow(freed(_tokens), schema).toArrow().sort_by("doc_id").combine_chunks()
    y = t["label"].to_numpy() if t.num_rows else np.zeros(0)
    field = Field()
    if len(np.unique(y)) < 2:
        field.prior = float(y.mean()) if len(y) else 0.0
        return field.shrink()
    columns = [t[c].combine_chunks() for c in _CODES]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    at = np.asarray(columns[0].offsets)
    of = np.repeat(np.arange(len(y)), np.diff(at))
    codes = [np.asarray(c.flatten()) for c in columns]
    del t, columns
    shape, (word, *parts) = codes[0] % SHAPES, [c // SHAPES for c in codes]
    marked = np.zeros(len(of), bool)
    for x in (word, *parts):
        marked |= _telling(of, x.astype(np.int64), word, y)[x]
    del codes
    tag = (marked & (y[of] == 1)).astype(np.int64)
    field.fit(word, parts, shape, of, tag)
    p = np.zeros(len(of))
    for lo in range(0, len(y), TEXTS):
        a, b = at[lo], at[min(lo + TEXTS, len(y))]
        p[a:b] = field.chances(word[a:b], [x[a:b] for x in parts], shape[a:b], of[a:b])
    field.calibration = _logistic(pooled(p, of, len(y)), y)
    return field.shrink()


def _telling(of: np.ndarray, bucket: np.ndarray, word: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets found mostly in toxic documents, and there after many different words, as no phrase is that only copies of a few documents share."""
    before = np.full(len(word), WORDS)
    before[1:] = np.where(of[1:] == of[:-1], word[:-1], WORDS)
    pair = bucket * (WORDS + 1) + before
    count = lambda x: np.bincount(np.unique(x) // (WORDS + 1), minlength=WORDS)
    bad = count(pair[y[of] == 1])
    return (bad >= np.maximum(3, FREQUENT * y.sum())) & (bad > 0.7 * (bad + count(pair[y[of] == 0])))


def _spans(data: np.ndarray, offsets: np.ndarray, t: Tokens, p: np.ndarray) -> list[str]:
    """start:end in code points of the runs of likely tokens of each text."""
    out: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
    hit = np.flatnonzero(p >= SPAN)
    if len(hit):
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = np.ones(len(hit), bool)
        first[1:] = (hit[1:] != hit[:-1] + 1) | (t.of[hit[1:]] != t.of[hit[:-1]])
        last = np.append(first[1:], True)
        for a, b in zip(hit[first], hit[last], strict=True):
            base = points[offsets[t.of[a]]]
            out[t.of[a]].append(f"{points[t.starts[a]] - base}:{points[t.ends[b]] - base}")
    return [",".join(x) for x in out]


def _score(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch)
            for lo, hi in slices(offsets, SLICE):
                own = offsets[lo : hi + 1]
                part, at = data[own[0] : own[-1]], own - own[0]
                if field.prior is not None:
                    score, spans = np.full(hi - lo, field.prior), [""] * (hi - lo)
                else:
                    t = Tokens(part, at)
                    p = field.marginals(t)
                    score, spans = sigmoid(pooled(p, t.of, hi - lo) @ field.calibration), _spans(part, at, t, p)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the toxic spans (code points, end exclusive) of each row."""
    scored = docs.select("doc_id", "text").mapInArrow(freed(_score(train(docs, labels, sample))), "doc_id long, score double, spans string")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
