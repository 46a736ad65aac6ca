"""Secret scans: fixed patterns, and a character network over further candidates.

The patterns' findings are the base; they stay whatever the network says. Candidates
are all runs of key characters, from the least length of the base findings on, that no
base finding touches. The network sees each candidate within its surroundings:
characters are embedded, convolved, pooled by their maximum and put through a logistic
output. Over a candidate of more than INSIDE characters it slides by half of that, and
the highest output counts.

All documents are read for its labels. The values of the base findings, with keyword
and assignment cut out, are positive; candidates that no base finding touches and one
ordinary shorter run of each document are negative; a window that is both is positive. A bit of a window's hash says
whether it is learned from or held out; of few windows, every other one is. The network begins with the FINDINGS windows of each of the three kinds with
the least hashes; where there are more, each window that is learned from is then learned from once more or for the first time, by
trainers of about PART windows, dealt by hash, whose networks are averaged. All windows held out count for the calibration of the output to a
probability, and the threshold is the highest that keeps RECALL of all positive ones among them. Candidates that reach it are added as kind `cnn`.

Defined results: a null text is empty, and like an empty one has no spans and the hash
of the empty text. Very long texts are scanned whole. Only a table without any base
finding, or without any other run, has no network; a warning is logged then and nothing is
added. Repeated rows give equal results; of tied hashes the smaller window is learned from,
and spans that begin together go by kind. An empty table gives no rows. Extra columns play
no part in the scan and pass through a redaction.
"""

from __future__ import annotations

import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import Adam, Scratch, bounded, sigmoid, freed

# Patterns and least lengths of the base findings.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: An ordinary run, shorter than any candidate.
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{4,11}(?![A-Za-z0-9+/_.=-])")
#: Windows of each kind that the network begins with, and windows of one trainer after that.
FINDINGS = 3000
PART = 16384
#: Logits are counted by steps of 1 / STEPS for the calibration.
STEPS = 64
RECALL = 0.95
AROUND, INSIDE = 20, 48
WIDE = AROUND + INSIDE + AROUND
EMBED, FILTERS, KERNEL = 8, 24, 5
REDACTED = "[SECRET]"

Span = tuple[int, int, str]
_HEX16 = re.compile(r"[0-9a-f]{16,}")  # the runs of HEX that are long enough: runs are maximal from left to right


def base_spans(text: str) -> list[Span]:
    """Base findings by start, then kind as listed."""
    out: list[Span] = [(m.start(), m.end(), "hex") for m in _HEX16.finditer(text)]
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[Span]) -> list[Span]:
    out, i, ends = [], 0, sorted(base)
    for m in CANDIDATE.finditer(text):
        while i < len(ends) and ends[i][1] <= m.start():
            i += 1
        if i == len(ends) or ends[i][0] >= m.end():  # the next finding that ends after the run's start begins after its end
            out.append((m.start(), m.end(), "cnn"))
    return out


def windows(before: str, s: str, after: str) -> list[bytes]:
    """The candidate between its surroundings as WIDE codes; all of a long one in several windows, the last at its end."""
    whole = (before[-AROUND:].rjust(AROUND) + s.ljust(INSIDE) + after[:AROUND].ljust(AROUND)).encode("ascii", "replace").replace(b"\n", b" ")
    last = len(whole) - WIDE
    return [whole[i : i + WIDE] for i in [*range(0, last, INSIDE // 2), last]]


def _around(text: str, start: int, end: int) -> list[bytes]:
    return windows(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])


def values(text: str, base: list[Span]) -> Iterator[list[bytes]]:
    """Windows of the values found, with keyword, assignment and quote cut out; a value that two patterns find counts once."""
    assigned = [s for s in base if s[2] == "assign"]
    for a, b, kind in base:
        if kind == "assign":
            quoted = text[b : b + 1] in ("'", '"')
            yield windows(text[max(0, a - AROUND) : a], ASSIGN.match(text, a)[2], text[b + quoted : b + quoted + AROUND])
        elif not any(x < b and a < y for x, y, _ in assigned):
            yield _around(text, a, b)


def _codes(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDE).astype(np.int64) & 127


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 0.5, (128, EMBED)), r.normal(0, 0.2, (KERNEL * EMBED, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.3, FILTERS), np.zeros(1)]
        self.threshold: float | None = None

    def _forward(self, x: np.ndarray):
        e, k, b, o, c = self.w
        v = np.lib.stride_tricks.sliding_window_view(e[x], KERNEL, axis=1)  # n, positions, EMBED, KERNEL
        v = v.transpose(0, 1, 3, 2).reshape(len(x), -1, KERNEL * EMBED)
        h = v @ k + b
        at = h.argmax(1)
        top = np.maximum(np.take_along_axis(h, at[:, None], 1)[:, 0], 0)
        return v, at, top, sigmoid(top @ o + c[0])

    def score(self, windows: list[bytes]) -> np.ndarray:
        e, k, b, o, c = self.w
        # a character's part in the convolution depends on its code and place alone
        place = [(e @ k[i * EMBED : (i + 1) * EMBED]).astype(np.float32) for i in range(KERNEL)]
        n = WIDE - KERNEL + 1
        out = np.empty(len(windows))
        for lo in range(0, len(windows), 256):
            x = _codes(windows[lo : lo + 256])
            h = place[0][x[:, :n]]
            for i in range(1, KERNEL):
                h += place[i][x[:, i : i + n]]
            out[lo : lo + 256] = sigmoid(np.maximum(h.max(1) + b, 0) @ o + c[0])
        return out

    def fit(self, windows: list[bytes], y: np.ndarray, held: np.ndarray | None = None, epochs: int = 12, size: int = 64) -> Network:
        """Learns from the windows that aren't held out; the rest calibrate the output and set the threshold. held: left out, every other one."""
        if len(np.unique(y)) < 2:
            return self
        if held is None or min(len(np.unique(y[held])), len(np.unique(y[~held]))) < 2:
            held = np.zeros(len(y), bool)
            for label in (0, 1):
                held[y == label] = np.arange((y == label).sum()) % 2 == 1
        x, learn, held = _codes(windows), np.flatnonzero(~held), np.flatnonzero(held)
        if len(np.unique(y[held])) < 2:  # a single window of a kind can't be held out
            held = np.arange(len(y))
        self.learn(x[learn], y[learn], y[learn].mean(), 0.005, epochs, size)
        out = [windows[i] for i in held]
        self.calibrate(logits(self.score(out)), y[held], np.ones(len(held)))
        p = np.sort(self.score([w for w, label in zip(out, y[held], strict=True) if label == 1]))
        self.threshold = float(p[int((1 - RECALL) * len(p))])
        return self

    def learn(self, x: np.ndarray, y: np.ndarray, share: float, rate: float, epochs: int, size: int = 64) -> None:
        """share: of positive windows among all that are learned from; both labels weigh the same there."""
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        adam, rng = Adam(self.w, rate), np.random.default_rng(3)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), size):
                self._step(adam, x[order[lo : lo + size]], y[order[lo : lo + size]], weight[order[lo : lo + size]])

    def calibrate(self, logit: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        """Platt scaling by Newton steps, both labels with equal weight; it becomes part of the output layer. times: how often each logit is there."""
        z = np.stack([logit, np.ones(len(logit))], 1)
        n = times[y == 1].sum(), times[y == 0].sum()
        aim = np.where(y == 1, (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2))
        weight = times * np.where(y == 1, 0.5 / n[0], 0.5 / n[1])
        loss = lambda ab: (weight * (np.logaddexp(0, z @ ab) - aim * (z @ ab))).sum()
        ab = np.array([1.0, 0.0])
        for _ in range(50):
            q = sigmoid(z @ ab)
            step = np.linalg.solve((z * (weight * q * (1 - q))[:, None]).T @ z + 1e-9 * np.eye(2), z.T @ (weight * (q - aim)))
            while loss(ab - step) > loss(ab) and np.abs(step).max() > 1e-9:
                step = step / 2
            ab = ab - step
        if ab[0] > 0:
            self.w[3], self.w[4] = ab[0] * self.w[3], ab[0] * self.w[4] + ab[1]

    def _step(self, adam: Adam, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        e, k, _, o, _ = self.w
        v, at, top, p = self._forward(x)
        d = (p - y) * weight / len(y)
        dh = d[:, None] * o * (top > 0)
        rows = v[np.arange(len(x))[:, None], at]  # n, FILTERS, KERNEL * EMBED
        dk = np.einsum("nf,nfi->if", dh, rows)
        de = np.zeros_like(e)
        back = (dh[:, :, None] * k.T).reshape(len(x), FILTERS, KERNEL, EMBED)
        place = at[:, :, None] + np.arange(KERNEL)
        np.add.at(de, x[np.arange(len(x))[:, None, None], place], back)
        adam.step([g + 1e-4 * w for g, w in zip([de, dk, dh.sum(0), top.T @ d, d.sum(keepdims=True)], self.w, strict=True)])


def logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def _ordinary(text: str) -> list[bytes]:
    m = ORDINARY.search(text, zlib.crc32(text[:256].encode("utf-8", "replace")) % (len(text) + 1)) or ORDINARY.search(text)
    return _around(text, m.start(), m.end()) if m else []


#: kind 2: values of base findings, 1: other candidates, 0: ordinary runs.
FOUND = "kind int, h long, window binary"


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds: list[dict[bytes, None]] = [{}, {}, {}]  # each window once
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            base = base_spans(text)
            for w in values(text, base):
                kinds[2].update(dict.fromkeys(w))
            for a, b, _ in candidates(text, base):
                kinds[1].update(dict.fromkeys(_around(text, a, b)))
            kinds[0].update(dict.fromkeys(_ordinary(text)))
        rows = [(k, zlib.crc32(w), w) for k, x in enumerate(kinds) for w in x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["kind", "h", "window"])


#: Whether a window is held out.
HELD = "(h >> 7) % 2 = 1"


def train(docs: DataFrame) -> Network:
    """A network that has learned from the windows of all documents that aren't held out; the others set its threshold."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.stage(bounded(docs).select("text").mapInArrow(freed(_findings), FOUND))
    rows = scratch.stage(found.groupBy("window").agg(F.max("kind").alias("kind"), F.max("h").alias("h")))
    scratch.drop(found)
    first = [rows.filter(F.col("kind") == k).orderBy("h", "window").limit(FINDINGS).select("h", "window").toArrow() for k in range(3)]
    kept = [w for t in first for w in t["window"].to_pylist()]
    y, h = np.repeat([0, 0, 1], [len(t) for t in first]), np.concatenate([t["h"].to_numpy() for t in first])
    n = {(r["held"], r["y"]): r["count"] for r in _labelled(rows).groupBy("held", "y").count().collect()}
    whole = sum(n.values()) == len(kept)
    network = Network().fit(kept, y, None if whole else (h >> 7) % 2 == 1)
    if network.threshold is None:
        logging.getLogger(__name__).warning("no network fitted: %d values of base findings, %d other runs; only the fixed patterns are applied", y.sum(), len(y) - y.sum())
    elif not whole and len(n) == 4:
        network = _learned(network, _labelled(rows), n, scratch)
    scratch.drop(rows)
    return network


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.select("h", "window", F.expr(HELD).alias("held"), (F.col("kind") == 2).cast("int").alias("y"))


def _learned(network: Network, rows: DataFrame, n: dict[tuple[bool, int], int], scratch: Scratch) -> Network:
    """The mean of the networks that trainers make of network, each from its own windows; calibration and threshold from all windows held out."""
    trainers = -(-(n[False, 0] + n[False, 1]) // PART)
    own = rows.filter(~F.col("held")).select(F.pmod(F.xxhash64("window"), F.lit(trainers)).alias("trainer"), "h", "window", "y")
    dealt = own.repartition(trainers, "trainer").sortWithinPartitions("trainer", "h", "window").select("trainer", "y", "window")
    made = dealt.mapInArrow(freed(_trained(network, n[False, 1] / (n[False, 0] + n[False, 1]))), "trainer long, n long, w binary").collect()
    total, sizes = 0, [w.size for w in network.w]
    for r in sorted(made, key=lambda r: r["trainer"]):
        total = total + r["n"] * np.frombuffer(r["w"], np.float64)
    mean = total / sum(r["n"] for r in made)
    network.w = [part.reshape(w.shape) for part, w in zip(np.split(mean, np.cumsum(sizes)[:-1]), network.w, strict=True)]
    held = rows.filter("held").select("y", "window")
    step = F.round(F.ln(F.greatest("p", F.lit(1e-12)) / F.greatest(1 - F.col("p"), F.lit(1e-12))) * STEPS).cast("int")
    counts = np.array(held.mapInArrow(freed(_scored(network)), "y int, p double").groupBy("y", step.alias("step")).count().orderBy("y", "step").collect())
    network.calibrate(counts[:, 1] / STEPS, counts[:, 0], counts[:, 2].astype(float))
    p = held.filter("y = 1").mapInArrow(freed(_scored(network)), "y int, p double")
    network.threshold = p.orderBy("p").limit(int((1 - RECALL) * n[True, 1]) + 1).agg(F.max("p")).first()[0]
    return network


def _trained(network: Network, share: float):
    """Over rows by trainer: what each trainer makes of the network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, y = None, [], []

        def done() -> pa.RecordBatch:
            own = Network()
            own.w = [w.copy() for w in network.w]
            own.learn(_codes(windows), np.array(y), share, 0.001, 1)
            w = np.concatenate([x.ravel() for x in own.w]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(y)], pa.int64()), pa.array([w], pa.binary())], names=["trainer", "n", "w"])

        for batch in batches:
            for trainer, label, window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if trainer != now and windows:
                    yield done()
                    windows, y = [], []
                now = trainer
                windows.append(window)
                y.append(label)
        if windows:
            yield done()

    return run


def _scored(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(batch.column(1).to_pylist()), pa.float64())], names=["y", "p"])

    return run


def find(texts: list[str | None], network: Network) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t or "") for t in texts]
    if network.threshold is None:
        return [(b, b) for b in base]
    more = [candidates(t or "", b) for t, b in zip(texts, base, strict=True)]
    seen = [_around(t, s[0], s[1]) for t, c in zip(texts, more, strict=True) for s in c]
    p = network.score([w for ws in seen for w in ws])
    if seen:
        p = np.maximum.reduceat(p, np.cumsum([0, *map(len, seen[:-1])]))
    out, at = [], 0
    for b, c in zip(base, more, strict=True):
        added = [s for s, x in zip(c, p[at : at + len(c)], strict=True) if x >= network.threshold]
        at += len(c)
        out.append((b, sorted(b + added, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def _scan(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(batch.column(1).to_pylist(), network)
            counts = [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS[:3]]
            sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(s) for _, s in found], pa.string()), pa.array([len(s) - len(b) for b, s in found], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(freed(_scan(train(docs))), SCANNED)


def redact_text(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b > at:
            out += [text[at : max(a, at)], REDACTED if a >= at else ""]
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows of docs with their columns; every finding in a text gives way to a mark. n_chars, if there, follows the text."""
    network, names = train(docs), docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = pa.array([redact_text(t, s) if s else t for t, (_, s) in zip(texts, find(texts, network), strict=True)], pa.string())
            columns = list(batch.columns)
            columns[at] = new
            if count is not None:
                columns[count] = pc.utf8_length(new).cast(batch.column(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(freed(run), docs.schema)
