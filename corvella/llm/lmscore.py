"""Masked pseudo-likelihood scores by a bidirectional window network.

The vocabulary is all words of the corpus with their counts. The softmax has two levels:
groups of EACH units, and one group of all other words. The OWN most frequent words are
units of their own; within the group of the others a word is as likely as its count in
the corpus plus one, in proportion. A network with one hidden layer predicts a word's
group, and its unit in the group, from REACH words on both sides, where each of the
other words has one of TAIL places by its hash; its biases begin at the corpus' own
shares. A document's score sums the
conditional log-probabilities of all of its words. The counts of the FREQUENT most
frequent words go to every task; a text's other words meet their counts in a join.

Training in numpy: equal texts are one with a count, which weighs its gradients. The
texts, in parts of PIECE words, are dealt by a hash of their words to trainers of about
POSITIONS positions each (at most TRAINERS of them). Each learns from its texts in the
order of that hash, every position in one of the ROUNDS rounds; weights are averaged by
the number of positions after each. So the model follows from the texts, not from how
the table is partitioned.

Defined results: null, empty and blank texts have no words, a sum of 0 and a null
mean. Very long texts are scored and learned from whole. Repeated rows, and ties of equal
texts, have equal scores: scoring takes sums of doubles on a grid, without rounding, and single exponentials and tangents of them, which follow from
each sum alone. Rows without id are scored and learned from. An empty table
gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import SLICE, Adam, Scratch, bounded, flat, freed, group_starts, mix, slices, span_hashes, text_of, word_bounds

#: The last group is that of all other words.
GROUPS, EACH = 32, 128
OWN = (GROUPS - 1) * EACH
TAIL = EACH
UNITS = OWN + TAIL
REACH, EMBED, HIDDEN = 2, 16, 32
#: Binary places of weights and hidden values in scoring: products of two and their sums are whole multiples of 2**-(2 * GRID) below 2**53, so they have no rounding.
GRID = 18
ROUNDS = 2
BATCH = 4096
#: Positions whose outputs in one group are held at once in scoring, so that they stay in the cache.
HELD_ROWS = 1024
RATE = 0.01
#: Words whose counts every task holds; those of all others are joined.
FREQUENT = 100_000
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000
POSITIONS = 1 << 21
TRAINERS = 4096
PIECE = 1 << 16
#: Parts of the weights, each averaged by a task of its own.
PARTS = 16


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_of(batch)
    for lo, hi in slices(offsets, SLICE):
        own = offsets[lo : hi + 1]
        part, at = data[own[0] : own[-1]], own - own[0]
        starts, ends, of = word_bounds(part, at)
        yield lo, hi, span_hashes(part, starts, ends).view(np.int64), of


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return words, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(words)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    size = 0
    for batch in batches:
        for _, _, h, _ in _words(batch):
            parts.append(np.unique(h, return_counts=True))
            size += len(parts[-1][0])
            if size > HELD:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts.pop()], names=["word", "n"])
                    parts, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)], names=["word", "n"])


def _tail(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(20)).astype(np.int64) % TAIL


class Vocabulary:
    """Units of words, the share of each frequent word among all without a unit of their own, and the counts of all words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, others: int, table: DataFrame):
        """words: the frequent ones, by count; others: sum of the counts plus one of all words without a unit of their own."""
        self.table = table
        self.others = float(np.log(max(others, 1)))
        self.mass = np.concatenate([counts[:OWN] + 1.0, np.ones(OWN - len(counts[:OWN])), [others + 1.0]])
        order = np.argsort(words)
        own = order < OWN
        self.frequent = words[order]
        self.unit = np.where(own, order, OWN + _tail(self.frequent))
        self.count = np.where(own, 0.0, np.log(counts[order] + 1.0))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def units(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit of each word; log of its share in its unit, less the log of the count for words that aren't frequent; and which these are."""
        unit, share, rare = OWN + _tail(h), np.zeros(len(h)), np.ones(len(h), bool)
        if len(self.frequent) and len(h):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            rare = self.frequent[at] != h
            unit, share = np.where(rare, unit, self.unit[at]), np.where(rare, 0.0, self.count[at])
        return unit, np.where(unit < OWN, share, share - self.others), rare


def vocabulary(docs: DataFrame, scratch: Scratch) -> Vocabulary:
    """Exact counts of all words of all documents."""
    counts = scratch.stage(bounded(docs).select("text").mapInArrow(freed(_count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    most = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    words, n = (most[c].to_numpy() for c in ("word", "n"))
    total = counts.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    return Vocabulary(words, n, total - int((n[:OWN] + 1).sum()), counts)


# ---------------------------------------------------------------- the network

SIZES = [(UNITS + 1, EMBED), (2 * REACH * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS - 1, HIDDEN, EACH), (GROUPS - 1, EACH)]


def _place(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each unit, and its number there; all units beyond OWN are in the last group."""
    group, unit = np.divmod(c.astype(np.int64), EACH)
    return np.minimum(group, GROUPS - 1), unit


def _groups(group: np.ndarray, most: int = BATCH) -> Iterator[tuple[int, int, int]]:
    """Each group of sorted positions with its range, in parts of at most `most`, but for the last one, in which no network decides."""
    edges = np.searchsorted(group, np.arange(GROUPS)).tolist()
    for k in range(GROUPS - 1):
        for lo in range(edges[k], edges[k + 1], most):
            yield k, lo, min(lo + most, edges[k + 1])


def _exp(h: np.ndarray, w: np.ndarray, b: np.ndarray, small: bool, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the outputs, and their sums. single: of outputs in doubles, at a third of the time; each follows from its output, and each sum from its row alone."""
    z = h @ w
    z += b
    if not small:
        z -= z.max(1, keepdims=True)
    if single:
        z = np.exp(z, dtype=np.float32, casting="same_kind")
        return z, z.sum(1)
    np.exp(z, out=z)
    return z, z.sum(1) if z.dtype == np.float64 else z @ np.ones(z.shape[1], z.dtype)


def on_grid(x: np.ndarray) -> np.ndarray:
    """Doubles between -16 and 16, rounded to GRID binary places."""
    return np.rint(np.clip(x, -16, 16).astype(np.float64) * 2.0**GRID) / 2.0**GRID


class Network:
    rounded = False

    def __init__(self, weights: np.ndarray | None = None, mass: np.ndarray | None = None):
        """mass: counts of the units, where the biases begin."""
        if weights is None:
            r = np.random.default_rng(1)
            scale = (0.1, 1 / np.sqrt(2 * REACH * EMBED), 0, 0.05, 0, 0.05, 0)
            self.w = [(r.normal(0, x, s) if x else np.zeros(s)).astype(np.float32) for x, s in zip(scale, SIZES, strict=True)]
            if mass is not None:
                each = mass[:OWN].reshape(-1, EACH)
                self.w[4][:] = np.log(np.append(each.sum(1), mass[OWN]) / mass.sum())
                self.w[6][:] = np.log(each / each.sum(1, keepdims=True))
        else:
            ends = np.cumsum([int(np.prod(s)) for s in SIZES])
            self.w = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(weights, ends[:-1]), SIZES, strict=True)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w])

    @staticmethod
    def context(c: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Units of the words around each word; UNITS beyond a text's ends."""
        out = np.full((len(c), 2 * REACH), UNITS, np.uint16)
        for i, d in enumerate([d for d in range(-REACH, REACH + 1) if d]):
            if len(c) > abs(d):
                a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
                out[a, i] = np.where(of[a] == of[b], c[b], UNITS)
        return out

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, w1, b1 = self.w[:3]
        seen = e.take(x.ravel(), axis=0).reshape(len(x), -1)
        h = seen @ w1
        h += b1
        if not self.rounded:
            return seen, np.tanh(h, out=h)
        h = np.multiply(np.tanh(h, dtype=np.float32, casting="same_kind"), 2.0**GRID, dtype=np.float64)
        np.rint(h, out=h)
        h *= 2.0**-GRID
        return seen, h

    def _small(self) -> bool:
        """Whether no output can reach a size at which its exponential overflows; the hidden layer lies within -1 and 1."""
        _, _, _, w2, b2, w3, b3 = self.w
        return max(np.abs(w2).sum(0).max() + np.abs(b2).max(), np.abs(w3).sum(1).max() + np.abs(b3).max()) < 60

    def exact(self) -> Network:
        """The network for scores: doubles on a grid, whose sums don't depend on their order, so that a position's score doesn't depend on those it is batched with."""
        net = object.__new__(Network)
        net.rounded = True
        net.w = [on_grid(x) if i in (0, 1, 3, 5) else x.astype(np.float64) for i, x in enumerate(self.w)]
        return net

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of the targets; of exact() the same in any batch."""
        _, _, _, w2, b2, w3, b3 = self.w
        out, small = np.empty(len(target)), self._small()
        for lo in range(0, len(target), 2 * BATCH):
            group, unit = _place(target[lo : lo + 2 * BATCH])
            order = np.argsort(group.astype(np.uint8), kind="stable")
            group, unit = group[order], unit[order]
            h = self._hidden(context[lo : lo + 2 * BATCH][order])[1]
            q, total = _exp(h, w2, b2, small, self.rounded)
            p = q[np.arange(len(q)), group] / total
            for k, a, b in _groups(group, HELD_ROWS):
                q, total = _exp(h[a:b], w3[k], b3[k], small, self.rounded)
                p[a:b] *= q[np.arange(b - a), unit[a:b]] / total
            out[lo + order] = np.log(np.maximum(p, 1e-37))
        return out

    def learn(self, x: np.ndarray, y: np.ndarray, adam: Adam, weight: np.ndarray | None = None) -> None:
        """One step over a batch of positions."""
        e, w1, _, w2, b2, w3, b3 = self.w
        group, unit = _place(y)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        x, group, unit = x[order], group[order], unit[order]
        weight = ((np.ones(len(y)) if weight is None else weight[order]) / len(y)).astype(w1.dtype)
        small = self._small()
        seen, h = self._hidden(x)
        p, total = _exp(h, w2, b2, small)
        p *= (weight / total)[:, None]
        p[np.arange(len(y)), group] -= weight
        dh, d3, db3 = p @ w2.T, np.zeros_like(w3), np.zeros_like(b3)
        for k, lo, hi in _groups(group):
            near = h[lo:hi]
            q, total = _exp(near, w3[k], b3[k], small)
            q *= (weight[lo:hi] / total)[:, None]
            q[np.arange(hi - lo), unit[lo:hi]] -= weight[lo:hi]
            d3[k], db3[k] = near.T @ q, q.sum(0)
            dh[lo:hi] += q @ w3[k].T
        dh *= 1 - h * h
        back = (dh @ w1.T).reshape(-1, EMBED)
        at = x.ravel()
        order = np.argsort(at, kind="stable")
        first = group_starts(at[order])[:-1]
        de = np.zeros_like(e)
        de[at[order[first]]] = np.add.reduceat(back[order], first, axis=0)
        adam.step([de, seen.T @ dh, dh.sum(0), h.T @ p, p.sum(0), d3, db3])


# ---------------------------------------------------------------- texts as units

CODED = "doc_id long, n_words long, fp long, codes binary, inside double, rare array<long>"


def _code(words: Vocabulary):
    """Units of each text's words, 2 bytes each; a hash of its words; its share inside the units; its words that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, of in _words(batch):
                unit, inside, rare = words.units(h)
                n = np.bincount(of, minlength=hi - lo)
                ends = np.concatenate([[0], np.cumsum(n)])
                place = (np.arange(len(h)) - ends[of]).astype(np.uint64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64) ^ mix(place + np.uint64(1))))])
                fp = (total[ends[1:]] - total[ends[:-1]]).view(np.int64)
                codes = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(unit.astype(np.uint16).tobytes())])
                some = np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=hi - lo))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(some), pa.array(h[rare]))
                share = np.bincount(of, inside, minlength=hi - lo).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(fp), codes, pa.array(share), lists], names=["doc_id", "n_words", "fp", "codes", "inside", "rare"])

    return run


def _units(batch: pa.RecordBatch, name: str = "codes") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their units one after another, the row of each unit and its place in the row."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(name)))
    for lo, hi in slices(offsets, SLICE):
        own = offsets[lo : hi + 1]
        c = np.frombuffer(data[own[0] : own[-1]].tobytes(), np.uint16)
        n = np.diff(own) // 2
        of = np.repeat(np.arange(hi - lo), n)
        yield lo, hi, c, of, np.arange(len(c)) - ((own[:-1] - own[0]) // 2)[of]


# ---------------------------------------------------------------- training


def pieces(coded: DataFrame, trainers: int) -> DataFrame:
    """trainer, fp, part, start, times and units of the parts of all different texts, with REACH words more on either side."""
    once = coded.filter("n_words > 0").groupBy("fp", "n_words").agg(F.count("*").alias("times"), F.first("codes").alias("codes"))
    part = once.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_words - 1) div {PIECE}"))).alias("part"))
    part = part.select("*", F.greatest(F.col("part") * PIECE - REACH, F.lit(0)).alias("start"))
    codes = F.substr("codes", (F.col("start") * 2 + 1).cast("int"), (((F.col("part") + 1) * PIECE + REACH - F.col("start")) * 2).cast("int"))
    return part.select(F.pmod(F.xxhash64("fp", "part"), F.lit(trainers)).cast("int").alias("trainer"), "fp", "part", "start", "times", codes.alias("codes"))


def turns(fp: np.ndarray, place: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each position is learned, by a hash of the text's words and the place in it."""
    return (mix(mix(fp.view(np.uint64)) + place.astype(np.uint64)) % np.uint64(rounds)).astype(np.int64)


class _Trainer:
    """Learns from positions as they come, BATCH at a time."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.net, self.n, self.held, self.size = Network(weights), 0.0, [], 0
        self.adam = Adam(self.net.w, rate)

    def push(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.held.append((x, y, weight))
        self.size += len(y)
        self.n += float(weight.sum())
        if self.size >= BATCH:
            self._learn(BATCH)

    def _learn(self, least: int) -> None:
        x, y, weight = (np.concatenate(c) for c in zip(*self.held, strict=True))
        lo = 0
        while len(y) - lo >= max(least, 1):
            self.net.learn(x[lo : lo + BATCH], y[lo : lo + BATCH], self.adam, weight[lo : lo + BATCH])
            lo += BATCH
        self.held, self.size = [(x[lo:], y[lo:], weight[lo:])], max(0, len(y) - lo)

    def end(self) -> np.ndarray:
        if self.size:
            self._learn(1)
        return self.net.flat()


def _train(weights: np.ndarray, turn: int, rounds: int, copies: float):
    """Pieces sorted by trainer → PARTS parts of each trainer's weights. copies: mean number of a position's copies."""

    def rows(trainer: int, t: _Trainer) -> pa.RecordBatch:
        w = [x.astype(np.float32).tobytes() for x in np.array_split(t.end(), PARTS)]
        return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([trainer] * PARTS, pa.int32()), pa.array([t.n] * PARTS), pa.array(w, pa.binary())], names=["part", "trainer", "n", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, t = -1, None
        for batch in batches:
            trainer, fp, part, start, times = (batch.column(i).to_numpy() for i in range(5))
            for lo, hi, c, of, place in _units(batch):
                x, row = Network.context(c, of), of + lo
                place = place + start[row]
                pick = (place >= part[row] * PIECE) & (place < (part[row] + 1) * PIECE) & (turns(fp[row], place, rounds) == turn)
                edges = group_starts(trainer[lo:hi])
                for a, b in zip(edges[:-1] + lo, edges[1:] + lo, strict=True):
                    if trainer[a] != now:
                        if t is not None:
                            yield rows(now, t)
                        now, t = int(trainer[a]), _Trainer(weights, RATE / (turn + 1))
                    i, j = np.searchsorted(row, (a, b))
                    own = np.flatnonzero(pick[i:j]) + i
                    t.push(x[own], c[own], times[row[own]] / copies)
        if t is not None:
            yield rows(now, t)

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the weights by part, in the order of the trainers."""
    now, n, total = -1, 0.0, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "w"])
    for batch in batches:
        for part, size, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if part != now:
                if now >= 0:
                    yield out()
                now, n, total = part, 0.0, 0.0
            n += size
            total = total + size * np.frombuffer(w.as_buffer(), np.float32).astype(np.float64)
    if now >= 0:
        yield out()


def train(coded: DataFrame, words: Vocabulary, scratch: Scratch, rounds: int = ROUNDS) -> Network:
    net = Network(mass=words.mass)
    total = coded.agg(F.sum("n_words")).first()[0] or 0
    if not total:
        return net.exact()
    trainers = min(TRAINERS, -(-total // POSITIONS))
    part = scratch.stage(pieces(coded, trainers))
    here = F.octet_length("codes").cast("long")
    copies = part.agg((F.sum(here * F.col("times")) / F.sum(here)).alias("c")).first()[0]  # whole numbers: their sums don't depend on the partitions
    weights = net.flat()
    for turn in range(rounds):
        own = part.repartitionByRange(trainers, "trainer").sortWithinPartitions("trainer", "fp", "part").mapInArrow(freed(_train(weights, turn, rounds, copies)), "part int, trainer int, n double, w binary")
        mean = own.repartition("part").sortWithinPartitions("part", "trainer").mapInArrow(freed(_sum), "part int, n double, w binary").collect()
        mean = [(r["part"], np.frombuffer(r["w"], np.float64), r["n"]) for r in mean]
        weights = np.concatenate([w / n for _, w, n in sorted(mean, key=lambda x: x[0])]) if mean[0][2] else weights
    scratch.drop(part)
    return Network(weights).exact()


# ---------------------------------------------------------------- scores

SCORED = "row long, doc_id long, n_words long, part double"


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = batch.column(batch.schema.get_field_index("inside")).to_numpy()
            for lo, hi, c, of, _ in _units(batch):
                total = np.bincount(of, net.log_p(Network.context(c, of), c), minlength=hi - lo) + inside[lo:hi]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(total.astype(np.float64))], names=["row", "doc_id", "n_words", "part"])

    return run


def score(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each document: number of words, summed and mean conditional log-probability."""
    s = scratch or Scratch(docs.sparkSession)
    words = vocabulary(docs, s)
    coded = s.stage(docs.select("doc_id", "text").mapInArrow(freed(_code(words)), CODED).select(F.monotonically_increasing_id().alias("row"), "*"))
    net = train(coded, words, s)
    scored = coded.select("row", "doc_id", "n_words", "codes", "inside").mapInArrow(freed(_score(net)), SCORED)
    each = coded.select("row", F.explode("rare").alias("word")).join(words.table.hint("shuffle_hash"), "word")
    # log(n + 1) in whole billionths, so that sums don't depend on their order
    more = each.groupBy("row").agg(F.sum(F.round(F.log(F.col("n") + 1) * 1e9).cast("long")).alias("more"))
    total = F.col("part") + F.coalesce(F.col("more"), F.lit(0)) / 1e9
    return scored.join(more, "row", "left").select("doc_id", "n_words", total.alias("log_probability"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_probability"))
