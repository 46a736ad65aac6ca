"""Hard-negative mining with a vector-approximation file.

Each component is quantised into one of CELLS cells, whose bounds are quantiles of a
sample (of SAMPLE vectors at most), widened at both ends to the least and greatest of
all values; the file of approximations holds a vector's cells, four bits each, beside
its whole numbers. For an anchor, tables give the least and greatest product with any
value of a cell, for two components at a time; a row's lower and upper score bounds are
sums of table entries. Only rows whose bounds leave open that they enter a result are
scored exactly.

First pass: the nearest POSITIVES rows of an anchor's label. The kth greatest lower
bound of a batch, and the kth exact score so far, rule out rows whose upper bound is
below. Second pass: for each positive, the NEGATIVES best rows of other labels
in its window of scores; rows are ruled out whose bounds lie outside, or below the kth found in it so
far. Both passes keep k rows for each anchor (and positive) and task, and the results of all tasks
are ranked once more. Bounds only ever leave rows out that can't enter, so results
are exact, whatever the data.

Anchors are taken in blocks of ANCHORS, whose vectors go to all tasks; the driver holds their
positives (POSITIVES rows each). Rows are never grouped by label or value, so a frequent label or a large group of copies is
scored where it lies.

Defined results: rows with a null id, label or vector, an empty vector, or null or
non-finite components take no part. Vectors of different lengths aren't compared; very long ones
are compared whole. An anchor's own row is left out; another row with its id is a candidate, and an anchor of its
own if it is one. Ties go to the smaller id. Fewer candidates than asked for give all; a positive without
negatives gives no row. Windows of positives with equal scores are equal; a negative positive score has an empty one.
Numbers so large that scores could pass 2**56 are an error. An empty table gives no rows. Extra columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.llm.common import Scratch, bounded, freed
from corvella.llm.multiindex import components_of
from corvella.llm.topk import whole

POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative's lies.
LOW, HIGH = 50, 95
CELLS = 16
SAMPLE = 4096
ANCHORS = 4096
#: Anchors and rows whose bounds are computed at once, and pairs that are scored at once.
SIDE, ROWS, PAIRS = 256, 2048, 1 << 14
MOST = 1 << 56

FILE = "row long, vec_id long, label long, anchor boolean, codes binary, levels array<long>"


# ---------------------------------------------------------------- the file


def levels(column: pa.Array) -> np.ndarray:
    return np.floor(256.0 * np.asarray(column.flatten()).astype(np.float64)).astype(np.int64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.diff(np.asarray(batch.column(batch.schema.get_field_index(column)).offsets))
    for n in np.unique(lengths):
        yield int(n), batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))


class Cells:
    """Bounds of the cells of vectors of one length: cell c of dimension d holds values from low[d, c] to high[d, c]."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray):
        at = np.sort(sample, axis=0)[(np.arange(1, CELLS) * len(sample)) // CELLS]  # a cell begins with each of these
        self.edges = np.ascontiguousarray(at.T)
        self.low = np.concatenate([least[:, None], self.edges], axis=1).astype(np.float64)
        self.high = np.concatenate([self.edges, most[:, None]], axis=1).astype(np.float64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Two cells a byte, a row for each vector; an odd last dimension has half a byte."""
        cells = np.stack([np.searchsorted(e, x[:, d], "right") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)
        if cells.shape[1] % 2:
            cells = np.concatenate([cells, np.zeros((len(x), 1), np.uint8)], axis=1)
        return cells[:, ::2] * CELLS + cells[:, 1::2]

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of each anchor with the values of two cells, by pair of dimensions and byte: (pair, anchor, 256)."""
        out = []
        a, b = anchors[:, :, None] * self.low, anchors[:, :, None] * self.high
        for one in (np.minimum(a, b), np.maximum(a, b)):
            if one.shape[1] % 2:
                one = np.concatenate([one, np.zeros((len(one), 1, CELLS))], axis=1)
            two = one[:, ::2, :, None] + one[:, 1::2, None, :]
            out.append(np.ascontiguousarray(two.reshape(*two.shape[:2], -1).transpose(1, 0, 2)))
        return out[0], out[1]


def bounds(tables: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper score bounds, anchors × rows, widened by what sums of large doubles may lack."""
    out = []
    for t in tables:
        total = np.zeros((t.shape[1], len(codes)))
        for j, table in enumerate(t):
            total += table[:, codes[:, j]]
        out.append(total)
    slack = 1e-12 * sum(np.abs(t).max(axis=2).sum(axis=0) for t in tables)[:, None]
    return out[0] - slack, out[1] + slack


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest number in each dimension, by length of the vectors; a row for each length and task."""
    seen: dict[int, list[np.ndarray]] = {}
    for whole_batch in batches:
        for n, batch in _by_length(whole_batch, "vector"):
            x = np.floor(256.0 * np.asarray(batch.column(batch.schema.get_field_index("vector")).flatten()).astype(np.float64)).reshape(-1, n)
            now = seen.setdefault(n, [x[0], x[0]])
            seen[n] = [np.minimum(now[0], x.min(0)), np.maximum(now[1], x.max(0))]
    for n, (a, b) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([a.tolist()], pa.list_(pa.float64())), pa.array([b.tolist()], pa.list_(pa.float64()))], names=["length", "least", "most"])


def _approximate(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for n, batch in _by_length(whole_batch, "vector"):
                x = levels(batch.column(batch.schema.get_field_index("vector")))
                codes = [c.tobytes() for c in cells[n].codes(x)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(codes, pa.binary()), lists], names=["row", "vec_id", "label", "anchor", "codes", "levels"])

    return run


# ---------------------------------------------------------------- the passes


class Best:
    """The k best (greatest score, then least id and row) of each group."""

    def __init__(self, k: int):
        self.k, self.rows = k, [np.zeros(0, np.int64) for _ in range(4)]  # group, score, id, row

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        both = [np.concatenate(x) for x in zip(self.rows, (group, score, ids, row), strict=True)]
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        both = [x[order] for x in both]
        rank = np.arange(len(order)) - np.searchsorted(both[0], both[0], "left")
        self.rows = [x[rank < self.k] for x in both]

    def floors(self, n: int) -> np.ndarray:
        """kth score of each of n groups; -inf where there are fewer."""
        out = np.full(n, -np.inf)
        if len(self.rows[0]):
            g, s = self.rows[0], self.rows[1]
            count = np.bincount(g, minlength=n)
            last = np.flatnonzero(np.append(g[1:] != g[:-1], True))
            full = last[count[g[last]] == self.k]
            out[g[full]] = s[full]
        return out


def exact(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of pairs, in whole numbers."""
    return np.concatenate([np.einsum("ij,ij->i", a[i[lo : lo + PAIRS]], x[j[lo : lo + PAIRS]]) for lo in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0, np.int64)


class Anchors:
    """A block of anchors of one length: rows, labels, whole numbers."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, x: np.ndarray, cells: Cells):
        self.row, self.ids, self.label, self.x, self.cells = row, ids, label, x, cells

    def parts(self) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """SIDE anchors of one label at a time, with their tables."""
        for label in np.unique(self.label):
            own = np.flatnonzero(self.label == label)
            for lo in range(0, len(own), SIDE):
                yield own[lo : lo + SIDE], self.cells.tables(self.x[own[lo : lo + SIDE]])

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, id, label, codes, whole numbers) of the rows of this length."""
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                for n, part in _by_length(batch.slice(lo, ROWS), "levels"):
                    if n == self.x.shape[1]:
                        col = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                        codes = np.frombuffer(b"".join(col("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                        yield col("row").to_numpy(), col("vec_id").to_numpy(), col("label").to_numpy(), codes, np.asarray(col("levels").flatten()).reshape(-1, n)


def _nearest(a: Anchors, k: int):
    """Best k rows of each anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, parts = Best(k), None
        for row, ids, label, codes, x in a.rows(batches):
            parts = parts or list(a.parts())
            floors = best.floors(len(a.row))
            for own, tables in parts:
                same = np.flatnonzero(label == a.label[own[0]])
                if not len(same):
                    continue
                low, high = bounds(tables, codes[same])
                mine = a.row[own][:, None] == row[same]
                low[mine] = high[mine] = -np.inf
                floor = floors[own]
                if len(same) > k:
                    floor = np.maximum(floor, np.partition(low, len(same) - k, axis=1)[:, len(same) - k])
                i, j = np.nonzero((high >= floor[:, None]) & ~mine)
                i, j = own[i], same[j]
                best.add(i, exact(a.x, x, i, j), ids[j], row[j])
        g, score, ids, row = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(a.row[g]), pa.array(ids), pa.array(score), pa.array(row)], names=["anchor", "vec_id", "score", "row"])

    return run


def _inside(a: Anchors, at: np.ndarray, rank: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, percent: tuple[int, int]):
    """Best k rows of other labels in the window of each positive: of anchor at[p], with its rank, id and score."""
    slots = int(rank.max())
    lowest, highest = np.full((slots, len(a.row)), np.inf), np.full((slots, len(a.row)), -np.inf)  # slots without a positive admit nothing
    lowest[rank - 1, at], highest[rank - 1, at] = -(-percent[0] * score // 100), percent[1] * score // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, parts = Best(k), None
        for row, rid, label, codes, x in a.rows(batches):
            parts = parts or list(a.parts())
            floors = np.maximum(lowest, best.floors(lowest.size).reshape(lowest.shape))
            for own, tables in parts:
                other = np.flatnonzero(label != a.label[own[0]])
                if not len(other):
                    continue
                low, high = bounds(tables, codes[other])
                may = np.zeros(low.shape, bool)
                for p in range(slots):
                    may |= (high >= floors[p, own, None]) & (low <= highest[p, own, None])
                i, j = np.nonzero(may)
                i, j = own[i], other[j]
                s = exact(a.x, x, i, j)
                for p in range(slots):
                    ok = (s >= floors[p, i]) & (s <= highest[p, i])
                    best.add(i[ok] + p * len(a.row), s[ok], rid[j[ok]], row[j[ok]])
        g, s, rid, row = best.rows
        slot = np.full(lowest.shape, -1)
        slot[rank - 1, at] = np.arange(len(at))
        p = slot.ravel()[g]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.row[at[p]]), pa.array(rank[p].astype(np.int32)), pa.array(a.ids[at[p]]), pa.array(ids[p]), pa.array(score[p]), pa.array(rid), pa.array(s), pa.array(row)],
            names=["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score", "row"],
        )

    return run


FOUND = "anchor long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, row long"


def mine(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: tuple[int, int] = (LOW, HIGH),
    key: str = "vec_id",
    vector: str = "embedding",
    scratch: Scratch | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    s, spark = scratch or Scratch(df.sparkSession), df.sparkSession
    chosen = bounded(df).select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).cast(f"array<{components_of(df, vector)}>").alias("vector"))
    rows = chosen.filter(whole("vector") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = s.stage(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", "vector"))
    ranges = rows.select("vector").mapInArrow(freed(_ranges), "length int, least array<double>, most array<double>")
    each = ranges.select("length", F.posexplode(F.arrays_zip("least", "most")).alias("d", "x")).groupBy("length", "d").agg(F.min("x.least").alias("least"), F.max("x.most").alias("most")).orderBy("length", "d").toArrow()
    cells: dict[int, Cells] = {}
    for n in np.unique(each["length"].to_numpy()).tolist():
        own = each.filter(pa.array(each["length"].to_numpy() == n))
        least, most = own["least"].to_numpy(), own["most"].to_numpy()
        if (np.maximum(np.abs(least), np.abs(most)) ** 2).sum() >= MOST:
            raise ValueError(f"scores of vectors of {n} components can pass {MOST}")
        sample = rows.filter(F.size("vector") == n).orderBy(F.xxhash64(F.lit(11), "row")).limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
        cells[n] = Cells(levels(sample), least.astype(np.int64), most.astype(np.int64))
    file = s.stage(rows.mapInArrow(freed(_approximate(cells)), FILE))
    s.drop(rows)

    found, after = f"{s.root}/negatives", None
    spark.createDataFrame([], FOUND).write.parquet(f"{found}/none")
    while True:
        part = file.filter("anchor") if after is None else file.filter(F.col("anchor") & (F.col("row") > after))
        block = part.orderBy("row").limit(ANCHORS).select("row", "vec_id", "label", "levels").toArrow().combine_chunks()
        if not block.num_rows:
            break
        after = int(block["row"][-1].as_py())
        for batch in block.to_batches():
            for n, own in _by_length(batch, "levels"):
                _block(file, Anchors(*(own.column(i).to_numpy() for i in range(3)), np.asarray(own.column(3).flatten()).reshape(-1, n), cells[n]), positives, negatives, percent, f"{found}/{after}-{n}")
        if block.num_rows < ANCHORS:
            break
    out = spark.read.schema(FOUND).option("recursiveFileLookup", "true").parquet(found)
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "row")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _block(file: DataFrame, a: Anchors, positives: int, negatives: int, percent: tuple[int, int], path: str) -> None:
    rows = file.select("row", "vec_id", "label", "codes", "levels")
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    near = rows.mapInArrow(freed(_nearest(a, positives)), "anchor long, vec_id long, score long, row long").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= positives)
    t = near.select("anchor", "rank", "vec_id", "score").toArrow()
    if not t.num_rows:
        return
    at = np.searchsorted(a.row, t["anchor"].to_numpy())
    order = np.lexsort((t["rank"].to_numpy(), at))
    rank, ids, score = (t[c].to_numpy().astype(np.int64)[order] for c in ("rank", "vec_id", "score"))
    rows.mapInArrow(freed(_inside(a, at[order], rank, ids, score, negatives, percent)), FOUND).write.parquet(path)
