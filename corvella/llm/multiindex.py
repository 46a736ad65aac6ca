"""Near-duplicate vectors by an inverted multi-index.

Equal vectors are collapsed to one with a count. Two codebooks, one for each half of
the dimensions, are learned from a bounded sample (SAMPLE vectors, or 16 for each
centroid where the books are large); the pairs of their centroids are the cells of a product grid and every vector is filed in its
nearest cell. A query visits cells by the multi-sequence order: by the sum of its two
half distances, nearest first. The number of cells visited is set on QUERIES vectors
that no codebook was learned from and that are compared with all rows: for each of their near pairs it is told exactly from
which number of visits on the two meet, and the least power of two counts at which the
mean recall of a query reaches the target, with a margin of two. Each query weighs the
same, however many neighbours it has (of those, at most NEIGHBOURS in each block of rows
are looked at). Where so many visits would file more rows than the comparison of all
blocks with all others, or where no query has a neighbour, so that no recall can be
measured, all rows are filed in one cell, which compares them exactly. Pairs that meet
in a cell are verified by cosine in double precision.

A task compares a cell's filed vectors with the cell's visitors, block against block
where a cell is large, and returns each vector's number of links and a spanning
forest. A pair that meets in two cells counts in the smaller one only, which both
rows tell from their own list of cells.

Vectors of different lengths are never compared. The INDEXED most frequent lengths have
an index each; the vectors of any other length, and those of a length with at most BLOCK
vectors, are compared with one another exactly.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing. Very long vectors are vectors of their length. A null vec_id
takes no part; its row has null component and is not kept. Repeated rows count as other
vectors, ties as links. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import Scratch, by_group, group_starts, local_roots, freed
from corvella.llm.components import components

COSINE = 0.9
SAMPLE = 8192
#: Vectors whose neighbours among all rows set the number of visits.
QUERIES = 512
NEIGHBOURS = 64
RECALL = 0.99
BLOCK = 1024
#: Vectors of a cell on average, from which the size of the codebooks follows.
FILED = 8
CENTROIDS = 4096
INDEXED = 8


def components_of(df: DataFrame, vector: str) -> str:
    """Type of the components in the plan: float stays, which doubles hold exactly; all others are doubles."""
    return "float" if dict(df.dtypes)[vector] == "array<float>" else "double"


def valid(vector: str):
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(x[lo : lo + 4096], c).argmin(1) for lo in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def centroids(rows: int) -> int:
    return int(np.clip(np.sqrt(rows / FILED), 1, CENTROIDS))


class Index:
    """Codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.half = sample.shape[1] // 2
        self.dimension = sample.shape[1]
        k = centroids(rows)
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)]
        self.rows, self.visits = rows, 1

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def compare_all(self) -> None:
        """One cell for all rows: its blocks are compared with one another."""
        self.books, self.visits = [b[:1] for b in self.books], 1

    def needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each row of x and of y, from which number of visits on the two meet: how many cells come no later than the one's own cell in
        the other's order, the lesser of both ways. Ties count as earlier, so the number is never too small."""
        own = [[_distances(z[:, h], b).argmin(1) for h, b in zip((slice(None, self.half), slice(self.half, None)), self.books, strict=True)] for z in (x, y)]
        best = np.full(len(x), self.cells, np.int64)
        for z, cell in ((x, own[1]), (y, own[0])):
            d = [_distances(z[:, : self.half], self.books[0]), _distances(z[:, self.half :], self.books[1])]
            for i in range(len(z)):
                most = d[0][i, cell[0][i]] + d[1][i, cell[1][i]] + 1e-12
                best[i] = min(best[i], np.searchsorted(np.sort(d[1][i]), most - d[0][i], "right").sum())
        return best

    def set_visits(self, pairs: list[tuple[int, int, int]], recall: float = RECALL) -> None:
        """pairs: (query, power of two from which on a pair meets, weight)."""
        if not pairs:
            return self.compare_all()
        query, power, weight = (np.array(x) for x in zip(*pairs, strict=True))
        _, at = np.unique(query, return_inverse=True)
        part = weight / np.bincount(at, weight)[at]
        met = np.cumsum(np.bincount(power, part)) / (at.max() + 1)
        self.visits = min(2 << int(np.flatnonzero(met >= recall - 1e-9)[0]), self.cells)
        # a row is filed `visits` times here, and there in each block as a filed vector and as a visitor
        if self.visits > 8 and self.visits >= 2 * -(-self.rows // BLOCK):
            self.compare_all()

    def visit(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector in multi-sequence order: among each half's n nearest centroids, the n least sums."""
        k = len(self.books[1])
        d = [_distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])]
        w = [min(n, len(b)) for b in self.books]
        order = [np.argsort(a, axis=1, kind="stable")[:, :m] for a, m in zip(d, w, strict=True)]
        best = [np.take_along_axis(a, o, 1) for a, o in zip(d, order, strict=True)]
        # (i, j) can be among the n least only if (i + 1) * (j + 1) <= n: each smaller pair comes before it
        i, j = np.nonzero(np.outer(np.arange(1, w[0] + 1), np.arange(1, w[1] + 1)) <= n)
        total = best[0][:, i] + best[1][:, j]
        first = np.argsort(total, axis=1, kind="stable")[:, :n]
        return (order[0][:, i].astype(np.int64) * k + order[1][:, j])[np.arange(len(x))[:, None], first]


def _measure(index: Index, ids: np.ndarray, queries: np.ndarray):
    """(id, times, vector) → (query, power, weight) of pairs of a query and a row that are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                batch = batch.filter(pa.array(np.diff(np.asarray(batch.column(2).offsets)) == index.dimension))
                if not batch.num_rows:
                    continue
                x, own = unit(matrix(batch.column(2))), batch.column(0).to_numpy()
                q, j = np.nonzero((queries @ x.T >= COSINE) & (ids[:, None] != own))
                first = np.searchsorted(q, q)
                count = np.bincount(q, minlength=len(ids))
                # of many neighbours of a query, NEIGHBOURS stand for all, at equal steps
                step = np.maximum(1, -(-count[q] // NEIGHBOURS))
                some = (np.arange(len(q)) - first) % step == 0
                q, j = q[some], j[some]
                weight = count[q] / np.bincount(q, minlength=len(ids))[q]
                power = np.ceil(np.log2(np.maximum(index.needed(queries[q], x[j]), 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(power), pa.array(weight)], names=["query", "power", "weight"])

    return run


def calibrate(index: Index, reps: DataFrame, ids: np.ndarray, queries: np.ndarray) -> None:
    near = reps.mapInArrow(freed(_measure(index, ids, queries)), "query int, power int, weight double").groupBy("query", "power").agg(F.sum("weight").alias("weight"))
    index.set_visits([tuple(r) for r in near.collect()])


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.diff(np.asarray(batch.column(column).offsets))
    for n in np.unique(lengths):
        yield int(n), batch.filter(pa.array(lengths == n))


def _file(indexes: dict[int, Index]):
    """(id, times, vector) → a row for each cell that the vector visits; the first is its own. All vectors of a length without index are in one cell."""
    visits = max((x.visits for x in indexes.values()), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = max(1, 16384 // visits)
            for lo in range(0, whole.num_rows, size):
                for dimension, batch in _by_length(whole.slice(lo, size), 2):
                    if index := indexes.get(dimension):
                        cells = index.visit(unit(matrix(batch.column(2))), index.visits)
                    else:
                        cells = np.zeros((batch.num_rows, 1), np.int64)
                    yield rows(batch, cells + (dimension << 32))

    def rows(batch: pa.RecordBatch, cells: np.ndarray) -> pa.RecordBatch:
        n, m = cells.shape
        at = pa.array(np.repeat(np.arange(n), m))
        # the list of all cells goes with the filed row only, the others' is empty
        ends = np.repeat(np.arange(n) * m, m) + np.where(np.tile(np.arange(m) == 0, n), 0, m)
        lists = pa.ListArray.from_arrays(pa.array(np.append(ends, n * m).astype(np.int32)), pa.array(np.sort(cells, axis=1).ravel()))
        return pa.RecordBatch.from_arrays(
            [pa.array(cells.ravel()), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.tile(np.arange(m) == 0, n)), batch.column(2).take(at), lists, pa.array(np.repeat(cells[:, 0], m))],
            names=["cell", "id", "times", "filed", "vector", "cells", "own"],
        )

    return run


FILED_ROWS = "cell long, id long, times long, filed boolean, vector array<{}>, cells array<long>, own long"


def _one_length(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Vectors of a group have one length; those of several groups may not."""
    for t in tables:
        t = t.combine_chunks()
        lengths = pc.list_value_length(t["vector"]).to_numpy()
        for n in np.unique(lengths):
            yield t.filter(pa.array(lengths == n))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _one_length(by_group(batches, "key")):
        keys, ids, times = (t[c].to_numpy() for c in ("key", "id", "times"))
        filed, own, cell, block, seat = (t[c].to_numpy(zero_copy_only=False) if c == "filed" else t[c].to_numpy() for c in ("filed", "own", "cell", "block", "seat"))
        x = unit(matrix(t["vector"]))
        full = np.cumsum(filed) - 1  # rows of `cells`: those of filed vectors
        cells = matrix(t["cells"].filter(pa.array(filed)))
        edges = group_starts(keys)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            c = cell[lo]
            f = np.flatnonzero(filed[lo:hi] & (seat[lo:hi] == 0)) + lo  # the block of filed vectors
            v = np.flatnonzero(seat[lo:hi] == 1) + lo  # a block of visitors, filed ones among them
            if not len(f) or not len(v):
                continue
            i, j = np.nonzero(x[f] @ x[v].T >= COSINE - 1e-12)
            i, j = f[i], v[j]
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= COSINE
            i, j = i[exact], j[exact]
            same = own[j] == c
            # both filed here: once, from the smaller id; else the visitor's pair counts in the smaller of the two cells if its partner visits back
            back = np.zeros(len(i), bool)
            other = np.flatnonzero(~same)
            if len(other):
                back[other] = (cells[full[i[other]]] == own[j[other]][:, None]).any(1)
            keep = np.where(same, ids[i] < ids[j], ~back | (c < own[j]))
            i, j = i[keep], j[keep]
            np.add.at(links, i, times[j])
            np.add.at(links, j, times[i])
            # a filed vector may stand in both seats; its rows are one node
            node, at = np.unique(ids[lo:hi], return_inverse=True)
            part = local_roots(len(node), at[i - lo], at[j - lo])
            root_id = node[part][at]
            root[lo:hi] = np.searchsorted(node, root_id)
            root[lo:hi] = root_id
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], names=["id", "links", "root"])


def fit(reps: DataFrame, count: int) -> Index:
    """An index of vectors of one length."""
    most = max(SAMPLE, 16 * centroids(count))
    sample = reps.orderBy(F.xxhash64(F.lit(4), "id")).limit(most + QUERIES).select("id", "vector").toArrow().combine_chunks()
    x = unit(matrix(sample["vector"]))
    learn = len(x) - min(QUERIES, len(x) // 2)  # the codebooks fit their own vectors better, so the queries are others
    index = Index(x[:learn], count)
    calibrate(index, reps, sample["id"].to_numpy()[learn:], x[learn:])
    return index


def near_duplicates(df: DataFrame, scratch: Scratch | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept."""
    s, kind = scratch or Scratch(df.sparkSession), components_of(df, vector)
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"), valid(vector).alias("ok"))
    good = rows.filter(F.col("ok") & F.col("vec_id").isNotNull())
    reps = s.stage(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")).select("id", "times", "vector"))
    length = F.size("vector")
    counts = reps.groupBy(length.alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(INDEXED).collect()
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    indexes = {r["length"]: fit(reps.filter(length == r["length"]), r["n"]) for r in counts if r["n"] > BLOCK}

    filed = s.stage(reps.mapInArrow(freed(_file(indexes)), FILED_ROWS.format(kind)))
    sizes = filed.groupBy("cell").agg(F.count_if("filed").alias("nf"), F.count("*").alias("nv")).filter("nf > 0 AND nv > 1")
    at = filed.join(sizes, "cell")
    bf, bv = F.ceil(F.col("nf") / BLOCK).cast("int"), F.ceil(F.col("nv") / BLOCK).cast("int")
    h = F.xxhash64(F.lit(6), "id")
    mine_f, mine_v = F.pmod(h, bf).cast("int"), F.pmod(h, bv).cast("int")
    as_filed = F.when(F.col("filed"), F.transform(F.sequence(F.lit(0), bv - 1), lambda v: F.struct(F.xxhash64("cell", mine_f, v).alias("key"), F.lit(0).alias("seat")))).otherwise(F.array().cast("array<struct<key:long,seat:int>>"))
    as_visitor = F.transform(F.sequence(F.lit(0), bf - 1), lambda f: F.struct(F.xxhash64("cell", f, mine_v).alias("key"), F.lit(1).alias("seat")))
    seats = at.withColumn("p", F.explode(F.concat(as_filed, as_visitor))).select("p.key", "p.seat", F.lit(0).alias("block"), "cell", "id", "times", "filed", "own", "vector", "cells")
    met = s.stage(seats.repartition("key").sortWithinPartitions("key").mapInArrow(freed(_compare), "id long, links long, root long"))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), s).withColumnRenamed("node", "id")
    node = reps.join(links, "id", "left").join(roots, "id", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = rows.withColumn("_probe", F.when(F.col("ok") & F.col("vec_id").isNotNull(), F.col("vector"))).drop("vector").withColumnRenamed("_probe", "vector").join(node, "vector", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
