"""Exact nearest rows without reading all of them: cells around pivots, bounded by the triangle inequality.

build() assigns each vector to the nearest of a bounded number of pivots and writes the table
by cell and distance to the pivot, with the least and greatest distance of each cell's
vectors to every pivot (pivots × pivots numbers). For a query q, every vector x of a
cell obeys |d(q, p) - d(x, p)| <= d(q, x) for each pivot p, so the cell's intervals bound its distances
from below. search() reads cells in waves, nearest bound first and each wave twice the one before,
filters each by the distances to its own pivot that can still be near, and stops when the next bound is beyond
the kth distance found. Results are those of a full scan, ties included; how much is read depends on how the
vectors lie.

Pivots are drawn from a sample of SAMPLE vectors at most, far from one another; a cell
is any number of files, as many tasks write it as its rows need. Vectors that are null, empty or hold null or
non-finite components, and those of another length than the first pivot's, are in a cell of their own, which is
never near (a scan puts
distances that are no numbers last).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions import vectors
from corvella.operators.search import _comparable, nearest
from corvella.sources.files import Files

PIVOTS = 64
SAMPLE = 4096
#: Cells of the first wave.
FIRST = 2
#: Relative error of a distance of doubles summed in any order, with room.
SLACK = 1e-9


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n vectors far apart: each next one is the farthest from those before."""
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class PivotIndex:
    """Where the table is, its pivots, and the intervals of its cells."""

    def __init__(self, table: DataFrame, root: str, vector: str, pivots: np.ndarray, cells: dict[int, tuple[np.ndarray, np.ndarray, int]]):
        self.table, self.spark, self.root, self.vector, self.pivots, self.cells = table, table.sparkSession, root, vector, pivots, cells
        self.read_rows = 0  # of the last search: rows of the cells that were read

    def rows(self) -> DataFrame:
        return self.table.drop("_d")

    def _bounds(self, q: np.ndarray) -> tuple[list[tuple[float, int]], np.ndarray]:
        """(lower bound, cell), least first, and the distances to the pivots."""
        d = np.sqrt(((self.pivots - q) ** 2).sum(1))
        out = [(float(np.maximum(np.maximum(d - high, low - d) - SLACK * (1 + d + high), 0).max()), cell) for cell, (low, high, _) in self.cells.items()]
        return sorted(out), d

    def search(self, query: Sequence[float], k: int, ties: Sequence[str] = ("id",), where: Column | None = None) -> DataFrame:
        """The k nearest rows that `where` admits, with distance (squared) and score; as search.nearest of all rows."""
        q = np.asarray(query, np.float64)
        if len(q) != self.pivots.shape[1]:
            raise ValueError(f"the index has vectors of {self.pivots.shape[1]} components, not {len(q)}")
        order, d = self._bounds(q)
        found: list = []
        kth, at, wave, self.read_rows = np.inf, 0, FIRST, 0
        schema = nearest(self.rows().drop("_cell", "_far"), list(query), k, self.vector, ties).schema
        while at < len(order) and (len(found) < k or order[at][0] <= kth):
            part = [c for b, c in order[at : at + wave] if len(found) < k or b <= kth]
            at, wave = at + wave, wave * 2
            self.read_rows += sum(self.cells[c][2] for c in part)
            near = F.lit(False)
            for c in part:  # in the cell of pivot c, only rows about as far from c as the query is
                reach = kth * (1 + SLACK) + SLACK * (1 + d[c]) if len(found) == k else np.inf
                near = near | ((F.col("_cell") == c) & F.col("_far").between(float(max(d[c] - reach, 0)), float(min(d[c] + reach, 1e308))))
            rows = self.rows().filter(near).drop("_cell", "_far")
            rows = rows if where is None else rows.filter(where)
            some = nearest(rows, list(query), k, self.vector, ties).collect()
            found = sorted(found + some, key=lambda r: (r["distance"], *(r[t] for t in ties)))[:k]
            kth = float(np.sqrt(found[-1]["distance"])) if len(found) == k else np.inf
        return self.spark.createDataFrame(found, schema)

    def drop(self) -> None:
        Files(self.spark).remove(self.root)


def build(df: DataFrame, folder: str, vector: str = "vector", pivots: int = PIVOTS) -> PivotIndex:
    """Writes df with its cells below folder. Columns _cell, _far and _d (distances to all pivots) are added there."""
    spark, root = df.sparkSession, f"{folder.rstrip('/')}/pivots-{uuid.uuid4().hex}"
    good = df.filter(_comparable(vector))
    sample = good.orderBy(F.xxhash64(F.lit(7), vector)).limit(SAMPLE).select(F.col(vector).cast("array<double>").alias("v")).toArrow()["v"].to_pylist()
    size = len(sample[0]) if sample else 1
    chosen = _pivots(np.array([v for v in sample if len(v) == size]), pivots) if sample else np.zeros((1, size))
    whole = _comparable(vector) & (F.size(vector) == size)
    far = F.array(*[F.sqrt(vectors.squared_l2(F.col(vector), vectors.literal(p))) for p in chosen])
    rows = df.withColumn("_d", F.when(whole, far)).withColumn("_far", F.array_min("_d"))
    rows = rows.withColumn("_cell", F.coalesce((F.array_position("_d", F.col("_far")) - 1).cast("int"), F.lit(-1)))
    # a large cell is dealt to several tasks by its distances, each a file with a range of its own
    rows.repartitionByRange("_cell", "_far").sortWithinPartitions("_cell", "_far").write.partitionBy("_cell").parquet(root)
    every = spark.read.schema(rows.schema).parquet(root)
    cells = {}
    bounds = [f(F.col("_d")[i]).alias(f"{f.__name__}{i}") for i in range(len(chosen)) for f in (F.min, F.max)]
    for r in every.filter("_cell >= 0").groupBy("_cell").agg(F.count("*").alias("n"), *bounds).collect():
        cells[r["_cell"]] = (np.array([r[f"min{i}"] for i in range(len(chosen))]), np.array([r[f"max{i}"] for i in range(len(chosen))]), r["n"])
    return PivotIndex(every, root, vector, chosen, cells)
