"""Exact filtered nearest-neighbour search."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import vectors
from corvella.sources.scratch import Staging


def filters(language: str | None = None, exclude_tests: bool = False, exclude_libraries: bool = False) -> Column:
    """Conjunction of the equality filters; reaches the scan."""
    out = F.lit(True)
    if language is not None:
        out = out & (F.col("language") == F.lit(language))
    if exclude_tests:
        out = out & ~F.col("isTestFile")
    if exclude_libraries:
        out = out & ~F.col("isLibraryFile")
    return out


def nearest(df: DataFrame, query: Column | Sequence[float], k: int, vector: str = "vector", ties: Sequence[str] = ("id",), metric: str = "squared_l2") -> DataFrame:
    """The k rows nearest to one query, with distance and score; one pass, no shuffle."""
    q = query if isinstance(query, Column) else vectors.literal(query)
    d = df.withColumn("distance", vectors.METRICS[metric](F.col(vector), q)).filter(F.col("distance").isNotNull())
    return d.orderBy("distance", *ties).limit(k).withColumn("score", vectors.score(F.col("distance")))


def nearest_to_row(df: DataFrame, key: str, value, k: int, vector: str = "vector", metric: str = "squared_l2", where: Column | None = None) -> DataFrame:
    """nearest() to the vector of a stored row; that row is read once, at most one."""
    q = df.filter(F.col(key) == F.lit(value)).select(vector).limit(1)
    rest = df if where is None else df.filter(where)
    joined = rest.join(F.broadcast(q.withColumnRenamed(vector, "_query")))
    return nearest(joined, F.col("_query"), k, vector, (key,), metric).drop("_query")


#: Queries of a block, whose vectors go to every task, and rows that meet them at once.
QUERIES, ROWS = 2048, 2048


def _comparable(vector: str) -> Column:
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _best(keys: np.ndarray, queries: np.ndarray, k: int):
    """Each task's k nearest rows of every query of a block.

    A matrix product tells which rows can be among them; their distances are then summed
    component by component, so that equal vectors have equal distances.
    """
    square = (queries * queries).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bound = np.full(len(keys), np.inf)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                part = whole.slice(lo, ROWS)
                part = part.filter(pa.array(np.diff(np.asarray(part.column(1).offsets)) == queries.shape[1]))
                if not part.num_rows:
                    continue
                x, own = _matrix(part.column(1)), part.column(0).to_numpy()
                norm = (x * x).sum(1)
                near = square[:, None] - 2 * queries @ x.T + norm
                slack = 1e-9 * (square[:, None] + norm)
                top = np.minimum(bound, np.partition(near + slack, k - 1, axis=1)[:, k - 1]) if len(own) >= k else bound
                i, j = np.nonzero(near - slack <= top[:, None])
                exact = np.concatenate([np.cumsum((queries[i[a : a + ROWS]] - x[j[a : a + ROWS]]) ** 2, axis=1)[:, -1] for a in range(0, len(i), ROWS)] or [np.zeros(0)])
                q, ids, d = np.concatenate([q, i]), np.concatenate([ids, own[j]]), np.concatenate([d, exact])
                order = np.lexsort((ids, d, q))
                rank = np.arange(len(order)) - np.searchsorted(q[order], q[order], "left")
                keep = order[rank < k]
                q, ids, d = q[keep], ids[keep], d[keep]
                full = np.flatnonzero(np.bincount(q, minlength=len(keys)) == k)
                bound[full] = d[np.searchsorted(q, full, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(ids), pa.array(d)], names=["_query", "_row", "d"])

    return run


def nearest_batch(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "qid", query_vector: str = "query") -> DataFrame:
    """query_key, key, d and rk (from 1) of the k nearest rows of each query, ties to the smaller key; keys are integers.

    Queries are taken in blocks of QUERIES, in the order of their keys, so that what a task
    holds is bounded; each task returns k rows of a query. Blocks are written to the shared folder and read by
    one scan, so that the plan doesn't grow with their number. Vectors that are null or hold
    null or non-finite components take no part, nor do those without key; vectors of
    different lengths aren't compared. Of queries with the same key one is asked.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("_row"), F.col(vector).alias("_v")).filter(_comparable("_v") & F.col("_row").isNotNull())
    asked = queries.select(F.col(query_key).cast("long").alias("_query"), F.col(query_vector).alias("_v")).filter(_comparable("_v") & F.col("_query").isNotNull()).dropDuplicates(["_query"])
    schema, stage = "_query long, _row long, d double", Staging(spark)
    root, after = stage.folder(), None
    spark.createDataFrame([], schema).write.parquet(f"{root}/none")
    while True:
        block = (asked if after is None else asked.filter(F.col("_query") > after)).orderBy("_query").limit(QUERIES).toArrow().combine_chunks()
        if block.num_rows:
            keys, vectors_ = block["_query"].to_numpy(), pa.concat_arrays(block["_v"].chunks)
            lengths = np.diff(np.asarray(vectors_.offsets))
            for n in np.unique(lengths):
                same = lengths == n
                rows.mapInArrow(_best(keys[same], _matrix(vectors_.filter(pa.array(same))), k), schema).write.parquet(f"{root}/{keys[-1]}-{n}")
            after = int(keys[-1])
        if block.num_rows < QUERIES:
            break
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root)
    w = Window.partitionBy("_query").orderBy("d", "_row")
    ranked = found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    return ranked.select(F.col("_query").alias(query_key), F.col("_row").alias(key), "d", "rk")


def result(df: DataFrame) -> DataFrame:
    """Result columns with their defaults."""
    text = lambda c, default: F.coalesce(F.when(F.col(c) != "", F.col(c)), default).alias(c)
    return df.select(
        text("filePath", F.lit("")),
        F.coalesce("startLine", F.lit(0)).alias("startLine"),
        F.coalesce("endLine", F.lit(0)).alias("endLine"),
        text("language", F.lit("unknown")),
        text("chunkType", F.lit("unknown")),
        text("content", F.lit("")),
        F.col("score").alias("similarityScore"),
        F.coalesce(F.when(F.col("_codebaseName") != "", F.col("_codebaseName")), F.col("cb")).alias("codebaseName"),
    )


def search(chunks: DataFrame, query: Sequence[float], k: int, language: str | None = None, exclude_tests: bool = False, exclude_libraries: bool = False, metric: str = "squared_l2") -> DataFrame:
    """Filters first, then the k best over all codebases, best first; ties by codebase and id."""
    return result(nearest(chunks.filter(filters(language, exclude_tests, exclude_libraries)), query, k, ties=("cb", "id"), metric=metric))


class Cache:
    """Results by all of their parameters, for ttl seconds; of more than `most`, those used longest ago go. A parameter is the version of what was searched, so a
    change by any engine or process leaves old results unread; engines of one store may share a cache."""

    def __init__(self, ttl: float = 60, clock: Callable[[], float] = time.monotonic, most: int = 1000):
        self.ttl, self.clock, self.most, self.entries = ttl, clock, most, OrderedDict()
        self.lock, self.hits, self.misses = Lock(), 0, 0

    @staticmethod
    def key(**params) -> str:
        return json.dumps(params, sort_keys=True)

    def get(self, key: str):
        with self.lock:
            hit = self.entries.get(key)
            if hit and self.clock() - hit[0] > self.ttl:
                del self.entries[key]
                hit = None
            self.hits, self.misses = self.hits + bool(hit), self.misses + (not hit)
            if not hit:
                return None
            self.entries.move_to_end(key)
            return hit[1]

    def put(self, key: str, value) -> None:
        with self.lock:
            self.entries[key] = (self.clock(), value)
            self.entries.move_to_end(key)
            while len(self.entries) > self.most:
                self.entries.popitem(last=False)

    def clear(self) -> None:
        with self.lock:
            self.entries.clear()

    def stats(self) -> dict:
        return {"size": len(self.entries), "ttl": self.ttl, "most": self.most, "hits": self.hits, "misses": self.misses}
