"""Exact top-k by distributed histogram selection.

Queries are taken in blocks of QUERIES, whose vectors are broadcast; everything is
scored against a block, block by block, by matrix products of integers held in
doubles (exact below 2**53). Each pass narrows an interval that holds a query's kth
score: tasks count scores by bin, down from the top until k are counted, since no
lower bin of that task can hold the kth score of all; the global counts locate the
bin, and the next pass divides it, until bins have a width of one. A last pass
returns the scores above the kth, and of those equal to it each task's k smallest ids;
ties are cut to the smallest ids for each query.

The driver holds one number for each query of a block. Bins and returned rows are at
most k for each query, task and pass, however many rows tie.

Defined results: vectors null, empty, or with null or non-finite components take no
part, and neither do rows without id. Vectors of different lengths aren't compared, very
long ones are compared whole. A query's own row is left out; another row with its id is a
candidate, and if it is a query too, has ranks of its own. Ties go to the smaller id.
Fewer candidates than k give all of them. An empty table gives no rows. Extra columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.llm.common import Scratch, freed
from corvella.llm.multiindex import components_of

K = 5
BINS = 512
QUERIES = 4096
ROWS = 2048


def whole(vector: str) -> Column:
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def levels(column: pa.Array) -> np.ndarray:
    return np.floor(256.0 * np.asarray(column.flatten()).astype(np.float64)).reshape(len(column), -1)


def _scores(batches: Iterator[pa.RecordBatch], queries: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores as queries × rows) block by block; own: rows of the queries, sorted; a query's own row scores -inf."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            lengths = np.diff(np.asarray(part.column(1).offsets))
            part = part.filter(pa.array(lengths == queries.shape[1]))
            if part.num_rows:
                ids, rows = part.column(0).to_numpy(), part.column(2).to_numpy()
                s = queries @ levels(part.column(1)).T
                at = np.searchsorted(own, rows)
                hit = np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == rows))
                s[at[hit], hit] = -np.inf
                yield ids, s


def _count(queries, own, low, width, k):
    """Counts by bin from the top; bin b of query q holds scores in low[q] + width[q] * [b, b + 1); all above count as the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(own), BINS), np.int64)
        for _, s in _scores(batches, queries, own):
            b = np.floor((s - low[:, None]) / width[:, None])
            q, r = np.nonzero(b >= 0)
            total += np.bincount(q * BINS + np.minimum(b[q, r], BINS - 1).astype(np.int64), minlength=total.size).reshape(total.shape)
        above = total[:, ::-1].cumsum(1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(b.astype(np.int32)), pa.array(total[q, b])], names=["query_id", "bin", "n"])

    return run


def _pick(queries, own, names, kth, k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for x, s in _scores(batches, queries, own):
            q, r = np.nonzero(s >= kth[:, None])
            ids, qs, ss = [np.concatenate([*ids, x[r]])], [np.concatenate([*qs, q])], [np.concatenate([*ss, s[q, r]])]
            order = np.lexsort((ids[0], -ss[0], qs[0]))
            rank = np.arange(len(order)) - np.searchsorted(qs[0][order], qs[0][order], "left")
            keep = order[rank < k]
            ids, qs, ss = [ids[0][keep]], [qs[0][keep]], [ss[0][keep]]
        yield pa.RecordBatch.from_arrays([pa.array(names[qs[0]]), pa.array(own[qs[0]]), pa.array(ids[0]), pa.array(ss[0].astype(np.int64))], names=["query_id", "own", "vec_id", "score"])

    return run


def _block(rows: DataFrame, own: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int, reach: float) -> DataFrame:
    norm = np.ceil(np.abs(queries).sum(1) * reach) + 1
    low, high = -norm, norm + 1  # integers: scores lie in [low, high)
    need = np.full(len(own), k, np.int64)  # rank inside the interval
    done = np.zeros(len(own), bool)
    while not done.all():
        width = np.maximum(1.0, np.ceil((high - low) / BINS))
        counted = rows.mapInArrow(freed(_count(queries, own, low, width, k)), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        run = counted.withColumn("upto", F.sum("n").over(down))
        bound = rows.sparkSession.createDataFrame([(int(o), int(n)) for o, n in zip(own, need, strict=True)], "query_id long, need long")
        hit = run.join(F.broadcast(bound), "query_id").filter("upto >= need").groupBy("query_id").agg(F.max("bin").alias("bin")).collect()
        at = {r["query_id"]: r["bin"] for r in hit}
        for i, o in enumerate(own):
            if done[i]:
                continue
            if o not in at:  # fewer than k candidates: all of them
                low[i], done[i] = -norm[i], True
                continue
            low[i] += at[o] * width[i]
            high[i] = min(high[i], low[i] + width[i]) if at[o] < BINS - 1 else high[i]
            done[i] = width[i] == 1
    return rows.mapInArrow(freed(_pick(queries, own, ids, low, k)), "query_id long, own long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest scores; ties to the smaller id."""
    s = scratch or Scratch(df.sparkSession)
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).cast(f"array<{components_of(df, vector)}>").alias("vector"), is_query.alias("q")).filter(whole("vector") & F.col("vec_id").isNotNull())
    rows = s.stage(rows.select("vec_id", "vector", F.monotonically_increasing_id().alias("row"), "q"))
    asked = rows.filter("q")
    rows = rows.select("vec_id", "vector", "row")
    reach = rows.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(F.floor(x.cast("double") * 256)))))).first()[0]
    found, after, schema = f"{s.root}/found", None, "query_id long, own long, vec_id long, score long"
    rows.sparkSession.createDataFrame([], schema).write.parquet(f"{found}/none")
    while True:
        part = asked if after is None else asked.filter(F.col("row") > after)
        block = part.orderBy("row").limit(QUERIES).select("vec_id", "row", "vector").toArrow()
        if not block.num_rows:
            break
        ids, own = block["vec_id"].to_numpy(), block["row"].to_numpy()
        after = int(own[-1])
        vectors = block["vector"].combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        lengths = np.diff(np.asarray(vectors.offsets))
        for n in np.unique(lengths):
            same = lengths == n
            _block(rows, own[same], levels(vectors.filter(pa.array(same))), ids[same], k, float(reach)).write.parquet(f"{found}/{after}-{n}")
        if block.num_rows < QUERIES:
            break
    out = rows.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(found)  # one scan, however many blocks
    w = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
