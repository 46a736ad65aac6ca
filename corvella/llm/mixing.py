"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a hash. A source's target over its
size says how many passes over its blocks the mix draws; the last pass ends inside
one block, at a cut in the order of the documents' hashes. The exact quotas of block
draws are then split among the output shards: at each node of a binary tree over the
shards the left half draws its number of blocks without replacement from the node's
quotas (multivariate hypergeometric) and the right half gets the rest. A source's
blocks are permuted and each shard takes its quota from the permutation in turn, so
shards draw disjoint blocks; within a shard rows are in the order of a hash.

Tables on the driver have one row for each source and one for each block: at most
BLOCKS blocks, one more for each source; their join is broadcast up to BROADCAST rows.
Nothing else leaves the executors. There is a shard for each SHARD_WORDS words of the
mix, up to SHARDS; its rows are brought together before their shuffle.

Defined results: null texts have size 0. Empty texts and sources without words have
nothing to take. A null source is a source of its own, after all others. Rows that
are equal in doc_id, source and text, ties of the hash, are drawn together. A very long
text is drawn whole, as any other. An empty table gives an empty mix. Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.llm.common import Scratch, bounded

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCKS = 16384
SOURCES = 1_000_000
BROADCAST = 100_000
#: Words of a shard, and the most shards; of many sources there are fewer, so that the quotas of all shards fit the driver.
SHARD_WORDS = 1 << 21
SHARDS = 4096
QUOTAS = 1 << 24
SEED = 20
SPACE = " \t\n\v\f\r"


def words(text: Column) -> Column:
    """Number of words: the length of the text with one letter in place of each word and the space after it. A count of matches would list them all."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(SPACE)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.octet_length(marks), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """share of all sizes, by weight; a source stops at most times its size and the others share the rest."""
    out, rest, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ -= over
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards × sources: how many block draws of each source a shard gets; rows sum to nearly equal numbers, columns to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    edge = [total * i // shards for i in range(shards + 1)]
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, left = todo.pop()
        if hi - lo == 1:
            out[lo] = left
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        draw = _hypergeometric(rng, left, edge[mid] - edge[lo])
        todo += [(lo, mid, draw), (mid, hi, left - draw)]
    return out


def _hypergeometric(rng: np.random.Generator, quotas: np.ndarray, n: int) -> np.ndarray:
    """Source by source, so that neither the number of sources nor of blocks is bounded by the generator's own limit."""
    out, rest = np.zeros_like(quotas), int(quotas.sum())
    for i in np.flatnonzero(quotas):
        q = quotas[i]
        rest -= int(q)
        if n:
            out[i] = rng.hypergeometric(int(q), rest, n) if rest else n
            n -= int(out[i])
    return out


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


class Mix:
    """The plan of a mix: a row for each block with its draws. Built from (source, size, order) rows only."""

    def __init__(self, narrow: DataFrame, scratch: Scratch, weights=WEIGHTS, share=SHARE, most=MOST, shards: int | None = None, seed=SEED):
        spark = narrow.sparkSession
        sums = narrow.groupBy("_key").agg(F.sum("_size").alias("n")).limit(SOURCES + 1).collect()
        if len(sums) > SOURCES:
            raise ValueError(f"more than {SOURCES} sources")
        sources = sorted(((r["_key"], r["n"]) for r in sums), key=lambda x: (x[0][:1] == "n", x[0]))
        sizes = [n for _, n in sources]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share, most)
        each = max(1, -(-sum(sizes) // BLOCKS))
        parts = [max(1, -(-n // each)) for n in sizes]
        rows = [(k, n, t, b) for (k, _), n, t, b in zip(sources, sizes, goal, parts, strict=True)]
        self.sources = spark.createDataFrame(rows, "_key string, _source_size long, _target double, _blocks int")
        if len(rows) <= BROADCAST:
            self.sources = F.broadcast(self.sources)
        shards = shards or int(min(SHARDS, max(64, QUOTAS // max(1, len(rows))), max(1, -(-sum(goal) // SHARD_WORDS))))
        self.placed = self.place(narrow)
        blocks = self.placed.groupBy("_key", "_block").agg(F.sum("_size").alias("n")).collect()
        by: dict[str, list[tuple[int, int]]] = {k: [] for k, _ in sources}
        for r in blocks:
            by[r["_key"]].append((r["_block"], r["n"]))
        plan, quotas, edges = [], [], {}
        for i, ((key, n), t) in enumerate(zip(sources, goal, strict=True)):
            own = sorted(by[key])
            order = np.random.default_rng([seed, i]).permutation(len(own))
            whole, rest = (int(t // n), t % n) if n else (0, 0.0)
            if whole >= most:
                whole, rest = int(most), 0.0
            draws = [(own[j][0], e) for e in range(whole) for j in order]
            for j in order:
                if rest <= 0:
                    break
                block, size = own[j]
                draws.append((block, whole))
                if size > rest:
                    edges[key, block] = rest
                rest -= size
            plan.append((key, draws))
            quotas.append(len(draws))
        per = split_quotas(np.array(quotas, np.int64), shards, seed) if sources else np.zeros((shards, 0), np.int64)
        out: dict[tuple[str, int], list[int]] = {}
        for i, (key, draws) in enumerate(plan):
            shard = np.repeat(np.arange(shards), per[:, i])
            for (block, _), s in zip(draws, shard, strict=True):
                out.setdefault((key, block), []).append(int(s))
        cuts = self._cuts(spark, edges)
        rows = [(k, b, s, cuts.get((k, b))) for (k, b), s in out.items()]
        self.draws = spark.createDataFrame(rows, "_key string, _block int, _shards array<int>, _cut long")
        if len(rows) <= BROADCAST:
            self.draws = F.broadcast(self.draws)

    def place(self, df: DataFrame) -> DataFrame:
        """Rows with _key and _order get their source's figures and their block."""
        return df.join(self.sources, "_key").withColumn("_block", F.pmod(F.col("_order"), F.col("_blocks")).cast("int"))

    def _cuts(self, spark, edges: dict) -> dict:
        """For each block that a pass ends in: the last document hash it takes, so that the taken words come nearest to what is left."""
        if not edges:
            return {}
        want = spark.createDataFrame([(k, b, float(r)) for (k, b), r in edges.items()], "_key string, _block int, _rest double")
        inside = self.placed.join(F.broadcast(want) if len(edges) <= BROADCAST else want, ["_key", "_block"]).groupBy("_key", "_block", "_rest", "_order").agg(F.sum("_size").alias("n"))
        w = Window.partitionBy("_key", "_block").orderBy("_order")
        run = inside.withColumn("upto", F.sum("n").over(w))
        best = run.groupBy("_key", "_block", "_rest").agg(F.min_by("_order", F.struct(F.abs(F.col("upto") - F.col("_rest")), "_order")).alias("cut"), F.min(F.abs(F.col("upto") - F.col("_rest"))).alias("off"))
        low = -(1 << 63)
        return {(r["_key"], r["_block"]): r["cut"] if r["off"] <= r["_rest"] else low for r in best.collect()}

    def copies(self, placed: DataFrame) -> DataFrame:
        """Adds _shards: the shard of each copy of the document in the mix."""
        s = F.coalesce("_shards", F.array().cast("array<int>"))
        last = F.col("_cut").isNotNull() & (F.col("_order") > F.col("_cut"))
        taken = F.when(F.col("_empty"), F.array().cast("array<int>")).when(last, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
        return placed.join(self.draws, ["_key", "_block"], "left").withColumn("_shards", taken)


def _marks(docs: DataFrame, seed: int) -> list[Column]:
    """Key of the source, hash that orders documents, and whether there is no word to take."""
    order = F.xxhash64(F.lit(seed), "doc_id", "source", F.xxhash64("text"))
    empty = F.coalesce(F.octet_length(F.btrim("text", F.lit(SPACE))), F.lit(0)) == 0
    return [_key(F.col("source")).alias("_key"), order.alias("_order"), empty.alias("_empty")]


def _narrow(docs: DataFrame, seed: int, *keep: str) -> DataFrame:
    return bounded(docs).select(*keep, words(F.col("text")).alias("_size"), *_marks(docs, seed))


def plan_rows(docs: DataFrame, scratch: Scratch | None = None, **kw) -> DataFrame:
    """One row for each document: size, its source's size and target, the words that the mix takes, copies and their shards."""
    scratch = scratch or Scratch(docs.sparkSession)
    narrow = scratch.stage(_narrow(docs, kw.get("seed", SEED), "doc_id"))
    mix = Mix(narrow, scratch, **kw)
    n = F.size("_shards")
    return mix.copies(mix.placed).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (n * F.col("_size")).cast("long").alias("taken"),
        n.alias("copies"),
        F.array_join(F.col("_shards").cast("array<string>"), ",").alias("shards"),
    )


def mix(docs: DataFrame, scratch: Scratch | None = None, shard_column: str | None = None, **kw) -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy. Rows of a shard lie together, in the order of a hash of row and shard; with shard_column, that column says the shard."""
    scratch = scratch or Scratch(docs.sparkSession)
    seed, columns = kw.get("seed", SEED), docs.columns
    plan = Mix(scratch.stage(_narrow(docs, seed)), scratch, **kw)
    wide = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(columns)], *_marks(docs, seed))
    out = plan.copies(plan.place(wide)).select(*[f"_in{i}" for i in range(len(columns))], "_order", F.explode("_shards").alias("_shard"))
    out = out.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64("_order", "_shard"))
    return out.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(columns)], *([F.col("_shard").alias(shard_column)] if shard_column else []))
