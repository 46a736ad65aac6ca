"""N-gram Jaccard join by chosen paths.

A document's set holds its runs of five words; two documents are linked when the sets
have a Jaccard similarity of 0.8 or more. Documents with equal sets are collapsed to
one representative (the smallest id) with a count. A representative carries a vector
of 64 minhash tokens, which agree in a coordinate with a chance equal to the
similarity. Each of RUNS runs splits the representatives on sampled shared tokens:
at a node, about 1 / 0.8 coordinates are sampled for the path so far and a set goes to
the child that its token names, so a linked pair is expected to stay together in one
child or more. Nodes of at most LIMIT sets are leaves; larger ones are split again,
and what is still large after DEPTH levels is compared in blocks of pairs, so no
bucket is cut. Within a leaf, all sets are compared by their tokens and a spanning
forest of the likely pairs is kept. Exact similarities follow within the connected
groups of likely pairs, block against block over the whole sets; a task returns each
set's number of links and a spanning forest, never the pairs.

The recall is measured in the run: while the sets are made, each is compared exactly with
those of up to SAMPLED documents, of which no two are similar, and a pair of different
sets is met if both are in one group of likely pairs. Where the mean over these documents
is below RECALL, another RUNS runs follow on other paths, with a lower bar for
likely pairs; after REPEATS of them a warning names the recall.

Defined results: words are runs without white space, as they are; a text of one to
four words has one set element, the whole run; a null, empty or blank text links with
nothing. Very long texts are compared whole. A null doc_id is in no class (class null, no
links) but its row is returned. Repeated rows count as copies, ties at 0.8 are links. An
empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import Scratch, bounded, by_group, flat, freed, release, group_starts, local_roots, mix, slices, span_hashes, text_of, word_bounds
from corvella.llm.components import components

WORDS = 5
SIMILARITY = 0.8
TOKENS = 64
RUNS = 8
LIMIT = 128
DEPTH = 4
#: Rows of a block where a large leaf, or a large group of likely pairs, is compared block against block.
PAIRS = 1024
BLOCK = 256
#: Tokens of 64 that a likely pair shares at least: four standard deviations below 0.8.
LIKELY = 38

#: Documents that are compared with all others to measure the recall, of up to LONGEST bytes each; the recall to reach; more runs at most.
SAMPLED = 1024
LONGEST = 1 << 16
RECALL = 0.99
REPEATS = 4

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_M = np.uint64(0x2545F4914F6CDD1D)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sets of all texts one after another, each sorted and without repeats, and the offsets of the texts in them."""
    starts, ends, of = word_bounds(data, offsets)
    count = len(offsets) - 1
    h = span_hashes(data, starts, ends)
    per = np.bincount(of, minlength=count)
    if len(h) >= n:
        run = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            run = run * _M + h[i : len(h) - n + 1 + i]
        whole = of[: len(h) - n + 1] == of[n - 1 :]
        run, owner = mix(run[whole]), of[: len(h) - n + 1][whole]
    else:
        run, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(per) - per
    for i in np.flatnonzero((per > 0) & (per < n)):
        x = per[i : i + 1].astype(np.uint64)
        for w in h[first[i] : first[i] + per[i]]:
            x = x * _M + w
        run, owner = np.append(run, mix(x)), np.append(owner, i)
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    run, owner = run[new], owner[new]
    return run, np.searchsorted(owner, np.arange(count + 1), "left")


def minhashes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of TOKENS tokens for each set that isn't empty, zeros for the others."""
    out = np.zeros((len(at) - 1, TOKENS), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        low = (sets >> np.uint64(32)).astype(np.uint32)
        for k in range(TOKENS):
            x = (low ^ _B[k]) * _A[k]
            out[full, k] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), at[full])
    return out


#: tokens: 64 of 4 bytes, for paths; small: the low 2 bytes of each, for comparisons.
SIGNED = "doc_id long, fp1 long, fp2 long, n int, tokens binary, small binary, near array<int>"


class Sample:
    """Sets by shingle: near() gives those that are similar to each of many sets."""

    def __init__(self, sets: np.ndarray, at: np.ndarray):
        self.size = np.diff(at)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(sets, kind="stable")
        self.sets, self.owner = sets[order], owner[order]

    def near(self, sets: np.ndarray, at: np.ndarray) -> pa.Array:
        n, lo = len(at) - 1, np.searchsorted(self.sets, sets, "left")
        times = np.searchsorted(self.sets, sets, "right") - lo
        of = np.repeat(np.arange(n), np.diff(at))
        hit = np.flatnonzero(times)
        rows = np.repeat(hit, times[hit])
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(times[hit]) - times[hit], times[hit])
        pair, both = np.unique(of[rows] * max(len(self.size), 1) + self.owner[lo[rows] + inside], return_counts=True)
        i, j = np.divmod(pair, max(len(self.size), 1))
        ok = both >= SIMILARITY * (np.diff(at)[i] + self.size[j] - both) - 1e-9
        ends = np.searchsorted(i[ok], np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(j[ok].astype(np.int32)))


def _prints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two numbers for each set that tell different sets apart."""
    total = np.zeros((2, len(sets) + 1), np.uint64)
    np.cumsum(mix(sets + np.uint64(1)), out=total[0, 1:])
    np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=total[1, 1:])
    return (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)


def _sign(sample: Sample):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _signed(batch, sample)

    return run


def _signed(batch: pa.RecordBatch, sample: Sample) -> Iterator[pa.RecordBatch]:
    data, offsets = text_of(batch)
    ids = batch.column(0)
    for lo, hi in slices(offsets):
        own = offsets[lo : hi + 1]
        sets, at = shingles(data[own[0] : own[-1]], own - own[0])
        fp = _prints(sets, at)
        tokens = minhashes(sets, at)
        yield pa.RecordBatch.from_arrays(
            [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(fp[0]), pa.array(fp[1]), pa.array(np.diff(at).astype(np.int32)), _rows(tokens), _rows(tokens.astype(np.uint16)), sample.near(sets, at)],
            names=["doc_id", "fp1", "fp2", "n", "tokens", "small", "near"],
        )


def _rows(x: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _token(tokens: Column, k: Column) -> Column:
    return F.substr(tokens, k * 4 + 1, F.lit(4))


def _children(rows: DataFrame) -> DataFrame:
    """(path, id, tokens) → (path, id) of the children. The coordinates depend on the path alone."""
    draw = lambda k: F.pmod(F.xxhash64("path", k), F.lit(1_000_000))
    every = F.sequence(F.lit(0), F.lit(TOKENS - 1))
    some = F.filter(every, lambda k: draw(k) < int(1_000_000 / (SIMILARITY * TOKENS)))
    least = F.array(F.array_min(F.transform(every, lambda k: F.struct(draw(k).alias("d"), k.alias("k"))))["k"])
    k = F.explode(F.when(F.size(some) > 0, some).otherwise(least)).alias("k")
    return rows.select("path", "id", "tokens", k).select(F.xxhash64("path", "k", _token(F.col("tokens"), F.col("k"))).alias("path"), "id")


def _likely(least: int):
    """Leaves → links of a spanning forest of the pairs that share `least` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "path"):
            keys, ids, side = (t[c].to_numpy() for c in ("path", "id", "side"))
            tokens = np.frombuffer(b"".join(t["small"].to_pylist()), np.uint16).reshape(-1, TOKENS)
            found = [(i[same], j[same]) for i, j in _pairs(group_starts(keys), side) if (same := (tokens[i] == tokens[j]).sum(1, dtype=np.int16) >= least).any()]
            if not found:
                continue
            root = local_roots(len(ids), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
            hung = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[hung]), pa.array(ids[root[hung]])], names=["a", "b"])

    return run


def _pairs(edges: np.ndarray, side: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each group, about `most` at a time. side 0: all against all; 1 and 2: each 1 against each 2."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo < 2:
            continue
        if side[lo] == 0 and (hi - lo) ** 2 <= most:
            i, j = np.triu_indices(hi - lo, 1)
            rows = [(i + lo, j + lo)]
        elif side[lo] == 0:
            rows = ((np.full(hi - i - 1, i), np.arange(i + 1, hi)) for i in range(lo, hi - 1))
        else:
            two = np.flatnonzero(side[lo:hi] == 2) + lo
            rows = ((np.full(len(two), i + lo), two) for i in np.flatnonzero(side[lo:hi] == 1))
        for i, j in rows:
            held.append((i, j))
            size += len(i)
            if size >= most:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held, size = [], 0
    if size:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def blocked(rows: DataFrame, key: str, count: str, row_id: str, size: int) -> DataFrame:
    """Groups of more than `size` rows become pairs of blocks, each a group of its own: (key, side) with side 0 for a whole group or
    a block against itself, 1 and 2 for the two blocks of a pair. A row is in as many pairs as its group has blocks."""
    n = F.ceil(F.col(count) / size).cast("int")
    own = F.pmod(F.xxhash64(F.lit(11), row_id), F.col("_n")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda o: F.struct(F.xxhash64(key, F.least(o, F.col("_own")), F.greatest(o, F.col("_own"))).alias("key"), F.when(o == F.col("_own"), 0).when(F.col("_own") < o, 1).otherwise(2).alias("side")),
    )
    alone = F.array(F.struct(F.col(key).alias("key"), F.lit(0).alias("side")))
    out = rows.withColumn("_n", n).withColumn("_own", own).withColumn("_p", F.explode(F.when(F.col("_n") > 1, pairs).otherwise(alone)))
    return out.withColumn(key, F.col("_p.key")).withColumn("side", F.col("_p.side")).drop("_p", "_n", "_own", count)


VERIFIED = "id long, links long, root long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts of a group → each document's links and the root of its local component."""
    for t in by_group(batches, "path"):
        keys, ids = t["path"].to_numpy(), t["id"].to_numpy()
        new = np.ones(len(ids), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])  # a repeated row counts in times, not here
        t = t.filter(pa.array(new))
        keys, ids, side, times = (t[c].to_numpy() for c in ("path", "id", "side", "times"))
        data, offsets = text_of(t.select(["text"]).combine_chunks().to_batches()[0])
        edges = group_starts(keys)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for g0, g1 in _group_slices(edges, offsets):
            own = offsets[edges[g0] : edges[g1] + 1]
            sets, at = shingles(data[own[0] : own[-1]], own - own[0])
            base = edges[g0]
            for g in range(g0, g1):
                lo, hi = edges[g] - base, edges[g + 1] - base
                a, b = _linked(sets[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], side[edges[g] : edges[g + 1]])
                if len(a):
                    a, b = a + edges[g], b + edges[g]
                    np.add.at(links, a, times[b])
                    np.add.at(links, b, times[a])
                    part = local_roots(edges[g + 1] - edges[g], a - edges[g], b - edges[g])
                    root[edges[g] : edges[g + 1]] = part + edges[g]
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], names=["id", "links", "root"])


def _group_slices(edges: np.ndarray, offsets: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    return slices(offsets[edges], size)


def _linked(sets: np.ndarray, at: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group with a similarity of SIMILARITY or more, exactly, one set against all others at a time."""
    n, size = len(at) - 1, np.diff(at)
    vocabulary, codes = np.unique(sets, return_inverse=True)
    mask, a, b = np.zeros(len(vocabulary), bool), [], []
    for i in range(n - 1) if side[0] == 0 else np.flatnonzero(side == 1):
        if not size[i]:
            continue
        other = np.arange(i + 1, n) if side[0] == 0 else np.flatnonzero(side == 2)
        fits = (np.minimum(size[other], size[i]) >= SIMILARITY * np.maximum(size[other], size[i])) & (size[other] > 0)
        other = other[fits]
        if not len(other):
            continue
        mask[codes[at[i] : at[i + 1]]] = True
        if side[0] == 0:
            lo = at[i + 1]
            total = np.concatenate([[0], np.cumsum(mask[codes[lo:]])])
            both = total[at[other + 1] - lo] - total[at[other] - lo]
        else:
            total = np.concatenate([[0], np.cumsum(mask[codes])])
            both = total[at[other + 1]] - total[at[other]]
        mask[codes[at[i] : at[i + 1]]] = False
        near = other[both >= SIMILARITY * (size[other] + size[i] - both) - 1e-9]
        a.append(np.full(len(near), i))
        b.append(near)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _sample(docs: DataFrame) -> tuple[Sample, list[tuple[int, int, int]]]:
    """Sets of up to SAMPLED documents, of which no two are similar, and their prints (number, fp1, fp2)."""
    some = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") <= LONGEST))
    t = some.orderBy(F.xxhash64(F.lit(3), "doc_id", F.xxhash64("text")), "doc_id", "text").limit(SAMPLED).select("text").toArrow()
    sets, at = shingles(*flat(t["text"].cast(pa.string())))
    near, taken = Sample(sets, at).near(sets, at).to_pylist(), set()
    for i, x in enumerate(near):
        if x and not taken.intersection(x):
            taken.add(i)
    keep = sorted(taken)
    size = np.diff(at)[keep]
    own = np.concatenate([sets[at[i] : at[i + 1]] for i in keep]) if keep else sets[:0]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return Sample(own, ends), [(j, *map(int, fp)) for j, fp in enumerate(_prints(own, ends).T)]


def _recall(signed: DataFrame, reps: DataFrame, likely: DataFrame, known: list[tuple[int, int, int]]) -> float:
    """Mean share of a sampled document's similar, different sets that are in its group of likely pairs."""
    place = reps.join(likely.withColumnRenamed("node", "id"), "id", "left").select("fp1", "fp2", F.coalesce("root", "id").alias("group"))
    own = F.broadcast(signed.sparkSession.createDataFrame(known, "j int, fp1 long, fp2 long")).join(place, ["fp1", "fp2"]).select("j", F.col("group").alias("own"), F.col("fp1").alias("own1"), F.col("fp2").alias("own2"))
    pairs = signed.filter("doc_id IS NOT NULL AND size(near) > 0").select("fp1", "fp2", F.explode("near").alias("j")).distinct()
    pairs = pairs.join(F.broadcast(own), "j").filter("fp1 <> own1 OR fp2 <> own2").join(place, ["fp1", "fp2"])
    met = pairs.groupBy("j").agg(F.avg((F.col("group") == F.col("own")).cast("int")).alias("share"))
    r = met.agg(F.avg("share")).first()[0]
    return 1.0 if r is None else r


def _links(reps: DataFrame, s: Scratch, turn: int) -> DataFrame:
    """Links between representatives that are likely pairs, by RUNS runs; another turn samples other paths."""
    start = reps.select("id", "tokens", F.explode(F.array(*[F.lit(r).cast("long") for r in range(turn * RUNS, (turn + 1) * RUNS)])).alias("path"))
    leaves: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        rows = s.stage(_children(start).distinct())
        counts = rows.groupBy("path").agg(F.count("*").alias("members")).filter("members > 1")
        sized = rows.join(counts, "path")
        if depth == DEPTH:
            leaves.append(sized)
            break
        sized = s.stage(sized)
        s.drop(rows)
        large = sized.filter(F.col("members") > LIMIT)
        leaves.append(sized.filter(F.col("members") <= LIMIT))
        if large.isEmpty():
            break
        start = large.select("path", "id").join(reps.select("id", "tokens"), "id")
    found = leaves[0]
    for x in leaves[1:]:
        found = found.unionByName(x)
    buckets = blocked(found, "path", "members", "id", PAIRS).join(reps.select("id", "small"), "id")
    return buckets.repartition("path").sortWithinPartitions("path").mapInArrow(freed(_likely(LIKELY - 4 * turn)), "a long, b long").distinct()


def classes(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest id reachable by links), n_links (other documents linked directly, copies included)."""
    s = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession
    sample, known = _sample(docs)
    signed = s.stage(bounded(docs).select("doc_id", "text").mapInArrow(freed(_sign(sample)), SIGNED))
    del sample
    release()  # the driver's copy of the sampled sets
    full = signed.filter("doc_id IS NOT NULL AND n > 0")
    reps = s.stage(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("id"), F.count("*").alias("times"), F.first("tokens").alias("tokens"), F.first("small").alias("small")))

    likely, links = None, None
    for turn in range(REPEATS + 1):
        new = _links(reps, s, turn)
        links = s.stage(new if links is None else links.unionByName(new).distinct())
        likely = s.stage(components(links, s))
        recall = _recall(signed, reps, likely, known)
        if recall >= RECALL:
            break
    else:
        logging.getLogger(__name__).warning("a recall of %.3f of the sampled pairs was reached, the target is %.2f", recall, RECALL)

    sizes = likely.groupBy("root").agg(F.count("*").alias("members"))
    members = likely.join(sizes, "root").select(F.col("node").alias("id"), F.col("root").alias("path"), "members").join(reps.select("id", "times"), "id")
    members = members.dropDuplicates(["id"])
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(members, "id")
    groups = blocked(texts, "path", "members", "id", BLOCK).select("path", "id", "side", "times", "text")
    checked = s.stage(groups.repartition("path").sortWithinPartitions("path", "id").mapInArrow(freed(_verify), VERIFIED))
    roots = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")), s)
    n = checked.groupBy("id").agg(F.sum("links").alias("links"))
    node = reps.join(n, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp1", "fp2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "id").alias("class_id"))
    linked = full.select("doc_id", "fp1", "fp2").join(node, ["fp1", "fp2"]).select("doc_id", "class_id", "n_links")
    alone = signed.filter("doc_id IS NULL OR n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def deduplicate(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One document of each class, the one with the smallest id; a repeated id stays once. Documents without words, and rows without id, stay."""
    s = scratch or Scratch(docs.sparkSession)
    kept = s.stage(classes(docs, s).filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("_rows")))
    own = [F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)]
    back = [F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)]
    wide = docs.select("doc_id", *own).join(kept.hint("merge"), "doc_id")  # as many ids as documents: never a broadcast, at any size
    once = wide.filter("_rows = 1").select(*back)
    many = wide.filter("_rows > 1").dropDuplicates(["doc_id"]).select(*back)
    return once.unionByName(many).unionByName(docs.filter("doc_id IS NULL"))
