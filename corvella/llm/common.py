"""What the operators share: staged tables in the shared folder, texts as flat byte arrays, words and their hashes."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvella.session import BATCH_BYTES, BATCH_ROWS, READ_ROWS, bounded  # noqa: F401
from corvella.sources.scratch import shared_folder

#: Bytes of text that the array code handles at once; a single longer text is handled whole.
SLICE = 1 << 20
_libc = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freed(run):
    """run, a function over the batches of a partition, that gives freed memory back to the system when it ends: workers stay for later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


# ---------------------------------------------------------------- staged tables


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of their lineage.

    drop() removes a table that nothing reads any more; the rest go at the end of the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/corvella-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def stage(self, df: DataFrame, *partition_by: str, compression: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.partitionBy(*partition_by).parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *staged: DataFrame) -> None:
        for df in staged:
            self._delete(df._staged_at)

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session has ended before the driver
            pass


# ---------------------------------------------------------------- texts as bytes


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the words: runs of bytes not in `gap`; no word spans two texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    full = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, full[:-1]
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, full[1:]
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)


_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base modulo 2**64, and of its inverse; one table for each process."""
    if len(_tables[0]) < n:
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _tables[i] = np.multiply.accumulate(t)
    return _tables[0], _tables[1]


def _lut(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_BYTES = _lut(7)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray, lut: np.ndarray = _BYTES):
    """64-bit hash of each span of bytes, the same wherever the span stands; for several ends, one array for each."""
    up, down = _powers(1 << max(20, len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(lut[data] * up[: len(data)], out=total[1:])
    out = [mix((total[e] - total[starts]) * down[starts] + (e - starts).astype(np.uint64)) for e in ends]
    return out[0] if len(out) == 1 else out


def text_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    return flat(batch.column(batch.schema.get_field_index(name)))


# ---------------------------------------------------------------- groups that lie together


def by_group(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `key`; a group is never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left"))  # sorted: the last group begins here
        first_same = held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == keys[-1]
        if last == 0 and (first_same or not held):
            held.append(batch)
            continue
        if last:
            held.append(batch.slice(0, last))
        yield pa.Table.from_batches(held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def group_starts(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the links a - b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


# ---------------------------------------------------------------- labelled samples


def fold(doc_id, n: int):
    """crc32 of the id as text modulo n; rows without id are in fold -1, which no model learns from."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1)).cast("int")


def labelled(labels: DataFrame, label: str, most: int, learn) -> DataFrame:
    """(doc_id, label) of at most `most` labelled ids that `learn` admits, by a hash of the id; the highest label of an id counts."""
    from pyspark.sql import functions as F

    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return ids.orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id").limit(most)


def sampled(docs: DataFrame, ids: DataFrame, longest: int) -> DataFrame:
    """(doc_id, label, text) of a bounded list of ids: one text each, that with the least hash among its texts of up to `longest` bytes."""
    from pyspark.sql import functions as F

    fits = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    own = fits.join(F.broadcast(ids), "doc_id")
    return own.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float = 0.003):
        self.w, self.rate, self.t = weights, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
        self.x = [np.zeros_like(x) for x in weights]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        rate, bias = self.rate / (1 - 0.9**self.t), 1 / (1 - 0.99**self.t)
        for w, g, m, v, x in zip(self.w, grads, self.m, self.v, self.x, strict=True):
            m *= 0.9
            m += np.multiply(g, 0.1, out=x)
            v *= 0.99
            np.multiply(g, g, out=x)
            x *= 0.01
            v += x
            np.sqrt(np.multiply(v, bias, out=x), out=x)
            x += 1e-8
            np.divide(m, x, out=x)
            x *= rate
            w -= x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
