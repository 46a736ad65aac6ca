"""Packing documents into sequences along a space-filling curve.

A document's words are hashed to a signed count vector of BUCKETS numbers, which fixed
random directions project to DIMENSIONS numbers; these are squeezed into a unit cube,
cut into 2**BITS steps each, and the place of the cell on the Hilbert curve through the
cube is the document's key. Documents are range-sorted by it, so that those
with like words stand beside one another, and the sorted documents' tokens, one behind
the other, are cut every LENGTH tokens: a sequence holds neighbours of the curve, and
only the end of the whole corpus is short. That end is cut at powers of two, which need no
padding.

The tokens of a document are made once, after the sort, and written with their number and
their place in the partition; what stands before a partition is a sum over the partitions
(a row each), so that all pieces are then found without another shuffle, however many
documents are alike. Documents with equal keys are parted by a hash of their ids: a large
group of copies takes as many partitions as it needs.

Ids equal those of the `tokenizers` library for a byte-level model. Texts are cut at spaces,
which no piece of its pattern spans, and a batch's distinct words are encoded by
`tiktoken` with the same vocabulary, which is several times faster. Models other than byte-level
ones with the usual pattern, and those with white space in a special token, are refused.

Defined results: null and empty texts are the end id alone. Very long texts are tokenised
whole, word by word, and their hashed vectors are summed over parts of 1 MB (a word that a cut parts counts as two). Documents
with equal keys stand in the order of a hash of the id, then the id, then the text; a null id is first; repeated rows are
packed each. Reruns give the same sequences. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.llm.common import SLICE, Scratch, bounded, freed, slices, span_hashes, text_of, word_bounds

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LENGTH = 2048
END = 1
BUCKETS = 256
DIMENSIONS, BITS = 4, 12
#: Bits beside the key by which documents with equal keys are parted.
TIE = 15

# ---------------------------------------------------------------- the curve


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _tables(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By place in a cell's 2**dims corners: rank on the curve of a corner (inverse Gray code), entry corner and direction of the sub-cube."""
    n = 1 << dims
    rank = np.zeros(n, np.int64)
    for i in range(n):
        rank[_gray(i)] = i
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # trailing ones
    entry = np.array([0 if i == 0 else _gray(2 * ((i - 1) // 2)) for i in range(n)])
    turn = np.array([0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % dims for i in range(n)])
    return rank, entry, turn


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers below 2**bits; rows next to one another on it differ by one in one dimension."""
    n, dims = cells.shape
    rank, entry, turn = _tables(dims)
    full = (1 << dims) - 1
    at, start, axis = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = lambda x, by: ((x << by) | (x >> (dims - by))) & full
    right = lambda x, by: ((x >> by) | (x << (dims - by))) & full
    for bit in range(bits - 1, -1, -1):
        corner = (((cells >> bit) & 1) << np.arange(dims)).sum(1)
        by = (axis + 1) % dims
        w = rank[right(corner ^ start, by)]
        at = (at << dims) | w
        start ^= left(entry[w], by)
        axis = (axis + turn[w] + 1) % dims
    return at


_DIRECTIONS = np.rint(1000 * np.random.default_rng(12).normal(size=(BUCKETS, DIMENSIONS)))


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed counts of hashed words, a row for each text; whole numbers."""
    n = np.maximum(1, -(-np.diff(offsets) // SLICE))  # parts of a text
    of = np.repeat(np.arange(len(n)), n)
    starts = offsets[of] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * SLICE
    edge, out = np.append(starts, offsets[-1]), np.zeros((len(n), BUCKETS))
    for lo, hi in slices(edge) if len(starts) else ():
        own = data[edge[lo] : edge[hi]]
        s, e, part = word_bounds(own, edge[lo : hi + 1] - edge[lo])
        if len(s):
            h = span_hashes(own, s, e)
            rows = of[lo:hi][part]
            first = rows[0]
            count = np.bincount((rows - first) * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)), (rows[-1] - first + 1) * BUCKETS)
            out[first : rows[-1] + 1] += count.reshape(-1, BUCKETS)
    return out


def keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Place of each text on the curve. Sums are of whole numbers, so a text has the same place in any batch."""
    v = vectors(data, offsets)
    length = np.sqrt(np.maximum((v * v).sum(1), 1.0))
    z = (v @ _DIRECTIONS) / (1000 * length)[:, None]
    unit = 0.5 + 0.5 * z / np.sqrt(1 + z * z)
    return hilbert(np.minimum(unit * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = keys(*text_of(batch))
        place = (key << TIE) | (batch.column(2).to_numpy() & ((1 << TIE) - 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place)], names=["doc_id", "text", "place"])


# ---------------------------------------------------------------- tokens

#: The pattern that byte-level models use, without its look-ahead.
_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_WHITES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: First bytes of characters among which white ones are, and control characters.
_ODD = np.isin(np.arange(256), [*range(9), *range(14, 32), 127, 0xC2, 0xE1, 0xE2, 0xE3])


class Encoder:
    """Ids of texts for a byte-level model, equal to those of `tokenizers` with add_special_tokens=False."""

    def __init__(self, path: str = TOKENIZER):
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or spec["model"].get("dropout"):
            raise ValueError(f"{path} isn't a byte-level model with the usual pattern and no normaliser")
        if any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
            raise ValueError(f"{path} has a special token with white space")
        byte = self._bytes()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]
        self.special = {s.encode(): i for s, i in special.items()}
        self.within = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # the last of several white characters before a word belongs to the word: texts are cut before it
        self.runs = re.compile(f"(?<=[{_WHITE}])(?=[{_WHITE}][^{_WHITE}])")

    @staticmethod
    def _bytes() -> dict[str, int]:
        """Characters that stand for bytes in the vocabulary: printable Latin ones for themselves, the others from U+0100 on."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(self.within.split(text) if self.within else [text]):
            if i % 2:
                out.append(self.special[part.encode()])
            else:
                for x in self.runs.split(part):
                    out += self.bpe.encode_ordinary(x)
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of words, each with the space before it, and their texts. A cut stands before a space that no white character precedes, where
        any piece ends."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            one, two = data[1:-1], data[:-2]
            solid = ((one > 32) & (one < 127)) | ((one > 127) & (two != 0xC2) & (two != 0x80) & (two != 0x81) & (two != 0x9A))
            cut[2:-1] = (data[2:] == 32) & solid
        cut[offsets] = True
        at = np.flatnonzero(cut)
        at = at[at < len(data)]
        return at, np.searchsorted(offsets, at, "right") - 1

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, one word behind the other in some order, and where each word's begin and end. Plain words, a space and solid characters that no
        two white ones part, are encoded as one text, which falls apart before each of their spaces; the others one by one."""
        white = _WHITES[data]
        odd = _ODD[data]
        odd[1:] |= white[1:] & white[:-1]
        odd = np.append(0, np.cumsum(odd))
        inner = np.minimum(starts + 1, ends)
        plain = (data[starts] == 32) & (ends - starts > 1) & (odd[ends] == odd[inner]) & ~white[ends - 1]
        raw = data.tobytes()
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                plain &= ~((starts <= at) & (at < ends))
                at = raw.find(x, at + 1)
        one = np.flatnonzero(plain)
        size = ends[one] - starts[one]
        text = data[np.repeat(starts[one] - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes().decode()
        ids = np.frombuffer(self.bpe._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32) if text else np.zeros(0, np.uint32)
        edge = np.append(0, 1 + np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size)))
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        low[one], high[one] = edge[:-1], edge[1:]
        more: list[int] = []
        for i in np.flatnonzero(~plain).tolist():
            low[i] = len(ids) + len(more)
            more += self.encode(raw[starts[i] : ends[i]].decode())
            high[i] = len(ids) + len(more)
        return np.append(ids, np.array(more, np.uint32)), low, high

    def batch(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end`, and the offsets of the texts in them."""
        starts, of = self.spans(data, offsets)
        n = np.ones(len(offsets) - 1, np.int64)
        if not len(starts):
            return np.full(len(n), end, np.uint32), np.arange(len(n) + 1)
        ends = np.append(starts[1:], len(data))
        _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        ids, low, high = self._distinct(data, starts[first], ends[first])
        m = (high - low)[which]
        n += np.bincount(of, m, len(n)).astype(np.int64)
        place = np.append(0, np.cumsum(n))
        out = np.full(place[-1], end, np.uint32)
        inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        # words go one behind the other; each text before a word has put one end id between
        out[np.arange(m.sum()) + np.repeat(of, m)] = ids[np.repeat(low[which], m) + inside]
        return out, place


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, part = Encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = text_of(batch)
            for lo, hi in slices(offsets):
                ids, place = coder.batch(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end)
                n = np.diff(place)
                blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * place).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), pa.array(at + place[:-1]), batch.column(0).slice(lo, hi - lo), pa.array(n), blob], names=["part", "at", "doc_id", "n", "ids"])
                at += int(place[-1])

    return run


# ---------------------------------------------------------------- sequences


def tail(total: int, length: int) -> list[int]:
    """Starts of the sequences after the full ones, and the end: powers of two, largest first."""
    at, out = total - total % length, []
    for bit in range(length.bit_length(), -1, -1):
        if (total % length) >> bit & 1:
            out.append(at)
            at += 1 << bit
    return [*out, total]


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end: int = END, scratch: Scratch | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all rows of docs (doc_id, text); ids: little-endian numbers of 32 bits."""
    s = scratch or Scratch(docs.sparkSession)
    tie = F.xxhash64(F.lit(12), "doc_id")
    located = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie")).mapInArrow(freed(_place), "doc_id long, text string, place long")
    along = located.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id", F.xxhash64("text"), "text")
    placed = s.stage(along.select("doc_id", "text").mapInArrow(freed(_encode(tokenizer, end)), "part int, at long, doc_id long, n long, ids binary"), compression="zstd")
    sizes = placed.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    full, short = total // length, F.array(*[F.lit(x).cast("long") for x in tail(total, length)])

    def sequence(x: Column) -> Column:
        return F.when(x < full * length, F.floor(x / length)).otherwise(full - 1 + F.size(F.filter(short, lambda t: t <= x)))

    def first(q: Column) -> Column:
        return F.when(q < full, q * length).otherwise(F.element_at(short, F.greatest(q - full, F.lit(0)).cast("int") + 1))

    def piece(q: Column) -> Column:
        low, high = F.greatest(first(q), F.col("from")), F.least(first(q + 1), F.col("from") + F.col("n"))
        start = low - F.col("from")
        return F.struct(start.alias("start"), (high - low).alias("length"), F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * (high - low)).cast("int")).alias("ids"), q.alias("sequence_id"), (low - first(q)).alias("offset"))

    rows = placed.join(F.broadcast(before), "part").withColumn("from", F.col("before") + F.col("at"))
    cuts = F.sequence(sequence(F.col("from")), sequence(F.col("from") + F.col("n") - 1))
    return rows.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(cuts, piece)).alias("p")).select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, tokens, ids and spans (offset, length, doc_id, start) of each sequence; a sequence has at most LENGTH pieces."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", "tokens", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["doc_id"].alias("doc_id"), x["start"].alias("start"))).alias("spans"))
