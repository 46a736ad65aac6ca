"""Embeddings as a column: one vector for each row, null for blank texts.

The default embedder hashes words and letter trigrams into a fixed number of
dimensions and normalises to length 1. Any Embedder can take its place; it is made
once in each Python worker.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from functools import cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384


class Embedder(Protocol):
    """sure, where it is there and true: any text that isn't blank has a vector, so rows are counted before they are embedded; a failure ends the job."""

    dimension: int
    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


#: Hash of a token: the sum of its bytes times powers of BASE modulo PRIME.
BASE, PRIME = 31, (1 << 31) - 1
WORD, TRIGRAM = 10, 3
#: Bytes of text whose tokens are held at once; a longer text is held whole.
SLICE = 1 << 15
_CLASS = np.zeros(256, np.uint8)  # 0: between words, 1: small letter, 2: capital, 3: digit, 4: part of a character beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_GROUP = np.array([0, 1, 1, 2, 3], np.uint8)[_CLASS]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """2**bits powers of BASE and of its inverse modulo PRIME, by doubling."""
    out = []
    for base in (BASE, pow(BASE, -1, PRIME)):
        t = np.ones(1, np.int64)
        while len(t) < 1 << bits:
            t = np.concatenate([t, t * pow(base, len(t), PRIME) % PRIME])
        out.append(t)
    return out[0], out[1]


@cache
def _places(dimension: int) -> np.ndarray:
    """Place of each trigram's hash, which is below PRIME as it stands, among 2 * dimension ones."""
    h = np.arange(255 * (1 + BASE + BASE * BASE) + 1)
    return (h % (2 * dimension)).astype(np.int32)


def places(data: np.ndarray, offsets: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of each text and of the trigrams of the words in ASCII: text * 2 * dimension + hash % (2 * dimension).

    A word is a run of letters, of digits, or of characters beyond ASCII; letters are parted
    before a capital that follows a small one, and before the last of several capitals if a small one follows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = data.tobytes()
    c, group, small = (np.frombuffer(raw.translate(x.tobytes()), np.uint8) for x in (_CLASS, _GROUP, _LOWER))
    small = small.astype(np.int32)
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = (group[1:] != group[:-1]) | ((c[:-1] == 1) & (c[1:] == 2))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    cut[1:-2] |= (c[:-2] == 2) & (c[1:-1] == 2) & (c[2:] == 1) & ~begins[2:-1]
    cut |= begins
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    full = c[starts] > 0
    starts, ends = starts[full], ends[full]
    up, down = _powers(max(10, len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(small * up[: len(data)], out=total[1:])
    word = (total[ends] - total[starts]) % PRIME * down[starts] % PRIME
    row = np.repeat(np.arange(len(offsets) - 1) * (2 * dimension), np.diff(offsets))
    # a trigram begins where no word ends in the next two places
    at = np.flatnonzero(~(cut[1:-2] | cut[2:-1]) & (group[:-2] > 0) & (c[:-2] < 4))
    three = small[:-2] + BASE * small[1:-1] + BASE * BASE * small[2:]
    return row[starts] + word % (2 * dimension), row[at] + _places(dimension)[three[at]]


def hash_counts(texts: list[str] | pa.Array, dimension: int = DIMENSION) -> np.ndarray:
    """Signed weights of each text's tokens by their hash, whole numbers; a null text has none."""
    column = (texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).fill_null("")
    out = np.zeros((len(column), dimension), np.int64)
    if not len(column):
        return out
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        words, trigrams = places(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], dimension)
        n = (hi - lo) * 2 * dimension
        signed = (WORD * np.bincount(words, minlength=n) + TRIGRAM * np.bincount(trigrams, minlength=n)).reshape(hi - lo, 2, dimension)
        np.subtract(signed[:, 0], signed[:, 1], out=out[lo:hi])
        lo = hi
    return out


class HashEmbedder:
    """Hashed words and letter trigrams, brought to length 1; a text without any lies along the first dimension."""

    name, sure = "feature-hash", True

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = hash_counts(texts, self.dimension).astype(np.float64)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out[:, 0] += norm[:, 0] == 0
        return (out / np.where(norm, norm, 1)).astype(np.float32)


class ModelEmbedder:
    """A sentence model of a folder: onnx/model.onnx (or model.onnx) and tokenizer.json. Token vectors are averaged over the text's tokens and brought to length 1.

    A row depends on its own text alone: texts of one number of tokens are run together, so that none is padded."""

    def __init__(self, folder: str, name: str, longest: int = 512):
        import onnxruntime
        from tokenizers import Tokenizer

        self.name = name
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # tasks are what runs side by side
        self.session = onnxruntime.InferenceSession(model_file(folder), options)
        self.tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        self.tokenizer.no_padding()
        self.tokenizer.enable_truncation(longest)
        self.inputs = {x.name for x in self.session.get_inputs()}
        self.dimension = self._run(np.array([self.tokenizer.encode("a").ids or [0]], np.int64)).shape[1]

    def _run(self, ids: np.ndarray) -> np.ndarray:
        feeds = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
        mean = self.session.run(None, {k: v for k, v in feeds.items() if k in self.inputs})[0].astype(np.float64).mean(1)
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        return (mean / np.where(norm, norm, 1)).astype(np.float32)

    def embed(self, texts: list[str]) -> np.ndarray:
        ids = [e.ids or [0] for e in self.tokenizer.encode_batch(list(texts))]
        out = np.zeros((len(ids), self.dimension), np.float32)
        for n in {len(x) for x in ids}:
            own = [i for i, x in enumerate(ids) if len(x) == n]
            out[own] = self._run(np.array([ids[i] for i in own], np.int64))
        return out


def model_file(folder: str) -> str | None:
    return next((p for p in (os.path.join(folder, "onnx", "model.onnx"), os.path.join(folder, "model.onnx")) if os.path.isfile(p)), None)


class _Served:
    """Makes the ModelEmbedder of a folder; small, so that it goes to workers, which read the files themselves."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name

    def __call__(self) -> ModelEmbedder:
        return ModelEmbedder(self.folder, self.name)


def served(name: str, folder: str) -> _Served | None:
    """The model of that name, if its files are below the folder, which all workers must see."""
    folder = os.path.join(os.path.expanduser(folder), name)
    return _Served(folder, name) if model_file(folder) and os.path.isfile(os.path.join(folder, "tokenizer.json")) else None


_made: dict[str, Embedder] = {}


def key_of(factory: Callable[[], Embedder]) -> str:
    """The same for the same factory in every process; factories that differ have embedders of their own."""
    return hashlib.md5(cloudpickle.dumps(factory)).hexdigest()


def embedder_of(factory: Callable[[], Embedder], key: str | None = None) -> Embedder:
    key = key or key_of(factory)
    if key not in _made:
        _made[key] = factory()
    return _made[key]


def embed_column(text: Column, factory: Callable[[], Embedder] = HashEmbedder, key: str | None = None, batch: int = 100) -> Column:
    """`batch` texts are embedded at once. A batch that fails is tried row by row, unless the embedder is sure; rows that fail are null and others keep their places."""
    key, sure = key or key_of(factory), getattr(factory, "sure", False)

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        model, rows = embedder_of(factory, key), texts.to_pylist()
        out: list[np.ndarray | None] = [None] * len(rows)
        whole = [i for i, t in enumerate(rows) if t is not None and t.strip()]
        for lo in range(0, len(whole), batch):
            full = whole[lo : lo + batch]
            try:
                for i, v in zip(full, model.embed([rows[i] for i in full]), strict=True):
                    out[i] = v
            except Exception:
                if sure:
                    raise
                for i in full:
                    try:
                        out[i] = model.embed([rows[i]])[0]
                    except Exception:
                        out[i] = None
        return _lists(out, np.float32)

    return run(text)


def _lists(rows: list[np.ndarray | None], kind: type) -> pa.Array:
    """The rows as one array of lists, without an object for each number."""
    none = np.array([r is None for r in rows], bool)
    offsets = np.cumsum([0, *(0 if r is None else len(r) for r in rows)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, kind), *(r for r in rows if r is not None)]).astype(kind, copy=False)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(none))


def hash_counts_column(text: Column, dimension: int = DIMENSION) -> Column:
    """The whole numbers that HashEmbedder brings to length 1."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _lists(list(hash_counts(texts, dimension)), np.int32)

    return run(text)


def embed_text(text: str, factory: Callable[[], Embedder] = HashEmbedder, key: str | None = None) -> list[float]:
    if not text or not text.strip():
        raise ValueError("a blank text has no embedding")
    return [float(x) for x in embedder_of(factory, key).embed([text])[0]]
