"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut where a space follows another character; pieces never cross such a
place. Equal words are encoded once; words are sorted by length and those of equal or
next length advance together, one byte at a time: the hash of every substring that ends there is probed in the sorted piece
keys, and the best piece's length and id are stored as backpointers.

A unigram model's best is the largest sum of scores. A byte-pair model has no such sum:
its encoding is the result of merges. There the transition is allowed or not: the
encoding of a word's prefix ends with the one piece that its own merges leave apart
from the last piece of the shorter prefix, and the same vectorised search over
backpointers finds it. Whether two pieces stay apart is decided from the ranks of the
merges along their common edge and is remembered for each pair. Words with runs of
spaces and very long words are merged one by one, exactly too.

Defined results: a null text has null ids; an empty one has none. Characters without a
piece become bytes (or the unknown id, where a model has no bytes). Decoding gives the
text back exactly, for any text without U+2581, which stands for a space. Very long texts
are encoded whole. Repeated rows give equal ids; of tied merges the leftmost goes first, of
tied sums the longest piece stays. An empty table gives no rows. Extra columns play no
part. Models with a normaliser other than identity are refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corvella.llm.common import _BASE, _BYTES, _powers, flat, slices, span_hashes, bounded, freed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longer words go the plain way, one by one.
LONGEST = 64
CACHE = 1 << 20
SLICE = 1 << 20
#: Words that advance together.
ROWS = 8192
_MARK = "▁"
_NEVER = 1 << 30
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """Pieces of a model file as arrays; spaces stand for U+2581."""

    def __init__(self, blob: bytes):
        self.pieces: list[bytes] = []
        score, kind = [], []
        self.unigram, self.prefix = True, True
        for field, value in _fields(blob):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(bytes(p[1]).decode().replace(_MARK, " ").encode())
                score.append(np.frombuffer(p.get(2, b"\0\0\0\0"), np.float32)[0])
                kind.append(p.get(3, NORMAL))
            elif field == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif field == 3:
                n = dict(_fields(value))
                if n.get(2) or n.get(4, 1) or not n.get(5, 1):
                    raise ValueError("only models with the identity normaliser that keep all white space are supported")
                self.prefix = bool(n.get(3, 1))
        self.score, self.kind = np.array(score, np.float64), np.array(kind)
        self.size = len(self.pieces)
        self.bytes = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kind == BYTE):
            self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kind[i] in (NORMAL, 4)}
        self._ranks()
        self._keys()

    # -- merges of a byte-pair model

    def merge(self, word: str) -> list[int]:
        """Ids of one word by merging the best pair, the leftmost of equals, until none is left; -1 for a character without piece."""
        s = [c.encode() for c in word]
        left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        todo: list[tuple] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(s) and (k := self.id.get(s[i] + s[j])) is not None:
                heapq.heappush(todo, (-self.score[k], i, s[i], s[j]))

        for i in range(len(s)):
            offer(i)
        self.last: tuple[bytes, bytes] | None = None
        while todo:
            _, i, a, b = heapq.heappop(todo)
            j = right[i] if s[i] == a else len(s)
            if s[i] != a or j >= len(s) or s[j] != b:
                continue
            self.last = a, b
            s[i], s[j] = a + b, b""
            right[i] = right[j]
            if right[i] < len(s):
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [self.id.get(x, -1) for x in s if x]

    def _ranks(self) -> None:
        """rank: 0 for single characters, else the place of the piece among the merges; parts: the two pieces of its last merge."""
        self.rank, self.parts = np.full(self.size + 1, 0, np.int64), np.full((self.size + 1, 2), -1, np.int64)
        self.usable = np.zeros(self.size + 1, bool)
        order = np.unique(-self.score, return_inverse=True)[1] + 1
        for p, i in self.id.items():
            word = p.decode()
            if self.unigram or len(word) == 1:
                self.usable[i] = True
            elif self.merge(word) == [i] and self.last:
                self.usable[i], self.rank[i] = True, order[i]
                self.parts[i] = [self.id[x] for x in self.last]

    def _keys(self) -> None:
        ids = np.array([i for p, i in self.id.items()])
        text = [self.pieces[i] for i in ids]
        ends = np.cumsum([len(t) for t in text])
        raw = self.raw(np.frombuffer(b"".join(text), np.uint8), ends - [len(t) for t in text], ends)
        self.length = np.zeros(self.size + 1, np.int64)
        self.length[ids] = [len(t) for t in text]
        self.hash = np.zeros(self.size + 1, np.uint64)
        self.hash[ids] = raw
        key = _salted(raw, self.length[ids])
        order = np.argsort(key)
        self.key, self.key_id = key[order], ids[order]
        self.may = np.zeros(1 << 20, bool)
        self.may[(key >> np.uint64(44)).astype(np.int64)] = True
        self.longest = int(self.length.max())
        self.lengths = np.zeros(self.longest + 1, bool)
        self.lengths[[len(t) for t in text if t.strip(b" ")]] = True
        self.longest = int(np.flatnonzero(self.lengths)[-1])

    @staticmethod
    def raw(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = _powers(1 << max(20, len(data).bit_length()))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
        return (total[ends] - total[starts]) * down[starts]

    def find(self, raw: np.ndarray, length) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        key = _salted(raw, length)
        out = np.full(len(key), -1, np.int64)
        hit = np.flatnonzero(self.may[(key >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.key, key[hit]), len(self.key) - 1)
        same = self.key[at] == key[hit]
        out[hit[same]] = self.key_id[at[same]]
        return out


def _salted(raw: np.ndarray, length) -> np.ndarray:
    h = (raw + np.asarray(length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


class Encoder:
    """A model with what has been learned of pairs and words so far; one for each Python worker."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.pair_key, self.pair_ok = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)
        self.flat_store = np.zeros(0, np.int32)

    # -- pairs

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b side by side are an encoding. Piece `size` is a character without piece: always apart."""
        m = self.m
        key = a * (m.size + 1) + b
        slot = ((key.astype(np.uint64) * _BASE) >> np.uint64(43)).astype(np.int64)
        out = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            k, at = np.unique(key[new], return_inverse=True)
            ok = self._decide(k // (m.size + 1), k % (m.size + 1))
            out[new] = ok[at]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[at]
        return out

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m, up = self.m, _powers(1 << 10)[0]
        out = (a == m.size) | (b == m.size)
        live = np.flatnonzero(~out)
        a, b, limit = a[live].copy(), b[live].copy(), np.full(len(live), _NEVER)
        while len(live):
            c = m.find(m.hash[a] + m.hash[b] * up[m.length[a]], m.length[a] + m.length[b])
            clash = (c >= 0) & (np.where(c >= 0, np.where(m.usable[c], m.rank[c], _NEVER), _NEVER) < limit)
            ra, rb = m.rank[a], m.rank[b]
            base_a, base_b = m.parts[a, 0] < 0, m.parts[b, 0] < 0
            open_a = ~base_a & ((ra > rb) | base_b)
            over = base_a & base_b
            out[live[over & ~clash]] = True
            limit = np.where(open_a, ra, rb + 1)
            a, b = np.where(open_a, m.parts[a, 1], a), np.where(open_a | over, b, m.parts[b, 0])
            on = ~clash & ~over
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return out

    # -- words of about equal length

    def words(self, w: np.ndarray, size_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of m words, filled up with zeros to n bytes → ids, word by word, and the number of each word's ids."""
        m, (count, n) = self.m, w.shape
        up, down = _powers(1 << 10)
        total = np.zeros((n + 1, count), np.uint64)
        np.cumsum((_BYTES[w] * up[:n]).T, axis=0, out=total[1:])
        lead = (w.T & 0xC0) != 0x80  # first bytes of characters
        lead = np.concatenate([lead, np.ones((1, count), bool)])
        last = np.full((n + 1, count), -1, np.int64)
        back = np.zeros((n + 1, count), np.int64)
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0
        lowest = m.score[m.kind == NORMAL].min() - 10
        for i in range(1, n + 1):
            todo = np.flatnonzero(lead[i] & (size_of >= i))
            for size in range(min(i, m.longest), 0, -1):
                if not len(todo):
                    break
                if not m.lengths[size]:
                    continue
                rows = todo[lead[i - size, todo] & (best[i - size, todo] > -np.inf)]
                found = m.find((total[i, rows] - total[i - size, rows]) * down[i - size], size)
                hit = found >= 0
                rows, found = rows[hit], found[hit]
                if not len(rows):
                    continue
                if m.unigram:
                    s = best[i - size, rows] + m.score[found]
                    ok = s > best[i, rows]
                    best[i, rows[ok]] = s[ok]
                else:
                    ok = m.usable[found]
                    if i > size:
                        ok[ok] = self.apart(last[i - size, rows[ok]], found[ok])
                    best[i, rows[ok]] = 0
                last[i, rows[ok]], back[i, rows[ok]] = found[ok], size
                if not m.unigram:
                    todo = todo[best[i, todo] == -np.inf]
            for size in range(1, min(i, 4) + 1):  # a character without piece
                rows = np.flatnonzero(lead[i] & (size_of >= i) & lead[i - size] & (best[i - size] > -np.inf) & (lead[i - size + 1 : i].sum(0) == 0 if size > 1 else True))
                if len(rows):
                    alone = m.find((total[i, rows] - total[i - size, rows]) * down[i - size], size) < 0
                    rows = rows[alone]
                    s = best[i - size, rows] + (lowest if m.unigram else 0)
                    ok = s > best[i, rows] if m.unigram else best[i, rows] == -np.inf
                    rows = rows[ok]
                    best[i, rows], last[i, rows], back[i, rows] = s[ok], m.size, size
        ids, owner, byte_at = [], [], []
        at, live = size_of.copy(), np.arange(count)
        while len(live):
            ids.append(last[at[live], live])
            owner.append(live)
            at[live] -= back[at[live], live]
            byte_at.append(at[live].copy())
            live = live[at[live] > 0]
        ids, owner, byte_at = np.concatenate(ids), np.concatenate(owner), np.concatenate(byte_at)
        order = np.lexsort((byte_at, owner))
        ids, owner, byte_at = ids[order], owner[order], byte_at[order]
        odd = ids == m.size
        if odd.any():
            ids, owner = self._bytes(ids, owner, w, size_of, byte_at, odd)
        return ids.astype(np.int32), np.bincount(owner, minlength=count)

    def _bytes(self, ids, owner, w, size_of, at, odd):
        """Characters without piece as their bytes."""
        m = self.m
        if m.bytes[0] < 0:
            return np.where(odd, m.unknown, ids), owner
        nxt = np.append(at[1:], 0)
        end = np.where(np.append(owner[1:] == owner[:-1], False), nxt, size_of[owner])
        times = np.where(odd, end - at, 1)
        rep = np.repeat(np.arange(len(ids)), times)
        inside = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
        return np.where(odd[rep], m.bytes[w[owner[rep], np.minimum(at[rep] + inside, w.shape[1] - 1)]], ids[rep]), owner[rep]

    def plain(self, word: bytes) -> list[int]:
        m, out = self.m, []
        text = word.decode("utf-8", "replace")
        for i, c in zip(ids := m.merge(text), self._runs(text, ids), strict=True) if not m.unigram else self._viterbi(text):
            if i >= 0:
                out.append(i)
            elif m.bytes[0] < 0:
                out.append(m.unknown)
            else:
                out += [int(m.bytes[b]) for b in c.encode()]
        return out

    def _runs(self, text: str, ids: list[int]) -> list[str]:
        out, at = [], 0
        for i in ids:
            n = len(self.m.pieces[i].decode()) if i >= 0 else 1
            out.append(text[at : at + n])
            at += n
        return out

    def _viterbi(self, text: str) -> list[tuple[int, str]]:
        m, low = self.m, self.m.score[self.m.kind == NORMAL].min() - 10
        b = [(0.0, 0, -1)] + [(-np.inf, 0, -1)] * len(text)
        for i in range(1, len(text) + 1):
            for size in range(1, min(i, m.longest) + 1):
                k = m.id.get(text[i - size : i].encode())
                if k is not None or size == 1:
                    b[i] = max(b[i], (b[i - size][0] + (low if k is None else m.score[k]), size, -1 if k is None else k), key=lambda x: x[0])
        out, i = [], len(text)
        while i:
            out.append((b[i][2], text[i - b[i][1] : i]))
            i -= b[i][1]
        return out[::-1]

    # -- texts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them."""
        n = len(offsets) - 1
        full = offsets[1:] > offsets[:-1]
        if self.m.prefix:
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        space = data == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[offsets[:-1][full]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        h = span_hashes(data, starts, ends)
        u, first, at = np.unique(h, return_index=True, return_inverse=True)
        place = self._lookup(u, data, starts[first], ends[first])
        lo, size = self.ends[place], self.ends[place + 1] - self.ends[place]
        times = size[at]
        stop = np.cumsum(times)
        source = np.repeat(lo[at] - (stop - times), times) + np.arange(stop[-1])
        words = np.searchsorted(starts, offsets)
        return self.flat_store[source], np.concatenate([[0], stop])[words]

    def _lookup(self, u: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.known) > CACHE:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, u), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != u) if len(self.known) else np.arange(len(u))
        if len(new):
            order, ids, counts = self._fresh(data, starts[new], ends[new])
            place = np.empty(len(new), np.int64)
            place[order] = len(self.ends) - 1 + np.arange(len(new))
            into = np.searchsorted(self.known, u[new])  # both are sorted, so they merge in one pass
            self.known, self.place = np.insert(self.known, into, u[new]), np.insert(self.place, into, place)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            self.flat_store = np.concatenate([self.flat_store, ids])
            at = np.searchsorted(self.known, u)
        return self.place[at]

    def _fresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words by length: (order of the words, ids, number of ids)."""
        size = ends - starts
        spaces = np.concatenate([[0], np.cumsum(data == 32)])
        odd = (spaces[ends] - spaces[starts] > 1) | (size > LONGEST)
        order, ids, counts = [], [], []
        plain = np.flatnonzero(~odd)
        plain = plain[np.argsort(size[plain], kind="stable")]
        for lo in range(0, len(plain), ROWS):
            part = plain[lo : lo + ROWS]
            column = np.arange(size[part[-1]])
            w = data[np.minimum(starts[part][:, None] + column, len(data) - 1)]
            w[column >= size[part][:, None]] = 0
            a, b = self.words(w, size[part])
            order.append(part)
            ids.append(a)
            counts.append(b)
        for r in np.flatnonzero(odd):
            x = self.plain(data[starts[r] : ends[r]].tobytes())
            order.append(np.array([r]))
            ids.append(np.array(x, np.int32))
            counts.append(np.array([len(x)]))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, and the offsets of the texts in them."""
        m = self.m
        if not hasattr(self, "spell"):
            spelt = [bytes([int(p[3:5], 16)]) if k == BYTE else p if k in (NORMAL, 4) else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(m.pieces, m.kind, strict=True)]
            self.spell, self.spell_at = np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelt])])
        lo, size = self.spell_at[ids], self.spell_at[ids.astype(np.int64) + 1] - self.spell_at[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        data = self.spell[np.repeat(lo - (stop - size), size) + np.arange(total)]
        offsets = np.concatenate([[0], stop])[at]
        if m.prefix:
            full = offsets[1:] > offsets[:-1]
            keep = np.ones(len(data), bool)
            first = offsets[:-1][full]
            keep[first[data[first] == 32]] = False
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            data = data[keep]
        return data, offsets


_encoders: dict[int, Encoder] = {}


def load(path: str = MODEL) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


ENCODED = "ids array<int>, n_ids int, round_trip boolean"


def _texts(column: pa.Array) -> pa.Array:
    return pc.replace_substring(column, _MARK, " ") if pc.any(pc.match_substring(column, _MARK)).as_py() else column


def _encode(model: PieceModel):
    import hashlib

    token = int(hashlib.md5(b"".join(model.pieces)).hexdigest()[:12], 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(token, Encoder(model)) if token not in _encoders else _encoders[token]
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            data, offsets = flat(_texts(column))
            for lo, hi in slices(offsets, SLICE):
                own = offsets[lo : hi + 1]
                part, at = data[own[0] : own[-1]], own - own[0]
                ids, ends = encoder.encode(part, at)
                back, edge = encoder.decode(ids, ends)
                if len(back) == len(part) and (edge == at).all():
                    bad = np.concatenate([[0], np.cumsum(back != part)])
                    same = bad[at[1:]] == bad[at[:-1]]
                else:
                    same = np.array([back[edge[i] : edge[i + 1]].tobytes() == part[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)])
                valid = column.slice(lo, hi - lo).is_valid()
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                none = pa.nulls(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)), pc.if_else(valid, lists, none.cast(lists.type)), pc.if_else(valid, pa.array(np.diff(ends).astype(np.int32)), none.cast(pa.int32())), pc.if_else(valid, pa.array(same), none.cast(pa.bool_()))],
                    names=[*batch.schema.names[:-1], "ids", "n_ids", "round_trip"],
                )

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, and whether decoding gives the text back, for each row."""
    return bounded(docs).select("doc_id", "text").mapInArrow(freed(_encode(load(path))), f"doc_id long, {ENCODED}")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids; bytes that are no UTF-8 become U+FFFD; null ids a null text."""
    model = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            lists = batch.column(1)
            none = lists.is_null().to_numpy(zero_copy_only=False)
            lists = pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type)) if none.any() else lists
            at = np.asarray(lists.offsets).astype(np.int64)
            data, ends = encoder.decode(np.asarray(lists.flatten()).astype(np.int64), at - at[0])
            texts = [None if x else data[a:b].tobytes().decode("utf-8", "replace") for x, a, b in zip(none, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return bounded(encoded).select("doc_id", "ids").mapInArrow(freed(run), "doc_id long, text string")
