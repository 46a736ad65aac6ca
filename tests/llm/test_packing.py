"""Packing: the curve, the ids and the sequences, each against a plain version."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.llm import common, packing, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(packing.TOKENIZER)


@pytest.fixture(scope="module")
def coder():
    return packing.Encoder()


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (4, 2), (5, 2)])
def test_curve_goes_through_every_cell_step_by_step(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = packing.hilbert(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_like_documents_are_neighbours():
    r = random.Random(1)
    topics = [[f"w{t}x{i}" for i in range(40)] for t in range(30)]
    texts = [" ".join(r.choice(topics[t]) for _ in range(300)) for t in range(30) for _ in range(10)]
    order = np.argsort(packing.keys(*common.flat(pa.array(texts))), kind="stable")
    topic = order // 10
    assert (topic[1:] == topic[:-1]).mean() > 0.3  # 0.03 by chance


def test_a_key_follows_the_text_alone():
    r = random.Random(2)
    texts = [" ".join(str(r.randrange(500)) for _ in range(r.randrange(400))) for _ in range(100)] + ["", "é " * 700_000]
    whole = packing.keys(*common.flat(pa.array(texts)))
    assert whole.tolist() == [packing.keys(*common.flat(pa.array([t])))[0] for t in texts]


def ids_of(coder, texts):
    ids, place = coder.batch(*common.flat(pa.array(texts, pa.string())), 1)
    return [ids[a:b].tolist() for a, b in zip(place[:-1], place[1:], strict=True)]


def test_ids_equal_the_librarys_on_the_table(spark, coder, library):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    want = [e.ids + [1] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(coder, texts) == want


def test_odd_texts(coder, library):
    texts = ["", " ", "  a", "a  b", "a\n\nb c", "a\xa0 b　 c d", "<|endoftext|> x <|endoftext|>", "x<|endoftext|>y  z", "it's  we'll'd", "a\x1cb \x1c c\x85 d", "​ a ​ b", "日本 語 １２ ٣", "😀 😀  a", "t\t\tx \t y", "\n", "x \n y\r\n z", "'S 's ' s", "“a” – b", "a b\n c\t d", "x" * 3000, "é à", None]
    assert ids_of(coder, texts) == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'sé \n\t\xa0\u3000“x1", "<|endoftext|>", "the ", " of"]), max_size=30).map("".join), min_size=1, max_size=4))
def test_any_texts(coder, library, texts):
    assert ids_of(coder, texts) == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def check(pieces, want, length):
    """pieces: rows with ids as bytes; want: ids by (doc_id, copy)."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    padding = 0
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, ids in want.items():
        rows = sorted(by_doc.pop(doc_id), key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in rows) == np.array(ids, np.uint32).tobytes()
        assert {p["doc_tokens"] for p in rows} == {len(ids)} and rows[0]["start"] == 0
    assert not by_doc


@pytest.mark.parametrize("length", [64, 2048])
def test_packs_the_whole_table(spark, library, length):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: e.ids + [1] for r, e in zip(rows, library.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True)}
    pieces = packing.pack(docs, length)
    check(pieces.collect(), want, length)
    whole = packing.sequences(pieces)
    lengths = [r["tokens"] for r in whole.select("tokens").collect()]
    assert sum(lengths) == sum(map(len, want.values())) and max(lengths) == length
    got = b"".join(r["ids"] for r in whole.orderBy("sequence_id").collect())
    assert len(got) == 4 * sum(lengths)


def test_query_digests_and_reruns(spark):
    a = sorted(tuple(r) for r in queries.op12_packing(spark, SF).collect())
    assert a == sorted(tuple(r) for r in queries.op12_packing(spark, SF).collect())
    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert a == sorted((p["doc_id"], p["start"], p["length"], zlib.crc32(p["ids"]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in pieces)


def test_odd_and_empty_tables(spark, library, odd_docs, no_docs):
    pieces = packing.pack(odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    want = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in odd_docs.collect() if r["doc_id"] is not None}
    check(pieces, want, packing.LENGTH)
    every = packing.pack(odd_docs)
    assert every.filter("start = 0").count() == odd_docs.count()
    assert every.filter("doc_id is null").select(F.sum("length")).first()[0] == len(library.encode("no id here at all today", add_special_tokens=False).ids) + 1
    assert packing.pack(no_docs).count() == 0 and packing.sequences(packing.pack(no_docs)).count() == 0


def test_copies_are_parted(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the very same words").alias("text"))
    located = docs.select("doc_id", "text", F.xxhash64(F.lit(12), "doc_id").alias("tie")).mapInArrow(packing._place, "doc_id long, text string, place long")
    assert located.select("place").distinct().count() > 2500


def test_tail():
    assert packing.tail(0, 2048) == [0] and packing.tail(4096, 2048) == [4096]
    assert packing.tail(4096 + 1300, 2048) == [4096, 5120, 5376, 5392, 5396]


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        packing.Encoder("/opt/tokenizers/word_bpe_49k.json")
