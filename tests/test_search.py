"""Pruned search against a full scan, token counts against plain merges, the cache, and a served model."""

import base64
import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.config import DEFAULTS, ConfigError
from corvella.operators import pivots
from corvella.operators.chunker import ChunkFile
from corvella.operators.embed import embed_column, embed_text, served
from corvella.operators.search import Cache, nearest
from corvella.operators.splitter import counter, estimate, split_by_tokens
from corvella.plans.engine import Engine

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(20, 12))[r.integers(0, 20, 3000)] * 5 + 0.3 * r.normal(size=(3000, 12))
    x[50:90] = x[50]
    rows = [(i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(4000, 0, None), (4001, 0, []), (4002, 0, [1.0]), (4003, 0, [float("nan")] * 12), (4004, 0, [None] * 12)]
    return spark.createDataFrame(rows + odd, "id int, label int, vector array<double>"), x


def test_pruned_search_equals_a_scan(spark, clustered, tmp_path):
    df, x = clustered
    index = pivots.build(df, str(tmp_path), pivots=24)
    assert sum(n for _, _, n in index.cells.values()) == 3000
    plain = lambda d: [(r["id"], r["distance"]) for r in d.orderBy("distance", "id").collect()]
    read = []
    for q, k, where in ((x[0], 5, None), (x[50], 45, None), (x[7] + 0.1, 1, None), (x[9], 8, F.col("label") == 1), (np.zeros(12), 30, None), (x[1], 4000, None)):
        want = nearest(df.filter("id < 4000").filter(F.lit(True) if where is None else where), [float(v) for v in q], k)
        got = plain(index.search([float(v) for v in q], k, where=where))
        assert got == plain(want)
        read.append(index.read_rows)
    assert max(read[:2]) < 1500 and read[-1] == 3000
    with pytest.raises(ValueError, match="components"):
        index.search([1.0], 1)
    index.drop()


def test_pruned_search_of_few_or_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id int, vector array<double>")
    assert [r["id"] for r in pivots.build(df, str(tmp_path)).search([0.0, 0.0], 5).orderBy("id").collect()] == [1, 2]
    empty = pivots.build(df.limit(0), str(tmp_path))
    assert empty.cells == {} and empty.search([0.0], 3).count() == 0


# -- tokens


def merged(piece, ranks):
    """Plain merges: the pair of least rank, the leftmost of equals, until none is left."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return len(parts)


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("abtheing 'sER\n\t._(){};=0123é日😀"), max_size=60))
def test_counts_equal_plain_merges(ranks, text):
    regex = pytest.importorskip("regex")
    from corvella.operators.splitter import PIECES

    assert counter(RANKS)(text) == sum(merged(p.encode(), ranks) for p in regex.findall(PIECES, text))


def test_counters(tmp_path):
    assert counter() is estimate and counter(str(tmp_path / "none")) is estimate
    (tmp_path / "broken").write_text("not ranks")
    assert counter(str(tmp_path / "broken")) is estimate
    text = "\n".join(f"def function_{i}(a, b): return a + {i}  # says what" for i in range(200))
    count = counter(RANKS)
    parts = split_by_tokens(text, 100, 10, count)
    assert all(count(p) <= 110 for p in parts) and parts != split_by_tokens(text, 100, 10)


def test_chunks_are_measured_by_the_file(spark):
    spark.udtf.register("chunk_file", ChunkFile)
    body = "\n".join(f"    value_{i} = compute({i})" for i in range(60))
    spark.createDataFrame([(f"def run():\n{body}\n".encode(),)], "content binary").createOrReplaceTempView("measured")
    n = lambda extra: spark.sql(f"SELECT count(*) n FROM measured m, LATERAL chunk_file(m.content, 'python', 200, 0{extra}) c").first()[0]
    assert n(f", '{RANKS}'") != n("") and n(", ''") == n("")


# -- cache


def test_a_cache_is_bounded_and_follows_the_store(spark, tmp_path):
    now, cache = [0.0], None
    cache = Cache(60, lambda: now[0], most=2)
    for k in "abc":
        cache.put(k, k)
        cache.get("b")
    assert cache.get("a") is None and cache.get("b") == "b" and cache.get("c") == "c" and cache.stats()["size"] == 2
    tree = tmp_path / "t"
    tree.mkdir()
    (tree / "a.py").write_text("def one():\n    return 1\n")
    shared = Cache(60)
    one, two = (Engine(spark, str(tmp_path / "s"), cache=shared) for _ in range(2))
    one.ingest(str(tree), "a")
    first = one.search("one")
    assert two.search("one") is first
    Engine(spark, str(tmp_path / "s")).delete_file("a", "a.py")  # another process would do the same
    assert two.search("one")["results"] == [] and one.search("one")["results"] == []


# -- a served model


def field(n, value):
    """A field of a protocol buffer message."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(n << 3 | 2) + varint(len(value)) + value


def model_of(table):
    """A model with one node: rows of a table by input_ids."""
    shape = lambda *dims: field(2, b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims))
    value = lambda name, kind, *dims: field(1, name) + field(2, field(1, field(1, kind) + shape(*dims)))
    tensor = field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, 1) + field(8, "w") + field(9, table.astype("<f4").tobytes())
    node = field(1, "w") + field(1, "input_ids") + field(2, "last_hidden_state") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, tensor) + field(11, value("input_ids", 7, "b", "n")) + field(12, value("last_hidden_state", 1, "b", "n", table.shape[1]))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


@pytest.fixture
def model(tmp_path):
    pytest.importorskip("onnxruntime")
    words = ["[UNK]", "red", "green", "blue", "tree"]
    folder = tmp_path / "models" / "own" / "small"
    (folder / "onnx").mkdir(parents=True)
    table = np.random.default_rng(8).normal(size=(len(words), 6))
    (folder / "onnx" / "model.onnx").write_bytes(model_of(table))
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {w: i for i, w in enumerate(words)}, "unk_token": "[UNK]"}}
    (folder / "tokenizer.json").write_text(json.dumps(spec))
    return tmp_path / "models", words, table


def test_a_served_model(spark, model, tmp_path):
    cache, words, table = model
    made = served("own/small", str(cache))
    texts = ["red tree", "Green", "blue blue RED tree other", "other things", "red tree"]

    def plain(text):
        v = np.mean([table.astype(np.float32)[words.index(w) if w in words else 0] for w in re.findall(r"\w+", text.lower())], axis=0, dtype=float)
        return v / np.linalg.norm(v)

    got = [r["v"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", embed_column(F.col("t"), made).alias("v")).orderBy("i").collect()]
    assert np.abs(np.array(got) - [plain(t) for t in texts]).max() < 1e-6 and got[0] == got[4] == embed_text("red tree", made)
    config = json.loads(json.dumps(DEFAULTS))
    config["embedding"] = {"modelName": "own/small", "cachePath": str(cache)}
    tree = tmp_path / "t"
    tree.mkdir()
    (tree / "a.py").write_text("def red():\n    return tree\n\n\ndef blue():\n    return green\n")
    engine = Engine(spark, str(tmp_path / "s"), config)
    engine.ingest(str(tree), "a")
    assert {len(r[0]) for r in engine.store.chunks("a").select("vector").collect()} == {6}
    assert engine.search("blue green")["results"][0]["content"].startswith("def blue")
    config["embedding"]["modelName"] = "own/none"
    with pytest.raises(ConfigError, match="own/none"):
        Engine(spark, str(tmp_path / "s"), config)
    assert served("own/none", str(cache)) is None


# -- the hashing embedder


def plain_counts(text, dimension):
    text = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", text))
    out = [0] * dimension
    for w in re.findall(r"[A-Za-z]+|[0-9]+|[^\x00-\x7f]+", text):
        b = (w.lower() if w.isascii() else w).encode()
        for t, weight in [(b, 10)] + [(b[i : i + 3], 3) for i in range(len(b) - 2) if w.isascii()]:
            h = sum(x * pow(31, i, 2**31 - 1) for i, x in enumerate(t)) % (2**31 - 1)
            out[h % dimension] += -weight if h // dimension % 2 else weight
    return out


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("abzABZ019 _-.é日İ\n"), max_size=40), min_size=1, max_size=5))
def test_hash_counts(texts):
    from corvella.operators import embed

    assert embed.hash_counts(texts, 50).tolist() == [plain_counts(t, 50) for t in texts]


def test_hash_counts_of_slices_and_long_words(monkeypatch):
    from corvella.operators import embed

    texts = ["HTTPServer parseXMLFile x1y2", None, "", "z" * 5000, "naïve café", "aB" * 700]
    want = [plain_counts(t or "", 384) for t in texts]
    for size in (1, 20, 1 << 21):
        monkeypatch.setattr(embed, "SLICE", size)
        assert embed.hash_counts(texts).tolist() == want
