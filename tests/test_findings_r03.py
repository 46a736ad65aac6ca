"""Inputs on which the findings of round 3 were made."""

import os

import pytest
from oracle import TABLES, same
from pyspark.sql import functions as F

from corvella.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a folder of tables like SF, but for those given."""

    def write(**own):
        for name in TABLES:
            if name in own:
                own[name].coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            else:
                os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def test_formats_of_odd_pages(spark, tables):
    """Whole percentages, sizes in the middle of two hundredths, marks that forms encode otherwise, nulls."""
    sizes = [0, 1, 5800, 11600, 23200, 131072, 393216, 655360, 1179648, None]
    rows = [(i, f"https://a.b/~c/*d/'e' f+%7E{i}?ü=1", n) for i, n in enumerate(sizes)] + [(99, None, 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, n int").select("page_id", "url", F.repeat(F.lit("x"), F.col("n")).alias("html"))
    sf = tables(pages=pages)
    same(QUERIES["text_formats"](spark, sf), ORACLE["text_formats"], sf)


def _counted(spark, files):
    """files with contents that come from a function, and the accumulator of how many it has made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(i):
        made.add(1)
        return f"def f{i}():\n    return {i}\n\n\nclass C{i}:\n    def run(self):\n        return 1\n"

    return files.select("relativePath", content("id").alias("content")), made


def test_contents_are_made_once(spark, tmp_path):
    """An ingest makes each content once, and so does a rescan; ids follow the order of path and chunk."""
    from corvella.plans.engine import Engine

    engine = Engine(spark, f"file://{tmp_path}/store")
    path = F.concat(F.lit("src/f"), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, ".md").otherwise(".py"))
    files = spark.range(3000).select("id", path.alias("relativePath"))
    table, made = _counted(spark, files)
    out = engine.ingest_files(table, "a")
    assert (out["totalFiles"], out["supportedFiles"], out["chunkCount"]) == (3000, 2400, 7200)
    assert made.value <= 3000
    rows = engine.store.chunks("a").select("id", "filePath", "startLine").collect()
    rows.sort(key=lambda r: int(r["id"].rpartition("_")[2]))
    assert [int(r["id"].rpartition("_")[2]) for r in rows] == list(range(7200))
    assert [(r["filePath"], r["startLine"]) for r in rows] == sorted((r["filePath"], r["startLine"]) for r in rows)
    table, made = _counted(spark, files.filter("id < 2000").unionByName(spark.range(5000, 5100).select("id", path.alias("relativePath"))))
    out = engine.rescan_files(table, "a")
    assert (out["filesAdded"], out["filesModified"], out["filesDeleted"], out["chunksAdded"]) == (80, 0, 800, 240)
    assert made.value <= 2100


def test_large_files_of_a_table_are_left_out(spark, tmp_path):
    from corvella.config import DEFAULTS
    from corvella.plans.engine import Engine

    engine = Engine(spark, f"file://{tmp_path}/store", DEFAULTS | {"ingestion": DEFAULTS["ingestion"] | {"maxFileSize": 40}})
    files = spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.py", "def g():\n    return 1\n" + "#" * 50), ("c.md", "x" * 90), ("d.py", None)], "relativePath string, content string")
    out = engine.ingest_files(files, "a")
    assert (out["totalFiles"], out["supportedFiles"], out["chunkCount"]) == (2, 2, 1)
    out = engine.rescan_files(files.filter("relativePath <> 'd.py'"), "a")
    assert (out["filesUnchanged"], out["filesDeleted"], out["filesAdded"]) == (1, 1, 0)


def test_sources_keep_letters_digits_and_blanks(spark, tables):
    """By the runs that stay, which is several times faster than looking for the marks; the same text."""
    from corvella.plans.queries import _sources

    odd = ["", None, "...", ".a", "a..", "\n\n", "é 😀a b\tc\r\nd", "".join(map(chr, range(1, 0x300))), "x.\n" * 300]
    docs = spark.createDataFrame([(5 * i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    sources = _sources(spark, tables(documents=docs))
    assert "regexp_replace" not in sources._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["doc_id"]: r["content"] for r in sources.collect()}
    for i, t in enumerate(odd):
        lines = "".join(c for c in t or "" if c.isascii() and (c.isalnum() or c in " \n")).split("\n")
        head = f"// of {5 * i}\nexport async function f{5 * i}<T,>(a: T): Promise<void> {{\n"
        assert got[5 * i].startswith(head + "\n".join(f'  say("{{ {x} }}");' for x in lines) + "\n}\n")


def test_vectors_come_from_one_worker_in_small_batches(spark):
    """Both columns of embed_documents go through one Python worker, whose batches are bounded; it held 5 GB before at 0.1 GB of documents."""
    df = QUERIES["embed_documents"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_vectors_are_written_once(spark, tmp_path, monkeypatch):
    """Of an embedder that can't fail no vector is staged: chunks are numbered before they are embedded. One that can is asked before they are numbered."""
    from corvella.operators.embed import HashEmbedder
    from corvella.plans.engine import Engine
    from corvella.sources.scratch import Staging

    class Unsure(HashEmbedder):
        sure = False

        def embed(self, texts):
            if any("f3(" in t for t in texts):
                raise ValueError
            return super().embed(texts)

    staged, write = [], Staging.__call__
    monkeypatch.setattr(Staging, "__call__", lambda self, df: staged.append(df.columns) or write(self, df))
    files = spark.createDataFrame([(f"f{i}.py", f"def f{i}():\n    return 1\n") for i in range(20)], "relativePath string, content string")
    for embedder, chunks in ((None, 20), (Unsure, 19)):
        staged.clear()
        engine = Engine(spark, f"file://{tmp_path}/store{chunks}", embedder=embedder)
        engine.ingest_files(files, "a")
        assert engine.rescan_files(files.withColumn("content", F.concat("content", F.lit("\n"))), "a")["chunksAdded"] == chunks
        assert any("vector" in columns for columns in staged) == (embedder is Unsure)
        rows = engine.store.chunks("a").collect()
        assert sorted(int(r["id"].rpartition("_")[2]) for r in rows) == list(range(chunks))
        assert all(len(r["vector"]) == 384 for r in rows)


def test_long_strings_are_read_by_runs():
    """Strings with and without escapes, ended or not, at a few nanoseconds a character; the choice at each character took twenty times that."""
    import time

    from corvella.operators.chunker import chunks

    odd = ['"a\\"b"', '"a', "'\\\\'", '"\\', '@"a""b\\"', '$"{x}"', '"a\\\nb"', "`a\\`${1}$`"]
    for language in ("javascript", "typescript", "java", "csharp"):
        for text in odd:
            chunks(text, language)
    text = "class A { int f() { say(\"" + "word " * 2_000_000 + "\"); } }"
    assert [c.kind for c in chunks(text[:200] + '"); } }', "java")] == ["class", "method"]
    best = []
    for _ in range(3):
        began = time.perf_counter()
        assert [c.kind for c in chunks(text, "java")] == ["class", "method"]
        best.append(time.perf_counter() - began)
    assert min(best) < 0.3


def test_blank_chunks_are_those_of_python(spark):
    """What is numbered before it is embedded is what the embedder takes."""
    from corvella.functions.text import not_blank

    rows = [(i, c * 2) for i, c in enumerate([chr(i) for i in range(1, 0x3100)])] + [(0x3100, ""), (0x3101, "  a ")]
    df = spark.createDataFrame(rows, "i int, t string").select("i", not_blank(F.col("t")).alias("full"))
    got = {r["i"]: r["full"] for r in df.collect()}
    assert got == {i: bool(t.strip()) for i, t in rows}
