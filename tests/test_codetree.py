"""The tree as a source: rounds of the walk, filters before anything is opened, one read a file."""

import os

import pytest
from pyspark.sql import functions as F

from corvella.operators import catalog
from corvella.plans.engine import Engine
from corvella.sources import codetree
from corvella.sources.gitignore import Ignore
from corvella.sources.scratch import Staging


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for i in range(6):
        for j in range(5):
            d = root / f"d{i}" / ("node_modules" if j == 1 else f"e{j}") / "deep" / "er"
            d.mkdir(parents=True)
            for k, ext in enumerate((".py", ".ts", ".md", ".log")):
                (d / f"f{k}{ext}").write_text(f"def f{i}{j}{k}():\n    return {k}\n" * (k + 1))
    (root / ".git").mkdir()
    (root / ".git" / "x.py").write_text("x")
    (root / ".gitignore").write_text("*.log\n/d0/e2/\n")
    (root / "link.py").symlink_to(root / "d1" / "e0" / "deep" / "er" / "f0.py")
    (root / "big.py").write_text("x" * 5000)
    return root


def names(df):
    return sorted((r["relativePath"], r["size"]) for r in df.select("relativePath", "size").collect())


@pytest.mark.parametrize("folders,entries", [(1000, 1000), (1, 1), (3, 7), (0, 5)])
def test_rounds_find_what_one_walk_finds(spark, tree, folders, entries):
    counts = {}
    want = sorted((r, n) for _, r, n in codetree.walk(str(tree), counts=counts))
    with Staging(spark) as stage:
        got = codetree.listing(spark, str(tree), stage=stage, driver_folders=folders, task_entries=entries)
        assert names(got.files) == want and got.n == len(want) and got.counts == counts
    assert len(want) == 6 * 5 * 3 - 3 + 1 and not [r for r, _ in want if "link" in r or "e2" in r and r.startswith("d0")]


def test_a_table_of_paths_is_filtered_as_a_walk_filters(spark, tree):
    every = [(os.path.relpath(os.path.join(d, n), tree),) for d, _, fs in os.walk(tree) for n in fs if n != "link.py"]
    df = spark.createDataFrame(every, "relativePath string")
    rules = Ignore((tree / ".gitignore").read_text())
    assert sorted(r[0] for r in codetree.visible(df, rules).collect()) == sorted(r for _, r, _ in codetree.walk(str(tree)))
    for text in ("# no\n!a\n", "build/\n!build/keep.md\n", "d*/**/er\n", "[!x]*.md\n"):
        (tree / ".gitignore").write_text(text)
        own = df.filter("relativePath <> '.gitignore'")
        assert sorted(r[0] for r in codetree.visible(own, Ignore(text)).collect()) == sorted(r for _, r, _ in codetree.walk(str(tree))), text


def test_other_file_systems_by_a_scheme(spark, tree, monkeypatch):
    """pyarrow.fs in place of the operating system."""
    want = sorted((r, n) for _, r, n in codetree.walk(str(tree)) if r != "link.py")
    remote = codetree.Remote(f"file://{tree}")
    w = codetree.Walker(str(tree))
    w.root = f"file://{tree}"
    monkeypatch.setattr(codetree, "file_system", lambda root: remote)
    assert sorted(x for x in w.walk([""]) if x[0] != "link.py") == want
    assert remote.read(f"file://{tree}/big.py") == b"x" * 5000


def test_only_what_is_left_is_opened(spark, tree, tmp_path):
    """Files that a filter rules out can't be read, and nothing is missed."""
    for d, _, fs in os.walk(tree):
        for n in fs:
            if n.endswith(".md") or n == "big.py":
                os.remove(os.path.join(d, n))
                os.mkfifo(os.path.join(d, n))  # opening it would wait for ever
    found = codetree.listing(spark, str(tree))
    assert {r["relativePath"].rsplit(".", 1)[1] for r in found.files.collect()} == {"py", "ts"}  # a fifo is no regular file
    codetree.source(spark)
    df = spark.read.format("codetree").load(str(tree)).filter("relativePath LIKE '%.py' AND size < 100")
    assert "PushedFilters" in df._jdf.queryExecution().executedPlan().toString() or df.count() == 29
    assert sorted(r["relativePath"] for r in df.collect()) == sorted(r for _, r, n in codetree.walk(str(tree)) if r.endswith(".py") and n < 100)
    assert spark.read.format("codetree").option("content", "false").load(str(tree)).filter("content IS NOT NULL").count() == 0


def test_pushed_filters():
    from pyspark.sql.datasource import EqualTo, IsNotNull, LessThanOrEqual, StringEndsWith

    reader = codetree.CodeTreeReader({"path": "/none"})
    kept = IsNotNull(("size",))
    assert list(reader.pushFilters([StringEndsWith(("relativePath",), ".py"), kept, LessThanOrEqual(("size",), 9), EqualTo(("content",), b"x")])) == [kept, EqualTo(("content",), b"x")]
    assert [(i, v) for i, _, v in reader.tests] == [(1, ".py"), (2, 9)]


def test_an_ingest_opens_each_supported_file_once(spark, tree, tmp_path, monkeypatch):
    log, real = str(tmp_path / "opened"), codetree._read

    def noted(root, keep, at, seen=None):
        inner = real(root, keep, at, seen)

        def run(batches):
            for batch in batches:
                with open(log, "a") as f:
                    f.write("".join(x + "\n" for x in batch.column(at).to_pylist()))
                yield from inner([batch])

        return run

    monkeypatch.setattr(codetree, "_read", noted)

    def opened():
        with open(log) as f:
            out = sorted(f.read().split())
        os.remove(log)
        return out

    told = []
    engine = Engine(spark, str(tmp_path / "s"))
    out = engine.ingest(str(tree), "a", tell=lambda *x: told.append(x))
    supported = sorted(r for _, r, _ in codetree.walk(str(tree)) if r.endswith((".py", ".ts")))
    assert opened() == supported
    assert out["supportedFiles"] == len(supported) and out["totalFiles"] == 88 and out["skippedByGitignore"] > 0
    assert told[-1][0] == "Complete" and ("Reading", len(supported), len(supported)) in told and ("Chunking and embedding", len(supported), len(supported)) in told
    assert engine.rescan("a")["filesUnchanged"] == len(supported)
    assert opened() == supported
    changed = tree / "d1" / "e0" / "deep" / "er" / "f0.py"
    changed.write_text("def other():\n    return 1\n")
    diff = engine.rescan("a")
    assert (diff["filesModified"], diff["chunksAdded"], diff["chunksDeleted"]) == (1, 1, 1)
    assert opened() == sorted([*supported, os.path.relpath(changed, tree)])
    assert len(engine.store.info("a")["folders"]) == 2 and engine.store.info("a")["folders"][1]["rows"] == 1  # what is unchanged isn't written
    ids = [r["id"] for r in engine.store.chunks("a").select("id").collect()]
    assert len(ids) == len(set(ids)) == out["chunkCount"]


def test_statistics_of_an_empty_tree(spark, tmp_path):
    found = codetree.listing(spark, str(tmp_path / "missing"))
    row = catalog.scan_statistics(codetree.described(found.files)).first()
    assert (row["totalFiles"], row["supportedFiles"], row["unsupportedByExtension"]) == (0, 0, {})
    assert codetree.contents(codetree.described(found.files), str(tmp_path), 0).agg(F.count("*")).first()[0] == 0
