"""The store: what a change writes, what readers see, and that deletes, names and partial aggregates agree with plain rewrites."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.operators import catalog
from corvella.sources import store as module
from corvella.sources.store import NotFound, Store


def rows(spark, some):
    """some: (id, file, timestamp, codebase)."""
    return spark.createDataFrame([(i, f"text of {i}", f, t, c, "python" if len(f) % 2 else "java", "method") for i, f, t, c in some], "id string, content string, filePath string, ingestionTimestamp string, _codebaseName string, language string, chunkType string")


def files(spark, names):
    return spark.createDataFrame([(n, "python", "h", 1) for n in names], "filePath string, language string, fileHash string, sizeBytes long")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def written(root):
    """Path and size of every file below a store's root, but for checksums."""
    out = {}
    for d, _, names in os.walk(root):
        out |= {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for n in names if not n.endswith(".crc")}
    return out


@pytest.fixture
def s(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def test_deletes_write_no_chunks(spark, s):
    s.replace("a", rows(spark, [(f"a_{i}", f"f{i % 50}.py", f"t{i % 3}", "a") for i in range(400)]), files(spark, [f"f{i}.py" for i in range(50)]))
    old = s.chunks("a")
    before = written(s.root)
    assert s.delete_file("a", "f7.py") == 8
    assert s.delete_chunk_set("a", "t1") == sum(i % 3 == 1 and i % 50 != 7 for i in range(400))
    assert s.delete_files("a", spark.createDataFrame([("f3.py",), ("f4.py",), (None,), ("none",)], "filePath string")) == sum(i % 3 != 1 and i % 50 in (3, 4) for i in range(400))
    new = {k: v for k, v in written(s.root).items() if k not in before}
    assert not [k for k in new if "/chunks/" in k or "/stats/" in k or "/files/" in k] and sum(new.values()) < 10_000
    want = sorted(f"a_{i}" for i in range(400) if i % 3 != 1 and i % 50 not in (3, 4, 7))
    assert ids(s.chunks("a")) == want and s.count("a") == len(want)
    assert {r[0] for r in s.files("a").select("filePath").collect()} == {f"f{i}.py" for i in range(50) if i not in (3, 4, 7)}
    assert len(ids(old)) == 400  # a reader of the version before
    assert s.delete_file("a", "f7.py") == 0 and s.delete_chunk_set("a", "t1") == 0


def test_a_delete_holds_for_what_was_there(spark, s):
    s.replace("a", rows(spark, [("1", "x.py", "t0", "a"), ("2", "y.py", "t0", "a"), ("9", "z.py", "t0", "a")]))
    s.delete_file("a", "x.py")
    s.append("a", rows(spark, [("3", "x.py", "t1", "a")]))
    assert ids(s.chunks("a")) == ["2", "3", "9"]
    assert s.update("a", spark.createDataFrame([("x.py",)], "filePath string"), rows(spark, [("4", "x.py", "t2", "a")])) == (1, 1)
    assert ids(s.chunks("a")) == ["2", "4", "9"]
    assert ids(s.chunks("a", ("filePath", "x.py"))) == ["4"] and ids(s.chunks("a", ("filePath", "q"))) == []
    s.delete_chunk_set("a", "t0")
    assert ids(s.chunks("a")) == ["4"]


def test_folders_are_pruned_by_their_ranges(spark, s):
    s.replace("a", rows(spark, [("1", "a.py", "t0", "a"), ("2", "c.py", "t0", "a")]))
    s.append("a", rows(spark, [("3", "m.py", "t1", "a"), ("4", "p.py", "t1", "a")]))
    first, second = s.info("a")["folders"]
    assert first["ranges"] == {"filePath": ["a.py", "c.py"], "ingestionTimestamp": ["t0", "t0"]} and first["rows"] == second["rows"] == 2
    read = {os.path.dirname(f) for f in s.chunks("a", ("filePath", "n.py")).inputFiles()}
    assert len(read) == 1 and second["dir"] in read.pop()


def test_a_rename_writes_a_list_only(spark, s):
    s.replace("a", rows(spark, [("1", "x.py", "t0", "a"), ("2", "y.py", "t0", "a")]), files(spark, ["x.py", "y.py"]))
    reader, before = s.chunks("a"), set(written(s.root))
    assert s.rename("a", "b") == 2
    assert len(new := set(written(s.root)) - before) == 1 and "_versions" in new.pop()
    got = s.chunks("b").collect()
    assert {(r["_codebaseName"], r["_renamedFrom"], r["cb"]) for r in got} == {("b", "a", module.table_of("b"))} and all(r["_renamedAt"] for r in got)
    assert {r["_codebaseName"] for r in reader.collect()} == {"a"}
    s.append("b", rows(spark, [("3", "z.py", "t1", "b")]))
    s.replace("a", rows(spark, [("7", "x.py", "t9", "a")]))  # the old name is free again
    assert {(r["id"], r["_codebaseName"], r["_renamedFrom"]) for r in s.chunks().collect()} == {("1", "b", "a"), ("2", "b", "a"), ("3", "b", None), ("7", "a", None)}
    assert s.delete_file("b", "x.py") == 1 and ids(s.chunks("b")) == ["2", "3"] and ids(s.chunks("a")) == ["7"]
    assert s.rename("b", "c") == 2
    assert {(r["id"], r["_renamedFrom"]) for r in s.chunks("c").collect()} == {("2", "b"), ("3", "b")}
    assert {(r["name"], r["chunkCount"], r["fileCount"]) for r in catalog.list_codebases(s.partials()).collect()} == {("a", 1, 1), ("c", 2, 2)}
    with pytest.raises(NotFound):
        s.info("b")
    with pytest.raises(ValueError):
        s.rename("c", "a")


def test_readers_outlive_a_drop(spark, s):
    s.replace("a", rows(spark, [("1", "x.py", "t0", "a")]))
    s.replace("b", rows(spark, [("2", "x.py", "t0", "b")]))
    reader, folder = s.chunks("a"), s.info("a")["folders"][0]["dir"]
    s.drop("a")
    assert not s.exists("a") and s.names() == ["b"] and ids(reader) == ["1"]
    s.delete_file("b", "none.py")  # nothing to change
    s.append("b", rows(spark, [("3", "y.py", "t0", "b")]))
    assert ids(reader) == ["1"]
    s.append("b", rows(spark, [("4", "y.py", "t0", "b")]))
    assert not os.path.exists(f"{s.root}/chunks/{folder}") and not os.path.exists(f"{s.root}/stats/{folder}")


def test_compaction(spark, s, monkeypatch):
    monkeypatch.setattr(module, "DELETES", 2)
    s.replace("a", rows(spark, [(str(i), f"f{i}.py", "t0", "a") for i in range(20)]), files(spark, [f"f{i}.py" for i in range(20)]))
    s.rename("a", "b")
    for i in range(3):
        s.delete_file("b", f"f{i}.py")
    x = s.info("b")
    assert x["deletes"] == [] and len(x["folders"]) == 1 and x["folders"][0]["rows"] == 17
    assert {(r["_codebaseName"], r["_renamedFrom"]) for r in s.chunks("b").collect()} == {("b", "a")} and s.files("b").count() == 17
    s.delete_files("b", spark.createDataFrame([(f"f{i}.py",) for i in range(3, 15)], "filePath string"))
    assert s.info("b")["deletes"] == [] and s.info("b")["folders"][0]["rows"] == 5 and s.files("b").count() == 5  # more than half was deleted


def test_many_codebases_in_one_write(spark, s):
    s.replace("a b", rows(spark, [("0", "x.py", "t0", "a b")]))
    some = [(str(i), f"f{i}.py", "t0", ["a b", "c/d=e", "é%f"][i % 3]) for i in range(30)]
    s.replace_all(rows(spark, [*some, ("n", "f", "t", None)]))
    assert s.names() == sorted(["a b", "c/d=e", "é%f"]) and s.info("a b")["version"] == 1
    for name in s.names():
        assert ids(s.chunks(name)) == sorted(i for i, _, _, c in some if c == name) and s.count(name) == 10
    assert not [x for x in os.listdir(f"{s.root}/chunks") if x.startswith("_")]


def test_partials_give_what_chunks_give(spark, s):
    s.replace("a", rows(spark, [(f"a_t_{i}", f"f{i % 7}.py" if i % 5 else "", f"t{i % 2}", "a") for i in range(60)]))
    s.append("a", rows(spark, [(f"a_u_{i}", "f1.py", "t5", "a") for i in range(3)]))
    s.replace("b", rows(spark, [(f"b_{i}", "g.py", "t0", "b") for i in range(4)]))
    s.delete_file("a", "f2.py")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(catalog.list_codebases(s.partials())) == plain(catalog.list_codebases(s.chunks()))
    for f in (catalog.stats, catalog.list_files, catalog.samples):
        assert plain(f(s.partials("a"))) == plain(f(s.chunks("a")))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.tuples(st.just("add"), st.lists(st.sampled_from("abc"), min_size=1, max_size=4)), st.tuples(st.just("file"), st.sampled_from("abc")), st.tuples(st.just("files"), st.lists(st.sampled_from("abc"), max_size=2)), st.tuples(st.just("set"), st.integers(0, 3)), st.tuples(st.just("rename"), st.none())), min_size=2, max_size=6))
def test_any_changes_equal_a_plain_list(spark, tmp_path_factory, changes):
    s, name, held, n = Store(spark, str(tmp_path_factory.mktemp("s"))), "n0", [("0", "a", "t0")], 1
    s.replace(name, rows(spark, [(*x, name) for x in held]))
    for k, (what, x) in enumerate(changes):
        if not s.exists(name):
            break
        if what == "add":
            new = [(str(n + i), f, f"t{k % 4}") for i, f in enumerate(x)]
            n += len(new)
            s.append(name, rows(spark, [(*y, name) for y in new]))
            held += new
        elif what == "file":
            assert s.delete_file(name, x) == sum(f == x for _, f, _ in held)
            held = [y for y in held if y[1] != x]
        elif what == "files":
            assert s.delete_files(name, spark.createDataFrame([(f,) for f in x], "filePath string")) == sum(f in x for _, f, _ in held)
            held = [y for y in held if y[1] not in x]
        elif what == "set":
            assert s.delete_chunk_set(name, f"t{x}") == sum(t == f"t{x}" for _, _, t in held)
            held = [y for y in held if y[2] != f"t{x}"]
        else:
            assert s.rename(name, f"n{k + 1}") == len(held)
            name = f"n{k + 1}"
    if s.exists(name):
        assert ids(s.chunks(name)) == sorted(i for i, _, _ in held) and s.count(name) == len(held)
        assert s.partials(name).agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0] == len(held)
