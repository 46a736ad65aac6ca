"""Ingest, search, rescan and changes of stored codebases, end to end."""

import pytest

from corvella.config import DEFAULTS, ConfigError, load
from corvella.operators.search import Cache
from corvella.plans.engine import Engine, NotFound, gapless
from corvella.sources.store import Conflict, Store
from corvella.streaming.progress import Jobs, changed_files

TS = "// Checks a password.\nfunction authenticate(user: string, password: string): boolean {\n  return user === password;\n}\n\nexport class Database {\n  connect(): void {\n    open();\n  }\n}\n"
PY = "def parse_file(path):\n    return open(path).read()\n\n\nclass Parser:\n    def run(self):\n        return parse_file('x')\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "tests").mkdir()
    (root / "src").mkdir()
    (root / "src" / "auth.ts").write_text(TS)
    (root / "src" / "utils.py").write_text(PY)
    (root / "src" / "tests").mkdir()
    (root / "src" / "tests" / "check.py").write_text("def test_authenticate():\n    assert True\n")
    (root / "plain.js").write_text("let x = 1;\n")
    (root / "notes.md").write_text("words\n")
    return root


def test_life_of_a_codebase(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    out = engine.ingest(str(tree), "My Project")
    assert (out["totalFiles"], out["supportedFiles"], out["unsupportedByExtension"]) == (5, 4, {".md": 1})
    assert {x["language"]: (x["fileCount"], x["chunkCount"]) for x in out["languages"]} == {"typescript": (1, 3), "python": (2, 4), "javascript": (1, 0)}
    ids = [r["id"] for r in engine.store.chunks("my-project").orderBy("filePath", "startLine").collect()]
    assert sorted(int(i.rsplit("_", 1)[1]) for i in ids) == list(range(7))

    found = engine.search("authenticate user password", max_results=5)
    assert found["results"][0]["content"].startswith("// Checks a password.") and found["totalResults"] == 5
    scores = [r["similarityScore"] for r in found["results"]]
    assert scores == sorted(scores, reverse=True) and all(0 < s <= 1 for s in scores)
    assert engine.search("authenticate user password", max_results=5) is found
    no_tests = engine.search("authenticate user password", max_results=5, exclude_tests=True)
    assert no_tests is not found and all("tests/" not in r["filePath"] for r in no_tests["results"])
    assert {r["language"] for r in engine.search("parse", language="python")["results"]} == {"python"}
    assert engine.search("parse", codebase="absent")["results"] == []
    with pytest.raises(ValueError):
        engine.search("  ")

    listed = engine.list_codebases().first()
    assert (listed["name"], listed["chunkCount"], listed["fileCount"], listed["languages"]) == ("my-project", 7, 3, ["python", "typescript"])
    stats = engine.stats("my-project").first()
    assert stats["chunkCount"] == 7 and {t["type"]: t["count"] for t in stats["chunkTypes"]} == {"function": 3, "class": 2, "method": 2}
    assert {r["filePath"]: r["chunkCount"] for r in engine.list_files("my-project").collect()} == {"src/auth.ts": 3, "src/utils.py": 3, "src/tests/check.py": 1}

    same = engine.rescan("my-project")
    assert (same["filesAdded"], same["filesModified"], same["filesDeleted"], same["filesUnchanged"]) == (0, 0, 0, 4)
    (tree / "src" / "utils.py").write_text("def only():\n    return 1\n")
    (tree / "new.py").write_text("def fresh():\n    return 2\n")
    (tree / "src" / "tests" / "check.py").unlink()
    diff = engine.rescan("my-project")
    assert {k: v for k, v in diff.items() if k != "durationMs"} == {"filesAdded": 1, "filesModified": 1, "filesDeleted": 1, "filesUnchanged": 2, "chunksAdded": 2, "chunksDeleted": 4}
    assert engine.store.count("my-project") == 5

    for bad in ("", "/etc/passwd", "a/../b"):
        with pytest.raises(ValueError):
            engine.delete_file("my-project", bad)
    assert engine.delete_file("my-project", "it's not there.py") == 0
    assert engine.delete_file("my-project", "new.py") == 1 and engine.store.count("my-project") == 4
    stamps = {r[0] for r in engine.store.chunks("my-project").select("ingestionTimestamp").distinct().collect()}
    assert engine.delete_chunk_set("my-project", "2000-01-01T00:00:00.000Z") == 0
    assert engine.delete_chunk_set("my-project", max(stamps)) == 1

    assert engine.rename("my-project", "other") == 3
    row = engine.store.chunks("other").first()
    assert (row["_codebaseName"], row["_renamedFrom"]) == ("other", "my-project") and not engine.store.exists("my-project")
    gone = spark.createDataFrame([("src/auth.ts",)], "filePath string")
    assert engine.store.delete_files("other", gone) == 3 and engine.store.count("other") == 0
    assert engine.rename("other", "empty") == 0 and not engine.store.exists("empty") and not engine.store.exists("other")
    with pytest.raises(NotFound):
        engine.stats("other")


def test_failed_ingest_keeps_the_old(spark, tree, tmp_path):
    class Broken:
        dimension, name = 2, "broken"

        def embed(self, texts):
            raise RuntimeError

    engine = Engine(spark, str(tmp_path / "s"))
    before = engine.ingest(str(tree), "a")["chunkCount"]
    broken = Engine(spark, str(tmp_path / "s"), embedder=Broken)
    rows = broken.chunk_rows(broken.scan(str(tree)), "a", "", "t")
    from corvella.operators.embed import embed_column

    assert rows.sparkSession is spark and before > 0
    df = spark.createDataFrame([("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(embed_column(df.t, Broken, "broken")).collect()] == [None, None, None]
    assert [r[0] is None for r in df.select(embed_column(df.t)).collect()] == [False, True, True]


def test_nearest_batch_against_brute_force(spark, monkeypatch):
    import numpy as np

    from corvella.operators import search

    monkeypatch.setattr(search, "QUERIES", 7)
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (300, 6)).round(1)
    x[100:140] = x[0]  # ties beyond k
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [1.0, 2.0]), (904, [1.0, 2.5]), (None, [0.0] * 6), (905, [])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").repartition(5)
    ask = df.filter("vec_id % 10 = 0 OR vec_id > 900").selectExpr("vec_id qid", "embedding query")
    got = {(a["qid"], a["rk"]): (a["vec_id"], a["d"]) for a in search.nearest_batch(df, ask.union(ask), 4).collect()}
    want = {}
    for q in range(0, 300, 10):
        d = [sum((a - b) ** 2 for a, b in zip(data[q][1], v, strict=True)) for _, v in data]
        for rk, i in enumerate(sorted(range(300), key=lambda i: (d[i], i))[:4], 1):
            want[q, rk] = i
    want |= {(903, 1): 903, (903, 2): 904, (904, 1): 904, (904, 2): 903}
    assert {k: v[0] for k, v in got.items()} == want
    assert search.nearest_batch(df, ask.limit(0), 4).count() == 0 and search.nearest_batch(df.limit(0), ask, 4).count() == 0


def test_row_numbers_survive_merged_partitions(spark):
    """Wide and narrow readers of one numbering merge partitions at different sizes; bounds of the ranges are sampled."""
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.range(0, 200_000, numPartitions=16).selectExpr("xxhash64(id) a", "sha2(cast(id as string), 512) wide")
        got = gapless(df, ["a"], "n").selectExpr("count(wide) c", "count(distinct n) d", "min(n) lo", "max(n) hi").first()
        assert tuple(got) == (200_000, 200_000, 0, 199_999)
        ordered = gapless(df, ["a"], "n").selectExpr("a", "lag(a) over (order by n) before").filter("a <= before").count()
        assert ordered == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_engines_keep_to_their_own_embedder(spark, tree, tmp_path):
    class Constant:
        dimension, name = 3, "constant"

        def embed(self, texts):
            import numpy as np

            return np.full((len(texts), 3), 2.0, np.float32)

    one, two = Engine(spark, str(tmp_path / "one")), Engine(spark, str(tmp_path / "two"), embedder=Constant)
    for engine in (one, two):
        engine.ingest(str(tree), "a")
    assert {len(r[0]) for r in one.store.chunks("a").select("vector").collect()} == {384}
    assert {tuple(r[0]) for r in two.store.chunks("a").select("vector").collect()} == {(2.0, 2.0, 2.0)}
    assert {r["similarityScore"] for r in two.search("any words")["results"]} == {1.0} and one.search("any words")["results"]


def test_an_ingest_leaves_no_tables_behind(spark, tree, tmp_path):
    import os

    from corvella.sources.scratch import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    Engine(spark, str(tmp_path / "s")).ingest(str(tree), "a")
    assert set(os.listdir(folder)) == before


def test_of_two_writers_the_later_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("1", "x", "a.py")], "id string, content string, filePath string")
    store.replace("a", rows)
    store.append("a", rows)
    assert store.count("a") == 2 and store.chunks("a").columns[-1] == "cb"
    late = store._latest()
    store.replace("b", rows)
    store._latest = lambda: late
    for name in ("a", "c"):
        with pytest.raises(Conflict):
            store.replace(name, rows)
    del store._latest
    assert store.names() == ["a", "b"] and store.chunks().count() == 3
    reader = store.chunks("a")
    store.append("a", rows)
    assert reader.count() == 2 and store.count("a") == 3


def test_config(tmp_path):
    assert load(env={}) ["search"] == DEFAULTS["search"]
    p = tmp_path / "c.json"
    p.write_text('{"ingestion": {"batchSize": 7, "maxFileSize": 9}}')
    c = load(str(p), {"INGESTION_BATCH_SIZE": "11", "LOG_LEVEL": "debug"})
    assert (c["ingestion"]["batchSize"], c["ingestion"]["maxFileSize"], c["logging"]["level"]) == (11, 9, "debug")
    for text in ('{"x": 1}', '{"server": {"port": 0}}', '{"server": {"port": "a"}}', "{", '{"search": 3}'):
        p.write_text(text)
        with pytest.raises(ConfigError):
            load(str(p), {})
    with pytest.raises(FileNotFoundError):
        load(str(tmp_path / "none.json"), {})
    with pytest.raises(ConfigError):
        load(env={"SERVER_PORT": "many"})


def test_cache():
    now = [0.0]
    cache = Cache(60, lambda: now[0])
    cache.put(cache.key(a=1), "x")
    assert cache.get(cache.key(a=1)) == "x" and cache.get(cache.key(a=2)) is None
    now[0] = 61
    assert cache.get(cache.key(a=1)) is None and cache.stats()["size"] == 0


def test_jobs():
    jobs = Jobs()

    def work(tell):
        tell("embedding", 1, 2)
        return 5

    last = list(jobs.events(jobs.start(work), 0.01))[-1]
    assert (last["status"], last["result"], last["phase"]) == ("completed", 5, "embedding")
    failed = list(jobs.events(jobs.start(lambda tell: 1 / 0), 0.01))[-1]
    assert failed["status"] == "failed" and "division" in failed["error"]


def test_changed_files_stream(spark, tmp_path):
    rows = [("a.py", "1", "2024-01-01 00:00:00"), ("a.py", "1", "2024-01-01 00:01:00"), ("a.py", "2", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "filePath string, fileHash string, ts string").selectExpr("filePath", "fileHash", "to_timestamp(ts) ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changed_files(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("changed").count() == 2


def test_appends_add_folders(spark, tmp_path, monkeypatch):
    """An append writes its own rows only; past the bound all become one folder; a rename is one change."""
    from corvella.sources import store as module

    monkeypatch.setattr(module, "FOLDERS", 3)
    s = Store(spark, str(tmp_path / "s"))
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as string) id", "'f' filePath", "'a' _codebaseName")
    for i in range(5):
        s.append("a", rows(10 * i, 10 * i + 10))
        assert sorted(int(r["id"]) for r in s.chunks("a").collect()) == list(range(10 * i + 10))
        assert len(s.info("a")["folders"]) == (i + 1 if i < 3 else i - 2)
    s.delete_file("a", "g")
    change = s._latest()[0]
    assert s.rename("a", "b") == 50 and s._latest()[0] == change + 1 and s.names() == ["b"]
    assert {r["_codebaseName"] for r in s.chunks("b").collect()} == {"b"} and s.count("b") == 50


def test_model_names_that_are_not_served_are_refused(spark, tmp_path):
    import copy

    from corvella.config import DEFAULTS, ConfigError, load
    from corvella.plans.engine import Engine

    config = copy.deepcopy(DEFAULTS)
    config["embedding"]["modelName"] = "another"
    with pytest.raises(ConfigError, match="another"):
        Engine(spark, str(tmp_path), config)
    config["embedding"]["modelName"] = "feature-hash"
    Engine(spark, str(tmp_path), config)
    path = tmp_path / "c.json"
    path.write_text('{"mcp": {"transport": "stdio"}}')
    assert load(str(path), {})["mcp"] == {"transport": "stdio"}
    path.write_text('{"mcp": {"transport": "other"}}')
    with pytest.raises(ConfigError):
        load(str(path), {})


def test_embedding_batches(spark):
    """A text that fails spoils its own batch only, and there only itself."""
    from pyspark.sql import functions as F

    from corvella.operators.embed import embed_column

    class Picky:
        dimension, name = 1, "picky"

        def embed(self, texts):
            import numpy as np

            if len(texts) > 3 or "bad" in texts:
                raise ValueError
            return np.array([[float(len(t))] for t in texts], np.float32)

    df = spark.createDataFrame([(i, "bad" if i == 4 else "x" * (i + 1)) for i in range(8)], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", embed_column(F.col("t"), Picky, batch=3).alias("v")).collect()}
    assert got[4] is None and all(got[i] == [i + 1.0] for i in got if i != 4)
