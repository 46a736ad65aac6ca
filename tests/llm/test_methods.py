"""Operators against brute force, libraries and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from made import words
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from corvella.llm import common, components, jaccard, mixing, multiindex, pieces, quality, queries, secrets, sharding, topk, toxicity

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def find(parent, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def grouped(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    return {i: find(parent, i) for i in ids}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)


# -- mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 166.66667, 83.33333])
    assert mixing.targets([10, 1000], [5, 2]) == pytest.approx([20, 1495])
    assert mixing.targets([0, 10], [5, 2]) == pytest.approx([0, 15])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=8), st.integers(1, 33))
def test_split_is_exact(quotas, shards):
    out = mixing.split_quotas(np.array(quotas), shards)
    assert (out.sum(0) == quotas).all() and (out >= 0).all() and out.sum(1).max() - out.sum(1).min() <= 1


def test_split_is_hypergeometric():
    left = np.array([mixing.split_quotas(np.array([30, 10]), 2, seed)[0, 0] for seed in range(400)])
    assert abs(left.mean() - 15) < 0.3 and 0.8 < left.var() / (20 * 0.75 * 0.25 * 20 / 39) < 1.25


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = table(spark, "documents")
    a = mixing.plan_rows(docs).collect()
    assert sorted(a) == sorted(mixing.plan_rows(docs.repartition(5)).collect())
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in a:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in a))


def test_mix_draws_disjoint_blocks(spark):
    rows = mixing.mix(table(spark, "documents"), shard_column="shard").groupBy("doc_id", "shard").count().collect()
    plan = {r["doc_id"]: r["shards"] for r in mixing.plan_rows(table(spark, "documents")).collect()}
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += [r["shard"]] * r["count"]
    assert all(sorted(map(int, filter(None, s.split(",")))) == sorted(got[i]) for i, s in plan.items())


def test_a_shard_is_shuffled_in_one_place(spark):
    docs = table(spark, "documents")
    out = mixing.mix(docs, shard_column="shard", shards=16).select("doc_id", "shard", F.spark_partition_id().alias("part")).collect()
    parts, ids = defaultdict(set), defaultdict(list)
    for r in out:
        parts[r["shard"]].add(r["part"])
        ids[r["shard"]].append(r["doc_id"])
    assert len(parts) == 16 and all(len(p) == 1 for p in parts.values())
    assert all(sorted(x) != x for x in ids.values() if len(x) > 9)


# -- sharding


def test_shards_hold_equal_bytes(spark):
    docs = table(spark, "documents")
    rows = sharding.shard_documents(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    load = defaultdict(int)
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        load[r["shard"]] += r["size"]
    assert sorted(load) == list(range(40)) and max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)


def test_a_new_shard_takes_slots_only_into_itself(spark, tmp_path):
    sizes = spark.range(512).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % 37 + 5).alias("bytes"), F.lit(3).cast("long").alias("rows"))
    first = sharding.first_map(sizes, 8)
    sharding.write_map(first, str(tmp_path / "map"), 0)
    sharding.write_map(sharding.add_shard(sharding.read_map(spark, str(tmp_path / "map"))), str(tmp_path / "map"), 1)
    with pytest.raises(Exception, match="exist"):
        sharding.write_map(first, str(tmp_path / "map"), 0)
    a, b = ({r["vslot"]: r for r in sharding.read_map(spark, str(tmp_path / "map"), v).collect()} for v in (0, 1))
    assert len(a) == len(b) == 512
    assert all(b[s]["shard"] in (a[s]["shard"], 8) for s in a)
    load = defaultdict(int)
    for r in b.values():
        load[r["shard"]] += r["bytes"]
    assert len(load) == 9 and max(load.values()) < 1.35 * min(load.values())
    assert sharding.assign(spark.range(100), sharding.read_map(spark, str(tmp_path / "map")), F.col("id"), slots=512).filter("shard IS NULL").count() == 0


def test_shards_against_a_plain_deal(spark, tmp_path):
    """Slots from the largest to the smallest, each to the lightest shard; places follow slot, id, checksum and size."""
    docs = table(spark, "documents").limit(400)
    docs = docs.unionAll(docs.filter("doc_id % 7 = 0")).unionAll(docs.filter("doc_id % 7 = 0"))
    rows = [tuple(r) for r in sharding.shard_documents(docs, shards=5, slots=64, maps=str(tmp_path / "map")).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot").collect()]
    assert len(rows) == docs.count() and sharding.read_map(spark, str(tmp_path / "map")).filter("version = 0").count() == len({r[3] for r in rows})
    size, load, shard = defaultdict(int), [0] * 5, {}
    for r in rows:
        size[r[3]] += r[1]
    for v in sorted(size, key=lambda v: (-size[v], v)):
        shard[v] = load.index(min(load))
        load[shard[v]] += size[v]
    want, at = [], [0] * 5
    for r in sorted(rows, key=lambda r: (r[3], r[0], r[2], r[1])):
        want.append((*r[:4], shard[r[3]], at[shard[r[3]]]))
        at[shard[r[3]]] += 1
    assert sorted(rows) == sorted(want)


def test_sharding_is_native(spark):
    plan = sharding.shard_documents(table(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- classifiers


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.85)])
def test_held_out_labels(spark, module, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score(docs, labels).join(labels, "doc_id").filter("held_out").select("score", label, "doc_id").collect()
    y, p = np.array([r[label] for r in rows]), np.array([r["score"] for r in rows])
    better = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
    assert len(y) > 500 and better > least
    n = 5 if label == "quality" else 4
    assert {zlib.crc32(str(r["doc_id"]).encode()) % n for r in rows} == ({0} if n == 5 else {2})


def test_gradient_of_attention():
    r = np.random.default_rng(0)
    m = quality.Model()
    m.w = [w.astype(np.float64) for w in m.w]
    x, of, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 0, 1, 1, 1, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])

    def loss():
        h, _, _, e = m.instances(x)
        p = m.scores(h, e, of, 4)[2]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    class Keep:
        def step(self, g):
            self.g = g

    keep = Keep()
    m._step(keep, x, of, y, 0.0)
    for w, g in zip(m.w, keep.g, strict=True):
        i = tuple(int(r.integers(n)) for n in w.shape)
        old, d = w[i], 1e-5
        w[i] = old + d
        up = loss()
        w[i] = old - d
        down = loss()
        w[i] = old
        assert g[i] == pytest.approx((up - down) / (2 * d), rel=2e-3, abs=1e-6)


def test_marginals_are_exact():
    r = np.random.default_rng(1)
    f = toxicity.Field()
    f.move = r.normal(size=(2, 2))
    e = r.normal(size=7)
    row, col = np.array([0, 0, 0, 0, 1, 1, 1]), np.array([0, 1, 2, 3, 0, 1, 2])
    got, log_z, moves = f.forward_backward(e, row, col, True)
    for c in (0, 1):
        own = e[row == c]
        total, one = 0.0, np.zeros(len(own))
        for code in range(1 << len(own)):
            s = [(code >> i) & 1 for i in range(len(own))]
            w = np.exp(sum(x for x, y in zip(own, s, strict=True) if y) + sum(f.move[a, b] for a, b in zip(s, s[1:])))
            total += w
            one += w * np.array(s)
        assert got[row == c] == pytest.approx(one / total) and log_z[c] == pytest.approx(np.log(total))
    assert moves.sum() == pytest.approx(5)


@pytest.mark.parametrize("window", [1, 2, 3, 64])
def test_chain_crosses_windows(monkeypatch, window):
    """Marginals, moves and the partition function of texts of several windows, against all labellings of each whole text."""
    monkeypatch.setattr(toxicity, "WINDOW", window)
    r = np.random.default_rng(2)
    f = toxicity.Field()
    f.move = r.normal(size=(2, 2))
    of = np.repeat([0, 1, 3, 4], [5, 1, 7, 2])
    e = r.normal(size=len(of))
    row, col = toxicity.chains(of)
    got, log_z, moves = f.forward_backward(e, row, col, True, toxicity._places(of, row))
    want = np.zeros((2, 2))
    for c in np.unique(of):
        own = e[of == c]
        total, one, pairs = 0.0, np.zeros(len(own)), np.zeros((2, 2))
        for code in range(1 << len(own)):
            s = [(code >> i) & 1 for i in range(len(own))]
            w = np.exp(sum(x for x, y in zip(own, s, strict=True) if y) + sum(f.move[a, b] for a, b in zip(s, s[1:])))
            total += w
            one += w * np.array(s)
            for a, b in zip(s, s[1:]):
                pairs[a, b] += w
        assert got[of == c] == pytest.approx(one / total)
        assert log_z[np.unique(row[of == c])].sum() == pytest.approx(np.log(total))
        want += pairs / total
    assert moves == pytest.approx(want)


def test_small_marginals_of_a_long_text_stay_small():
    p = np.concatenate([np.full(20_000, 0.001), [0.9], np.full(3, 0.01)])
    x = toxicity.pooled(p, np.repeat([0, 1, 2], [20_000, 1, 3]), 4)
    assert x[0, 2] < 0.03 and x[1, 1] == 0.9 and x[2, 1] == 0.01 and (x[3] == [1, 0, 0]).all()


def test_every_text_of_the_sample_is_learned_from(spark, monkeypatch):
    """Marked or not, and one text of an id with several."""
    seen = []
    monkeypatch.setattr(toxicity.Field, "fit", lambda self, word, parts, shape, of, tag: seen.append((len(np.unique(of)), len(of))) or self)
    rows = [(i, f"plain words of document number {'abcdefghij'[i % 10]} " * 3) for i in range(2500)] + [(3000 + i, "vile " + "abcdefghij"[i % 10] + " words") for i in range(40)]
    rows += [(0, "another text of the same id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 3000).cast("int").alias("toxic")).distinct()
    toxicity.train(docs, labels)
    n = labels.filter("crc32(cast(doc_id as string)) % 4 <> 2").count()
    assert seen[0][0] == n > 1500


def test_toxic_spans_name_the_words(spark):
    docs = table(spark, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, table(spark, "labels")).filter("spans <> ''").collect():
        for span in r["spans"].split(","):
            a, b = map(int, span.split(":"))
            word = text[r["doc_id"]][a:b]
            assert word == word.strip() and word[0].isalpha() and word[-1].isalpha()


# -- near duplicates


def test_multiindex_against_brute_force(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 32))
    x = np.concatenate([c + 0.13 * r.normal(size=(n, 32)) for c, n in zip(centres, [300, *[20] * 20, *[1] * 19], strict=True)] + [r.normal(size=(400, 32))]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 500, axis=0), 3 * x[5:8]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    out = {row["vec_id"]: row for row in multiindex.near_duplicates(df).collect()}
    got = np.array([out[i]["n_links"] for i in range(len(x))])
    assert (got <= near.sum(1)).all() and got.sum() >= 0.97 * near.sum()
    want = grouped(range(len(x)), zip(*np.nonzero(near), strict=True))
    assert np.mean([out[i]["component_id"] == want[i] for i in want]) > 0.97


def test_multiindex_visits_follow_all_rows(spark, monkeypatch):
    """Most near pairs lie in one hot cluster and meet at once; pairs at the limit elsewhere, mostly outside the sample, need more visits."""
    monkeypatch.setattr(multiindex, "SAMPLE", 96)
    monkeypatch.setattr(multiindex, "FILED", 0.25)
    r = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(r.normal(size=(3000, 64)))
    side = r.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    x = np.concatenate([a, 0.91 * a + np.sqrt(1 - 0.91**2) * side, unit(r.normal(size=(1, 64)) + 0.005 * r.normal(size=(300, 64)))]).astype(np.float32)
    u = unit(x.astype(np.float64))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = np.array([n for _, n in sorted((row["vec_id"], row["n_links"]) for row in multiindex.near_duplicates(df).collect())])
    want = near.sum(1)
    assert (got <= want).all() and (got[want > 0] / want[want > 0]).mean() >= 0.98


def test_multiindex_links_every_length_in_double_precision(spark):
    rows = [(i, [1.0] * 15 + [float(i)]) for i in range(50)] + [(100, [1.0, 0.0, 0.0]), (101, [1.0, 0.05, 0.0]), (102, [0.0, 1.0, 0.0])]
    edge = float(0.9 / np.sqrt(1 - 0.81))
    rows += [(200, [1.0, 0.0]), (201, [edge * (1 + 1e-12), 1.0]), (202, [edge * (1 - 1e-9), -1.0])]  # a cosine just above 0.9 and one just below; a float can't tell
    rows += [(300 + i, [float(i + 1)]) for i in range(3)]
    out = {r["vec_id"]: r for r in multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    got = {i: (out[i]["n_links"], out[i]["component_id"]) for i in out}
    assert got[100] == got[101] == (1, 100) and got[102] == (0, 102)
    assert got[200] == got[201] == (1, 200) and got[202] == (0, 202)
    assert all(got[300 + i] == (2, 300) for i in range(3))
    x = multiindex.unit(np.array([v for _, v in rows[:50]]))
    assert [got[i][0] for i in range(50)] == ((x @ x.T >= 0.9).sum(1) - 1).tolist()


def test_topk_takes_doubles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 3)
    x = [(i, [i / 256 - 1e-12, 1.0]) for i in range(40)]  # a float would round up to i / 256
    out = [tuple(r) for r in topk.top_k(spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 5 == 0, 2).collect()]
    v = np.floor(256 * np.array([e for _, e in x])).astype(np.int64)
    want = []
    for i in range(0, 40, 5):
        s = v @ v[i]
        want += [(i, r + 1, j, s[j]) for r, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (-s[j], j))[:2])]
    assert sorted(out) == want


def test_multiindex_needed_visits():
    r = np.random.default_rng(13)
    x = multiindex.unit(r.normal(size=(200, 16)))
    y = multiindex.unit(x + 0.1 * r.normal(size=x.shape))
    index = multiindex.Index(x, 8 * 12 * 12)
    need = index.needed(x, y)
    for n in (1, 2, 5, 17, 144):
        a, b = index.visit(x, n), index.visit(y, n)
        met = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
        assert (met == (need <= n)).all()
    index.rows = 10**9
    index.set_visits([(0, 0, 1e6), (1, 6, 1.0)])  # by query, not by pair
    assert index.visits == 128
    index.set_visits([])
    assert index.cells == index.visits == 1


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_jaccard(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    links = {(i, j) for i, s in sets.items() for j in set().union(*[where[x] for x in s]) if i < j and len(s & sets[j]) >= 0.8 * len(s | sets[j])} if sets else set()
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (c, n[i]) for i, c in grouped(sets, links).items()}


def test_jaccard_against_brute_force_on_documents(spark):
    docs = table(spark, "documents")
    want = brute_jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(docs).collect()} == want


def test_jaccard_large_groups_and_shared_passages(spark):
    """A group of near copies larger than a block, chains at the limit, and a passage that unlike documents share."""
    r = random.Random(8)
    rows, seed, passage = [], words(r, 80), words(r, 60)
    for _ in range(420):
        w = list(seed)
        w[r.randrange(80)] = "changed" + str(r.randrange(30))
        rows.append(" ".join(w))
    rows += [" ".join(passage + words(r, 60)) for _ in range(300)]
    chain = words(r, 200)
    for i in range(12):
        chain = chain[8:] + words(r, 8)
        rows.append(" ".join(chain))
    rows += [rows[0]] * 50
    docs = list(enumerate(rows))
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    want = brute_jaccard(docs)
    found, all_ = sum(n for _, n in got.values()), sum(n for _, n in want.values())
    assert found == all_ and got == want


def test_jaccard_runs_go_on_until_the_recall_is_met(spark, monkeypatch):
    """With a bar for likely pairs that no pair meets at first."""
    monkeypatch.setattr(jaccard, "LIKELY", 70)
    r = random.Random(3)
    rows = []
    for _ in range(60):
        w = words(r, 90)
        rows += [" ".join(w), " ".join([*w[:88], "other", "end"])]
    docs, turns, links = list(enumerate(rows)), [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda reps, s, turn: turns.append(turn) or links(reps, s, turn))
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(docs) and turns[0] == 0 and len(turns) > 1


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(180)]
    want = grouped({x for p in links for x in p}, links)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark)).collect()}
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}


def test_components_not_done_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        components.components(links, common.Scratch(spark), most=2)


def test_topk_many_ties(spark):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(300, 8)), np.repeat(r.normal(size=(1, 8)), 900, axis=0), np.zeros((50, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = defaultdict(list)
    for row in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    for i in range(0, len(x), 50):
        s = q @ q[i]
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[j], j))[:5]
        assert got[i] == [(j, s[j]) for j in order]


# -- tokens


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_equal_the_library(spark, library):
    docs = table(spark, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pieces.encode(docs).collect()
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)
    assert all(r["ids"] == library.encode(text[r["doc_id"]]) for r in rows)


_encoder = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab thein  .\n=1", max_size=60), st.text("语言模型かなéñß😀 ", max_size=20)), min_size=1, max_size=6))
def test_pieces_of_any_text(texts):
    import pyarrow as pa
    import sentencepiece

    if not _encoder:
        _encoder.extend([pieces.Encoder(pieces.load()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)])
    texts = [t.replace("▁", " ") for t in texts]
    data, offsets = common.flat(pa.array(texts, pa.string()))
    ids, at = _encoder[0].encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == _encoder[1].encode(t)
    back, edge = _encoder[0].decode(ids, at)
    assert [back[a:b].tobytes().decode() for a, b in zip(edge[:-1], edge[1:])] == texts


# -- secrets


def plain_base(text):
    out = []
    for k, (name, pattern, least, group) in enumerate((("assign", secrets.ASSIGN, 12, 2), ("access", secrets.ACCESS, 18, 0), ("hex", secrets.HEX, 16, 0))):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_base_spans_against_plain_patterns(spark):
    docs = table(spark, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.scan(docs).collect():
        want = plain_base(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert r["n_assign"] == sum(x.startswith("assign") for x in want) and r["n_hex"] == sum(x.startswith("hex") for x in want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "secret", "=", ": ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "ſecret", "x-y.z", "é", "\n"]), max_size=14))
def test_base_spans_of_any_text(parts):
    text = "".join(parts)
    assert [f"{k}:{a}:{b}" for a, b, k in secrets.base_spans(text)] == plain_base(text)


def test_network_adds_little_to_paths(spark):
    r = random.Random(5)
    key = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    rows = [(i, f"{' '.join(words(r, 20))} token = \"{key()}\" {' '.join(words(r, 20))}") for i in range(150)]
    rows += [(1000 + i, f"{' '.join(words(r, 10))} /usr/share/doc/part{i}/some_longer_name_{i} {' '.join(words(r, 10))}") for i in range(150)]
    rows += [(5000 + i, f"{' '.join(words(r, 20))} credential {key()} {' '.join(words(r, 20))}") for i in range(20)]
    out = {x["doc_id"]: x for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["n_assign"] == 1 for i in range(150))
    assert sum(out[1000 + i]["n_added"] for i in range(150)) < 15
    # what stands after another keyword is a candidate like others: at most itself is added
    assert all(out[5000 + i]["n_added"] <= 1 for i in range(20))


def test_network_finds_keys_without_other_candidates(spark, monkeypatch):
    """All runs but the planted keys are short; of many documents only few windows are learned from, the planted keys are not among them."""
    monkeypatch.setattr(secrets, "FINDINGS", 60)
    r = random.Random(6)
    key = lambda: "".join(r.choice("abcdef0123456789ABCDEFGHIJKLMNOP") for _ in range(31)) + "7"
    short = lambda n: " ".join(r.choice(WORDS_IN_ORDER) for _ in range(n))
    rows = [(i, f"{short(20)} token = \"{key()}\" {short(20)}") for i in range(300)] + [(1000 + i, short(40)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    network = secrets.train(docs)
    assert network.threshold is not None
    planted = [f"{short(10)} credential {key()} {short(10)}" for _ in range(50)]
    found = secrets.find(planted + [t for i, t in rows if i >= 1000], network)
    assert sum(len(s) - len(b) for b, s in found[:50]) >= 45
    assert sum(len(s) - len(b) for b, s in found[50:]) == 0
    # with them in the table: scanned as well
    out = secrets.scan(docs.unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(planted[:5])], docs.schema)))
    assert out.filter("doc_id >= 5000 AND n_added = 1").count() >= 4


def test_every_run_of_the_least_length_is_a_candidate(spark):
    for run in ("a1b2c3d4e5f6", "correcthorsebattery", "123456789012", "ab.cd.ef.gh.12", "x" * 5000):
        assert secrets.candidates(f"of {run} and", []) == [(3, 3 + len(run), "cnn")]
    assert secrets.candidates("of a1b2c3d4e5f and", []) == []
    seen = secrets.windows("before ", "".join(chr(33 + i % 90) for i in range(400)), " after")
    assert all(len(w) == secrets.WIDE for w in seen)
    whole = "".join(chr(33 + i % 90) for i in range(400))
    assert all(any(whole[i : i + 32].encode() in w for w in seen) for i in range(400 - 31))
    r = random.Random(7)
    key = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    line = lambda n: " ".join(r.choice(WORDS_IN_ORDER) + "/some/ordinary/folder" * (i % 9 == 0) for i in range(n))
    rows = [(i, f"{line(20)} token = \"{key(r.randrange(12, 40))}\" {line(20)}") for i in range(300)]
    rows += [(1000 + i, line(40)) for i in range(100)]
    network = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    inside = [f"{line(9)} {'some/ordinary/folder/' * 9}{key(48)}{'/some/ordinary/folder' * 9} {line(9)}" for _ in range(20)]
    short = [f"{line(20)} {key(14)} {line(20)}" for _ in range(20)]
    plain = [f"{line(9)} {'some/ordinary/folder/' * 19} {line(9)}" for _ in range(20)]
    n = [sum(len(s) > len(b) for b, s in secrets.find(texts, network)) for texts in (inside, short, plain)]
    assert n[0] >= 18 and n[1] >= 18 and n[2] == 0, n


def test_redaction():
    assert secrets.redact_text("a token=xyz b", [(2, 11, "assign"), (8, 11, "hex")]) == "a [SECRET] b"


# -- language model


def test_lm_gradient_and_order(spark):
    from corvella.llm import lmscore

    no = lmscore.UNITS
    assert lmscore.Network.context(np.array([5, 6, 7]), np.array([0, 0, 1])).tolist() == [[no, no, 6, no], [no, 5, no, no], [no, no, no, no]]
    r = random.Random(1)
    fixed = " ".join(WORDS_IN_ORDER * 20)
    rows = [(i, fixed) for i in range(60)] + [(100, " ".join(r.sample(WORDS_IN_ORDER * 20, 200)))]
    out = {x["doc_id"]: x["mean_log_probability"] for x in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] > out[100]


@pytest.mark.parametrize("frequent", [100, 100_000])
def test_lm_uses_the_counts_of_all_words(spark, monkeypatch, frequent):
    """Words beyond the classes of their own: frequent ones are likelier than those that occur once, by their counts."""
    from corvella.llm import lmscore

    monkeypatch.setattr(lmscore, "FREQUENT", frequent)
    own = min(lmscore.OWN, frequent)
    r = random.Random(2)
    common_words = [f"common{i}" for i in range(4200)]
    rows = [(i, " ".join(r.choices(common_words, k=300))) for i in range(200)]
    rows += [(1000 + i, " ".join(f"once{i}x{j} {r.choice(common_words)}" for j in range(100))) for i in range(10)] + [(2000, None), (2001, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = lmscore.vocabulary(docs, common.Scratch(spark))
    n = {x["word"]: x["n"] for x in words.table.collect()}
    h = np.array(list(n), np.int64)
    unit, inside, rare = words.units(h)
    share = np.exp(inside + np.where(rare, np.log(np.array(list(n.values())) + 1), 0))
    assert (share[unit < lmscore.OWN] == 1).all() and share[unit >= lmscore.OWN].sum() == pytest.approx(1)
    assert (np.sort(unit[unit < lmscore.OWN]) == np.arange(own)).all()
    assert rare.sum() == max(0, len(n) - frequent)
    out = {x["doc_id"]: x["mean_log_probability"] for x in lmscore.score(docs).collect()}
    assert len(out) == len(rows) and out[2000] is None and out[2001] is None
    assert min(out[i] for i in range(200)) > max(out[1000 + i] for i in range(10))


def coded(spark, docs):
    from corvella.llm import lmscore

    words = lmscore.vocabulary(docs, common.Scratch(spark))
    return words, docs.select("doc_id", "text").mapInArrow(lmscore._code(words), lmscore.CODED)


def test_lm_learns_from_every_position(spark, monkeypatch):
    """Over the rounds each position once, with its copies as weight, also where a long text is parted."""
    import pyarrow as pa

    from corvella.llm import lmscore

    monkeypatch.setattr(lmscore, "PIECE", 7)
    learned = []
    monkeypatch.setattr(lmscore.Network, "learn", lambda self, x, y, adam, weight: learned.append(np.column_stack([x, y, weight])))
    texts = [f"{' '.join(WORDS_IN_ORDER)} number{i // 2}" for i in range(200)] + ["one", " ", " ".join(f"w{i}" for i in range(100))]
    words, rows = coded(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    parts = lmscore.pieces(rows, 3).orderBy("trainer", "fp", "part").toArrow().combine_chunks().to_batches()
    n = [[r["n"][0].as_py() for r in lmscore._train(lmscore.Network().flat(), t, lmscore.ROUNDS, 1.0)(iter(parts))] for t in range(lmscore.ROUNDS)]
    assert len(n[0]) == 3 and sum(map(sum, n)) == 11 * 200 + 101 and min(map(sum, n)) > 900
    got = sorted(tuple(map(int, x)) for part in learned for x in part)
    want = defaultdict(int)
    for _, _, h, of in lmscore._words(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])):
        c = words.units(h)[0]
        for x, y in zip(lmscore.Network.context(c, of), c, strict=True):
            want[(*map(int, x), int(y))] += 1
    total = defaultdict(int)
    for x in got:
        total[x[:-1]] += x[-1]
    assert total == want


def test_lm_scores_do_not_follow_the_partitions(spark, monkeypatch):
    from corvella.llm import lmscore

    monkeypatch.setattr(lmscore, "POSITIONS", 1 << 16)
    docs = table(spark, "documents")
    a, b = ({r["doc_id"]: r["mean_log_probability"] for r in lmscore.score(d).collect()} for d in (docs, docs.repartition(11).orderBy(F.desc("doc_id"))))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a if a[i] is not None) < 1e-4


def test_lm_scores_against_plain_sums(spark):
    """Each word's log-probability by the network's definition, one word after another."""
    from corvella.llm import lmscore

    rows = [(i, f"{' '.join(WORDS_IN_ORDER)} number{i // 2} {'x' * i}") for i in range(30)] + [(99, " ".join(f"u{i}" for i in range(4200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = common.Scratch(spark)
    words, c = coded(spark, docs)
    net = lmscore.train(s.stage(c), words, s)
    e, w1, b1, w2, b2, w3, b3 = (w.astype(np.float64) for w in net.w)
    n = defaultdict(int)
    for _, t in rows:
        for w in t.split():
            n[w] += 1
    unit = {w: int(words.units(lmscore.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])).view(np.int64))[0][0]) for w in n}
    got = {r["doc_id"]: r["log_probability"] for r in lmscore.score(docs).collect()}
    for i, t in rows:
        u, total = [lmscore.UNITS] * 2 + [unit[w] for w in t.split()] + [lmscore.UNITS] * 2, 0.0
        for j, w in enumerate(t.split(), 2):
            h = np.tanh(np.concatenate([e[u[k]] for k in (j - 2, j - 1, j + 1, j + 2)]) @ w1 + b1)
            g, k = divmod(min(u[j], lmscore.OWN), lmscore.EACH)
            z = h @ w2 + b2
            total += z[g] - np.log(np.exp(z).sum())
            if g < lmscore.GROUPS - 1:
                zz = h @ w3[g] + b3[g]
                total += zz[k] - np.log(np.exp(zz).sum())
            else:
                total += np.log((n[w] + 1) / sum(m + 1 for v, m in n.items() if unit[v] >= lmscore.OWN))
        assert got[i] == pytest.approx(total, abs=2e-3)


def test_lm_gradient_of_all_weights():
    from corvella.llm import lmscore

    r = np.random.default_rng(3)
    net = lmscore.Network()
    net.w = [w.astype(np.float64) for w in net.w]
    x, y = r.integers(0, lmscore.UNITS + 1, (40, 4)), r.integers(0, lmscore.UNITS, 40)

    class Keep:
        def step(self, g):
            self.g = g

    keep = Keep()
    weight = r.uniform(0.5, 3, 40)
    net.learn(x, y, keep, weight)
    for w, g in zip(net.w, keep.g, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, loss = w[i], []
        for d in (1e-4, -1e-4):
            w[i] = old + d
            loss.append(-(net.log_p(x, y) * weight).mean())
        w[i] = old
        assert g[i] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=1e-3)


WORDS_IN_ORDER = "the quick brown fox jumps over a lazy dog today".split()
