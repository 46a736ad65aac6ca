"""Scores follow from the texts alone, however the table is partitioned."""

import numpy as np
from pyspark.sql import functions as F

from corvella.llm import lmscore

SF = "/root/testdata/sf0.01"


def test_scores_do_not_follow_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    docs = docs.unionAll(docs.filter("doc_id % 5 = 0").select((F.col("doc_id") + 10**6).alias("doc_id"), "text")).persist()
    run = lambda df: {r["doc_id"]: r["log_probability"] for r in lmscore.score(df).collect()}
    one, two = run(docs), run(docs.repartition(7, F.xxhash64("doc_id")))
    assert one == two and all(one[i] == one[i - 10**6] for i in one if i >= 10**6)
    docs.unpersist()


def test_a_position_does_not_follow_its_batch():
    r = np.random.default_rng(1)
    net = lmscore.Network()
    for w in net.w:
        w += r.normal(0, 0.5, w.shape).astype(np.float32)
    c = r.integers(0, lmscore.UNITS, 3000).astype(np.uint16)
    x = lmscore.Network.context(c, np.zeros(3000, np.int64))
    whole, exact = net.exact().log_p(x, c), net.log_p(x, c)
    assert np.abs(whole - exact).max() < 1e-2
    for size in (1, 7, 1000):
        assert np.concatenate([net.exact().log_p(x[lo : lo + size], c[lo : lo + size]) for lo in range(0, 3000, size)]).tolist() == whole.tolist()


def test_exponentials_of_scores_are_single():
    """Doubles took half of the time of scoring; log-probabilities are those of doubles to 1e-5."""
    r = np.random.default_rng(2)
    net = lmscore.Network()
    for w in net.w:
        w += r.normal(0, 0.3, w.shape).astype(np.float32)
    c = np.concatenate([r.integers(0, lmscore.UNITS, 3000), r.integers(0, lmscore.EACH, 3000)]).astype(np.uint16)
    x = lmscore.Network.context(c, np.repeat(np.arange(60), 100))
    net = net.exact()
    e, w1, b1, w2, b2, w3, b3 = net.w
    h = lmscore.on_grid(np.tanh(e[x].reshape(len(x), -1) @ w1 + b1))
    share = lambda z: z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
    group, unit = lmscore._place(c)
    want = share(h @ w2 + b2)[np.arange(len(c)), group]
    for k in range(lmscore.GROUPS - 1):
        own = np.flatnonzero(group == k)
        want[own] += share(h[own] @ w3[k] + b3[k])[np.arange(len(own)), unit[own]]
    assert np.abs(net.log_p(x, c) - want).max() < 1e-5
    assert all(q.dtype == np.float32 for q in lmscore._exp(h, w2, b2, net._small(), net.rounded))
