"""Every operator over odd and empty tables: it gives its defined result for each row."""

import pytest
from pyspark.sql import functions as F

from corvella.llm import jaccard, lmscore, mixing, multiindex, pieces, quality, secrets, sharding, topk, toxicity


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mixing(odd_docs, no_docs):
    rows = mixing.plan_rows(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    out = {r["doc_id"]: r for r in rows}
    assert out[4]["size"] == out[5]["size"] == out[6]["size"] == out[4]["taken"] == 0
    assert out[3]["source_size"] == 60 + 6  # the null source
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.plan_rows(no_docs).collect() == []
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(no_docs).count() == 0


def test_sharding(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    out = {r["doc_id"]: r for r in rows}
    assert out[4]["size"] == 16 and out[4]["text_crc32"] is None and out[5]["size"] == 16
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard_documents(no_docs).collect() == []


def test_quality(odd_docs, no_docs, odd_labels, no_labels):
    rows = quality.score(odd_docs, odd_labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    out = {r["doc_id"]: r for r in rows}
    assert out[4]["score"] == out[5]["score"]
    assert {r["score"] for r in quality.score(odd_docs, no_labels).collect()} == {0.5}
    assert quality.score(no_docs, odd_labels).count() == 0
    assert quality.accepted(odd_docs, no_labels).count() == odd_docs.count()
    assert quality.accepted(odd_docs, odd_labels).columns == odd_docs.columns


def test_multiindex(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (2, [2.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, []), (10, [1.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("id", F.lit(2))
    out = [tuple(r) for r in multiindex.near_duplicates(df).collect()]
    assert len(out) == len(rows)
    assert (1, 2, 1, True) in out and out.count((2, 2, 1, False)) == 2
    for i in (3, 4, 5, 6, 7, 8, 9, 10):
        assert (i, 0, i, True) in out
    assert (None, 0, None, False) in out
    assert multiindex.near_duplicates(df.limit(0)).count() == 0


def test_jaccard(odd_docs, no_docs):
    rows = jaccard.classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows}
    assert out[1] == (1, 3) and out[2] == (1, 3) and out[3] == (1, 3)
    assert out[7] == (7, 1) and out[8] == (7, 1)
    assert out[4] == (4, 0) and out[5] == (5, 0) and out[6] == (6, 0) and out[None] == (None, 0)
    assert jaccard.classes(no_docs).collect() == []
    kept = jaccard.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 6, 7, None} <= set(ids) and not {2, 3, 8} & set(ids)


def test_repeated_id_stays_once(spark, odd_docs):
    twice = odd_docs.filter("doc_id = 1").unionAll(odd_docs.filter("doc_id = 1"))
    assert jaccard.deduplicate(twice).count() == 1
    assert {r["n_links"] for r in jaccard.classes(twice).collect()} == {1}


def test_pieces(odd_docs, no_docs):
    out = by_id(pieces.encode(odd_docs))
    assert out[4]["ids"] is None and out[5]["ids"] == [] and out[5]["round_trip"]
    back = by_id(pieces.decode(pieces.encode(odd_docs)))
    for r in odd_docs.collect():
        if r["doc_id"] != 11:
            assert back[r["doc_id"]]["text"] == r["text"]
    assert "😀" in back[11]["text"] and "\x00" in back[11]["text"]
    assert pieces.encode(no_docs).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.2, -0.3]), (1, [0.1, 0.1]), (2, [0.1, 0.1]), (3, None), (4, [float("nan"), 0.0]), (None, [1.0, 1.0]), (100, None), (5, [None, 1.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(True))
    out = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    mine = sorted(r for r in out if r[0] == 0)
    assert [r[2] for r in mine] == [0, 0, 1, 1, 2, 2, 50, 50]  # two rows of one id: each has the other; equal scores by id; fewer than five
    assert [r[2] for r in sorted(r for r in out if r[0] == 50)] == [0, 0, 1, 2]
    assert {r[0] for r in out} == {0, 50}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_toxicity(odd_docs, no_docs, odd_labels, no_labels):
    rows = toxicity.score(odd_docs, odd_labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.score(odd_docs, no_labels).collect()} == {0.0}
    assert toxicity.score(no_docs, odd_labels).count() == 0


def test_lmscore(odd_docs, no_docs):
    rows = lmscore.score(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    out = {r["doc_id"]: r for r in rows}
    for i in (4, 5, 6):
        assert (out[i]["n_words"], out[i]["log_probability"], out[i]["mean_log_probability"]) == (0, 0.0, None)
    assert out[9]["n_words"] == 60_000 and out[9]["log_probability"] < 0
    assert lmscore.score(no_docs).count() == 0


def test_secrets(odd_docs, no_docs):
    rows = secrets.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    out = {r["doc_id"]: r for r in rows}
    assert out[11]["n_assign"] == 1 and out[4]["spans"] == ""
    assert secrets.scan(no_docs).count() == 0
    red = secrets.redact(odd_docs)
    assert red.columns == odd_docs.columns
    texts = by_id(red)
    assert texts[4]["text"] is None and "[SECRET]" in texts[11]["text"] and texts[11]["n_chars"] == len(texts[11]["text"])


@pytest.mark.parametrize("most", [1, 7])
def test_scratch_tables_are_whole(spark, most):
    from corvella.llm.common import Scratch

    s = Scratch(spark)
    t = s.stage(spark.range(most))
    assert t.count() == most
    s.drop(t)
