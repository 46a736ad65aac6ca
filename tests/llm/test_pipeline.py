"""The pipeline's stages, each on its own input, and the whole."""

import corpus_pipeline
from test_methods import brute_jaccard

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "jaccard", "secrets", "mixing", "pieces"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        if name != "pieces":
            assert docs.columns == columns
        if name == "quality":
            ids = {r["doc_id"] for r in rows}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in ids for i in good) >= 0.97 * len(good)
            assert sum(i in ids for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())
            kept = [(r["doc_id"], r["text"]) for r in rows]
        elif name == "jaccard":
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, (c, _) in brute_jaccard(kept).items() if i == c)
        elif name == "secrets":
            assert all("token = \"" not in r["text"] or "[SECRET]" in r["text"] for r in rows)
            assert all(len(r["text"]) == r["n_chars"] for r in rows)
            assert all(r["text"] == before[r["doc_id"]]["text"] for r in rows if "[SECRET]" not in r["text"])
        elif name == "mixing":
            assert max(docs.groupBy("doc_id").count().toPandas()["count"]) <= 2
        else:
            assert all(r["round_trip"] for r in rows)


def _folder(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_and_empty_tables(spark, tmp_path, odd_docs, no_docs, odd_labels, no_labels):
    """Nulls, empty and very long texts, repeated rows and clashing names go through all stages; so do empty tables."""
    ids = {r["doc_id"] for r in odd_docs.collect()}
    for name, labels in (("labelled", odd_labels), ("none", no_labels)):
        out = corpus_pipeline.run(spark, _folder(spark, tmp_path / name, odd_docs, labels)).collect()
        assert {r["doc_id"] for r in out} <= ids
        assert all(r["round_trip"] or r["doc_id"] == 11 for r in out if r["ids"] is not None)
    assert {r["doc_id"] for r in out} & {1, 2} == {1}  # without labels nothing is rejected; of two equal texts one stays
    for name, labels in (("empty", odd_labels), ("both", no_labels)):
        out = corpus_pipeline.run(spark, _folder(spark, tmp_path / name, no_docs, labels))
        assert out.count() == 0 and out.columns == ["doc_id", "ids", "n_ids", "round_trip"]
