"""Quality scores: a plain scorer gives the same, and a score follows from the text alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def plain(model, text):
    """One text, passage by passage, with loops and plain sums."""
    data = (text or "").encode()
    top, total = np.zeros(quality.HIDDEN), 0.0
    w1, b1, v, u, a, o, b = (x.astype(float) for x in model.w)
    for lo in range(0, max(len(data), 1), quality.PASSAGE):
        part = np.frombuffer(data[lo : lo + quality.PASSAGE], np.uint8)
        c = [int(quality._CLASS[x]) for x in part]
        x = np.zeros(quality.FEATURES)
        for i in c:
            x[i] += 1
        for i, j in zip(c[:-1], c[1:], strict=True):
            x[16 + 16 * i + j] += 1
        x[:272] = np.sqrt(x[:272] / max(len(c), 1))
        x[272], x[273] = np.log1p(len(c)) / 7, not c
        h = np.tanh((x - model.mean) * model.scale @ w1 + b1)
        e = np.exp(np.sum(np.tanh(h @ v) / (1 + np.exp(-(h @ u))) * a))
        top, total = top + e * h, total + e
    return 1 / (1 + np.exp(-(top / total @ o + b[0])))


def test_equals_a_plain_scorer(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()
    texts = [r["text"] for r in docs] + ["", "x", "é " * 3000, None]
    data, offsets = quality.text_of(__import__("pyarrow").record_batch({"text": texts}))
    got = quality.predict(model, data, offsets)
    assert np.abs(got - [plain(model, t) for t in texts]).max() < 2e-3  # weights are rounded to 16 places


def test_scores_follow_from_the_text_alone(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.limit(50).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    run = lambda df: {r["doc_id"]: (r["text"], r["score"]) for r in df.select("doc_id", "text").mapInArrow(keep, "doc_id long, text string, score double").collect()}
    score = quality._score(model)

    def keep(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 13):
                part = b.slice(lo, 13)
                one = list(score([part]))[0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), one.column(1)], names=["doc_id", "text", "score"])

    one, two = run(docs), run(docs.repartition(7))
    assert one == two
    by_text = {}
    for t, x in one.values():
        assert by_text.setdefault(t, x) == x
    whole = {r["doc_id"]: r["score"] for r in docs.mapInArrow(score, "doc_id long, score double").collect()}
    assert whole == {k: x for k, (_, x) in one.items()}
