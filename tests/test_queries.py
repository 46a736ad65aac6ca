import pytest
from oracle import same

from corvella.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE[name], SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_documents_are_embedded(spark):
    """The vectors themselves, which the query's SQL can't give, against the embedder."""
    from pyspark.sql import functions as F

    from corvella.operators.embed import HashEmbedder, embed_column

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in docs.select("doc_id", "text", embed_column(F.col("text")).alias("vector")).collect()}
    assert len(got) == docs.count()
    for r in list(got.values())[:200]:
        assert abs(sum((a - b) ** 2 for a, b in zip(r["vector"], HashEmbedder().embed([r["text"]])[0], strict=True))) < 1e-9
