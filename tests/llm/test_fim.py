"""Fill-in-the-middle against a version with a list of units."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from corvella.llm import fim, queries

SF = "/root/testdata/sf0.01"


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    return len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_matches_sql(spark):
    same(queries.op13_fim(spark, SF), queries.ORACLE["op13_fim"], SF)


@given(st.text(st.sampled_from("ab1 <>PSMé😀\n\x00"), max_size=40), st.integers(-3, 10**6))
def test_equals_list_of_units(text, doc_id):
    x = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    assert fim.cut(text, tuple(int(x[i : i + 8], 16) for i in (0, 8, 16, 24))) == plain(doc_id, text)


@pytest.mark.parametrize("low,high", [(0, 0), (0, 3), (2, 2), (1, 7), (7, 7)])
def test_ends(low, high):
    text = "ab, cd é1"
    units = fim.UNIT.findall(text)
    assert fim.ends(text, low, high) == (len("".join(units[:low])), len("".join(units[:high])))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").unionAll(spark.createDataFrame([(50, "a<P>b"), (51, "x <M"), (52, "<S>"), (-7, "minus seven")], "doc_id long, text string"))
    out = fim.fill_in_middle(rows.withColumn("n", F.lit(1)).withColumn("form", F.lit(2)).withColumn("h1", F.lit(3)))
    got = sorted((tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)
    assert got == sorted(((r["doc_id"], *plain(r["doc_id"], r["text"])) for r in rows.collect()), key=repr)
    back = sorted((tuple(r) for r in out.select("doc_id", fim.restored(F.col("output"), F.col("form"))).collect()), key=repr)
    assert back == sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), key=repr)
    assert fim.fill_in_middle(no_docs).count() == 0


def test_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    n = {r["form"]: r["count"] for r in fim.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 400) < 100 and abs(n["spm"] - 720) < 150
    assert {r["form"] for r in fim.fill_in_middle(docs, taken=100, spm=100).select("form").distinct().collect()} == {"spm"}
    assert {r["form"] for r in fim.fill_in_middle(docs, taken=0).select("form").distinct().collect()} == {"plain"}
