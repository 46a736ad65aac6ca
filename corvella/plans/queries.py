"""The engine's operators over the test tables, each beside its ANSI SQL.

Stand-ins: documents are chunks or files (codebase = source, language = lang),
conversations are files with ordered chunks, pages.url are names, events.ts are
ingestion timestamps, labels are flags, embeddings are the vector table.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvella.config import DEFAULTS
from corvella.functions import names, paths, text, vectors
from corvella.operators import catalog, pivots, rescan, search
from corvella.operators.chunker import chunk_table
from corvella.operators.embed import embed_column, hash_counts_column
from corvella.operators.splitter import SplitChunk, split_sentences
from corvella.plans.engine import Engine, gapless
from corvella.session import bounded
from corvella.sources import codetree
from corvella.sources.files import Files
from corvella.sources.gitignore import Ignore
from corvella.sources.scratch import Staging, shared_folder
from corvella.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def store(spark: SparkSession) -> Iterator[tuple[Store, Staging]]:
    """An empty store in a folder of its own, which goes at the end; what is returned from it is staged before."""
    root = f"{shared_folder(spark)}/corvella-store-{uuid.uuid4().hex}"
    try:
        yield Store(spark, root), Staging(spark)
    finally:
        Files(spark).remove(root)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: one chunk a file, the ingestion named by the language."""
    name = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents")
    return d.select(name.alias("id"), F.col("text").alias("content"), name.alias("filePath"), F.col("lang").alias("language"), F.lit(1).alias("startLine"), F.col("lang").alias("ingestionTimestamp"), F.col("source").alias("_codebaseName"))


def _store_documents(s: Store, spark: SparkSession, sf_dir: str, name: str = "all") -> None:
    """The documents as one codebase."""
    chunks = _documents(spark, sf_dir)
    files = chunks.select("filePath", "language", F.md5("content").alias("fileHash"), F.octet_length("content").cast("long").alias("sizeBytes"))
    s.replace(name, chunks.withColumn("_codebaseName", F.lit(name)), files, "")


_D = "list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda x: (x[1]-x[2])*(x[1]-x[2])))"
_ONE = f"with s as (select e.vec_id, e.label, {_D} d from embeddings e, (select embedding from embeddings where vec_id = 0) q) "
_PATH = "concat(source, case doc_id % 5 when 0 then '/tests/' when 1 then '/node_modules/' when 2 then '/xvenv/' when 3 then '/__tests__/' else '/src/' end, case doc_id % 3 when 0 then 'latest_foo' when 1 then 'a.test' else 'm' end, case doc_id % 4 when 0 then '.PY' when 1 then '.ts' when 2 then '.md' else '' end)"


def _to_first(spark: SparkSession, sf_dir: str, k: int, **kw) -> DataFrame:
    return search.nearest_to_row(table(spark, sf_dir, "embeddings"), "vec_id", 0, k, "embedding", **kw)


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") == 0).select(F.col("embedding").alias("q")).limit(1)
    return e.join(F.broadcast(q)).select("vec_id", "label", vectors.squared_l2(F.col("embedding"), F.col("q")).alias("d"))


@query(_ONE + "select vec_id, label, round(sqrt(exp(-d/2)), 6) score from s order by d, vec_id limit 10")
def knn_topk(spark, sf_dir):
    return _to_first(spark, sf_dir, 10).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"with s as (select q.vec_id qid, e.vec_id vec_id, {_D} d from embeddings e, embeddings q where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by qid order by d, vec_id) rk from s) select qid, rk::int rk, vec_id from r where rk <= 5")
def knn_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return search.nearest_batch(e, q, 5).select("qid", "rk", "vec_id")


@query(f"with s as (select q.vec_id qid, e.vec_id vec_id, e.label, {_D} d from embeddings e, embeddings q where q.vec_id in (0, 7, 77)), r as (select *, row_number() over (partition by qid order by d, vec_id)::int rk from s) select qid, rk, vec_id, label, round(sqrt(d), 6) l2 from r where rk <= 10")
def knn_pruned(spark, sf_dir):
    """Exact nearest rows by cells around pivots, of three queries."""
    e, out = table(spark, sf_dir, "embeddings"), None
    index = pivots.build(e, shared_folder(spark), "embedding", 16)
    try:
        for r in e.filter("vec_id in (0, 7, 77)").select("vec_id", "embedding").collect():
            found = index.search(r["embedding"], 10, ("vec_id",))
            ranked = found.select(F.lit(r["vec_id"]).alias("qid"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rk"), "vec_id", "label", F.round(F.sqrt("distance"), 6).alias("l2"))
            out = ranked if out is None else out.unionAll(ranked)
    finally:
        index.drop()
    return out


@query(_ONE + "select vec_id, round(sqrt(exp(-d/2)), 6) score from s where label = 3 order by d, vec_id limit 5")
def knn_filtered(spark, sf_dir):
    return _to_first(spark, sf_dir, 5, where=F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))


@query(_ONE + ", r as (select *, row_number() over (partition by label order by d, vec_id) rk from s) select label, vec_id from r where rk <= 4 order by d, label, vec_id limit 4")
def knn_multi_table(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    query = e.filter("vec_id = 0").select("embedding").first()[0]
    with store(spark) as (s, stage):
        s.replace_all(e.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").cast("string").alias("filePath"), F.lpad(F.col("label").cast("string"), 6, "0").alias("_codebaseName")))
        found = search.search(s.chunks(), query, 4)
        return stage(found.select(F.col("codebaseName").cast("long").alias("label"), F.col("filePath").cast("long").alias("vec_id")))


@query(_ONE + "select vec_id, round(sqrt(d), 6) l2, round(sqrt(exp(-d/2)), 6) score from s")
def distance_scores(spark, sf_dir):
    return _distances(spark, sf_dir).select("vec_id", F.round(F.sqrt("d"), 6).alias("l2"), F.round(vectors.score(F.col("d")), 6).alias("score"))


@query(_ONE + "select case when sqrt(exp(-d/2)) >= .8 then 'high' when sqrt(exp(-d/2)) >= .6 then 'medium' else 'low' end band, count(*) n from s group by 1")
def confidence_bands(spark, sf_dir):
    return _distances(spark, sf_dir).groupBy(vectors.confidence(vectors.score(F.col("d"))).alias("band")).agg(F.count("*").alias("n"))


@query("select source, count(*) chunks, count(distinct doc_id) files, string_agg(distinct lang, ',' order by lang) langs from documents group by 1")
def list_codebases(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("filePath"), F.col("lang").alias("language"), F.col("source").alias("_codebaseName"), F.lit("").alias("_path"), F.lit("").alias("_lastIngestion"))
    return catalog.list_codebases(chunks).select(F.col("name").alias("source"), F.col("chunkCount").alias("chunks"), F.col("fileCount").alias("files"), F.array_join("languages", ",").alias("langs"))


@query("select conv_id, count(*) n, sum(length(text))::bigint sz, max(turn) \"last\", arg_max(md5(text), turn) h from conversations group by 1")
def file_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = F.lpad(F.col("turn").cast("string"), 12, "0")
    rows = c.select(F.col("conv_id").cast("string").alias("filePath"), turns.alias("id"), F.col("text").alias("content"), F.lit("").alias("language"), F.lit(False).alias("isTestFile"), F.lit(False).alias("isLibraryFile"), turns.alias("ingestionTimestamp"), F.md5("text").alias("fileHash"))
    return catalog.list_files(rows).select(F.col("filePath").cast("long").alias("conv_id"), F.col("chunkCount").alias("n"), F.col("sizeBytes").alias("sz"), F.col("lastIngestion").cast("long").alias("last"), F.col("fileHash").alias("h"))


@query("select conv_id, min(turn) first_turn, arg_min(md5(text), turn) h, count(*) n from conversations group by 1")
def stored_hashes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("filePath"), F.col("turn").alias("id"), F.md5("text").alias("fileHash"))
    first = rows.groupBy("filePath").agg(F.min("id").alias("first_turn"))
    return rescan.stored_hashes(rows).join(first, "filePath").select(F.col("filePath").alias("conv_id"), "first_turn", F.col("fileHash").alias("h"), F.col("chunkCount").alias("n"))


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("p"))


@query(
    f"select doc_id, (regexp_matches(p, '([.](test|spec)|_(test|spec))[.](ts|js|tsx|jsx|py|java|cs)$', 'i') or regexp_matches(p, 'test_.*[.](py|java|cs)$', 'i') or regexp_matches(p, '__tests__/|/tests?/|/spec/')) t, regexp_matches(p, '/node_modules/|/vendor/|/packages/|/dist/|/build/|/out/|/target/|/bin/|/obj/|/.venv/|/venv/|/site-packages/') l, lower(regexp_extract(p, '[^/]([.][^./]*)$', 1)) ext from (select doc_id, {_PATH} p from documents)"
)
def classify_paths(spark, sf_dir):
    p = F.col("p")
    return _paths(spark, sf_dir).select("doc_id", paths.is_test(p).alias("t"), paths.is_library(p).alias("l"), paths.extension(p).alias("ext"))


@query(f"select doc_id, case lower(regexp_extract(p, '[^/]([.][^./]*)$', 1)) when '.py' then 'python' when '.ts' then 'typescript' end as \"language\" from (select doc_id, {_PATH} p from documents)")
def language_of_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", paths.language(F.col("p")).alias("language"))


@query(f"select case when ext = '' then '(no extension)' else ext end ext, count(*) n from (select lower(regexp_extract({_PATH}, '[^/]([.][^./]*)$', 1)) ext from documents) where ext not in ('.cs', '.java', '.js', '.jsx', '.ts', '.tsx', '.py') group by 1")
def unsupported_by_ext(spark, sf_dir):
    files = _paths(spark, sf_dir).select(paths.classify(F.col("p")).alias("c")).select("c.*")
    return catalog.unsupported_by_extension(files).select(F.col("extension").alias("ext"), F.col("files").alias("n"))


@query(f"select count(*) total, count(*) filter (where ext in ('.py', '.ts')) supported, count(*) filter (where ext not in ('.py', '.ts')) unsupported from (select lower(regexp_extract({_PATH}, '[^/]([.][^./]*)$', 1)) ext from documents)")
def scan_statistics(spark, sf_dir):
    files = _paths(spark, sf_dir).select(paths.classify(F.col("p")).alias("c")).select("c.*")
    return catalog.scan_statistics(files).select(F.col("totalFiles").alias("total"), F.col("supportedFiles").alias("supported"), F.col("unsupportedFiles").alias("unsupported"))


#: A rescan of the documents: an id divisible by 13 is not there any more, one divisible by 7 has another text, one divisible by 11 was not there before.
@query("with s as (select doc_id, md5(coalesce(text, '')) h from documents where doc_id % 11 <> 0), c as (select doc_id, md5(case when doc_id % 7 = 0 then concat(coalesce(text, ''), ' edited') else coalesce(text, '') end) h from documents where doc_id % 13 <> 0) select case when s.h is null then 'added' when c.h is null then 'deleted' when s.h <> c.h then 'modified' else 'unchanged' end kind, count(*) n from s full join c using (doc_id) group by 1")
def rescan_diff(spark, sf_dir):
    d, t = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    stored = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("filePath"), text.file_hash(t).alias("fileHash"))
    current = d.filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("filePath"), text.file_hash(F.when(F.col("doc_id") % 7 == 0, F.concat(t, F.lit(" edited"))).otherwise(t)).alias("fileHash"))
    changes = rescan.counters(rescan.diff(stored, current))
    kinds = ("added", "modified", "unchanged", "deleted")
    return changes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"files{k.capitalize()}").alias("n")) for k in kinds])).alias("x")).select("x.*").filter("n > 0")


@query("select doc_id, ceil(length(text)/4)::bigint tok, ceil(length(text)/4)::bigint tok16 from documents")
def token_estimate(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.length(t)).alias("tok"), text.estimated_tokens(text.utf16_length(t)).alias("tok16"))


@query("select doc_id, (generate_subscripts(l, 1))::int start_line, length(unnest(l))::int n from (select doc_id, string_split(text, chr(10)) l from documents)")
def line_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("start_line"), F.length("line").alias("n"))


@query("select doc_id, len(regexp_extract_all(text, '[^.!?]+[.!?]+|[^.!?]+$'))::int n, md5(array_to_string(regexp_extract_all(text, '[^.!?]+[.!?]+|[^.!?]+$'), '|')) h from documents")
def sentence_split(spark, sf_dir):
    s = split_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("h"))


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(url)), '\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') nm from pages")
def normalise_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.normalised(F.col("url")).alias("nm"))


@query(r"select page_id, t, translate(regexp_extract(t, '^codebase_(.+)_\d+_\d+_\d+$', 1), '_', '-') back from (select page_id, concat('codebase_', regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), '_1_0_0') t from pages)")
def table_name(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", names.table_name(F.col("url")).alias("t"))
    return t.select("page_id", "t", names.recovered_name(F.col("t")).alias("back"))


@query("select page_id, array_to_string(list_transform(string_split(regexp_replace(url, '[-_/]', ' ', 'g'), ' '), lambda w: concat(upper(substring(w, 1, 1)), substring(w, 2))), ' ') d from pages")
def display_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.display_name(F.col("url"), "[-_/]").alias("d"))


@query("select event_id, floor((epoch_us(timestamp '2024-03-01') - epoch_us(ts))/86400000000.0)::bigint dd from events")
def days_since(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.whole_days(F.col("ts").cast("timestamp"), F.lit("2024-03-01").cast("timestamp")).alias("dd"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') iso from events")
def iso_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.iso_timestamp(F.col("ts").cast("timestamp")).alias("iso"))


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("filePath"))


@query("select d.lang, count(*) n, sum(length(d.text))::bigint size from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1) group by 1")
def delete_files(spark, sf_dir):
    with store(spark) as (s, stage):
        _store_documents(s, spark, sf_dir)
        s.delete_files("all", _toxic(spark, sf_dir))
        return stage(s.chunks("all").groupBy(F.col("language").alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("size")))


@query("select lang, count(*) n, sum(length(text))::bigint size, count(*) files from documents where doc_id <> 7 group by 1")
def delete_file(spark, sf_dir):
    with store(spark) as (s, stage):
        _store_documents(s, spark, sf_dir)
        s.delete_file("all", "7")
        files = s.files("all").groupBy(F.col("language").alias("lang")).agg(F.count("*").alias("files"))
        chunks = s.chunks("all").groupBy(F.col("language").alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("size"))
        return stage(chunks.join(files, chunks.lang.eqNullSafe(files.lang)).drop(files.lang))


@query("select count(*) n from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)")
def chunks_to_delete(spark, sf_dir):
    with store(spark) as (s, _):
        _store_documents(s, spark, sf_dir)
        n = s.delete_files("all", _toxic(spark, sf_dir))
    return spark.createDataFrame([(n,)], "n long")


@query("select source, coalesce(lang, 'unknown') as \"language\", count(distinct doc_id) files, count(*) chunks, sum(length(text))::bigint size from documents where not (source in ('src1', 'src2') and (doc_id % 9 = 0 or lang = 'de')) group by 1, 2")
def stored_statistics(spark, sf_dir):
    """The store's partial aggregates of all codebases, after deletes of many files and of a chunk set in two; no chunk is read."""
    d = table(spark, sf_dir, "documents")
    with store(spark) as (s, stage):
        s.replace_all(_documents(spark, sf_dir))
        gone = d.filter("doc_id % 9 = 0").select(F.col("doc_id").cast("string").alias("filePath"))
        for name in ("src1", "src2"):
            s.delete_files(name, gone)
            s.delete_chunk_set(name, "de")
        p = s.partials()
        sizes = p.groupBy(F.col("_codebaseName").alias("source"), catalog.or_unknown("language").alias("language")).agg(F.sum("size").alias("size"))
        counts = catalog.language_stats(p, "_codebaseName").select(F.col("_codebaseName").alias("source"), "language", F.col("fileCount").alias("files"), F.col("chunkCount").alias("chunks"))
        return stage(counts.join(sizes, ["source", "language"]))


@query("select sum(length(text))::bigint a, sum(length(text))::bigint b, sum(strlen(text))::bigint c from documents")
def size_bytes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").agg(F.sum(F.length(t)).alias("a"), F.sum(text.utf16_length(t)).alias("b"), F.sum(F.octet_length(t)).cast("long").alias("c"))


@query("select source, count(*) n from documents left join labels using (doc_id) where lang = 'en' and coalesce(toxic, 0) = 0 and coalesce(quality, 0) = 0 group by 1")
def flag_filter(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("isTestFile"), (F.col("quality") == 1).alias("isLibraryFile"))
    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "language").join(flags, "doc_id", "left").na.fill(False)
    return d.filter(search.filters("en", True, True)).groupBy("source").agg(F.count("*").alias("n"))


@query("select source, coalesce(lang, 'unknown') as \"language\", count(distinct doc_id) files, count(*) chunks from documents group by 1, 2")
def stats_by_language(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return catalog.language_stats(d, "_codebaseName").select(F.col("_codebaseName").alias("source"), "language", F.col("fileCount").alias("files"), F.col("chunkCount").alias("chunks"))


@query("select coalesce(nullif(role, ''), 'unknown') as \"type\", count(*) as \"count\" from conversations group by 1")
def chunk_type_counts(spark, sf_dir):
    return catalog.chunk_type_stats(table(spark, sf_dir, "conversations").withColumnRenamed("role", "chunkType"))


@query("select max(source) as \"name\", count(*) chunks, count(distinct doc_id) files, sum(length(text))::bigint size_bytes from documents")
def codebase_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("_codebaseName"), F.lit("").alias("_path"), F.col("doc_id").cast("string").alias("filePath"), F.lit("").alias("_lastIngestion"), F.col("text").alias("content"))
    return catalog.totals(d).select("name", F.col("chunkCount").alias("chunks"), F.col("fileCount").alias("files"), F.col("sizeBytes").alias("size_bytes"))


@query("select event_type, count(*) n from events where strftime(ts, '%Y-%m-%d') <> '2024-01-02' group by 1")
def delete_chunk_set(spark, sf_dir):
    e, day = table(spark, sf_dir, "events"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    with store(spark) as (s, stage):
        s.replace("events", e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("language"), day.alias("ingestionTimestamp")))
        s.delete_chunk_set("events", "2024-01-02")
        return stage(s.chunks("events").groupBy(F.col("language").alias("event_type")).agg(F.count("*").alias("n")))


@query("select source, renamed_from, count(*) n from (select case when source = 'src2' then 'renamed' else source end source, case when source = 'src2' then source end renamed_from from documents) group by 1, 2")
def rename_codebase(spark, sf_dir):
    d = _documents(spark, sf_dir)
    with store(spark) as (s, stage):
        s.replace("src2", d.filter("_codebaseName = 'src2'"))
        s.replace("rest", d.filter("_codebaseName <> 'src2' OR _codebaseName IS NULL"))
        s.rename("src2", "renamed")
        return stage(s.chunks().groupBy(F.col("_codebaseName").alias("source"), F.col("_renamedFrom").alias("renamed_from")).agg(F.count("*").alias("n")))


@query("select conv_id, turn, concat('conv_2024-01-01T00:00:00.000Z_', row_number() over (order by conv_id, turn) - 1) id from conversations")
def row_ids(spark, sf_dir):
    n = gapless(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], "n")
    return n.select("conv_id", "turn", F.concat(F.lit("conv_2024-01-01T00:00:00.000Z_"), F.col("n").cast("string")).alias("id"))


@query("select count(*) n, count(*) filter (where strlen(html) <= 5000) kept from pages")
def size_filter(spark, sf_dir):
    size = F.octet_length("html")
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("n"), F.count_if(codetree.fits(size, 5000)).alias("kept"))


@query("select lang, count(*) n from documents group by 1 order by n desc, lang")
def language_counts(spark, sf_dir):
    d = _documents(spark, sf_dir)
    files = d.select("filePath", "language")
    return catalog.ingest_language_stats(files, d).select(F.col("language").alias("lang"), F.col("chunkCount").alias("n"))


@query("select doc_id, md5(text) file_hash from documents")
def file_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.file_hash(F.col("text")).alias("file_hash"))


@query("select source, arg_min(doc_id, doc_id) sample_id, count(*) n from documents group by 1")
def table_samples(spark, sf_dir):
    return catalog.samples(_documents(spark, sf_dir)).select(F.col("name").alias("source"), F.col("sample.id").cast("long").alias("sample_id"), F.col("rows").alias("n"))


@query("select distinct lang from documents")
def distinct_languages(spark, sf_dir):
    return catalog.languages(_documents(spark, sf_dir)).select(F.col("language").alias("lang"))


@query("select conv_id, turn, role, text from conversations where not regexp_matches(text, '\\S') union all select conv_id, turn, role, text from conversations where regexp_matches(text, '\\S')")
def blank_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = F.when(text.is_blank(F.col("text")), "blank").otherwise("full")
    key = F.from_json("id", "conv_id long, turn long")
    with store(spark) as (s, stage):
        s.replace_all(c.select(F.to_json(F.struct("conv_id", "turn")).alias("id"), F.col("text").alias("content"), F.col("role").alias("chunkType"), name.alias("_codebaseName")))
        return stage(s.chunks().select(key["conv_id"].alias("conv_id"), key["turn"].cast(c.schema["turn"].dataType).alias("turn"), F.col("chunkType").alias("role"), F.col("content").alias("text")))


@query("select l_orderkey, l_linenumber, case when l_extendedprice < 60000 then printf('%.1fs', l_extendedprice/1000) else printf('%dm %ds', floor(l_extendedprice/60000)::bigint, floor(l_extendedprice/1000 - 60*floor(l_extendedprice/60000))::bigint) end took from (select l_orderkey, l_linenumber, floor(l_extendedprice) + 0.25 l_extendedprice from lineitem)")
def durations(spark, sf_dir):
    ms = F.floor("l_extendedprice") + F.lit(0.25)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.duration(ms).alias("took"))


#: Lines of eight words of a document, of 400 characters at most; no line is longer than 512 tokens, so parts hold whole lines.
_LINES = r"select doc_id, list_transform(range(0, len(w), 8), lambda i: array_to_string(list_slice(w, i + 1, i + 8), ' ')) l from (select doc_id, list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x[1:400]) w from documents)"


@query(
    f"""with recursive d as ({_LINES}),
c as (select doc_id, l, list_transform(l, lambda x: ((length(x) + 4) // 4)::bigint) t, ((length(array_to_string(l, chr(10))) + 3) // 4)::bigint whole from d),
p as (select doc_id, l, t, 0 part, 1 lo, case when whole <= 512 then len(l) else coalesce(list_position(list_transform(range(1, len(l) + 1), lambda i: list_sum(t[1:i]) > 512), true) - 1, len(l)) end hi from c where len(l) > 0
 union all select doc_id, l, t, part + 1, hi + 1, coalesce(list_position(list_transform(range(hi + 1, len(l) + 1), lambda i: list_sum(t[hi + 1:i]) - t[hi + 1] + ((length(l[hi + 1]) + 3) // 4) > 512), true) + hi - 1, len(l)) from p where hi < len(l))
select doc_id, part::int part, array_to_string(l[lo:hi], chr(10)) as "content", (case when part > 0 then lo else 1 end)::int as "startLine", hi::int as "endLine", case when lo = 1 and hi = len(l) then 'function' else concat('function_part_', part + 1) end as "chunkType" from p"""
)
def token_chunks(spark, sf_dir):
    spark.udtf.register("split_chunk", SplitChunk)
    words = F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: F.substring(w, 1, 400))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8).cast("int")), lambda i: F.array_join(F.slice("w", i * 8 + 1, 8), " "))
    view = f"_corvella_{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.array_join(lines, "\n").alias("text")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT d.doc_id, c.* FROM {view} d, LATERAL split_chunk(d.text, 1, 'function', 512, 0) c")


@query(
    r"""with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, unnest(regexp_extract_all(translate(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+|[0-9]+|[^\x00-\x7F]+')) w from d),
b as (select doc_id, w, case when w[1] <= '~' then list_transform(string_split(reverse(w), ''), lambda c: unicode(c)::bigint) else list_reverse(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint)) end c from w),
h as (select doc_id, list_reduce(c, lambda a, x: (a * 31 + x) % 2147483647) h, 10 weight from b
 union all select doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: unicode(w[i]) + 31 * unicode(w[i + 1]) + 961 * unicode(w[i + 2]))) h, 3 weight from b where w[1] <= '~'),
v as (select doc_id, h % 384 k, sum(case when h // 384 % 2 = 0 then weight else -weight end)::bigint x from h group by 1, 2),
g as (select doc_id, md5(string_agg(k || ':' || x, ',' order by k)) digest from v where x <> 0 group by 1)
select doc_id, case when regexp_matches(text, '\S') then 384 end::int dimension, regexp_matches(text, '\S') embedded, coalesce(digest, md5('')) digest from documents left join g using (doc_id)"""
)
def embed_documents(spark, sf_dir):
    """Length and direction of each vector, and a digest of the whole numbers that it is made of."""
    d = bounded(table(spark, sf_dir, "documents")).select("doc_id", embed_column(F.col("text")).alias("vector"), hash_counts_column(F.col("text")).alias("raw"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(total(F.transform("raw", lambda x: x.cast("double") * x.cast("double"))))
    length = F.sqrt(total(F.transform("vector", lambda x: x.cast("double") * x.cast("double"))))
    along = total(F.zip_with("vector", "raw", lambda x, y: x.cast("double") * y))
    same = (F.abs(length - 1) < 1e-5) & ((norm == 0) | (F.abs(along - norm) < 1e-6 * norm))
    numbers = F.filter(F.transform("raw", lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), x.cast("string")))), lambda x: x.isNotNull())
    return d.select("doc_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dimension"), F.coalesce(F.col("vector").isNotNull() & same, F.lit(False)).alias("embedded"), F.md5(F.array_join(numbers, ",")).alias("digest"))


def _packed(parts: str, glue: str) -> str:
    """SQL of parts packed into texts of at most 512 tokens, in order."""
    return f"""list_reduce(list_transform({parts}, lambda p: {{'out': []::varchar[], 'now': p}}), lambda a, x: case when a.now = '' then {{'out': a.out, 'now': x.now}} when (length(a.now) + {len(glue)} + length(x.now) + 3) // 4 > 512 then {{'out': list_append(a.out, a.now), 'now': x.now}} else {{'out': a.out, 'now': a.now || '{glue}' || x.now}} end, {{'out': []::varchar[], 'now': ''}})"""


def _parts(packed: str) -> str:
    return f"case when ({packed}).now = '' then ({packed}).out else list_append(({packed}).out, ({packed}).now) end"


_STRIPPED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_WORDS = r"list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')"


@query(
    f"""with l as (select doc_id, coalesce(text, '') t, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
q as (select *, case when (length(line) + 4) // 4 > 512 then list_transform(case when len(regexp_extract_all(line, '[^.!?]+[.!?]+|[^.!?]+$')) = 0 then [line] else regexp_extract_all(line, '[^.!?]+[.!?]+|[^.!?]+$') end, lambda x: {_STRIPPED}) else []::varchar[] end sentences from l),
v as (select *, list_filter(flatten(list_transform(sentences, lambda s: case when (length(s) + 3) // 4 > 512 then {_parts(_packed(_WORDS, " "))} else [s] end)), lambda p: p <> '') pieces from q),
k as (select *, {_packed("pieces", " ")} packed from v),
e as (select doc_id, t, list({{'out': []::varchar[], 'now': [line], 'used': ((length(line) + 4) // 4)::bigint, 'parts': {_parts("packed")}}} order by i) e from k group by 1, 2),
r as (select doc_id, t, list_reduce(e, lambda a, x: case
  when x.used > 512 then {{'out': list_concat(case when len(a.now) > 0 then list_append(a.out, array_to_string(a.now, chr(10))) else a.out end, x.parts[1:len(x.parts) - 1]), 'now': x.parts[len(x.parts):len(x.parts)], 'used': case when len(x.parts) > 0 then ((length(x.parts[len(x.parts)]) + 3) // 4)::bigint else 0 end, 'parts': []::varchar[]}}
  when len(a.now) > 0 and a.used + x.used > 512 then {{'out': list_append(a.out, array_to_string(a.now, chr(10))), 'now': list_append(a.now[len(a.now) + 1 - greatest(1, len(list_filter(range(1, len(a.now) + 1), lambda j: list_sum(list_transform(a.now[len(a.now) + 1 - j:], lambda y: (length(y) + 4) // 4)) <= 50))):], x.now[1]),
   'used': ((length(array_to_string(list_append(a.now[len(a.now) + 1 - greatest(1, len(list_filter(range(1, len(a.now) + 1), lambda j: list_sum(list_transform(a.now[len(a.now) + 1 - j:], lambda y: (length(y) + 4) // 4)) <= 50))):], x.now[1]), chr(10))) + 3) // 4)::bigint, 'parts': []::varchar[]}}
  else {{'out': a.out, 'now': list_append(a.now, x.now[1]), 'used': a.used + x.used, 'parts': []::varchar[]}} end, {{'out': []::varchar[], 'now': []::varchar[], 'used': 0::bigint, 'parts': []::varchar[]}}) f from e),
o as (select doc_id, case when (length(t) + 3) // 4 <= 512 then [t] when len(f.now) > 0 then list_append(f.out, array_to_string(f.now, chr(10))) else f.out end parts from r),
p as (select doc_id, len(parts) n, unnest(parts) c, generate_subscripts(parts, 1) i from o),
w as (select *, sum(length(c) - length(replace(c, chr(10), '')) + 1) over (partition by doc_id order by i) upto from p)
select doc_id, (i - 1)::int part, md5(c) digest, (upto - (length(c) - length(replace(c, chr(10), ''))))::int as "startLine", upto::int as "endLine", case when n > 1 then 'function_part_' || i else 'function' end as "chunkType" from w"""
)
def split_texts(spark, sf_dir):
    """Whole texts as they are, with long lines, sentences and words over the bound, and parts that overlap by 50 tokens."""
    spark.udtf.register("split_chunk", SplitChunk)
    view = f"_corvella_{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT d.doc_id, c.part, md5(c.content) digest, c.startLine, c.endLine, c.chunkType FROM {view} d, LATERAL split_chunk(d.text, 1, 'function', 512, 50) c")



#: Documents as files: folders by id, of which some are hidden, ignored, tests or libraries, and an extension in some cases.
_FILE = "concat(case doc_id % 7 when 0 then '.cache/' when 1 then 'src/tests/' when 2 then 'app/node_modules/x/' when 3 then 'ignored/deep/' when 4 then 'src/_own/' when 5 then 'lib/vendor/' else '' end, case doc_id % 4 when 0 then 'test_' else 'm' end, doc_id, case doc_id % 9 when 0 then '.PY' when 1 then '.ts' when 2 then '.log' when 3 then '.java' when 4 then '.cs' when 5 then '.test.js' when 6 then '' when 7 then '.md' else '.tsx' end)"
_RULES = "# of this tree\nignored/\n*.log\n!m1*.log\n"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    files = table(spark, sf_dir, "documents").select(F.expr(_FILE).alias("relativePath"), F.octet_length(t).cast("long").alias("size"), t.alias("text"))
    return codetree.described(codetree.visible(files, Ignore(_RULES)).filter(codetree.fits(F.col("size"), 4000)))


@query(
    f"""with f as (select {_FILE} p, coalesce(text, '') t from documents), v as (select *, lower(regexp_extract(p, '[^/]([.][^./]*)$', 1)) x from f where strlen(t) <= 4000 and not p like '.cache/%' and not p like 'ignored/%' and (not p like '%.log' or regexp_matches(p, '(^|/)m1[^/]*[.]log$')))
select p as "relativePath", strlen(t)::bigint as "size", x as "extension", case x when '.py' then 'python' when '.ts' then 'typescript' when '.tsx' then 'typescript' when '.js' then 'javascript' when '.java' then 'java' when '.cs' then 'csharp' end as "language", x in ('.py', '.ts', '.tsx', '.js', '.java', '.cs') as "supported",
 p like '%.test.js' or p like '%/tests/%' or regexp_matches(p, 'test_.*[.](py|java|cs)$', 'i') as "isTestFile", p like '%/node_modules/%' or p like '%/vendor/%' as "isLibraryFile", md5(t) as "fileHash" from v"""
)
def code_tree(spark, sf_dir):
    return _tree(spark, sf_dir).select("relativePath", "size", "extension", "language", "supported", "isTestFile", "isLibraryFile", text.file_hash(F.col("text")).alias("fileHash"))


#: A document as a source file: each line of its text, letters and digits only, is a statement in the body of one declaration. Parts: before the lines, after them, and around each.
_CODE = {
    "typescript": ("// of {0}\nexport async function f{0}<T,>(a: T): Promise<void> {\n", "}\n\ninterface I{0} {\n  a: string;\n}\n", '  say("{ ', ' }");'),
    "javascript": ("class C{0} {\n  // runs\n  async *['run'](a) {\n", "  }\n\n  get size() { return 1; }\n}\n", "    say(`}} ", " ${(() => 1)()}`);"),
    "java": ("package p;\n\npublic enum E{0} {\n  ONE(1) {\n    @Override public int of(int a) {\n", "      return a;\n    }\n  };\n  abstract int of(int a);\n}\n", '      say("', '}");'),
    "csharp": ("namespace N {\n  public class C{0} {\n    public int Size { get; set; } = 3;\n    public C{0}() { }\n    public int Of(int a) {\n", "      return a;\n    }\n  }\n}\n", '      Say(@"', '{");'),
    "python": ("# of {0}\nclass C{0}:\n    def run(self, a):\n", "        return a\n\n\ndef f{0}():\n    return 1\n", '        say("', '")'),
}
#: Chunks of such a file: kind, first line, and last line less the number of text lines; each text line in JavaScript is an arrow function too.
_CHUNKS = {
    "typescript": (("function", 2, 3), ("interface", 5, 7)),
    "javascript": (("class", 1, 7), ("method", 2, 4), ("method", 6, 6)),
    "java": (("method", 5, 7), ("method", 9, 9)),
    "csharp": (("class", 2, 8), ("property", 3, 3), ("method", 5, 7)),
    "python": (("class", 1, 4), ("method", 3, 4), ("function", 7, 8)),
}
#: Chunks that begin behind the lines of the text, or before them but end there too.
_AFTER = {("typescript", 5), ("javascript", 6), ("java", 9), ("python", 7)}
_ABOVE = {("csharp", 3)}


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, language and content of each document's file. The runs that stay are found, not the marks that go: Java looks for those a fifth as fast."""
    kept = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9 \n]++"), F.lit(0)), "")
    language = F.element_at(F.array(*[F.lit(x) for x in _CODE]), (F.col("doc_id") % len(_CODE) + 1).cast("int"))
    content, named = None, lambda x: F.replace(F.lit(x), F.lit("{0}"), F.col("doc_id").cast("string"))
    for name, (head, tail, before, after) in _CODE.items():
        own = F.concat(named(head + before), F.replace("t", F.lit("\n"), F.lit(f"{after}\n{before}")), named(f"{after}\n{tail}"))
        content = F.when(F.col("language") == name, own) if content is None else content.when(F.col("language") == name, own)
    return table(spark, sf_dir, "documents").select("doc_id", kept.alias("t"), language.alias("language")).select("doc_id", "language", content.alias("content"))


def _chunk_rows() -> str:
    rows = []
    for name, found in _CHUNKS.items():
        for kind, first, last in found:
            k = 0 if (name, first) in _ABOVE else 1
            rows.append(f"('{name}', '{kind}', {first}, {1 if (name, first) in _AFTER else 0}, {last}, {k})")
    return ", ".join(rows)


@query(
    f"""with d as (select doc_id, len(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 \n]', '', 'g'), chr(10))) n, (['{"', '".join(_CODE)}'])[doc_id % {len(_CODE)} + 1] lang from documents), c as (select * from (values {_chunk_rows()}) t(lang, kind, a, ka, b, kb))
select doc_id, kind as "chunkType", (a + ka * n)::int as "startLine", (b + kb * n)::int as "endLine" from d join c using (lang) union all select doc_id, 'function', (3 + i)::int, (3 + i)::int from (select doc_id, unnest(range(1, n + 1)) i from d where lang = 'javascript')"""
)
def code_chunks(spark, sf_dir):
    files = _sources(spark, sf_dir).select("doc_id", "language", F.encode("content", "UTF-8").alias("content"))
    return chunk_table(files, ["doc_id"], 1000000000, 0).select("doc_id", "chunkType", "startLine", "endLine")


_LANGUAGES = "(['" + "', '".join(_CODE) + f"'])[doc_id % {len(_CODE)} + 1]"
_PER_FILE = "case lang " + " ".join(f"when '{k}' then {len(v)}{' + n' if k == 'javascript' else ''}" for k, v in _CHUNKS.items()) + " end"
_LINES_OF = "len(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 \n]', '', 'g'), chr(10)))"
_EXTENSIONS = {"typescript": ".ts", "javascript": ".js", "java": ".java", "csharp": ".cs", "python": ".py"}


def _code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, relativePath and content."""
    extension = F.create_map(*[F.lit(x) for kv in _EXTENSIONS.items() for x in kv])[F.col("language")]
    return _sources(spark, sf_dir).select("doc_id", F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), extension).alias("relativePath"), F.encode("content", "UTF-8").alias("content"))


def _engine(spark: SparkSession, s: Store) -> Engine:
    """Chunks are not split, so that SQL can tell their number; files of any size are read."""
    config = copy.deepcopy(DEFAULTS)
    config["ingestion"] |= {"maxChunkTokens": 1 << 30, "maxFileSize": 1 << 30}
    return Engine(spark, s.root, config)


@query(
    f"""with d as (select doc_id, {_LINES_OF} n, {_LANGUAGES} lang from documents)
select lang as "language", count(*) files, sum({_PER_FILE})::bigint chunks, sum({_PER_FILE})::bigint embedded, sum({_PER_FILE})::bigint hashed, (select sum({_PER_FILE}) from d)::bigint as "ids", (select sum({_PER_FILE}) - 1 from d)::bigint as "last" from d group by 1"""
)
def ingest_documents(spark, sf_dir):
    """Documents as source files, ingested: parsed, embedded, numbered, stored and read back."""
    files = _code_files(spark, sf_dir)
    with store(spark) as (s, stage):
        _engine(spark, s).ingest_files(files.drop("doc_id"), "documents")
        c = s.chunks("documents")
        number = F.regexp_extract("id", r"_(\d+)$", 1).cast("long")
        whole = c.agg(F.countDistinct(number).alias("ids"), F.max(number).alias("last"))
        hashes = s.files("documents").select("filePath", F.col("fileHash").alias("h"))
        each = c.join(hashes, "filePath").groupBy("language").agg(F.countDistinct("filePath").alias("files"), F.count("*").alias("chunks"), F.count_if(F.size("vector") == 384).alias("embedded"), F.count_if(F.col("fileHash") == F.col("h")).alias("hashed"))
        return stage(each.join(F.broadcast(whole)))


@query(
    f"""with d as (select doc_id, {_LINES_OF} n, {_LANGUAGES} lang, doc_id % 11 <> 0 was, doc_id % 13 <> 0 stays, doc_id % 7 = 0 edited from documents), c as (select *, ({_PER_FILE})::bigint k from d)
select count(*) filter (where stays and not was) as "filesAdded", count(*) filter (where stays and was and edited) as "filesModified", count(*) filter (where stays and was and not edited) as "filesUnchanged", count(*) filter (where was and not stays) as "filesDeleted",
 coalesce(sum(k) filter (where stays and (edited or not was)), 0)::bigint as "chunksAdded", coalesce(sum(k) filter (where was and (edited or not stays)), 0)::bigint as "chunksDeleted", coalesce(sum(k) filter (where stays), 0)::bigint as "chunks", count(*) filter (where stays) as "files" from c"""
)
def rescan_documents(spark, sf_dir):
    """An ingest and a rescan of the documents as files: some go, some come, some have another end."""
    files, i = _code_files(spark, sf_dir), F.col("doc_id")
    later = files.filter(i % 13 != 0).select("relativePath", F.when(i % 7 == 0, F.concat("content", F.encode(F.lit("\n"), "UTF-8"))).otherwise(F.col("content")).alias("content"))
    with store(spark) as (s, _):
        engine = _engine(spark, s)
        engine.ingest_files(files.filter(i % 11 != 0).drop("doc_id"), "documents")
        counts = engine.rescan_files(later, "documents")
        counts |= {"chunks": s.count("documents"), "files": s.files("documents").count()}
    names = ("filesAdded", "filesModified", "filesUnchanged", "filesDeleted", "chunksAdded", "chunksDeleted", "chunks", "files")
    return spark.createDataFrame([tuple(int(counts[k]) for k in names)], ", ".join(f"{k} long" for k in names))


@query("select source, lang as \"language\", count(*) n, sum(length(text))::bigint size from documents where source <> 'src1' and not (source = 'src2' and lang = 'fr') and not (source = 'src3' and doc_id % 2 = 1) group by 1, 2")
def store_life(spark, sf_dir):
    """Codebases created, appended to, replaced and dropped; one is asked for by its name, an absent one has no rows."""
    d = _documents(spark, sf_dir).filter("_codebaseName IS NOT NULL")
    later = F.col("_codebaseName").isin("src2", "src3") & F.col("language").isin("fr", "de", "es")
    with store(spark) as (s, stage):
        s.replace_all(d.filter(~F.coalesce(later, F.lit(False))))
        for name, languages in (("src2", ("de", "es")), ("src3", ("fr", "de", "es"))):
            for language in languages:
                s.append(name, d.filter((F.col("_codebaseName") == name) & (F.col("language") == language)))
        if s.exists("src3"):
            s.replace("src3", s.chunks("src3").filter(F.col("id").cast("long") % 2 == 0))
        if s.exists("src1"):
            s.drop("src1")
        rest = s.chunks().filter("_codebaseName <> 'src3'")
        left = rest.unionAll(s.chunks("src3")).unionAll(s.chunks("absent"))
        return stage(left.groupBy(F.col("_codebaseName").alias("source"), "language").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("size")))


@query(f"select case when x = '' then '(no extension)' else x end as \"extension\", p as \"path\" from (select lower(regexp_extract({_PATH}, '[^/]([.][^./]*)$', 1)) x, concat(doc_id, ':', {_PATH}) p from documents) where x not in ('.py', '.ts') union all select case x when '.py' then 'python' else 'typescript' end, p from (select lower(regexp_extract({_PATH}, '[^/]([.][^./]*)$', 1)) x, concat(doc_id, ':', {_PATH}) p from documents) where x in ('.py', '.ts')")
def file_groups(spark, sf_dir):
    """Unsupported files by extension and the others by language, a row for each."""
    p = F.concat(F.col("doc_id").cast("string"), F.lit(":"), "p")
    files = _paths(spark, sf_dir).select(p.alias("relativePath"), paths.classify(F.col("p")).alias("c")).select("relativePath", "c.*")
    return catalog.unsupported_files(files).withColumnRenamed("relativePath", "path").unionAll(catalog.files_by_language(files).select(F.col("language"), F.col("relativePath")))


@query(r"select page_id, printf('%.2f MB', strlen(html) / 1048576.0) size, url_encode(url) encoded, floor(100.0 * strlen(html) / 20000)::bigint percent, replace(url, chr(39), chr(39) || chr(39)) quoted from pages")
def text_formats(spark, sf_dir):
    n = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", text.memory_size(n).alias("size"), text.url_encode(F.col("url")).alias("encoded"), text.percentage(n, F.lit(20000)).cast("long").alias("percent"), F.replace("url", F.lit("'"), F.lit("''")).alias("quoted"))
