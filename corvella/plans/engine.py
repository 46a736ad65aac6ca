"""Ingest, rescan, search and catalogue behind one object."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvella.config import DEFAULTS, ConfigError
from corvella.functions import text
from corvella.functions.names import normalise
from corvella.operators import catalog, rescan
from corvella.operators import search as search_ops
from corvella.operators.chunker import chunk_table
from corvella.operators.embed import HashEmbedder, embed_column, embed_text, served
from corvella.sources import codetree
from corvella.sources.gitignore import Ignore
from corvella.sources.scratch import Staging
from corvella.sources.store import NotFound, Store, now_iso
from corvella.streaming.progress import Progress


Tell = Callable[[str, int, int], None]


def _silent(phase: str, current: int, total: int) -> None:
    pass


def _heard(progress: Progress, tell: Tell) -> Progress | None:
    """Rows are counted, which takes them through Python, only where somebody is told."""
    return None if tell is _silent else progress


class Engine:
    """embedder: makes the embedder, in each worker once; left out, it is the model that the configuration names, if its files are below its cachePath, else HashEmbedder.
    ranks: file of a tokenizer's ranks by which chunks are measured. cache: may be shared by engines of one store."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None, embedder=None, ranks: str | None = None, cache: search_ops.Cache | None = None):
        self.spark, self.config, self.ranks = spark, config or DEFAULTS, ranks or ""
        self.store = Store(spark, root)
        names = self.config["embedding"]
        self.embedder = embedder or served(names["modelName"], names["cachePath"]) or HashEmbedder
        if (model := names["modelName"]) != DEFAULTS["embedding"]["modelName"] and model != getattr(self.embedder, "name", None):
            raise ConfigError(f"embedding.modelName {model!r} isn't served: put its files below embedding.cachePath, pass an embedder of that name, or leave the setting at its default for {HashEmbedder.name}")
        self.cache = cache or search_ops.Cache(self.config["search"]["cacheTimeoutSeconds"])

    def chunk_rows(self, files: DataFrame, name: str, path: str, timestamp: str, first: int = 0, stage: Staging | None = None, progress: Progress | None = None, n: int | None = None) -> DataFrame:
        """files (about n supported ones) → embedded chunk rows with gapless ids in the order of path and chunk: chunks without an embedding get no id.

        The files are put in order, not the chunks, which are many and wide and follow their file's order as they are made; they are parsed and written once, then numbered.
        Vectors are most of what is written: of an embedder that is sure they are made after that, by the job that writes the rows where they stay."""
        stage = stage or Staging(self.spark)
        c = self.config["ingestion"]
        supported = codetree.in_order(files.filter("supported"), n)
        named = (progress.counted(supported) if progress else supported).withColumnRenamed("relativePath", "filePath")
        rows = chunk_table(named, ["filePath", "language", "isTestFile", "isLibraryFile", "fileHash"], c["maxChunkTokens"], c["chunkOverlapTokens"], self.ranks)
        rows = rows.filter(text.not_blank(F.col("content")))
        vector, sure = embed_column(F.col("content"), self.embedder, batch=c["batchSize"]), getattr(self.embedder, "sure", False)
        if not sure:
            rows = rows.withColumn("vector", vector).filter(F.col("vector").isNotNull())
        rows = _numbered(stage(rows.withColumn("_at", F.monotonically_increasing_id())), "_n")
        if sure:
            rows = rows.withColumn("vector", vector)
        return rows.select(
            F.concat(F.lit(f"{name}_{timestamp}_"), (F.col("_n") + first).cast("string")).alias("id"),
            *("vector", "content", "filePath", "startLine", "endLine", "language", "chunkType", "isTestFile", "isLibraryFile", "fileHash"),
            *[F.lit(v).alias(k) for k, v in (("ingestionTimestamp", timestamp), ("_codebaseName", name), ("_path", path), ("_lastIngestion", timestamp))],
        )

    @staticmethod
    def _manifest(files: DataFrame) -> DataFrame:
        return files.filter("supported").select(F.col("relativePath").alias("filePath"), "language", "fileHash", F.col("size").alias("sizeBytes"))

    def listing(self, path: str, respect_gitignore: bool = True, stage: Staging | None = None) -> codetree.Listing:
        """Names, sizes, languages and flags of a tree's files up to the bound of size; no file is opened."""
        found = codetree.listing(self.spark, path, respect_gitignore, True, stage)
        fit = found.files.filter(codetree.fits(F.col("size"), self.config["ingestion"]["maxFileSize"]))
        return codetree.Listing(codetree.described(fit), found.counts, found.n)

    def scan(self, path: str, respect_gitignore: bool = True) -> DataFrame:
        """The supported files of a tree with contents and hashes."""
        found = self.listing(path, respect_gitignore)
        return codetree.contents(found.files.filter("supported"), path, found.n)

    def _described(self, files: DataFrame, rules: Ignore | None) -> DataFrame:
        """A table of files as a listing with hash, and content where the file is supported and small enough. Large files are still there: a filter by
        size would make each content once more, before the rows that pass it; filter what is written."""
        sized = codetree.visible(files, rules).select("relativePath", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"), F.col("content").cast("binary").alias("content"))
        read = F.col("supported") & self._fits()
        return codetree.described(sized).withColumns({"fileHash": F.when(read, text.file_hash(F.col("content"))), "content": F.when(read, F.col("content"))})

    def _fits(self) -> Column:
        return codetree.fits(F.col("size"), self.config["ingestion"]["maxFileSize"])

    def ingest(self, path: str, name: str, respect_gitignore: bool = True, tell: Tell = _silent) -> dict[str, Any]:
        """Replaces the codebase when everything is written; a failure leaves the old one. tell(phase, current, total) follows it.

        The tree is walked once and each supported file read once, into a staged table from which chunks, manifest and counts all come."""
        began = time.monotonic()
        tell("Scanning", 0, 0)
        with Staging(self.spark) as stage:
            found = self.listing(path, respect_gitignore, stage)
            counts = catalog.scan_statistics(found.files).first().asDict() | found.counts
            with Progress(self.spark, "Reading", counts["supportedFiles"], tell) as p:
                files = stage(codetree.contents(found.files.filter("supported"), path, found.n, seen=p.seen))
            return counts | self._replace(files, name, path, counts["supportedFiles"], stage, tell) | {"durationMs": round(1000 * (time.monotonic() - began))}

    def ingest_files(self, files: DataFrame, name: str, path: str = "", rules: Ignore | None = None, tell: Tell = _silent) -> dict[str, Any]:
        """As ingest, of a table of files (relativePath, content): hidden, ignored and large ones are left out, and the rest is written once."""
        began = time.monotonic()
        with Staging(self.spark) as stage:
            every = stage(self._described(files, rules)).filter(self._fits())
            counts = catalog.scan_statistics(every).first().asDict()
            return counts | self._replace(every, name, path, counts["supportedFiles"], stage, tell) | {"durationMs": round(1000 * (time.monotonic() - began))}

    def _replace(self, files: DataFrame, name: str, path: str, total: int, stage: Staging, tell: Tell) -> dict[str, Any]:
        name, timestamp = normalise(name), now_iso()
        previous = self.store.count(name)
        with Progress(self.spark, "Chunking and embedding", total, tell) as p:
            rows = self.chunk_rows(files, name, path, timestamp, stage=stage, progress=_heard(p, tell), n=total)
        self.store.replace(name, rows, self._manifest(files), path)
        self.cache.clear()
        languages = [r.asDict() for r in catalog.ingest_language_stats(self.store.files(name), self.store.partials(name)).collect()]
        tell("Complete", total, total)
        chunks = sum(x["chunkCount"] for x in languages)
        return {"chunkCount": chunks, "previousChunkCount": previous, "chunkDelta": chunks - previous, "languages": languages}

    def rescan(self, name: str, path: str | None = None, tell: Tell = _silent) -> dict[str, Any]:
        """Reads again what changed; gitignore rules always hold here.

        Every file is hashed once, without its content leaving the task; the changed ones are then read, and the manifest has the hashes of what was read. Their chunks
        are appended and those of changed and deleted files named as deleted, in one change of the store: what is unchanged isn't written."""
        began, info = time.monotonic(), self.store.info(name)
        path = path or info["path"]
        tell("Scanning", 0, 0)
        with Staging(self.spark) as stage:
            found = self.listing(path, True, stage)
            supported = found.files.filter("supported")
            with Progress(self.spark, "Comparing", found.n, tell) as p:
                hashed = stage(codetree.contents(supported, path, found.n, keep=False, seen=p.seen))

            def read(new: DataFrame, n: int) -> DataFrame:
                with Progress(self.spark, "Reading", n, tell) as p:
                    return stage(codetree.contents(supported.join(new, "relativePath", "left_semi"), path, n, seen=p.seen))

            return self._update(hashed, read, name, path, stage, tell) | {"durationMs": round(1000 * (time.monotonic() - began))}

    def rescan_files(self, files: DataFrame, name: str, rules: Ignore | None = None, tell: Tell = _silent) -> dict[str, Any]:
        """As rescan, of a table of files: what makes its contents may cost more than they do, so they are written once and hashed on the way."""
        began, info = time.monotonic(), self.store.info(name)
        with Staging(self.spark) as stage:
            every = stage(self._described(files, rules).filter("supported")).filter(self._fits())
            read = lambda new, n: stage(every.join(new, "relativePath", "left_semi"))
            return self._update(every.drop("content"), read, name, info["path"], stage, tell) | {"durationMs": round(1000 * (time.monotonic() - began))}

    def _update(self, hashed: DataFrame, read: Callable[[DataFrame, int], DataFrame], name: str, path: str, stage: Staging, tell: Tell) -> dict[str, Any]:
        """hashed: all files without contents; read(relativePath, n): the n of these names with contents."""
        timestamp = now_iso()
        changes = stage(rescan.diff(self.store.files(name), self._manifest(hashed)))
        counts = rescan.counters(changes).first().asDict() | {"chunksAdded": 0, "chunksDeleted": 0}
        fresh = counts["filesAdded"] + counts["filesModified"]
        if fresh + counts["filesDeleted"]:
            gone = changes.filter(F.col("kind").isin("modified", "deleted")).select("filePath")
            new = changes.filter(F.col("kind").isin("added", "modified")).select(F.col("filePath").alias("relativePath"))
            files = read(new, fresh)
            manifest = self._manifest(hashed.join(new, "relativePath", "left_anti")).unionByName(self._manifest(files))
            with Progress(self.spark, "Chunking and embedding", fresh, tell) as p:
                added = self.chunk_rows(files, name, path, timestamp, stage=stage, progress=_heard(p, tell), n=fresh) if fresh else None
            counts["chunksDeleted"], counts["chunksAdded"] = self.store.update(name, gone, added, manifest, path)
        self.cache.clear()
        tell("Complete", fresh, fresh)
        return counts

    def search(self, query: str, codebase: str | None = None, language: str | None = None, max_results: int = 0, exclude_tests: bool = False, exclude_libraries: bool = False) -> dict[str, Any]:
        began, k = time.monotonic(), max_results or self.config["search"]["defaultMaxResults"]
        key = self.cache.key(store=self.store.root, change=self.store.change(), model=self.embedder.name, query=query, codebase=codebase, language=language, k=k, tests=exclude_tests, libraries=exclude_libraries)
        if hit := self.cache.get(key):
            return hit
        vector = embed_text(query, self.embedder)
        if not (self.store.exists(codebase) if codebase else self.store.tables()):
            return {"results": [], "totalResults": 0, "queryTime": round(1000 * (time.monotonic() - began))}
        found = search_ops.search(self.store.chunks(codebase), vector, k, language, exclude_tests, exclude_libraries)
        rows = [r.asDict() for r in found.collect()]
        out = {"results": rows, "totalResults": len(rows), "queryTime": round(1000 * (time.monotonic() - began))}
        self.cache.put(key, out)
        return out

    def list_codebases(self) -> DataFrame:
        return catalog.list_codebases(self.store.partials())

    def stats(self, name: str) -> DataFrame:
        self.store.info(name)
        return catalog.stats(self.store.partials(name))

    def list_files(self, name: str) -> DataFrame:
        self.store.info(name)
        return catalog.list_files(self.store.partials(name))

    def delete_file(self, name: str, path: str) -> int:
        self.cache.clear()
        return self.store.delete_file(name, path)

    def delete_chunk_set(self, name: str, timestamp: str) -> int:
        self.cache.clear()
        return self.store.delete_chunk_set(name, timestamp)

    def rename(self, old: str, new: str) -> int:
        self.cache.clear()
        return self.store.rename(old, new)

    def drop(self, name: str) -> None:
        self.cache.clear()
        self.store.drop(name)


def gapless(df: DataFrame, order: list[str], out: str, stage: Staging | None = None) -> DataFrame:
    """Numbers from 0 in the given order, which must tell all rows apart.

    Rows are sorted by range and written once with their partition and place in it; the
    offsets, a row for each partition, and the rows themselves are both read from there.
    Planned twice, the ranges would not be the same: their bounds are sampled, and
    partitions are merged by size at run time.
    """
    stage = stage or Staging(df.sparkSession)
    return _numbered(stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())), out)


def _numbered(placed: DataFrame, out: str) -> DataFrame:
    """Numbers from 0 by _at, the monotonic ids with which the table was written."""
    part = F.shiftright("_at", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))
    offsets = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_from"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(out, F.col("_from") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_from")


__all__ = ["Engine", "NotFound", "gapless"]
