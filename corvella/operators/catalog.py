"""Listings and statistics; all are aggregates with map-side combine.

Those of chunks take the chunks themselves or their partial aggregates (partial()): one
row for each file, language, kind and ingestion, with the columns of the chunk with the first
id, and with the counts and sizes of all. They give the same for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that all chunks of a row of partial() share.
WITHIN = ("filePath", "language", "chunkType", "ingestionTimestamp", "_codebaseName", "_path")
PARTIAL = "filePath string, language string, chunkType string, ingestionTimestamp string, _codebaseName string, _path string, id string, isTestFile boolean, isLibraryFile boolean, fileHash string, _lastIngestion string, chunks long, size long"


def partial(chunks: DataFrame) -> DataFrame:
    """Mergeable aggregates of chunks; a file's rows are as many as its kinds and ingestions."""
    first = F.min_by(F.struct("id", "isTestFile", "isLibraryFile"), numbered()).alias("_first")
    rows = chunks.groupBy(*WITHIN).agg(first, F.max("fileHash").alias("fileHash"), F.max("_lastIngestion").alias("_lastIngestion"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("size"))
    return rows.select(*WITHIN, "_first.*", "fileHash", "_lastIngestion", "chunks", "size")


def _count(df: DataFrame) -> Column:
    return F.coalesce(F.sum("chunks"), F.lit(0)) if "chunks" in df.columns else F.count("*")


def _size(df: DataFrame) -> Column:
    return F.coalesce(F.sum("size") if "chunks" in df.columns else F.sum(F.length("content")), F.lit(0))


def or_unknown(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown"))


def numbered(c: str = "id") -> Column:
    """Ids end in a number: their order is by what is before it, then by the number. Ids without one come first, as text."""
    digits = F.regexp_extract(F.col(c).cast("string"), r"0*(\d*)$", 1)
    return F.struct(F.regexp_replace(F.col(c).cast("string"), r"\d+$", "").alias("before"), F.length(digits).alias("size"), digits.alias("digits"))


def first_by_id(*columns: str) -> Column:
    """The columns, as a struct, of the row with the first id."""
    return F.min_by(F.struct(*columns), numbered())


def list_codebases(chunks: DataFrame) -> DataFrame:
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return chunks.groupBy(F.col("_codebaseName").alias("name")).agg(
        first_by_id("_path")["_path"].alias("path"),
        _count(chunks).alias("chunkCount"),
        F.countDistinct(full("filePath")).alias("fileCount"),
        F.max("_lastIngestion").alias("lastIngestion"),
        F.sort_array(F.collect_set(full("language"))).alias("languages"),
    )


def samples(chunks: DataFrame) -> DataFrame:
    """name, the row with the first id, and the number of rows of each codebase."""
    return chunks.groupBy(F.col("_codebaseName").alias("name")).agg(first_by_id("id", "_codebaseName", "language").alias("sample"), _count(chunks).alias("rows"))


def languages(chunks: DataFrame) -> DataFrame:
    return chunks.select("language").distinct()


def language_stats(chunks: DataFrame, *within: str) -> DataFrame:
    return chunks.groupBy(*within, or_unknown("language").alias("language")).agg(F.countDistinct(F.coalesce("filePath", F.lit(""))).alias("fileCount"), _count(chunks).alias("chunkCount"))


def chunk_type_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(or_unknown("chunkType").alias("type")).agg(_count(chunks).alias("count"))


def totals(chunks: DataFrame) -> DataFrame:
    """One row; sizeBytes is in code points."""
    return chunks.agg(
        F.max("_codebaseName").alias("name"),
        F.min(F.when(F.col("_path") != "", F.col("_path"))).alias("path"),
        _count(chunks).alias("chunkCount"),
        F.countDistinct(F.coalesce("filePath", F.lit(""))).alias("fileCount"),
        F.max("_lastIngestion").alias("lastIngestion"),
        _size(chunks).alias("sizeBytes"),
    )


def stats(chunks: DataFrame) -> DataFrame:
    """totals() with the language and chunk type statistics as arrays; these have a row for each kind only."""
    lang = language_stats(chunks).agg(F.sort_array(F.collect_list(F.struct("language", "fileCount", "chunkCount"))).alias("languages"))
    kind = chunk_type_stats(chunks).agg(F.sort_array(F.collect_list(F.struct("type", "count"))).alias("chunkTypes"))
    return totals(chunks).join(F.broadcast(lang)).join(F.broadcast(kind))


def list_files(chunks: DataFrame) -> DataFrame:
    """Roll-up by file; the row with the first id gives language and flags, the latest timestamp the hash."""
    first = first_by_id("language", "isTestFile", "isLibraryFile")
    latest = F.max(F.struct("ingestionTimestamp", "fileHash"))
    return (
        chunks.filter(F.col("filePath") != "")
        .groupBy("filePath")
        .agg(_count(chunks).alias("chunkCount"), _size(chunks).alias("sizeBytes"), first.alias("_first"), latest.alias("_latest"))
        .select(
            "filePath",
            F.coalesce(F.when(F.col("_first.language") != "", F.col("_first.language")), F.lit("javascript")).alias("language"),
            "chunkCount",
            F.coalesce("_latest.ingestionTimestamp", F.lit("")).alias("lastIngestion"),
            "sizeBytes",
            F.coalesce("_first.isTestFile", F.lit(False)).alias("isTestFile"),
            F.coalesce("_first.isLibraryFile", F.lit(False)).alias("isLibraryFile"),
            F.coalesce("_latest.fileHash", F.lit("")).alias("fileHash"),
        )
    )


def scan_statistics(files: DataFrame) -> DataFrame:
    """One row of counters with the unsupported files by extension; one pass over the files, then one over a row for each extension."""
    by = files.groupBy(_extension(), "supported").agg(F.count("*").alias("files"))
    entry = F.when(~F.col("supported"), F.struct("extension", "files"))
    each = by.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("totalFiles"),
        F.coalesce(F.sum(F.when(F.col("supported"), F.col("files"))), F.lit(0)).alias("supportedFiles"),
        F.coalesce(F.sum(F.when(~F.col("supported"), F.col("files"))), F.lit(0)).alias("unsupportedFiles"),
        F.collect_list(entry).alias("entries"),
    )
    return each.select("totalFiles", "supportedFiles", "unsupportedFiles", F.map_from_entries("entries").alias("unsupportedByExtension"))


def _extension() -> Column:
    return F.when(F.col("extension") == "", "(no extension)").otherwise(F.col("extension")).alias("extension")


def unsupported_by_extension(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("supported")).groupBy(_extension()).agg(F.count("*").alias("files"))


def unsupported_files(files: DataFrame, path: str = "relativePath") -> DataFrame:
    """(extension, path) of each unsupported file, sorted: a group is a range of rows, of any size."""
    return files.filter(~F.col("supported")).select(_extension(), path).orderBy("extension", path)


def files_by_language(files: DataFrame, path: str = "relativePath") -> DataFrame:
    """(language, path) of each file with a language, sorted: a group is a range of rows, of any size."""
    return files.filter(F.col("language").isNotNull()).select("language", path).orderBy("language", path)


def ingest_language_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files without chunks count as files."""
    per = chunks.groupBy("filePath").agg(_count(chunks).alias("n"))
    return files.filter(F.col("language").isNotNull()).join(per, "filePath", "left").groupBy("language").agg(F.count("*").alias("fileCount"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunkCount")).orderBy(F.desc("chunkCount"), "language")
