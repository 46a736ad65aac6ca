"""Difference of a stored and a current file manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.operators.catalog import first_by_id


def diff(stored: DataFrame, current: DataFrame, key: str = "filePath", value: str = "fileHash") -> DataFrame:
    """key and kind: added, deleted, modified or unchanged. One full outer join on the key."""
    s = stored.select(key, F.coalesce(value, F.lit("")).alias("_old"))
    c = current.select(key, F.coalesce(value, F.lit("")).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    return s.join(c, key, "full_outer").select(key, kind.alias("kind"))


def stored_hashes(chunks: DataFrame) -> DataFrame:
    """Hash of each file's first chunk, and its number of chunks."""
    return chunks.groupBy("filePath").agg(first_by_id("fileHash")["fileHash"].alias("fileHash"), F.count("*").alias("chunkCount"))


def counters(changes: DataFrame) -> DataFrame:
    kinds = ("added", "modified", "unchanged", "deleted")
    return changes.agg(*[F.count_if(F.col("kind") == k).alias(f"files{k.capitalize()}") for k in kinds])
