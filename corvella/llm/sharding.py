"""Sharding by fixed virtual slots.

A record's hash picks one of SLOTS virtual slots; bytes and rows are summed by slot,
and a versioned map says each slot's shard. The first version deals the slots out
from the largest to the smallest, each to the lightest shard (law: bytes). Adding a
shard edits the map: slots move to the new shard until all are near the new mean, and
no slot moves between old shards. Only SQL functions run here; the map has SLOTS rows
whatever the input, so its fold in one row and its broadcast are bounded.

Rows equal in id, checksum and size are counted before they are placed, so that a row
repeated many times is one row in the shuffle; its copies take places one after another.

Defined results: a null text has no bytes, so its size is 16 and its crc32 null; an empty
one has the size 16 and the crc32 0. Very long texts are one record, as any other. Null
ids hash with their text. Repeated rows share a slot and have places of their own; ties
between slots of equal bytes go to the smaller slot first. An empty table has no rows and
an empty map. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.llm.common import Scratch

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16


#: Copies of a row that are placed together.
LOT = 1 << 16
MAP = "vslot int, shard int, bytes long, rows long, version int"


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_of(*columns: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_sizes(sized: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; a row of `sized` stands for n equal ones."""
    return sized.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0: (version, vslot, shard, bytes, rows)."""
    row = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "rows"))).alias("s"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == at - 1, v - x["neg"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["to"], F.array(at - 1)).alias("to"))

    dealt = row.select(F.arrays_zip(F.col("s"), F.aggregate("s", start, step, lambda a: a["to"]).alias("to")).alias("z"))
    return dealt.select(F.explode("z").alias("z")).select(
        F.lit(0).alias("version"), F.col("z.s.vslot").alias("vslot"), F.col("z.to").alias("shard"), (-F.col("z.s.neg")).alias("bytes"), F.col("z.s.rows").alias("rows")
    )


def add_shard(old: DataFrame) -> DataFrame:
    """The next version with one shard more; slots leave a shard while it holds more than the new mean, smallest first."""
    bounds = old.agg(F.max("shard").alias("last"), F.max("version").alias("v"), F.sum("bytes").alias("total"))
    w = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    at = old.join(F.broadcast(bounds)).withColumn("upto", F.sum("bytes").over(w))
    moved = F.col("upto") > F.col("total") / (F.col("last") + 2)
    return at.select((F.col("v") + 1).alias("version"), "vslot", F.when(moved, F.col("last") + 1).otherwise(F.col("shard")).alias("shard"), "bytes", "rows")


def write_map(versioned: DataFrame, path: str, version: int) -> None:
    """Keeps every version; one that exists is refused, so none is ever changed."""
    versioned.filter(F.col("version") == version).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    maps = spark.read.schema(MAP).parquet(path)
    return maps.filter(F.col("version") == version) if version is not None else maps.join(F.broadcast(maps.agg(F.max("version").alias("version"))), "version")


def assign(records: DataFrame, versioned: DataFrame, *key: Column, slots: int = SLOTS) -> DataFrame:
    """Any records with their shard, without a shuffle: the map is broadcast, it has at most `slots` rows."""
    return records.withColumn("_vslot", slot_of(*key, slots=slots)).join(F.broadcast(versioned.select(F.col("vslot").alias("_vslot"), "shard")), "_vslot", "left").drop("_vslot")


def shard_documents(docs: DataFrame, scratch: Scratch | None = None, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """One row for each document: size, crc32, shard, its place in the shard (gapless from 0) and its virtual slot.

    The map is written to `maps` as version 0 and read from there; without `maps` to a folder of this run."""
    scratch = scratch or Scratch(docs.sparkSession)
    maps = maps or f"{scratch.root}/map"
    sized = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"), slot_of(F.col("doc_id"), F.xxhash64("text"), slots=slots).alias("vslot"))
    rows = scratch.stage(sized.groupBy("vslot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n")))
    write_map(first_map(slot_sizes(rows), shards), maps, 0)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    current = read_map(docs.sparkSession, maps, 0).select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("from"))
    earlier = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(current), "vslot")
    lots = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {LOT}"))).alias("lot")).repartition("vslot", "doc_id", "lot")
    each = lots.select("*", F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("n"), (F.col("lot") + 1) * LOT) - 1)).alias("copy"))
    return each.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("from") + F.col("first") + F.col("copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )
