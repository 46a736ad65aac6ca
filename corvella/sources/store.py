"""Codebases as versioned Parquet folders with deletes and names beside them.

root/chunks/<folder>/ holds what one change has added to a codebase, root/files/<folder>/ a file
manifest, root/stats/<folder>/ the partial aggregates of the chunks of the same name (catalog.partial),
root/deletes/<folder>/ a list of values that a change has deleted. root/_versions/<i>.json names, after change i, the
folders of each codebase with their number of rows and the ranges of their paths and timestamps,
its deletes, and what it is called.

A change writes folders and then makes the next file of _versions in one rename, so that a
failed write leaves the old version in place and of two writers at once the later one
fails. No change but a compaction writes chunks that are there already:

- Chunks are appended as a folder of their own. The counts and ranges of it are observed by the job that writes it.
- A delete is a row of the codebase's list: a column, a value (or a folder of values) and the
  change that made it. It holds for the folders that were written before. Readers drop the
  rows it names: one value by a filter that reaches the scan, many by an anti join.
- A rename changes the list alone: readers get the logical columns (_codebaseName,
  _renamedFrom, _renamedAt, cb) from there.

Where a codebase has more than FOLDERS folders or DELETES deletes, or more than half its rows are deleted, the change
compacts it: the rows that are left are written as one folder. Folders that no version names
stay until the change after the next one, for those who still read them. The root may be on any file
system that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.functions.names import table_of
from corvella.operators import catalog
from corvella.schema import CHUNKS, FILES
from corvella.sources.files import Files

KEPT_VERSIONS = 10
#: Folders and deletes of a codebase at most.
FOLDERS = 32
DELETES = 32
#: Columns by which rows are deleted, and whose ranges are kept for each folder.
KEYS = ("filePath", "ingestionTimestamp")
LOGICAL = ("_codebaseName", "_renamedFrom", "_renamedAt")


class NotFound(LookupError):
    """No such codebase."""


class Conflict(RuntimeError):
    """Another writer changed the store at the same time."""


def now_iso() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def _fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, null where df has none of that name."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def _version(folder: str) -> str:
    """Last part of cb=<table>/<letter>=<id>."""
    return folder.rpartition("=")[2]


def _before(folders: list[dict], change: int) -> list[str]:
    """Folders that a delete of this change holds for."""
    return [f["dir"] for f in folders if f["change"] < change]


def may_hold(folder: dict, column: str, value: str) -> bool:
    """Whether the folder's range of the column leaves open that it holds the value."""
    low, high = folder["ranges"].get(column) or (None, None)
    return low is not None and low <= value <= high


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.fs = spark, root.rstrip("/"), Files(spark)
        self.fs.make(f"{self.root}/_versions")

    # ------------------------------------------------------------ versions

    def _latest(self) -> tuple[int, dict]:
        """Number of the last change (-1: none yet), and the codebases by table and folders to remove after it."""
        names = [x for x in self.fs.names(f"{self.root}/_versions") if x.endswith(".json") and x[:-5].isdigit()]
        if not names:
            return -1, {"codebases": {}, "trash": []}
        text = self.fs.read(f"{self.root}/_versions/{names[-1]}")
        return int(names[-1][:-5]), json.loads(text or '{"codebases": {}, "trash": []}')

    def change(self) -> int:
        """Number of the last change, by whichever writer; -1 if there is none."""
        return self._latest()[0]

    def _codebases(self) -> dict[str, dict]:
        return self._latest()[1]["codebases"]

    def _commit(self, change: int, state: dict, unused: list[str]) -> None:
        """Makes change the latest; unused: folders (with their kind) that it no longer names."""
        name = lambda i: f"{self.root}/_versions/{i:012d}.json"
        gone = [x for x in state["trash"] if x["change"] <= change - 2]
        state["trash"] = [x for x in state["trash"] if x["change"] > change - 2]
        if unused:
            state["trash"].append({"change": change, "dirs": sorted(unused)})
        if not self.fs.create(name(change), json.dumps(state, indent=1, sort_keys=True)):
            raise Conflict(f"change {change} of {self.root} was made by another writer")
        if change >= KEPT_VERSIONS:
            self.fs.remove(name(change - KEPT_VERSIONS))
        for folder in (d for x in gone for d in x["dirs"]):
            self.fs.remove(f"{self.root}/{folder}")

    @staticmethod
    def _named(x: dict) -> set[str]:
        """Folders that a codebase names."""
        out = {f"{kind}/{f['dir']}" for f in x["folders"] for kind in ("chunks", "stats")} | {f"deletes/{d['dir']}" for d in x["deletes"] if "dir" in d}
        return out | ({f"files/{x['files']['dir']}"} if x["files"] else set())

    # ------------------------------------------------------------ reading

    def tables(self) -> list[str]:
        return sorted(self._codebases())

    def names(self) -> list[str]:
        return sorted(x["name"] for x in self._codebases().values())

    def exists(self, name: str) -> bool:
        return table_of(name) in self._codebases()

    def info(self, name: str) -> dict[str, Any]:
        try:
            return self._codebases()[table_of(name)]
        except KeyError:
            raise NotFound(f"codebase {name!r} not found") from None

    def _live(self, kind: str, schema: T.StructType, chosen: dict[str, dict], only: tuple[str, str] | None = None) -> DataFrame:
        """Rows of the folders of some codebases without the deleted ones, with `cb`, their codebase's table. only: a column and its value; folders that can't hold it aren't read."""
        folders = {f["dir"]: (t, f) for t, x in chosen.items() for f in x["folders"] if not only or may_hold(f, *only)}
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("cb", F.lit(""))
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/{d}" for d in folders])
        read = self._called(read, chosen, folders)
        if only:
            read = read.filter(F.col(only[0]) == F.lit(only[1]))
        return self._without_deleted(read, chosen, folders).drop("v")

    def _called(self, df: DataFrame, chosen: dict[str, dict], folders: dict[str, tuple[str, dict]]) -> DataFrame:
        """The logical columns: where a codebase was renamed, those of the list in place of the stored ones."""
        was = lambda t, f: (chosen[t]["logical"] or {"change": -1})["change"] > f["change"]
        renamed = [(_version(d), t, *(chosen[t]["logical"][c] for c in LOGICAL)) for d, (t, f) in folders.items() if was(t, f)]
        if not renamed:
            return df
        names = [c for c in LOGICAL if c in df.columns]
        small = self.spark.createDataFrame(renamed, f"v string, _cb string, {', '.join(f'_new{c} string' for c in LOGICAL)}")  # a row for each folder of the renamed codebases
        out = df.join(F.broadcast(small), "v", "left")
        return out.withColumns({c: F.coalesce(f"_new{c}", c) for c in names} | {"cb": F.coalesce("_cb", "cb")}).drop("_cb", *[f"_new{c}" for c in LOGICAL])

    def _without_deleted(self, df: DataFrame, chosen: dict[str, dict], folders: dict[str, tuple[str, dict]]) -> DataFrame:
        many: dict[str, list[tuple[str, str]]] = {k: [] for k in KEYS}
        for t, x in chosen.items():
            for d in x["deletes"]:
                within = [f for f in _before(x["folders"], d["change"]) if f in folders]
                if "dir" in d:
                    many[d["column"]] += [(d["dir"], _version(f)) for f in within]
                    continue
                within = [_version(f) for f in within if may_hold(folders[f][1], d["column"], d["value"])]
                if within:
                    df = df.filter(~F.coalesce((F.col(d["column"]) == F.lit(d["value"])) & F.col("v").isin(within), F.lit(False)))
        for column, pairs in many.items():
            if pairs:
                values = self.spark.read.schema("value string").option("basePath", f"{self.root}/deletes").parquet(*[f"{self.root}/deletes/{d}" for d in sorted({d for d, _ in pairs})])
                of = self.spark.createDataFrame([(_version(d), v) for d, v in pairs], "d string, v string")
                gone = values.join(F.broadcast(of), "d").select("v", F.col("value").alias(column))
                df = df.join(gone, ["v", column], "left_anti")
        return df

    def chunks(self, name: str | None = None, only: tuple[str, str] | None = None) -> DataFrame:
        """Chunks of one codebase, or of all, with the table's name as column `cb`; none there: no rows. only: (column, value) of KEYS."""
        return self._live("chunks", CHUNKS, self._chosen(name), only)

    def partials(self, name: str | None = None) -> DataFrame:
        """Partial aggregates of the same chunks, which catalog's functions read in their place: a row for each file, language, kind and ingestion."""
        return self._live("stats", catalog.PARTIAL, self._chosen(name))

    def _chosen(self, name: str | None) -> dict[str, dict]:
        return {t: x for t, x in sorted(self._codebases().items()) if name is None or t == table_of(name)}

    def files(self, name: str) -> DataFrame:
        return self._files(self.info(name))

    def _files(self, x: dict) -> DataFrame:
        if not x["files"]:
            return self.spark.createDataFrame([], FILES)
        df = self.spark.read.schema(FILES).parquet(f"{self.root}/files/{x['files']['dir']}")
        later = [d for d in x["deletes"] if d["column"] == "filePath" and d["change"] > x["files"]["change"]]
        if one := [d["value"] for d in later if "value" in d]:
            df = df.filter(~F.col("filePath").isin(one))
        for d in later:
            if "dir" in d:
                df = df.join(self.spark.read.schema("value string").parquet(f"{self.root}/deletes/{d['dir']}").withColumnRenamed("value", "filePath"), "filePath", "left_anti")
        return df

    def count(self, name: str) -> int:
        """Chunks of a codebase; from the list alone where nothing is deleted."""
        x = self._chosen(name).get(table_of(name))
        if x is None:
            return 0
        return self._rows(x)

    @staticmethod
    def _rows(x: dict) -> int:
        return sum(f["rows"] for f in x["folders"]) - sum(d["rows"] for d in x["deletes"])

    # ------------------------------------------------------------ writing

    def _folder(self, table: str, prefix: str) -> str:
        return f"cb={table}/{prefix}={uuid.uuid4().hex[:12]}"  # of two writers, each has a folder of its own

    def _add(self, table: str, chunks: DataFrame, change: int) -> dict:
        """Writes chunks and their partial aggregates; rows and ranges are observed by the job that writes."""
        folder, seen = self._folder(table, "v"), Observation()
        least = [f(c).alias(f"{f.__name__}_{c}") for c in KEYS for f in (F.min, F.max)]
        _fitted(chunks, CHUNKS).observe(seen, F.count(F.lit(1)).alias("rows"), *least).write.parquet(f"{self.root}/chunks/{folder}")
        written = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/chunks/{folder}")
        catalog.partial(written).write.parquet(f"{self.root}/stats/{folder}")
        x = seen.get
        return {"dir": folder, "change": change, "rows": x["rows"], "ranges": {c: [x[f"min_{c}"], x[f"max_{c}"]] for c in KEYS}}

    def _list(self, table: str, files: DataFrame, change: int) -> dict:
        folder = self._folder(table, "f")
        files.select(*FILES.names).write.parquet(f"{self.root}/files/{folder}")
        return {"dir": folder, "change": change}

    def _begin(self, name: str) -> tuple[int, dict, str, dict | None]:
        (last, state), table = self._latest(), table_of(name)
        old = state["codebases"].get(table)
        if old and old["name"] != name:
            raise ValueError(f"{name!r} and {old['name']!r} share the table {table}")
        return last + 1, state, table, old

    def _finish(self, change: int, state: dict, table: str, old: dict | None, new: dict) -> None:
        new = self._compacted(table, new, change)
        state["codebases"][table] = new
        self._commit(change, state, sorted(self._named(old) - self._named(new)) if old else [])

    def _compacted(self, table: str, x: dict, change: int) -> dict:
        stored = sum(f["rows"] for f in x["folders"])
        if len(x["folders"]) <= FOLDERS and len(x["deletes"]) <= DELETES and 2 * self._rows(x) >= stored:
            return x
        live = self._live("chunks", CHUNKS, {table: x}).drop("cb")
        files = self._list(table, self._files(x), change) if x["files"] and any(d["column"] == "filePath" for d in x["deletes"]) else x["files"]
        return x | {"folders": [self._add(table, live, change)], "deletes": [], "files": files, "logical": None}

    def replace(self, name: str, chunks: DataFrame, files: DataFrame | None = None, path: str | None = None) -> None:
        """The next version of a codebase; it may read the present one."""
        change, state, table, old = self._begin(name)
        listed = self._list(table, files, change) if files is not None else (self._list(table, self.files(name), change) if old and old["files"] else None)
        new = {"name": name, "version": old["version"] + 1 if old else 0, "folders": [self._add(table, chunks, change)], "deletes": [], "files": listed, "logical": None, "path": path if path is not None else (old or {}).get("path", "")}
        self._finish(change, state, table, old, new)

    def replace_all(self, chunks: DataFrame) -> None:
        """The next version of each codebase that _codebaseName names, written by one job; their names and counts go through the driver, as the list holds them."""
        (change, state), tag = self._latest(), uuid.uuid4().hex[:12]
        change += 1
        rows = _fitted(chunks, CHUNKS).filter(F.col("_codebaseName").isNotNull())
        at = f"{self.root}/chunks/_{tag}"
        rows.withColumn("_of", F.col("_codebaseName")).write.partitionBy("_of").parquet(at)
        written = self.spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in CHUNKS)}, _of string").parquet(at)
        catalog.partial(written).withColumn("_of", F.col("_codebaseName")).write.partitionBy("_of").parquet(f"{self.root}/stats/_{tag}")
        ranges = [f(c).alias(f"{f.__name__}_{c}") for c in KEYS for f in (F.min, F.max)]
        found = self.spark.read.schema(catalog.PARTIAL).parquet(f"{self.root}/stats/_{tag}").groupBy("_codebaseName").agg(F.sum("chunks").alias("rows"), *ranges).collect()
        unused: set[str] = set()
        for r in found:
            table, part = table_of(r["_codebaseName"]), f"_of={self.fs.escaped(r['_codebaseName'])}"
            old, folder = state["codebases"].get(table), self._folder(table, "v")
            if old and old["name"] != r["_codebaseName"]:
                raise ValueError(f"{r['_codebaseName']!r} and {old['name']!r} share the table {table}")
            for kind in ("chunks", "stats"):
                self.fs.move(f"{self.root}/{kind}/_{tag}/{part}", f"{self.root}/{kind}/{folder}")
            entry = {"dir": folder, "change": change, "rows": r["rows"], "ranges": {c: [r[f"min_{c}"], r[f"max_{c}"]] for c in KEYS}}
            unused |= self._named(old) if old else set()
            state["codebases"][table] = {"name": r["_codebaseName"], "version": old["version"] + 1 if old else 0, "folders": [entry], "deletes": [], "files": None, "logical": None, "path": (old or {}).get("path", "")}
        for kind in ("chunks", "stats"):
            self.fs.remove(f"{self.root}/{kind}/_{tag}")
        self._commit(change, state, sorted(unused))

    def append(self, name: str, chunks: DataFrame) -> None:
        """Appends to a codebase, or creates it."""
        if not self.exists(name):
            return self.replace(name, chunks)
        self.update(name, chunks=chunks)

    def update(self, name: str, gone: DataFrame | None = None, chunks: DataFrame | None = None, files: DataFrame | None = None, path: str | None = None) -> tuple[int, int]:
        """One change: deletes the files of gone (one column filePath), adds chunks, replaces the file manifest; numbers of chunks deleted and added."""
        change, state, table, old = self._begin(name)
        if old is None:
            raise NotFound(f"codebase {name!r} not found")
        new = old | {"version": old["version"] + 1, "folders": list(old["folders"]), "deletes": list(old["deletes"])}
        deleted = added = 0
        if gone is not None:
            folder = self._folder(table, "d")
            gone.select(F.col("filePath").alias("value")).filter(F.col("value").isNotNull()).distinct().write.parquet(f"{self.root}/deletes/{folder}")
            written = self.spark.read.schema("value string").parquet(f"{self.root}/deletes/{folder}").withColumnRenamed("value", "filePath")
            deleted = self.partials(name).join(written, "filePath", "left_semi").agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
            new["deletes"].append({"column": "filePath", "dir": folder, "change": change, "rows": deleted})
        if files is not None:
            new["files"] = self._list(table, files, change)
        if chunks is not None:
            new["folders"].append(self._add(table, chunks, change))
            added = new["folders"][-1]["rows"]
        if path is not None:
            new["path"] = path
        self._finish(change, state, table, old, new)
        return deleted, added

    def _delete_one(self, name: str, column: str, value: str) -> int:
        self.info(name)
        n = self._live("stats", catalog.PARTIAL, self._chosen(name), (column, value)).agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
        listed = column == "filePath" and not self.files(name).filter(F.col("filePath") == F.lit(value)).isEmpty()
        if n or listed:
            change, state, table, old = self._begin(name)
            self._finish(change, state, table, old, old | {"version": old["version"] + 1, "deletes": [*old["deletes"], {"column": column, "value": value, "change": change, "rows": n}]})
        return n

    def delete_file(self, name: str, path: str) -> int:
        """Number of chunks deleted. Paths are relative and have no '..'. Writes a row of the list, no chunks."""
        if not path or ".." in path or path.startswith("/"):
            raise ValueError(f"not a relative file path: {path!r}")
        return self._delete_one(name, "filePath", path)

    def delete_files(self, name: str, paths: DataFrame) -> int:
        """paths: one column filePath. Writes the paths, no chunks; number of chunks deleted."""
        return self.update(name, gone=paths)[0]

    def delete_chunk_set(self, name: str, timestamp: str) -> int:
        return self._delete_one(name, "ingestionTimestamp", timestamp)

    def drop(self, name: str) -> None:
        """The codebase is gone at once; its folders go two changes later."""
        self.info(name)
        change, state = self._latest()
        old = state["codebases"].pop(table_of(name))
        self._commit(change + 1, state, sorted(self._named(old)))

    def rename(self, old: str, new: str) -> int:
        """Number of chunks; one change of the list, no chunk is written. A codebase without chunks is dropped and not created anew."""
        x = self.info(old)
        if self.exists(new):
            raise ValueError(f"codebase {new!r} exists")
        n = self._rows(x)
        if not n:
            self.drop(old)
            return 0
        change, state = self._latest()
        x = state["codebases"].pop(table_of(old))
        state["codebases"][table_of(new)] = x | {"name": new, "version": x["version"] + 1, "logical": {"change": change + 1, **dict(zip(LOGICAL, (new, old, now_iso()), strict=True))}}
        self._commit(change + 1, state, [])
        return n

