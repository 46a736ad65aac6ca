"""Directory trees as a Spark source.

A listing is a table (relativePath, size) of the regular files of a tree. Its walk expands a
frontier of folders: the driver reads the first ones, at most DRIVER_FOLDERS, and where that doesn't end
it, executors take the frontier in rounds; a task follows the folders it was given for
TASK_ENTRIES names and hands back those it has not come to, so that a large subtree is
dealt out again. Each round is written, and no list of paths is on the driver. Nothing is
opened for a listing: sizes, extensions, ignore rules and statistics need names only.

Contents are read for the rows that a listing still has after its filters, by tasks of
FILES_PER_PARTITION files. spark.read.format("codetree") offers the same as a data source that takes
filters of path and size before it opens anything. Paths are those of a local or shared file system or, with a scheme
(hdfs, s3, gs), of any that pyarrow.fs knows. Names that begin with `.` are hidden; unlike Spark's own listing,
those that begin with `_` are not.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from corvella.functions import paths, text
from corvella.schema import SCANNED
from corvella.sources.gitignore import Ignore
from corvella.sources.scratch import Staging

FILES_PER_PARTITION = 256
#: Of files that are read already; the bounds of ranges are held by the driver.
FILES_PER_RANGE = 1024
#: Folders that the driver reads itself, and names that a task reads before it hands the rest back.
DRIVER_FOLDERS = 256
TASK_ENTRIES = 20_000
MOST = 1048576
LISTING = "relativePath string, size long"


# ---------------------------------------------------------------- file systems


class Local:
    """Folders and files by the operating system; links are left out."""

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int | None]]:
        """(name, is a folder, size) of what is in a folder, by name; size None: neither a folder nor a regular file."""
        with os.scandir(folder) as found:
            for e in sorted(found, key=lambda e: e.name):
                plain = e.is_file(follow_symlinks=False)
                yield e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False).st_size if plain else None

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()


class Remote:
    """The same by pyarrow.fs, for paths with a scheme; opened where it is used."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.uri = uri.rstrip("/")

    def _at(self, path: str) -> str:
        return self.root.rstrip("/") + path.removeprefix(self.uri)

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int | None]]:
        from pyarrow import fs

        for e in sorted(self.fs.get_file_info(fs.FileSelector(self._at(folder))), key=lambda e: e.base_name):
            yield e.base_name, e.type == fs.FileType.Directory, e.size if e.type == fs.FileType.File else None

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(self._at(path)) as f:
            return f.read()


def file_system(root: str) -> Local | Remote:
    return Remote(root) if "://" in root and not root.startswith("file://") else Local()


def _plain(root: str) -> str:
    return (root.removeprefix("file://") if root.startswith("file://") else root).rstrip("/") or "/"


def rules_of(root: str) -> Ignore | None:
    """Rules of the .gitignore of a tree's root."""
    try:
        return Ignore(file_system(root).read(f"{_plain(root)}/.gitignore").decode("utf-8"))
    except (OSError, UnicodeDecodeError):
        return None


# ---------------------------------------------------------------- the walk


class Walker:
    """Reads folders; which names it leaves out is counted in skippedHidden (folders) and skippedByGitignore (files and folders)."""

    def __init__(self, root: str, respect_gitignore: bool = True, skip_hidden: bool = True):
        self.root, self.hidden = _plain(root), skip_hidden
        self.rules = rules_of(root) if respect_gitignore else None
        self.counts = {"skippedHidden": 0, "skippedByGitignore": 0}

    def below(self, folder: str, fs: Local | Remote) -> tuple[list[str], list[tuple[str, int]]]:
        """Relative paths of the folders, and of the files with their sizes, in a folder; an unreadable one has none."""
        folders, files = [], []
        try:
            entries = list(fs.entries(f"{self.root}/{folder}" if folder else self.root))
        except OSError:
            return [], []
        for name, is_folder, size in entries:
            relative = f"{folder}/{name}" if folder else name
            if self.hidden and name.startswith("."):
                self.counts["skippedHidden"] += is_folder
            elif self.rules and self.rules.ignored(relative, is_folder):
                self.counts["skippedByGitignore"] += 1
            elif is_folder:
                folders.append(relative)
            elif size is not None:
                files.append((relative, size))
        return folders, files

    def walk(self, todo: list[str], most_folders: int | None = None, most_entries: int | None = None) -> Iterator[tuple[str, int]]:
        """Files below the folders of todo, which keeps those that a bound leaves unread."""
        fs = file_system(self.root)
        read = seen = 0
        while todo and (most_folders is None or read < most_folders) and (most_entries is None or seen < most_entries):
            folders, files = self.below(todo.pop(), fs)
            todo += reversed(folders)
            read, seen = read + 1, seen + len(folders) + len(files)
            yield from files


def walk(root: str, respect_gitignore: bool = True, skip_hidden: bool = True, counts: dict | None = None) -> Iterator[tuple[str, str, int]]:
    """(path, relative path, size) of a tree's files, in one process."""
    w = Walker(root, respect_gitignore, skip_hidden)
    for relative, size in w.walk([""]):
        yield f"{w.root}/{relative}", relative, size
    if counts is not None:
        counts.update(w.counts)


#: kind: file, folder (still to be read), or the name of a count, whose number is in size.
_ROUND = "kind string, relativePath string, size long"


def _expand(walker: Walker, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "relativePath", "size"]
        rows = lambda kind, some: pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.string()), pa.array([x for x, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=names)
        todo = [x for batch in batches for x in batch.column(0).to_pylist()]
        held = []
        for x in walker.walk(todo, most_entries=entries):
            held.append(x)
            if len(held) == 4096:
                yield rows("file", held)
                held = []
        yield rows("file", held)
        yield rows("folder", [(x, 0) for x in todo])
        for kind, n in walker.counts.items():
            yield rows(kind, [(None, n)])

    return run


class Listing:
    """files: the table (relativePath, size); counts: what was left out."""

    def __init__(self, files: DataFrame, counts: dict[str, int], n: int):
        self.files, self.counts, self.n = files, counts, n


def listing(spark: SparkSession, root: str, respect_gitignore: bool = True, skip_hidden: bool = True, stage: Staging | None = None, driver_folders: int = DRIVER_FOLDERS, task_entries: int = TASK_ENTRIES) -> Listing:
    """The files of a tree, without opening any."""
    w, todo = Walker(root, respect_gitignore, skip_hidden), [""]
    found = list(w.walk(todo, most_folders=driver_folders))
    counts, n = dict(w.counts), len(found)
    parts = [spark.createDataFrame(found, LISTING)]
    frontier = spark.createDataFrame([(x,) for x in todo], "relativePath string") if todo else None
    stage, size = stage or Staging(spark), len(todo)
    while frontier is not None:
        w.counts = dict.fromkeys(w.counts, 0)
        done = stage(frontier.repartition(max(1, min(size, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(_expand(w, task_entries), _ROUND))
        seen = {r["kind"]: r for r in done.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("total")).collect()}
        counts = {k: v + (seen[k]["total"] if k in seen else 0) for k, v in counts.items()}
        if "file" in seen:
            n += seen["file"]["n"]
            parts.append(done.filter("kind = 'file'").select("relativePath", "size"))
        size = seen["folder"]["n"] if "folder" in seen else 0
        frontier = done.filter("kind = 'folder'").select("relativePath") if size else None
    files = parts[0]
    for x in parts[1:]:
        files = files.unionAll(x)
    return Listing(files, counts, n)


# ---------------------------------------------------------------- what the rows are, and their contents


def fits(size: Column, most: int) -> Column:
    """Files of this size are read."""
    return size <= most


def described(files: DataFrame) -> DataFrame:
    """A listing with extension, language, supported and flags; from paths alone."""
    p = F.col("relativePath")
    return files.select("*", paths.extension(p).alias("extension"), paths.language(p).alias("language"), paths.is_supported(p).alias("supported"), paths.is_test(p).alias("isTestFile"), paths.is_library(p).alias("isLibraryFile"))


def visible(files: DataFrame, rules: Ignore | None = None, skip_hidden: bool = True) -> DataFrame:
    """Rows of a table of paths that a walk would find: no part of the path is hidden or ignored. For trees that are tables."""
    p = F.col("relativePath")
    if skip_hidden:
        files = files.filter(~p.rlike(r"(^|/)\."))
    return files.filter(~rules.matches(p)) if rules else files


def _read(root: str, keep: bool, at: int, seen=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = file_system(root)
        for batch in batches:
            for i, relative in enumerate(batch.column(at).to_pylist()):
                try:
                    content = fs.read(f"{_plain(root)}/{relative}")
                except OSError:
                    content = None
                digest = hashlib.md5(content).hexdigest() if content is not None else None
                row = batch.slice(i, 1)
                own = [pa.array([content], pa.binary())] if keep else []
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([digest], pa.string()), *own], names=[*row.schema.names, "fileHash", *(["content"] if keep else [])])
            if seen is not None:
                seen.add(batch.num_rows)

    return run


def dealt(files: DataFrame, n: int) -> DataFrame:
    """About n rows in partitions of FILES_PER_PARTITION. A number of its own: rows are small, or what they cost is not their size."""
    return files.repartition(max(1, -(-n // FILES_PER_PARTITION)))


def in_order(files: DataFrame, n: int | None = None) -> DataFrame:
    """About n rows in ranges of paths, sorted: partitions and rows follow the order of paths. n: left out, Spark takes its own number."""
    parts = () if n is None else (max(1, -(-n // FILES_PER_RANGE)),)
    return files.repartitionByRange(*parts, "relativePath").sortWithinPartitions("relativePath")


def contents(files: DataFrame, root: str, n: int, keep: bool = True, seen=None) -> DataFrame:
    """Rows of a listing (about n of them) with fileHash and, unless keep is false, content; each file is opened once. Null where a file can't be read. seen: an
    accumulator of the files read."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "fileHash string", *(["content binary"] if keep else [])])
    return dealt(files, n).mapInArrow(_read(root, keep, files.columns.index("relativePath"), seen), schema)


def scan(spark: SparkSession, root: str, respect_gitignore: bool = True, skip_hidden: bool = True, max_file_size: int = MOST) -> DataFrame:
    """Files of a tree with extension, language, supported, flags, content and md5."""
    found = listing(spark, root, respect_gitignore, skip_hidden)
    p = F.concat(F.lit(f"{_plain(root)}/"), "relativePath")
    return contents(described(found.files.filter(fits(F.col("size"), max_file_size))), root, found.n).withColumn("path", p)


def scan_counts(root: str, respect_gitignore: bool = True, skip_hidden: bool = True) -> dict:
    counts: dict = {}
    for _ in walk(root, respect_gitignore, skip_hidden, counts):
        pass
    return counts


# ---------------------------------------------------------------- the data source


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


class CodeTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda name: str(options.get(name, "true")).lower() == "true"
        self.root, self.gitignore, self.hidden, self.open = options["path"], flag("respectGitignore"), flag("skipHidden"), flag("content")
        self.most = int(options.get("maxFileSize", MOST))
        self.tests: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Those of path, relativePath and size are taken: rows they rule out are never opened."""
        columns = {("path",): 0, ("relativePath",): 1, ("size",): 2}
        for f in filters:
            if type(f) in _TESTS and tuple(f.attribute) in columns and f.value is not None:
                self.tests.append((columns[tuple(f.attribute)], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = [f for f in walk(self.root, self.gitignore, self.hidden) if f[2] <= self.most and all(_TESTS[kind](f[i], v) for i, kind, v in self.tests)]
        return [_Files(files[i : i + FILES_PER_PARTITION]) for i in range(0, len(files), FILES_PER_PARTITION)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs = file_system(self.root)
        for path, relative, size in partition.files:
            try:
                yield path, relative, size, fs.read(path) if self.open else None
            except OSError:
                yield path, relative, size, None


class CodeTree(DataSource):
    """Options: respectGitignore, skipHidden, maxFileSize, and content (false: no file is opened)."""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self):
        return SCANNED

    def reader(self, schema) -> CodeTreeReader:
        return CodeTreeReader(self.options)


def source(spark: SparkSession) -> None:
    """Registers the format "codetree" and lets it take filters."""
    spark.dataSource.register(CodeTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def folders(path: str) -> dict:
    """Folders directly below a folder, by name without regard to case; hidden ones and links are left out. The parent of the root is null."""
    path = os.path.abspath(path)
    names = sorted((e.name for e in os.scandir(path) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")), key=lambda n: (n.casefold(), n.swapcase()))
    up = os.path.dirname(path)
    return {"currentPath": path, "parentPath": up if up != path else None, "directories": [{"name": n, "path": os.path.join(path, n)} for n in names]}
