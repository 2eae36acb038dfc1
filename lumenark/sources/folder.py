"""Folders of media as a Spark data source, to be read once or as a stream.

    folder.read(spark, "/Volumes/T7 SSD1").filter("extension = '.arw'")
    folder.register(spark)
    spark.readStream.format("media_folder").option("content", True).load("s3://bucket/dump")

Planning lists folders from the top down until there are enough to share out, no further; tasks walk what lies below. The files of
a folder that planning has seen are dealt to several tasks if there are many. Filters on path, name, extension, size and time
are applied while walking: by name before a file is looked at, by size and time before it is read; a prefix of
the path leaves out folders. That takes spark.sql.python.filterPushdown.enabled in the session and the option pushed, which
read() sets where the session allows it; without them Spark filters what the walk gives.

Options: content (read files for their sha256; null for one that cannot be read), extensions (comma-separated, `*` for
all; else those of the rules), slices (partitions to aim at, 64), pushed, settle (streams: seconds that a change must be old, 0).
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from lumenark.functions import rules as R

NAME = "media_folder"
SCHEMA = "full_path string, file_name string, extension string, file_size long, modified_time string, sha256 string"
COLUMNS = SCHEMA.replace(" string", "").replace(" long", "").split(", ")
INGEST_EXTENSIONS = (*R.BUCKETS["photos"], *R.BUCKETS["raw"], *R.BUCKETS["videos"], *R.BUCKETS["sidecar"])
#: Files of one folder that go to one task, where planning has seen them.
FILES_A_SLICE = 2_000
#: Partitions are at most so many times those aimed at.
ROUNDS = 4
BATCH = 1_024

#: What a file must be, by filter: (file's value, filter's value).
TESTS = {
    D.EqualTo: lambda a, b: a == b, D.EqualNullSafe: lambda a, b: a == b, D.In: lambda a, b: a in b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b,
    D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a,
}
BY_NAME = ("full_path", "file_name", "extension")


def extension_of(name: str) -> str:
    """In lower case; a name that begins with its only dot, or ends with one, has none."""
    stem, dot, ext = name.rpartition(".")
    return f".{ext.lower()}" if stem and dot and ext else ""


@dataclass
class Test:
    column: str
    kind: type
    value: object
    negated: bool = False

    def holds(self, row: dict) -> bool:
        return TESTS[self.kind](row[self.column], self.value) != self.negated


@dataclass
class Part:
    """A folder: with all below it, or its own files only, and of these the k-th of m shares."""

    folder: str
    deep: bool
    k: int = 0
    m: int = 1
    whole: bool = False  # streams: whatever lies below counts as changed


class Share(D.InputPartition):
    def __init__(self, parts: list[Part], after: int = 0, until: int | None = None):
        self.parts, self.after, self.until = parts, after, until


class Tree:
    """A folder on any file system that pyarrow knows; a plain path is local."""

    def __init__(self, folder: str):
        from pyarrow import fs

        folder = folder.rstrip("/") or "/"
        self.fs, self.root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))
        self.outer = folder[: len(folder) - len(self.root)] if folder.endswith(self.root) and not folder.startswith("file:") else ""
        self.local = self.fs.type_name == "local"

    def list(self, folder: str) -> tuple[list, list]:
        """(folders, files) in a folder; one that has gone meanwhile, or may not be read, is empty. Links to folders are not followed."""
        from pyarrow import fs

        try:
            found = self.fs.get_file_info(fs.FileSelector(folder))
        except (FileNotFoundError, PermissionError):
            return [], []
        folders = [x for x in found if x.type == fs.FileType.Directory and not (self.local and os.path.islink(x.path))]
        return folders, [x for x in found if x.type == fs.FileType.File]

    def changed(self, path: str, modified: int) -> int:
        """When a file or folder became what and where it is, in nanoseconds; on local disks a move or a copy that keeps the time of modification counts, too."""
        try:
            return max(modified, os.stat(path).st_ctime_ns) if self.local else modified
        except OSError:
            return modified

    def sha256(self, path: str) -> str | None:
        import hashlib

        sha = hashlib.sha256()
        try:
            with self.fs.open_input_stream(path) as file:
                while some := file.read(1 << 20):
                    sha.update(some)
        except OSError:
            return None
        return sha.hexdigest()


class Walker:
    """What readers have in common: options, filters, planning and walking."""

    def __init__(self, options: dict):
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("media_folder: load() takes the folder")
        told = options.get("extensions")
        self.extensions = None if told == "*" else frozenset(f".{e.strip().lstrip('.').lower()}" for e in told.split(",")) if told else frozenset(INGEST_EXTENSIONS)
        self.content = str(options.get("content", "false")).lower() == "true"
        self.slices, self.settle = int(options.get("slices", 64)), float(options.get("settle", 0))
        self.tests: list[Test] = []

    def leads_on(self, outer_path: str) -> bool:
        """Whether files below a folder can pass the filters on paths."""
        inside = f"{outer_path.rstrip('/')}/"
        for t in self.tests:
            if t.column == "full_path" and not t.negated and t.kind in (D.StringStartsWith, D.EqualTo, D.EqualNullSafe):
                wanted = str(t.value)
                if not (inside.startswith(wanted) and t.kind is D.StringStartsWith or wanted.startswith(inside)):
                    return False
        return True

    def plan(self, after: int = 0, until: int | None = None) -> list[Share]:
        tree = Tree(self.folder)
        level, parts = ([Part(tree.root, True)] if self.leads_on(tree.outer + tree.root) else []), []
        with ThreadPoolExecutor(16) as pool:
            while level and len(level) + len(parts) < self.slices:
                below = []
                for part, (folders, files) in zip(level, pool.map(lambda p: tree.list(p.folder), level)):
                    m = -(-len(files) // FILES_A_SLICE)
                    parts += [Part(part.folder, False, k, m, part.whole) for k in range(m)]
                    below += self.enter(tree, part, folders, after, until)
                level = below
        parts += level
        n = max(1, min(len(parts), ROUNDS * self.slices))
        return [Share(parts[k::n], after, until) for k in range(n)]

    def enter(self, tree: Tree, part: Part, folders: list, after: int, until: int | None) -> list[Part]:
        """The folders to go on with. One that changed since `after`, as did the folder it is in, may have been moved there: then all below it counts, whatever its own time."""
        out = []
        for x in folders:
            if self.leads_on(tree.outer + x.path):
                whole = part.whole
                if until is not None and not whole and tree.local:
                    around = tree.fs.get_file_info(part.folder).mtime_ns or 0
                    whole = after < around and after < tree.changed(x.path, x.mtime_ns)
                out.append(Part(x.path, True, whole=whole))
        return out

    def rows(self, share: Share) -> Iterator[tuple]:
        tree = Tree(self.folder)
        by_name, by_stat = [t for t in self.tests if t.column in BY_NAME], [t for t in self.tests if t.column not in BY_NAME]
        todo = list(share.parts)
        while todo:
            part = todo.pop()
            folders, files = tree.list(part.folder)
            if part.deep:
                todo += self.enter(tree, part, folders, share.after, share.until)
            for x in files:
                row = {"full_path": tree.outer + x.path, "file_name": x.base_name, "extension": extension_of(x.base_name)}
                if self.extensions is not None and row["extension"] not in self.extensions or part.m > 1 and zlib.crc32(x.base_name.encode()) % part.m != part.k or not all(t.holds(row) for t in by_name):
                    continue
                row |= {"file_size": x.size, "modified_time": x.mtime.strftime("%Y-%m-%dT%H:%M:%S")}
                if not all(t.holds(row) for t in by_stat):
                    continue
                if share.until is not None:
                    changed = tree.changed(x.path, x.mtime_ns)
                    if not (share.after < changed or part.whole) or changed > share.until:
                        continue
                yield (*row.values(), tree.sha256(x.path) if self.content else None)

    def batches(self, share: Share):
        import pyarrow as pa

        schema = pa.schema([(c, pa.int64() if c == "file_size" else pa.string()) for c in COLUMNS])
        held = []
        for row in self.rows(share):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class Reader(Walker, D.DataSourceReader):
    def partitions(self) -> list[Share]:
        return self.plan()

    def read(self, partition: Share):
        yield from self.batches(partition)


class FilteringReader(Reader):
    """Spark takes a reader that asks for filters only where the session allows it."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            inner, negated = (f.child, True) if isinstance(f, D.Not) else (f, False)
            if isinstance(inner, D.IsNotNull) and not negated and inner.attribute[0] in COLUMNS[:-1]:
                continue  # they never are
            if type(inner) in TESTS and inner.attribute[0] in COLUMNS[:-1] and inner.value is not None and not (isinstance(inner, D.In) and None in inner.value):
                self.tests.append(Test(inner.attribute[0], type(inner), inner.value, negated))
            else:
                yield f


class StreamReader(Walker, D.DataSourceStreamReader):
    """Files by the time of their last change. An offset is a moment; a batch holds what changed after one and until the next,
    which one walk finds again after a failure, unless it has changed since and belongs to a later batch. Each trigger is one walk, so
    give the query an interval. A file comes again if its folder may have been moved; merge by path. What is removed is not told.
    """

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.plan(start["until"], end["until"]) if start["until"] < end["until"] else []

    def read(self, partition: Share):
        yield from self.batches(partition)


class FolderSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return (FilteringReader if str(self.options.get("pushed", "false")).lower() == "true" else Reader)(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FolderSource)


def read(spark: SparkSession, folder: str, **options: str | bool | int) -> DataFrame:
    """What lies below a folder now (SCHEMA)."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).options(**{"pushed": pushed, **options}).load(folder)
