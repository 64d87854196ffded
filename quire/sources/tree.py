"""File trees as a data source: ``spark.read.format("file_tree")``.

Filters on ``repo_id``, ``path`` and ``size`` reach the listing: folders that cannot hold a wanted path
are not entered, and files that are not wanted are not opened.

Options: ``root`` (a URI) and ``repo_id`` (its name, by default empty), or ``roots``, a JSON object of names
and URIs; ``contents`` (``false``: listing only; ``digest``: files are read whole, in chunks, and ``sha256`` stands for
their contents, so a file of any size takes little memory), ``partitions`` (folders listed while planning, 64).

Planning lists folders breadth-first until there are ``partitions`` of them left to enter. Each of those is
walked by a task of its own; the files of a folder that was listed are split by their bytes and a hash of their
names, so a large flat folder is read by many tasks. Skipped directories and binary extensions are those of
``scan_files``. The tasks build their rows in Arrow batches of a bounded size.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as DS
from pyspark.sql.types import StructType

from quire import constants as C
from quire.sources.files import digested

SCHEMA = "repo_id string, path string, size bigint, mtime timestamp"
TASK_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 32 * 1024 * 1024
BATCH_ROWS = 10_000
SUFFIX = C.EXT_RE.replace(r"\z", r"\Z")  # the end of a text, as Python writes it
COMPARED: dict[type, Callable] = {
    DS.EqualTo: lambda a, b: a == b,
    DS.GreaterThan: lambda a, b: a > b,
    DS.GreaterThanOrEqual: lambda a, b: a >= b,
    DS.LessThan: lambda a, b: a < b,
    DS.LessThanOrEqual: lambda a, b: a <= b,
    DS.In: lambda a, b: a in b,
    DS.StringStartsWith: lambda a, b: a.startswith(b),
    DS.StringEndsWith: lambda a, b: a.endswith(b),
    DS.StringContains: lambda a, b: b in a,
}
TYPES = {"repo_id": str, "path": str, "size": int}


@dataclass(frozen=True)
class Wanted:
    """What the query asks for: every test ``(column, kind, value)`` has to hold."""

    tests: tuple[tuple[str, type, object], ...] = ()

    def keeps(self, **values: object) -> bool:
        return all(COMPARED[kind](values[name], value) for name, kind, value in self.tests if name in values)

    def enters(self, folder: str) -> bool:
        """Whether a path below ``folder`` can pass: a test of equality or of the start names its folders."""
        below = f"{folder}/"
        for name, kind, value in self.tests:
            if name != "path":
                continue
            if kind is DS.EqualTo and not value.startswith(below):
                return False
            if kind is DS.In and not any(v.startswith(below) for v in value):
                return False
            if kind is DS.StringStartsWith and not (below.startswith(value) or value.startswith(below)):
                return False
        return True


@dataclass
class Part(DS.InputPartition):
    """A folder; ``deep``: with all below it. ``share`` of ``shares``: the files whose name hash falls there."""

    repo_id: str
    root: str
    folder: str
    deep: bool
    share: int = 0
    shares: int = 1


def skipped(name: str) -> bool:
    hidden = name.startswith(".") and name not in C.ALLOWED_HIDDEN
    return hidden or name in C.SKIPPED_DIRS


def listed(root: str, folder: str) -> tuple[list, list[str]]:
    """Files (Arrow's records, paths below the root) and folders to enter, both in name order."""
    import pyarrow.fs as pafs

    system, base = pafs.FileSystem.from_uri(root)
    try:
        infos = system.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base))
    except OSError:
        return [], []  # unreadable directories are skipped
    files, folders = [], []
    for info in sorted(infos, key=lambda i: i.path):
        path = info.path[len(base) :].lstrip("/")
        if info.type == pafs.FileType.Directory:
            if not skipped(info.base_name):
                folders.append(path)
        elif info.type == pafs.FileType.File:
            files.append((path, info))
    return files, folders


class TreeReader(DS.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.roots = json.loads(options["roots"]) if "roots" in options else {options.get("repo_id", ""): options["root"]}
        self.target = int(options.get("partitions", 64))
        self.contents = "content" in schema.fieldNames()
        self.digests = "sha256" in schema.fieldNames()
        self.wanted = Wanted()

    def pushFilters(self, filters: list[DS.Filter]) -> Iterator[DS.Filter]:
        tests = []
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = f.value if isinstance(f, DS.In) else (getattr(f, "value", None),)
            if type(f) in COMPARED and name in TYPES and all(isinstance(v, TYPES[name]) for v in values):
                tests.append((name, type(f), f.value))
            elif not (isinstance(f, DS.IsNotNull) and name in TYPES):  # these columns are never null
                yield f
        self.wanted = Wanted(tuple(tests))

    def _files(self, part: Part) -> tuple[list, list[str]]:
        files, folders = listed(part.root, part.folder)
        kept = []
        for path, info in files:
            suffix = re.search(SUFFIX, path)
            binary = suffix is not None and suffix[1].lower() in C.BINARY_EXTENSIONS
            if not binary and self.wanted.keeps(path=path, size=info.size or 0):
                if zlib.crc32(path.encode()) % part.shares == part.share:
                    kept.append((path, info))
        return kept, [f for f in folders if self.wanted.enters(f)]

    def partitions(self) -> list[Part]:
        todo = deque(Part(repo, root, "", True) for repo, root in self.roots.items() if self.wanted.keeps(repo_id=repo))
        made: list[Part] = []
        while todo and len(todo) < self.target:
            part = todo.popleft()
            files, folders = self._files(part)
            todo.extend(Part(part.repo_id, part.root, f, True) for f in folders)
            size = sum(info.size or 0 for _, info in files) if self.contents or self.digests else 0
            shares = 1 + size // TASK_BYTES
            if files:
                made += [Part(part.repo_id, part.root, part.folder, False, i, shares) for i in range(shares)]
        return (made + list(todo)) or [Part("", "", "", False)]

    def _walk(self, part: Part) -> Iterator[tuple]:
        todo = [part] if part.root else []
        while todo:
            own = todo.pop()
            files, folders = self._files(own)
            yield from files
            if own.deep:
                todo += [Part(own.repo_id, own.root, f, True) for f in reversed(folders)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        types = [("repo_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))]
        schema = pa.schema(types + ([("content", pa.binary())] if self.contents else []) + ([("sha256", pa.string())] if self.digests else []))
        system, base = pafs.FileSystem.from_uri(partition.root) if partition.root else (None, "")
        rows, held = [], 0
        for path, info in self._walk(partition):
            row = [partition.repo_id, path, info.size or 0, info.mtime]
            # A large file does not wait beside others.
            if rows and self.contents and held + row[2] > BATCH_BYTES:
                yield batch(rows, schema)
                rows, held = [], 0
            if self.contents or self.digests:
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        row.append(stream.read() if self.contents else digested(stream, 0)[2])
                except OSError:
                    continue  # unreadable files are skipped
                held += len(row[-1])
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield batch(rows, schema)


def batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class TreeSource(DS.DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        more = {"false": "", "digest": ", sha256 string"}
        return SCHEMA + more.get(self.options.get("contents", "true").lower(), ", content binary")

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let its filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
