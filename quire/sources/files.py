"""Files of a file system, listed and read by the executors.

The built-in binary file source leaves out names that start with ``_`` or ``.``,
so the listing is done with Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import paths as P
from quire.session import written

ENTRY = "repo_id string, root string, path string, size bigint, mtime timestamp, is_dir boolean"
RAW = "repo_id string, path string, size bigint, mtime timestamp, content binary"
BATCH_BYTES = 32 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024
CHUNK_BYTES = 4 * 1024 * 1024


def digested(stream, held_bytes: int) -> tuple[int, bytes, str]:
    """Size, first bytes and SHA-256 of an open file; a chunk of it is in memory at a time."""
    digest, size, front = hashlib.sha256(), 0, b""
    while chunk := stream.read(CHUNK_BYTES):
        digest.update(chunk)
        front += chunk[: max(0, held_bytes - len(front))]
        size += len(chunk)
    return size, front, digest.hexdigest()


def _list_dirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs

    for batch in batches:
        for repo_id, root, folder in batch[["repo_id", "root", "path"]].itertuples(index=False):
            system, base = pafs.FileSystem.from_uri(root)
            start = f"{base}/{folder}" if folder else base
            try:
                infos = system.get_file_info(pafs.FileSelector(start))
            except OSError:
                continue  # unreadable directories are skipped
            if not infos:
                continue
            yield pd.DataFrame(
                {
                    "repo_id": repo_id,
                    "root": root,
                    "path": [i.path[len(base) :].lstrip("/") for i in infos],
                    "size": [i.size or 0 for i in infos],
                    "mtime": [i.mtime for i in infos],
                    "is_dir": [i.type == pafs.FileType.Directory for i in infos],
                }
            )


def list_files(roots: DataFrame) -> DataFrame:
    """All files below ``roots`` (``repo_id, root`` URI) outside skipped directories.

    One round per directory level; a round lists its directories in parallel and
    its entries are written, so no level is listed twice. Gives ``ENTRY``.
    """
    # A named number of tasks: rows of directories are tiny, and adaptive
    # execution would put them all into one task by their size.
    tasks = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels: list[DataFrame] = []
    frontier = roots.select("repo_id", "root", F.lit("").alias("path"))
    while True:
        spread = frontier.repartition(tasks, "repo_id", "path")
        entries = written(spread.mapInPandas(_list_dirs, ENTRY), "listing")
        levels.append(entries.filter("not is_dir"))
        frontier = entries.filter(F.col("is_dir") & ~P.skipped(P.parts(F.col("path")))).select(
            "repo_id", "root", "path"
        )
        if frontier.isEmpty():
            break
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files.drop("is_dir")


def _read(batches: Iterator[pd.DataFrame], held_bytes: int | None = None) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs

    columns = ["repo_id", "path", "size", "mtime", "content"] + (["sha256"] if held_bytes is not None else [])
    for batch in batches:
        rows, held = [], 0
        for r in batch.itertuples(index=False):
            # A large file does not wait beside others.
            if rows and held_bytes is None and held + r.size > BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
            system, base = pafs.FileSystem.from_uri(r.root)
            try:
                with system.open_input_stream(f"{base}/{r.path}") as stream:
                    if held_bytes is None:
                        data = stream.read()
                        read = (len(data), r.mtime, data)
                    else:
                        size, data, digest = digested(stream, held_bytes)
                        read = (size, r.mtime, data, digest)
            except OSError:
                continue  # unreadable files are skipped
            rows.append((r.repo_id, r.path, *read))
            held += len(data)
            if held >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def read_files(listing: DataFrame, max_bytes: int | None = None, held_bytes: int | None = None) -> DataFrame:
    """Contents of listed files as ``RAW``; files above ``max_bytes``, if given, are never opened.

    With ``held_bytes`` files are read whole as well, but in chunks: ``content`` has the first bytes and a
    further column ``sha256`` the hash of all, so a file of any size takes little memory.
    """
    chosen = listing if max_bytes is None else listing.filter(F.col("size") <= max_bytes)
    # Tasks are sized by the bytes to be read, not by the small listing rows.
    total = chosen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(total // TASK_BYTES, int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = RAW if held_bytes is None else f"{RAW}, sha256 string"
    return chosen.repartition(tasks, "repo_id", "path").mapInPandas(functools.partial(_read, held_bytes=held_bytes), schema)


def textual_files(roots: DataFrame) -> DataFrame:
    """The listing without the files whose name tells that they are binary."""
    listing = list_files(roots)
    return listing.filter(~F.lower(P.suffix(F.col("path"))).isin(*C.BINARY_EXTENSIONS))


def scan_files(roots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """List, drop by name, and by size if it is limited, then read what is left."""
    return read_files(textual_files(roots), max_bytes)
