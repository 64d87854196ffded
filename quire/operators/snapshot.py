"""Content-hash manifests of a corpus, stored by snapshot."""

from __future__ import annotations

from datetime import datetime, timezone
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quire import constants as C
from quire.functions import text as T
from quire.operators.filters import included_files, is_text
from quire.options import PackOptions, SnapshotOptions
from quire.sources.published import children, current, publish

MARK = "snapshot_id="

META_SCHEMA = ST.StructType(
    [
        ST.StructField("snapshot_id", ST.StringType()),
        ST.StructField("schema_version", ST.IntegerType()),
        ST.StructField("created_at", ST.TimestampType()),
        ST.StructField("respect_gitignore", ST.BooleanType()),
        ST.StructField("include_patterns", ST.ArrayType(ST.StringType())),
        ST.StructField("exclude_patterns", ST.ArrayType(ST.StringType())),
        ST.StructField("max_bytes", ST.LongType()),
        ST.StructField("max_lines", ST.LongType()),
    ]
)


def inline_content(text: Column, size: Column, textual: Column, options: SnapshotOptions) -> Column:
    """Content is kept for text within both limits; a limit of 0 is off."""
    keep = textual
    if options.max_bytes:
        keep = keep & (size <= options.max_bytes)
    if options.max_lines:
        # Lines of a text-mode read: breaks, plus an unfinished last line.
        breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        tail = F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)
        keep = keep & (breaks + tail <= options.max_lines)
    return F.when(keep, text)


def manifest(
    files: DataFrame, options: SnapshotOptions = SnapshotOptions(), rules: DataFrame | None = None
) -> DataFrame:
    """``repo_id, path, size, mtime, sha256, is_text, content`` of the included files.

    ``files`` has raw bytes: ``repo_id, path, size, mtime, content BINARY``.
    """
    scan = PackOptions(
        include_patterns=options.include_patterns,
        exclude_patterns=options.exclude_patterns,
        respect_gitignore=options.respect_gitignore,
    )
    return manifest_rows(included_files(files, scan, rules), options)


def manifest_rows(files: DataFrame, options: SnapshotOptions = SnapshotOptions()) -> DataFrame:
    """Manifest of exactly the given files."""
    textual = is_text(F.col("path"), F.col("size"), F.col("content"))
    marked = files.withColumn("is_text", textual).withColumn(
        "_text", T.normalize_newlines(T.decode(F.col("content")))
    )
    return marked.select(
        "repo_id",
        "path",
        F.col("size").cast("bigint").alias("size"),
        F.col("mtime").cast("double").alias("mtime"),
        T.sha256(F.col("content")).alias("sha256"),
        "is_text",
        inline_content(F.col("_text"), F.col("size"), F.col("is_text"), options).alias("content"),
    )


def header(spark: SparkSession, snapshot_id: str, options: SnapshotOptions) -> DataFrame:
    """The one-row description of a snapshot."""
    row = (
        snapshot_id,
        C.SNAPSHOT_SCHEMA_VERSION,
        datetime.now(timezone.utc),
        options.respect_gitignore,
        list(options.include_patterns),
        list(options.exclude_patterns),
        options.max_bytes,
        options.max_lines,
    )
    return spark.createDataFrame([row], META_SCHEMA)


def _folder(folder: str, snapshot_id: str) -> str:
    """The folder of one snapshot; it is named here, so ids stay strings (``1`` is not ``01``)."""
    return f"{folder}/{MARK}{quote(snapshot_id, safe='')}"


def write_snapshot(rows: DataFrame, folder: str, snapshot_id: str, options: SnapshotOptions = SnapshotOptions()) -> None:
    """Write a manifest and its header below ``folder``; an earlier snapshot of that id is replaced.

    Both are published in one step: a reader meanwhile gets the manifest and the header of the earlier snapshot.
    """
    head = header(rows.sparkSession, snapshot_id, options).drop("snapshot_id")
    publish({"files": rows, "meta": head}, _folder(folder, snapshot_id))


def snapshot_ids(spark: SparkSession, folder: str) -> list[str]:
    """Ids of the snapshots below ``folder``, in name order."""
    names = [n for n in children(spark, folder) if n.startswith(MARK)]
    return [unquote(n[len(MARK) :]) for n in names if current(spark, f"{folder}/{n}")]


def _table(spark: SparkSession, folder: str, snapshot_id: str, name: str) -> DataFrame:
    found = current(spark, _folder(folder, snapshot_id))
    if found is None:
        raise ValueError(f"no snapshot {snapshot_id!r} in {folder}")
    return spark.read.parquet(f"{found}/{name}")


def read_snapshot(spark: SparkSession, folder: str, snapshot_id: str) -> DataFrame:
    """Manifest of one snapshot; the files of others are not listed."""
    return _table(spark, folder, snapshot_id, "files").withColumn("snapshot_id", F.lit(snapshot_id))


def read_header(spark: SparkSession, folder: str, snapshot_id: str) -> DataFrame:
    """Header of one snapshot, a row."""
    return _table(spark, folder, snapshot_id, "meta").withColumn("snapshot_id", F.lit(snapshot_id))


def read_options(spark: SparkSession, folder: str, snapshot_id: str) -> SnapshotOptions:
    """The settings in a snapshot header (one row)."""
    row = read_header(spark, folder, snapshot_id).first()
    return SnapshotOptions(
        include_patterns=tuple(row.include_patterns),
        exclude_patterns=tuple(row.exclude_patterns),
        respect_gitignore=row.respect_gitignore,
        max_bytes=row.max_bytes,
        max_lines=row.max_lines,
    )
