"""Queries that run an operator on a stream of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans import inputs as I
from quire.plans.aggregates import MEASURED
from quire.plans.registry import query
from quire.session import new_folder
from quire.sources.tables import scan_table
from quire.streaming.manifest import ManifestStream
from quire.streaming.metrics import drain, extension_counts


def document_stream(spark, sf_dir):
    """The table as a stream, be it one file or a folder of files: only a pattern may name either."""
    schema = I.table(spark, sf_dir, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")


def file_stream(spark, sf_dir):
    return scan_table(document_stream(spark, sf_dir), "source", I.PATH_SQL.format(S="string"), "text", "doc_id")


@query(
    "stream_by_extension",
    f"select ext, count(*) as file_count, cast(sum(tokens) as bigint) as tokens, cast(sum(lines) as bigint) as lines from {MEASURED} group by ext",
)
def stream_by_extension(spark, sf_dir):
    counts = extension_counts(file_stream(spark, sf_dir))
    return drain(counts, new_folder(spark, "by-extension"), new_folder(spark, "stream"))


@query(
    "stream_manifest_diff",
    f"""select c.repo_id, c.path, case when p.path is null then 'A' when p.content <> c.content then 'M' else 'U' end as status
        from {I.STATE_SQL['curr']} c left join {I.STATE_SQL['prev']} p on p.repo_id = c.repo_id and p.path = c.path""",
)
def stream_manifest_diff(spark, sf_dir):
    """The later state arrives as a stream and is diffed against the earlier manifest."""
    hashed = lambda rows: rows.select("repo_id", "path", T.sha256(F.col("content").cast("binary")).alias("sha256"), F.lit(1.0).alias("mtime"))
    manifest = ManifestStream(new_folder(spark, "manifest"), hashed(I.prev_state(spark, sf_dir)))
    arriving = hashed(I.edited(file_stream(spark, sf_dir)))
    return manifest.run(arriving, new_folder(spark, "stream")).select("repo_id", "path", "status")


