"""Streams over small parquet folders."""

import pytest
from pyspark.sql import functions as F

from quire.plans import streams as PS
from quire.streaming.manifest import ManifestStream
from quire.streaming.metrics import drain, extension_counts

SCHEMA = "repo_id string, path string, sha256 string, mtime double"


def test_manifest_over_several_batches(spark, tmp_path):
    batches = [
        [("r", "a", "1", 1.0), ("r", "b", "2", 1.0), ("r", "b", "3", 2.0)],
        [("r", "a", "1", 3.0), ("r", "c", "9", 3.0)],
        [("r", "b", "4", 4.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    start = spark.createDataFrame([("r", "a", "0"), ("r", "z", "5")], "repo_id string, path string, sha256 string")
    manifest = ManifestStream(f"file://{tmp_path}/m", start)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    events = manifest.run(stream, f"file://{tmp_path}/cp")
    assert events.select("batch").distinct().count() == 3
    current = {r.path: r.sha256 for r in manifest.current(spark).collect()}
    assert current == {"a": "1", "b": "4", "c": "9", "z": "5"}
    # A repeated batch leaves the log as it was.
    before = sorted(map(tuple, manifest.events(spark).collect()))
    manifest.apply(spark.read.schema(SCHEMA).parquet(f"file://{tmp_path}/in/1"), events.agg(F.max("batch")).first()[0] + 1)
    assert len(manifest.events(spark).collect()) == len(before) + 2


def test_manifest_with_deletions(spark, tmp_path):
    batches = [
        [("r", "a", None, 1.0), ("r", "b", "2", 1.0), ("r", "none", None, 1.0)],
        [("r", "a", "7", 2.0), ("r", "b", "3", 2.0), ("r", "b", None, 3.0)],
        [("r", "b", None, 4.0), ("r", "c", None, 4.0), ("r", "c", "1", 5.0)],
    ]
    start = spark.createDataFrame([("r", "a", "0"), ("r", "z", "5")], "repo_id string, path string, sha256 string")
    manifest = ManifestStream(f"file://{tmp_path}/m", start)
    for _ in range(2):  # a repeated batch changes nothing
        for i, rows in enumerate(batches):
            manifest.apply(spark.createDataFrame(rows, SCHEMA), i)
    got = {(r.batch, r.path, r.status) for r in manifest.events(spark).filter("batch >= 0").collect()}
    assert got == {(0, "a", "D"), (0, "b", "A"), (1, "a", "A"), (1, "b", "D"), (2, "c", "A")}
    assert {r.path: r.sha256 for r in manifest.current(spark).collect()} == {"a": "7", "c": "1", "z": "5"}


def test_running_extension_counts(spark, tmp_path):
    schema = "repo_id string, path string, content string"
    for i, rows in enumerate([[("r", "a.py", "x y\n"), ("r", "b.md", "z")], [("s", "c.py", "w")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    result = drain(extension_counts(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert {tuple(r) for r in result.collect()} == {(".py", 2, 3, 2), (".md", 1, 1, 1)}


def test_running_counts_without_rows_or_news(spark, tmp_path):
    schema = "repo_id string, path string, content string"
    (tmp_path / "in").mkdir()
    run = lambda: drain(extension_counts(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").collect()
    assert run() == []
    spark.createDataFrame([("r", "a.py", "x y")], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second run has no new files
        assert [tuple(r) for r in run()] == [(".py", 1, 2, 1)]


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_a_table_of_one_file_or_a_folder_is_streamed(spark, tmp_path, parts):
    docs = [(i, "s", "en", f"w{i} x") for i in range(30)]
    table = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    (tmp_path / "sf").mkdir()
    if parts:
        table.repartition(parts).write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    else:
        table.toPandas().to_parquet(tmp_path / "sf" / "documents.parquet")
    counts = PS.stream_by_extension(spark, f"file://{tmp_path}/sf").agg(F.sum("file_count"), F.sum("tokens")).first()
    assert tuple(counts) == (30, 60)
    states = PS.stream_manifest_diff(spark, f"file://{tmp_path}/sf").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in states}["A"] == 3 and sum(r["count"] for r in states) == 30
