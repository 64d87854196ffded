"""Versions of tables: whole ones only, the earlier one until the step that publishes."""

import pytest

from quire.operators import snapshot as S
from quire.options import SnapshotOptions
from quire.sources import published as P


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def test_a_reader_sees_the_old_or_the_new_version(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    assert P.current(spark, folder) is None and P.versions(spark, folder) == []
    P.publish({"x": numbers(spark, 1), "y": numbers(spark, 10)}, folder)
    read = lambda: {n: sorted(r.n for r in spark.read.parquet(f"{P.current(spark, folder)}/{n}").collect()) for n in "xy"}
    assert read() == {"x": [1], "y": [10]}
    held = spark.read.parquet(f"{P.current(spark, folder)}/x")
    # The second table fails after the first is written: nothing changes.
    broken = numbers(spark, 1).selectExpr("raise_error('lost') as n")
    with pytest.raises(Exception, match="lost"):
        P.publish({"x": numbers(spark, 2), "y": broken}, folder)
    assert read() == {"x": [1], "y": [10]}
    # A version may be made from the one before, and who reads that can finish.
    P.publish({"x": held.selectExpr("n + 1 as n"), "y": numbers(spark)}, folder)
    assert read() == {"x": [2], "y": []} and held.first().n == 1
    P.publish({"x": numbers(spark, 3), "y": numbers(spark, 4)}, folder)
    assert read() == {"x": [3], "y": [4]}
    assert len(P.versions(spark, folder)) == P.KEEP
    kept = {v.split("-")[1] for v in P.versions(spark, folder)}
    # Besides the kept versions only what the failed writer left is there.
    assert len(set(P.children(spark, f"{folder}/data")) - kept) == 1
    with pytest.raises(ValueError):
        P.publish({"x": numbers(spark, 3)}, folder, keep=0)


def test_header_and_files_of_a_snapshot_agree(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    schema = "repo_id string, path string, size long, mtime double, content binary"
    rows = [S.manifest_rows(spark.createDataFrame([("r", n, 1, 0.0, bytearray(b"x"))], schema)) for n in ("a.py", "b.py")]
    S.write_snapshot(rows[0], folder, "s/1", SnapshotOptions(max_lines=1))
    broken = rows[1].selectExpr(*[c for c in rows[1].columns if c != "sha256"], "cast(raise_error('lost') as string) as sha256")
    with pytest.raises(Exception, match="lost"):
        S.write_snapshot(broken, folder, "s/1", SnapshotOptions(max_lines=2))
    assert S.read_options(spark, folder, "s/1").max_lines == 1
    assert [r.path for r in S.read_snapshot(spark, folder, "s/1").collect()] == ["a.py"]
    S.write_snapshot(rows[1], folder, "s/1", SnapshotOptions(max_lines=2))
    assert S.read_options(spark, folder, "s/1").max_lines == 2
    assert [r.path for r in S.read_snapshot(spark, folder, "s/1").collect()] == ["b.py"]
    S.write_snapshot(rows[0], folder, "t")
    assert S.snapshot_ids(spark, folder) == ["s/1", "t"]
