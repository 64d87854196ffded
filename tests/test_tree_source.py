"""The file tree as a data source: rows of the scan, pruned listing, pushed filters."""

import hashlib
import json
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import datasource as DS
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.sources import tree as TS
from quire.sources import files as FS
from quire.sources.files import scan_files
from tests.test_projects import PROJECT, lay_out

FULL = StructType([StructField(n, StringType()) for n in ("repo_id", "path", "size", "mtime", "content")])
MORE = {"node_modules/x.js": "x", ".git/config": "x", "docs/a/b/c/deep.md": "d", "docs/big.md": "z" * 5000, "empty.txt": "", "ä ö/ü.py": "u"}


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    base = tmp_path_factory.mktemp("trees")
    lay_out(base / "one", {**PROJECT, **MORE})
    lay_out(base / "two", {f"flat/f{i}.py": str(i) for i in range(300)})
    (base / "none").mkdir()
    return {n: f"file://{base / n}" for n in ("one", "two", "none")}


def read(spark, roots, **options):
    TS.register(spark)
    return spark.read.format("file_tree").options(roots=json.dumps(roots), **options).load()


def rows(df):
    return sorted((r.repo_id, r.path, r.size, bytes(r.content)) for r in df.select("repo_id", "path", "size", "content").collect())


def test_rows_of_the_scan(spark, roots):
    table = spark.createDataFrame(list(roots.items()), "repo_id string, root string")
    want = rows(scan_files(table))
    assert len(want) > 300
    for partitions in (1, 64):
        assert rows(read(spark, roots, partitions=partitions)) == want
    listing = read(spark, roots, contents="false")
    assert listing.columns == ["repo_id", "path", "size", "mtime"] and listing.count() == len(want)
    assert read(spark, {"none": roots["none"]}).count() == read(spark, {}).count() == 0
    assert read(spark, {"gone": roots["none"] + "/missing"}).count() == 0


def test_filters_reach_the_listing(spark, roots):
    everything = read(spark, roots)
    whole = [(r.repo_id, r.path, r.size) for r in everything.collect()]
    path, size = F.col("path"), F.col("size")
    for cond, plain in (
        (path.startswith("docs/a") & (size > 0), lambda r, p, s: p.startswith("docs/a") and s > 0),
        (path.isin("main.py", "flat/f7.py"), lambda r, p, s: p in ("main.py", "flat/f7.py")),
        ((path == "docs/a/b/c/deep.md") & (F.col("repo_id") == "one"), lambda r, p, s: p == "docs/a/b/c/deep.md"),
        (path.endswith(".py") & (size <= 2), lambda r, p, s: p.endswith(".py") and s <= 2),
        ((F.col("repo_id") != "two") & ~path.contains("a"), lambda r, p, s: r != "two" and "a" not in p),
        (path.startswith("no"), lambda r, p, s: p.startswith("no")),
    ):
        got = everything.filter(cond)
        assert sorted((r.repo_id, r.path, r.size) for r in got.collect()) == sorted(x for x in whole if plain(*x))
    plan = everything.filter(path.startswith("docs/") & (size < 10))._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.split("BatchScan")[0], "the source answers these filters alone"


def test_folders_that_cannot_match_are_not_entered(roots, monkeypatch):
    entered = []
    plain = TS.listed

    def noted(root, folder):
        entered.append(folder)
        return plain(root, folder)

    monkeypatch.setattr(TS, "listed", noted)
    reader = TS.TreeReader({"roots": json.dumps(roots)}, FULL)
    left = list(reader.pushFilters([DS.EqualTo(("repo_id",), "one"), DS.StringStartsWith(("path",), "docs/a/"), DS.IsNotNull(("path",)), DS.IsNull(("size",))]))
    assert left == [DS.IsNull(("size",))]
    got = [r for part in reader.partitions() for b in reader.read(part) for r in b.column("path").to_pylist()]
    assert got == ["docs/a/b/c/deep.md"]
    assert set(entered) == {"", "docs", "docs/a", "docs/a/b", "docs/a/b/c"}


def test_a_flat_folder_is_split(roots, monkeypatch):
    monkeypatch.setattr(TS, "TASK_BYTES", 100)
    reader = TS.TreeReader({"roots": json.dumps({"two": roots["two"]})}, FULL)
    parts = reader.partitions()
    got = [[r for b in reader.read(p) for r in b.column("path").to_pylist()] for p in parts]
    assert len(parts) > 4 and max(map(len, got)) < 150
    assert sorted(sum(got, [])) == sorted(f"flat/f{i}.py" for i in range(300))


def test_digests_are_those_of_the_contents(spark, roots):
    table = spark.createDataFrame(list(roots.items()), "repo_id string, root string")
    want = [(r, p, s, hashlib.sha256(c).hexdigest()) for r, p, s, c in rows(scan_files(table))]
    cols = ["repo_id", "path", "size", "sha256"]
    assert sorted(map(tuple, read(spark, roots, contents="digest").select(cols).collect())) == want
    read_back = FS.read_files(FS.textual_files(table), held_bytes=10).collect()
    assert sorted((r.repo_id, r.path, r.size, r.sha256) for r in read_back) == want
    assert {len(r.content) for r in read_back} == {min(10, r.size) for r in read_back}


def test_a_large_file_is_digested_in_little_memory(tmp_path):
    with open(tmp_path / "large.bin2", "wb") as file:
        file.truncate(200_000_000)
    listing = pd.DataFrame({"repo_id": ["r"], "root": [f"file://{tmp_path}"], "path": ["large.bin2"], "size": [200_000_000], "mtime": [pd.Timestamp(0)]})
    schema = StructType([f for f in FULL if f.name != "content"] + [StructField("sha256", StringType())])
    reader = TS.TreeReader({"root": f"file://{tmp_path}"}, schema)
    for run in (
        lambda: [x for b in FS._read(iter([listing]), held_bytes=5) for x in b["sha256"]],
        lambda: [x for p in reader.partitions() for b in reader.read(p) for x in b.column("sha256").to_pylist()],
    ):
        tracemalloc.start()
        got = set(run())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == 1 and peak < 50_000_000
