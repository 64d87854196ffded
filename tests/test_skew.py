"""One key with a large share of the rows, and the plans that must hold for it."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import analysis as A
from quire.operators import diff as D
from quire.operators import skew
from quire.operators import tree as TR
from quire.sources.tables import ordered_text


def skewed(spark, n=4000):
    """Nine of ten rows belong to one repository."""
    rng = random.Random(1)
    rows = [("hot" if i % 10 else f"r{i % 7}", f"d{i % 5}/{rng.randint(0, 10**9)}-{i}", i % 13) for i in range(n)]
    return rows, spark.createDataFrame(rows, "repo_id string, path string, v long").repartition(16)


def test_positions_of_a_hot_group(spark):
    rows, df = skewed(spark)
    got = {(r.repo_id, r.path): (r.position, r.total) for r in skew.positions(df, ["repo_id"], ["path"], {"total": F.col("v")}).collect()}
    assert len(got) == len(rows)
    for repo in {r[0] for r in rows}:
        total = 0
        for i, (_, path, v) in enumerate(sorted(r for r in rows if r[0] == repo)):
            total += v
            assert got[repo, path] == (i + 1, total)


def test_hot_group_is_split_over_ranges(spark):
    _, df = skewed(spark)
    keys = df.repartitionByRange(8, "repo_id", "path").withColumn("p", F.spark_partition_id())
    assert keys.filter("repo_id = 'hot'").select("p").distinct().count() > 4


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_lookup_join_salted_and_broadcast(spark, limit):
    rows, df = skewed(spark)
    table = spark.createDataFrame([("hot", 1), ("r0", 2)], "repo_id string, w long")
    got = skew.lookup_join(df, table, ["repo_id"], ["path"], limit=limit)
    assert got.count() == len(rows)
    assert got.filter("repo_id = 'hot' and w = 1").count() == sum(r[0] == "hot" for r in rows)
    assert got.filter("w is null").count() == sum(r[0] not in ("hot", "r0") for r in rows)


def test_segments_join_to_the_whole_text(spark):
    rows, df = skewed(spark, 1500)
    parts = df.withColumn("text", F.concat("path", F.repeat(F.lit("é"), F.col("v").cast("int"))))
    got = skew.in_segments(parts, ["repo_id"], ["path"], "text", 2000).collect()
    for repo in {r[0] for r in rows}:
        want = "\n".join(p + "é" * v for _, p, v in sorted(r for r in rows if r[0] == repo))
        mine = sorted((r.segment, r.text) for r in got if r.repo_id == repo)
        assert "\n".join(t for _, t in mine) == want
        assert len({s for s, _ in mine}) == len(mine)
        # The last part of a segment may cross the bound, no other.
        assert all(len(t.encode()) < 2000 + 60 for _, t in mine)
    assert sum(r.n_parts for r in got) == len(rows)


def test_long_documents_have_parts(spark):
    """Parts follow bytes, not positions: those of the second document begin late and have gaps."""
    one = spark.range(5000).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.col("id").cast("string").alias("t"))
    two = one.select(F.lit(2).alias("doc"), (F.col("pos") * 1000 + 77_777).alias("pos"), "t")
    short = spark.createDataFrame([(3, 9, "a"), (3, 2, None), (3, 2, None), (None, 1, "n")], "doc int, pos long, t string")
    got = ordered_text(one.unionByName(two).unionByName(short), "doc", "pos", "t", part_bytes=4000).collect()
    want = " ".join(map(str, range(5000)))
    for doc in (1, 2):
        parts = sorted((r.part, r.text) for r in got if r.doc == doc)
        assert len(parts) > 4 and " ".join(t for _, t in parts) == want
        assert all(len(t) <= 4000 + 5 for _, t in parts)
    assert [(r.part, r.text) for r in got if r.doc == 3] == [(0, "  a")]
    assert [(r.part, r.text) for r in got if r.doc is None] == [(0, "n")]


def test_segments_with_repeated_keys(spark):
    """Equal keys double no text, and the texts go through one exchange."""
    df = spark.createDataFrame([("r", "a", "x"), ("r", "a", "x"), ("r", "b", "y")], "repo_id string, path string, text string")
    got = skew.in_segments(df, ["repo_id"], ["path"], "text", 1000).collect()
    assert [(r.text, r.n_parts) for r in got] == [("x\nx\ny", 3)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_files_plan(spark):
    df = spark.createDataFrame([("r", "a/b", 1, 2)], "repo_id string, path string, tokens long, lines long")
    assert "TakeOrderedAndProject" in plan(A.top_files(df, 3))
    assert "WindowGroupLimit" in plan(A.top_files_per_repo(df, 3))


def test_status_reads_no_content(spark, tmp_path):
    columns = "repo_id string, path string, sha256 string, is_text boolean, content string"
    spark.createDataFrame([("r", "a", "1", True, "x")], columns).write.parquet(f"file://{tmp_path}/m")
    m = spark.read.parquet(f"file://{tmp_path}/m")
    assert "content#" not in plan(D.status(m, m)) and "content:" not in plan(D.status(m, m))


def test_no_cross_joins(spark):
    df = spark.createDataFrame([("r", "a/b", "x")], "repo_id string, path string, content string")
    for made in (TR.tree_nodes(df), TR.last_children(TR.tree_nodes(df)), A.path_order(df)):
        assert "CartesianProduct" not in plan(made) and "NestedLoop" not in plan(made)


def test_unified_diffs_and_line_stats(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(120):
        old = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        new = [x for x in old if rng.random() > 0.2] + rng.choices("abef", k=rng.randint(0, 3))
        pairs.append(("r", f"f{i}", True, True, True, True, "\n".join(old), "\n".join(new)))
    lost = [("r", "no old", True, True, False, True, "", "a\nb"), ("r", "no new", True, True, True, False, "a", "")]
    flags = ", ".join(f"{side}_{flag} boolean" for flag in ("is_text", "available") for side in ("old", "new"))
    df = spark.createDataFrame(pairs + lost, f"repo_id string, path string, {flags}, old_text string, new_text string")
    unified = {r.path: r.diff for r in D.unified(df).collect()}
    stats = {r.path: (r.lines_added, r.lines_removed) for r in D.line_stats(df).collect()}
    # A side that is not stored is no empty file: such a pair has neither a diff nor counts.
    assert set(stats) == {p[1] for p in pairs} and not {"no old", "no new"} & set(unified)
    for _, path, *_, old, new in pairs:
        o, n = old.splitlines(), new.splitlines()
        if old != new:
            assert unified[path] == "\n".join(difflib.unified_diff(o, n, f"a/{path}", f"b/{path}", n=3, lineterm=""))
        more = [max(n.count(x) - o.count(x), 0) for x in set(o + n)]
        less = [max(o.count(x) - n.count(x), 0) for x in set(o + n)]
        assert stats[path] == (sum(more), sum(less))


def test_tree_flags_in_a_full_directory(spark):
    files = spark.range(3000).select(F.lit("r").alias("repo_id"), F.format_string("d/%05d.txt", "id").alias("path"))
    last = TR.last_children(TR.tree_nodes(files)).filter("is_last")
    assert {r.path for r in last.collect()} == {"d", "d/02999.txt"}
    lines = TR.tree_lines(files).orderBy("tree_key").collect()
    assert len(lines) == 3002 and lines[-1].line.startswith("    └── ") and lines[1].line.startswith("└── ")
