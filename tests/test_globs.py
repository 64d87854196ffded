"""Ignore patterns: cases of the public pattern language."""

import pytest
from pyspark.sql import functions as F

from quire.functions import globs as G
from quire.operators.filters import drop_ignored, included_by_globs
from quire.sources.rules import ignore_rules

CASES = [
    (["*.md"], ["README.md", "a/b.md"], ["README.mdx", "md"]),
    (["tests/*"], ["tests/a.py", "tests/sub/b.py"], ["a/tests/x.py", "tests"]),
    (["my_folder"], ["my_folder/a", "x/my_folder/b/c", "my_folder"], ["my_folder2/a"]),
    ([".cache/"], [".cache/f", "a/.cache/b/c"], [".cache"]),
    (["/build"], ["build", "build/x"], ["a/build"]),
    (["a/**/b"], ["a/b", "a/x/b", "a/x/y/b/c"], ["b", "x/a/b"]),
    (["**/foo"], ["foo", "a/foo", "a/b/foo/c"], ["foobar"]),
    (["abc/**"], ["abc/x", "abc/x/y"], ["abc", "x/abc/y"]),
    (["**"], ["a", "a/b"], []),
    (["a?c"], ["abc", "x/a-c"], ["ac", "a/c"]),
    (["[ab]*.py"], ["a.py", "x/b1.py"], ["c.py"]),
    (["[!ab].py"], ["c.py"], ["a.py"]),
    ([r"\#x", r"\!y"], ["#x", "!y"], ["x", "y"]),
    (["# comment", "", "  "], [], ["a", "# comment"]),
    (["*.log", "!keep.log"], ["a.log", "x/b.log"], ["keep.log", "x/keep.log"]),
    (["*.log", "!keep.log", "x/keep.log"], ["x/keep.log"], ["keep.log"]),
    (["!a", "a"], ["a"], []),
    (["dir/", "!dir/keep"], ["dir/x"], ["dir/keep"]),
    (["a.b"], ["a.b"], ["aXb"]),
]


@pytest.mark.parametrize("patterns,hits,misses", CASES, ids=lambda x: ",".join(x)[:30])
def test_patterns(spark, patterns, hits, misses):
    paths = hits + misses
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path for r in df.filter(G.matches_any(F.col("path"), patterns)).collect()}
    assert got == set(hits)
    # The same rules as an ignore file of a repository.
    files = df.withColumn("repo_id", F.lit("r"))
    ignore = spark.createDataFrame([("r", ".gitignore", "\n".join(patterns))], "repo_id string, path string, content string")
    kept = {r.path for r in drop_ignored(files, ignore_rules(ignore)).collect()}
    assert kept == set(misses)


def test_no_include_pattern_is_everything(spark):
    df = spark.createDataFrame([("a",), ("b/c",)], "path string")
    assert df.filter(included_by_globs(F.col("path"), [])).count() == 2
