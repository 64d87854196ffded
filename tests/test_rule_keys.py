"""Ignore rules met by equality of keys, against one regular expression per repository."""

import random
import re
import time

from quire.functions import globs as G
from quire.operators.filters import drop_ignored, ignored_paths
from quire.sources.rules import ignore_rules, keyed_rules

NAMES = ["a", "b", "ab", "doc_1", "x.py", "x.tar.gz", ".env", "a.b", "*", "?", "[x]", "build", "ä", "a\\b", "e."]
STEPS = ["a", "b", "ab", "doc_?", "*.py", "*.gz", "*.tar.gz", ".*", "a.b", r"\*", r"\?", "[ab]", "[!a]*", "build", "**", "*", "x.*", "ä*", "*_1", "?.py", "d*_[0-9]", "[x", r"\[x]", "*.", "a\\"]


def made(seed, repos=60, paths=80):
    r = random.Random(seed)
    files, rules = {}, {}
    for i in range(repos):
        files[f"r{i}"] = {"/".join(r.choice(NAMES) for _ in range(r.randint(1, 4))) for _ in range(paths)}
        lines = []
        for _ in range(r.randint(0, 7)):
            body = "/".join(r.choice(STEPS) for _ in range(r.choice((1, 1, 1, 2, 2, 3))))
            lines.append(("!" if r.random() < 0.3 else "") + ("/" if r.random() < 0.2 else "") + body + ("/" if r.random() < 0.2 else ""))
        rules[f"r{i}"] = lines
    return files, rules


def table(spark, files):
    return spark.createDataFrame([(r, p) for r, ps in files.items() for p in sorted(ps)], "repo_id string, path string")


def rule_table(spark, rules):
    rows = [(r, ".gitignore", "\n".join(lines)) for r, lines in rules.items()]
    return ignore_rules(spark.createDataFrame(rows, "repo_id string, path string, content string"))


def plain(files, rules):
    out = set()
    for repo, paths in files.items():
        parsed = [x for line in rules[repo] if (x := G.parse(line))]
        tests = [(negated, re.compile(regex.replace(r"\z", r"\Z"), re.S)) for negated, regex in parsed]
        for path in paths:
            last = [negated for negated, test in tests if test.search(path)][-1:]
            if last == [False]:
                out.add((repo, path))
    return out


def test_against_regular_expressions(spark):
    files, rules = made(3)
    want = plain(files, rules)
    assert 300 < len(want) < sum(map(len, files.values())) - 300
    got = [tuple(x) for x in ignored_paths(table(spark, files), rule_table(spark, rules)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_keys(spark):
    assert G.key_of("/build/") == ("path", "build", True, True)
    assert G.key_of("docs/en") == ("path", "docs/en", True, False)
    assert G.key_of(r"\!x\*") == ("name", "!x*", True, False)
    assert G.key_of("*.tar.gz") == ("end", ".tar.gz", True, False)
    assert G.key_of("docs/**/x_9*") == ("path", "docs", False, False)
    assert G.key_of("**/de/*.js") == ("name", "de", False, False)
    assert G.key_of("test_*.py") == ("end", ".py", False, False)
    assert G.key_of("doc_?[0-4]") == ("path", "", False, False)
    assert G.key_of("# no") is None and G.key_of("  ") is None


def test_many_rules_in_one_repository(spark):
    """Ten thousand rules, a fifth of them negated: a path meets only those with one of its keys."""
    lines = [f"/dir{i}/sub{i % 7}" if i % 5 else f"!dir{i - 1}/sub{(i - 1) % 7}/keep" for i in range(10_000)]
    files = {"r": {f"dir{i}/sub{j}/{name}" for i in range(0, 10_000, 50) for j in range(7) for name in ("x", "keep")}}
    files["r"] |= {f"dir{i - 1}/sub{(i - 1) % 7}/{name}" for i in range(5, 10_000, 500) for name in ("x", "keep")}
    rules = rule_table(spark, {"r": lines})
    assert keyed_rules(rules).filter("regex is not null").isEmpty()
    positive = {line[1:] for line in lines if line[0] == "/"}
    kept = {line[1:] for line in lines if line[0] == "!"}
    want = {p for p in files["r"] if p.rsplit("/", 1)[0] in positive and p not in kept}
    assert want and any(p in kept for p in files["r"])
    start = time.time()
    got = {x.path for x in ignored_paths(table(spark, files), rules).collect()}
    assert got == want and time.time() - start < 60


def test_contents_are_not_shuffled(spark):
    files, rules = made(5, repos=3)
    wide = table(spark, files).selectExpr("*", "repeat(path, 50) as content")
    kept = drop_ignored(wide, rule_table(spark, rules))
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert {(x.repo_id, x.path) for x in kept.collect()} == {(r, p) for r, ps in files.items() for p in ps} - plain(files, rules)
    nothing = drop_ignored(wide, rule_table(spark, {"r0": ["# none"]}))
    assert nothing.count() == wide.count()
