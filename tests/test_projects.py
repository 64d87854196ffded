"""Small projects on disk, scanned, filtered, packed, analysed and compared."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import text as T
from quire.operators import analysis as A
from quire.operators import diff as D
from quire.operators import render as R
from quire.operators import snapshot as S
from quire.operators.filters import included_files
from quire.operators.modes import processed_files
from quire.operators.pack import pack as pack_files
from quire.operators.pack import pack_folders
from quire.options import PackOptions, SnapshotOptions
from quire.sources.files import scan_files
from quire.sources.rules import ignore_rules

PROJECT = {
    "main.py": "import utils\n\nprint('main')\n" * 10,
    "utils.py": "def helper():\n    pass\n" * 5,
    "README.md": "# Test Project\n" * 3,
    "script.js": "console.log(`hello ``` world`);",
    "data/config.json": '{"key": "value"}',
    "data/users.csv": "id,name\n1,test",
    "data/binary.dat": b"\x00\x01\x02\x03",
    "tests/test_main.py": "def test_main():\n    assert True",
    "tests/sub/sub_test.py": "def test_sub(): pass",
    ".env": "SECRET=KEY",
    ".cache/cachefile": "cached",
    ".gitignore": "*.csv\n.env\n.cache/\n",
    "image.png": "not really a png",
    "pkg/__init__.py": "",
    "_private/x.py": "y = 1\n",
}


def lay_out(root: Path, files: dict) -> Path:
    for path, content in files.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content if isinstance(content, bytes) else content.encode())
    return root


def scanned(spark, *roots: Path):
    table = spark.createDataFrame([(r.name, f"file://{r}") for r in roots], "repo_id string, root string")
    return scan_files(table)


def chosen(spark, root, options=PackOptions()):
    raw = scanned(spark, root)
    texts = raw.withColumn("content", T.decode(F.col("content")))
    return included_files(raw, options, ignore_rules(texts)).withColumn("content", T.decode(F.col("content")))


def paths(df):
    return {r.path for r in df.select("path").collect()}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    return lay_out(tmp_path_factory.mktemp("p") / "test_project", PROJECT)


def test_scan_keeps_special_names_and_prunes(spark, project):
    got = paths(scanned(spark, project))
    assert {".env", ".gitignore", "pkg/__init__.py", "_private/x.py", "data/binary.dat"} <= got
    assert ".cache/cachefile" not in got and "image.png" not in got


def test_default_selection(spark, project):
    got = paths(chosen(spark, project))
    assert {"main.py", "README.md", "tests/test_main.py", "data/config.json", "script.js", "pkg/__init__.py"} <= got
    assert not got & {"data/users.csv", ".env", ".cache/cachefile", "data/binary.dat", "image.png"}


def test_selection_options(spark, project):
    assert paths(chosen(spark, project, PackOptions(include_patterns=("*.md",), respect_gitignore=False))) == {"README.md"}
    no_tests = paths(chosen(spark, project, PackOptions(exclude_patterns=("tests/*",))))
    assert "main.py" in no_tests and not {p for p in no_tests if p.startswith("tests/")}
    all_rules_off = paths(chosen(spark, project, PackOptions(respect_gitignore=False)))
    assert {"data/users.csv", ".env"} <= all_rules_off and ".cache/cachefile" not in all_rules_off


def test_explicit_list_overrides_filters(spark, project):
    raw = scanned(spark, project)
    wanted = spark.createDataFrame([("test_project", "data/binary.dat")], "repo_id string, path string")
    assert paths(included_files(raw, chosen=wanted)) == {"data/binary.dat"}
    assert paths(included_files(raw, chosen=wanted.limit(0))) == set()


def pack(spark, root, options=PackOptions()):
    rows = processed_files(chosen(spark, root, options), options)
    repos = spark.createDataFrame([(root.name,)], "repo_id string")
    return "\n".join(r.text for r in R.assembled(R.pack_parts(rows, options, repos)).orderBy("segment").collect())


def test_pack_default(spark, project):
    got = pack(spark, project, PackOptions(include_patterns=("main.py", "utils.py")))
    assert got == (
        f"Project Structure:\n{C.DIR_ICON} test_project\n├── {C.FILE_ICON} main.py\n└── {C.FILE_ICON} utils.py\n\n\n"
        "Relative File Path: main.py\n\n```python\n" + ("import utils\n\nprint('main')\n" * 10).rstrip() + "\n```\n\n"
        "Relative File Path: utils.py\n\n```python\n" + ("def helper():\n    pass\n" * 5).rstrip() + "\n```"
    )


def test_pack_markdown_lengthens_fences(spark, project):
    got = pack(spark, project, PackOptions(output_format="markdown", include_patterns=("main.py", "script.js")))
    assert "## main.py\n```python\n" in got and "````javascript" in got and "Relative File Path" not in got


def test_pack_xml(spark, project):
    got = pack(spark, project, PackOptions(output_format="cxml", include_patterns=("*.py",)))
    assert got.endswith("</documents>") and '<document index="1">\n<source>_private/x.py</source>' in got
    assert '<document index="2">\n<source>main.py</source>' in got


def test_pack_tree(spark, project):
    got = pack(spark, project)
    tree = got.split("\n\n\n")[0].split("\n")
    d, f = C.DIR_ICON, C.FILE_ICON
    assert tree[1:] == [
        f"{d} test_project", f"├── {d} _private", f"│   └── {f} x.py", f"├── {d} data", f"│   └── {f} config.json",
        f"├── {d} pkg", f"│   └── {f} __init__.py", f"├── {d} tests", f"│   ├── {d} sub", f"│   │   └── {f} sub_test.py",
        f"│   └── {f} test_main.py", f"├── {f} .gitignore", f"├── {f} main.py", f"├── {f} README.md",
        f"├── {f} script.js", f"└── {f} utils.py",
    ]


def test_tree_depth(spark, project):
    got = pack(spark, project, PackOptions(tree_depth=1, include_patterns=("tests/",)))
    assert f"└── {C.DIR_ICON} tests\n    └── ... (depth limit reached)" in got


def test_empty_project(spark, tmp_path):
    root = tmp_path / "empty"
    root.mkdir()
    assert pack(spark, root).endswith("\n" + C.NO_FILES_MESSAGE)
    xml = pack(spark, root, PackOptions(output_format="cxml"))
    assert xml.endswith(f"<documents>\n{C.NO_FILES_MESSAGE}\n</documents>")


def test_analysis(spark, project):
    options = PackOptions(respect_gitignore=False, include_patterns=("main.py",))
    rows = processed_files(chosen(spark, project, options), options)
    total = A.overall(rows).first()
    assert (total.file_count, total.total_lines) == (1, 30)
    assert A.over_token_limit(rows, 10).first().over_limit
    assert not A.over_token_limit(rows, 0).first().over_limit
    everything = processed_files(chosen(spark, project))
    top = A.top_files(everything, 2).collect()
    assert [r.path for r in top] == ["main.py", "utils.py"]
    assert A.by_extension(everything, 1).collect()[0].ext == ".py"


def test_written_pack(spark, project, tmp_path):
    options = PackOptions()
    rows = processed_files(chosen(spark, project, options), options)
    R.write_pack(R.pack_parts(rows, options), f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out" / "repo_id=test_project").glob("part-*"))
    assert "".join(f.read_text() for f in files).strip() == pack(spark, project)


def modes(spark, files, options, summaries=None):
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo_id string, path string, content string")
    return {r.path: r for r in processed_files(df, options, summaries).collect()}


def test_content_modes(spark):
    ten = "".join(f"l{i}\n" for i in range(10))
    files = {
        "d.csv": ten, "short.json": "{}\n", "nul.csv": "\0" + ten, "a.txt": ten, "b.py": "x\n", "empty.md": "",
        "n.ipynb": '{"nbformat":4,"cells":[{"cell_type":"code","source":"x=1"}]}', "plain.ipynb": "text\n", "blank.ipynb": " \n\n",
        "crlf.txt": "a\r\nb\rc\r\n",
    }
    summaries = spark.createDataFrame([("r", "b.py", "SUM"), ("r", "a.txt", "SUM")], "repo_id string, path string, summary string")
    got = modes(spark, files, PackOptions(file_max_lines=3, compress=True, data_sample_lines=5), summaries)
    note = "\n\n... (File content truncated due to limits: 3 lines)"
    data_note = "\n\n... (Data file content truncated to first 5 lines)"
    assert got["d.csv"].content == "l0\nl1\nl2\nl3\nl4" + data_note and got["d.csv"].was_truncated
    assert got["short.json"].content == "{}" + data_note and not got["short.json"].was_truncated
    assert "nul.csv" not in got
    whole = modes(spark, {"d.csv": ten, "nul.csv": "\0" + ten}, PackOptions())
    assert whole["d.csv"].content == ten.rstrip("\n") and whole["nul.csv"].mode == "full"
    assert got["a.txt"].content == "l0\nl1\nl2" + note and got["a.txt"].mode == "limited"
    assert got["b.py"].content == "SUM" and got["b.py"].is_summary
    assert got["empty.md"].content == "" and got["empty.md"].lines == 0
    assert got["n.ipynb"].content == "x=1" and got["n.ipynb"].mode == "notebook"
    assert got["plain.ipynb"].content == "text\n"
    assert got["blank.ipynb"].content == " " and got["blank.ipynb"].mode == "full"
    assert got["crlf.txt"].content == "a\nb\nc"
    numbered = modes(spark, {"a.txt": "x\ny\n"}, PackOptions(show_line_numbers=True))
    assert numbered["a.txt"].content == "   1 | x\n   2 | y" and numbered["a.txt"].tokens == 6


def test_snapshot_and_diff(spark, tmp_path):
    before = lay_out(tmp_path / "before" / "proj", {"a.txt": "one\nTwo\nthree\n", "b.bin": b"\x00\x01", "same.txt": "s\n", "crlf.txt": "x\ny\n"})
    after = lay_out(tmp_path / "after" / "proj", {"a.txt": "one\nTwo!\nthree\n", "c.txt": "new file\n", "same.txt": "s\n", "crlf.txt": "x\r\ny\r\n"})
    timed = lambda df: df.withColumn("mtime", F.col("mtime").cast("timestamp").cast("double"))
    prev = S.manifest(timed(scanned(spark, before)), SnapshotOptions())
    curr = S.manifest(timed(scanned(spark, after)), SnapshotOptions())
    states = D.status(prev, curr)
    assert {(r.path, r.status) for r in states.collect()} == {("a.txt", "M"), ("c.txt", "A"), ("same.txt", "U"), ("crlf.txt", "M")}
    texts = D.diff_texts(D.text_pairs(prev, curr))
    got = [r.text for r in D.report(D.report_lines(states, texts)).orderBy("segment").collect()]
    assert got == [
        "Diff Summary\nAdded: 1\nDeleted: 0\nModified: 2\n\n# Added\nA\tc.txt\n\n# Modified\nM\ta.txt\nM\tcrlf.txt\n\n# Diffs\n"
        "--- a/a.txt\n+++ b/a.txt\n@@ -1,3 +1,3 @@\n one\n-Two\n+Two!\n three\n"
        "diff --git a/crlf.txt b/crlf.txt\n(no textual changes detected)"
    ]
    stats = {r.path: (r.lines_added, r.lines_removed) for r in D.line_stats(D.text_pairs(prev, curr)).collect()}
    assert stats == {"a.txt": (1, 1), "crlf.txt": (0, 0)}


def test_snapshot_header(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    options = SnapshotOptions(include_patterns=("*.py",), max_lines=7)
    rows = S.manifest_rows(spark.createDataFrame([("r", "a.py", 1, 0.0, bytearray(b"x"))], "repo_id string, path string, size long, mtime double, content binary"))
    S.write_snapshot(rows, folder, "one", options)
    assert S.read_options(spark, folder, "one") == options
    assert S.read_snapshot(spark, folder, "one").count() == 1
    with pytest.raises(ValueError):
        S.read_options(spark, folder, "two")


def test_snapshot_ids_stay_strings(spark, project, tmp_path):
    from quire.operators import snapshot as S

    folder = f"file://{tmp_path}/snap"
    rows = S.manifest_rows(spark.createDataFrame([("r", "a.txt", 1, 0.0, bytearray(b"x"))], "repo_id string, path string, size long, mtime double, content binary"))
    for snapshot_id in ("1", "01", "2026-01-01", "1"):
        S.write_snapshot(rows, folder, snapshot_id)
    for snapshot_id in ("1", "01", "2026-01-01"):
        assert [r.snapshot_id for r in S.read_snapshot(spark, folder, snapshot_id).collect()] == [snapshot_id]
        assert S.read_options(spark, folder, snapshot_id).max_bytes == 0


def test_diff_of_texts_that_are_not_stored(spark):
    from quire.operators import diff as D
    from quire.operators import snapshot as S
    from quire.options import SnapshotOptions

    schema = "repo_id string, path string, size long, mtime double, content binary"

    def state(text, limit=0):
        row = ("r", "a.txt", len(text), 0.0, bytearray(text.encode()))
        return S.manifest_rows(spark.createDataFrame([row], schema), SnapshotOptions(max_bytes=limit))

    old, new = "one\ntwo\n", "one\ntwo\n" + "more\n" * 10
    gated_new = D.text_pairs(state(old), state(new, 20))
    assert D.line_stats(gated_new).count() == 0 and D.special_cases(gated_new).first().kind == "content_missing"
    gated_old = D.text_pairs(state(new, 20), state(old))
    assert D.special_cases(gated_old).first().line == "Content not stored: a/a.txt b/a.txt"
    plain = D.line_stats(D.text_pairs(state(old), state(new))).first()
    assert (plain.lines_added, plain.lines_removed) == (10, 0)


def test_one_call_from_folders_to_packs(spark, project, tmp_path):
    """Scan, ignore rules, decoding, modes, assembly and statistics in one call, for several folders."""
    other = lay_out(tmp_path / "other", {"a.py": "def f():\n    return 1\n", "b.log": "x", ".gitignore": "*.log\n"})
    empty = lay_out(tmp_path / "empty", {"x.png": "no text"})
    roots = spark.createDataFrame([(r.name, f"file://{r}") for r in (project, other, empty)], "repo_id string, root string")
    made = pack_folders(roots, PackOptions(max_tokens=20, top_n=2, tree_depth=2))
    files = {(r.repo_id, r.path) for r in made.processed.collect()}
    assert ("other", "a.py") in files and ("other", "b.log") not in files and ("test_project", "data/users.csv") not in files
    texts = {r.repo_id: r.text for r in made.texts().collect()}
    assert set(texts) == {"test_project", "other", "empty"}
    assert "Relative File Path: a.py" in texts["other"] and "b.log" not in texts["other"] and C.NO_FILES_MESSAGE in texts["empty"]
    counts = {r.repo_id: r.files for r in made.files_processed().collect()}
    assert counts["empty"] == 0 and counts["test_project"] == sum(r == "test_project" for r, _ in files)
    totals = {r.repo_id: r for r in made.totals().collect()}
    assert totals["test_project"].over_limit and not totals["other"].over_limit
    assert made.top_files().count() == 2 and made.by_extension().count() == 2
    made.write(f"file://{tmp_path}/out")
    lines = spark.read.text(f"file://{tmp_path}/out/repo_id=other").collect()
    assert "\n".join(r.value for r in lines).rstrip() == texts["other"]


def test_one_call_with_summaries_and_chosen_files(spark, project):
    raw = scanned(spark, project)
    short = {r.path: r for r in pack_files(raw, PackOptions(compress=True)).processed.collect()}
    assert short["utils.py"].is_summary and "def helper()" in short["utils.py"].content
    assert not short["README.md"].is_summary and "# Test Project" in short["README.md"].content
    some = spark.createDataFrame([(project.name, ".env"), (project.name, "data/users.csv")], "repo_id string, path string")
    assert paths(pack_files(raw, chosen=some).processed) == {".env", "data/users.csv"}
