"""The entry without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"


def copied(tmp_path, *left_out):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(d, n) in left_out])
    return to


def names(folder):
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=env, capture_output=True, text=True)


def test_without_the_optional_package(tmp_path):
    to = copied(tmp_path, os.path.join(ROOT, "quire", "llm"), os.path.join(ROOT, "corpus_pipeline.py"))
    (to / "quire" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted package leaves behind
    got = names(to)
    assert got.returncode == 0 and got.stdout.strip().endswith("[]"), got.stderr


def test_other_import_errors_show(tmp_path):
    to = copied(tmp_path)
    if not (to / "corpus_pipeline.py").exists():
        return
    (to / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    got = names(to)
    assert got.returncode != 0 and "no_such_module_at_all" in got.stderr
