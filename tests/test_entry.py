"""The entry imports from copies of the tree with parts of it taken out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXT = "op1_packing" if os.path.isfile(os.path.join(ROOT, "crosspanel", "llm", "registry.py")) else None


def names(tree):
    code = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tree, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tree)}, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout


def copy(tmp_path, *skip):
    tree = tmp_path / "tree"
    shutil.copytree(os.path.join(ROOT, "crosspanel"), tree / "crosspanel", ignore=shutil.ignore_patterns("__pycache__", *skip))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in skip and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tree / name)
    return tree


@pytest.mark.parametrize("skip", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",), ("registry.py",)])
def test_entry_without_parts(tmp_path, skip):
    out = names(copy(tmp_path, *skip))
    assert "feature_table" in out and "pipeline" not in out
    assert ("op1_packing" in out) == (TEXT is not None and skip == ("corpus_pipeline.py",))


def test_entry_with_an_emptied_folder(tmp_path):
    tree = copy(tmp_path, "llm")
    (tree / "crosspanel" / "llm").mkdir()
    assert "feature_table" in names(tree)


@pytest.mark.skipif(TEXT is None, reason="the text operators are not here")
def test_a_broken_operator_is_not_hidden(tmp_path):
    tree = copy(tmp_path)
    with open(tree / "crosspanel" / "llm" / "packing.py", "a") as f:
        f.write("\nimport a_module_that_is_missing\n")
    with pytest.raises(AssertionError, match="a_module_that_is_missing"):
        names(tree)
