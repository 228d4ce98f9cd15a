"""The entry file without the training-data sub-package, as a copy of the tree."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from strandline.plans import catalogue

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [("strandline/llm", "tests/llm"), ("strandline/llm", "tests/llm", "corpus_pipeline.py")])
@pytest.mark.parametrize("emptied", [False, True])
def test_entry_without_the_optional_part(tmp_path, gone, emptied):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        if (tree / name).is_dir():
            shutil.rmtree(tree / name)
            if emptied:
                (tree / name).mkdir()
        else:
            (tree / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) + sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tree, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.strip() == str(sorted(catalogue.QUERIES) + sorted(catalogue.ORACLES))
