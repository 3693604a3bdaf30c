"""The driver contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    if os.path.exists(__spark_entry__.ENTRY_DIR):
        df = __spark_entry__.entry(spark)
        assert df.columns == ["id", "partition", "offset", "type", "key", "data"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(tmp_path):
    """Imports in a copy from which the subpackage, the pipeline and their tests are gone."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda folder, names: {x for x in names if x in (".git", "llm", "corpus_pipeline.py", "spark-warehouse")})
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(x.startswith('op') or x == 'pipeline' for x in q); assert len(e.oracle_sql()) > 40"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidelog.llm" not in path.read_text()


@pytest.mark.parametrize("name", ["corpus_pipeline.py", "tidelog/llm"])
def test_no_swallowed_imports(name):
    path = ROOT / name
    for file in [path] if path.is_file() else path.rglob("*.py"):
        assert "ImportError" not in file.read_text()
