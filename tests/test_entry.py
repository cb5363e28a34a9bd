"""The entry works without the training-data subpackage, whether or not the pipeline file is there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = (
    "import sys, __spark_entry__ as e; q, s = e.queries(), e.oracle_sql();"
    "assert set(s) <= set(q) and len(q) > 50, len(q);"
    "assert not [n for n in q if n.startswith('op') or n == 'pipeline'], q.keys();"
    "import bench; assert not [m for m in sys.modules if m.startswith('tessera.llm')]"
)


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import tessera.llm.mixing\n") if with_pipeline else None
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_nothing_outside_the_subpackage_imports_it():
    for path in [p for p in (ROOT / "tessera").rglob("*.py") if "llm" not in p.parts]:
        assert "tessera.llm" not in path.read_text(), path
