"""The entry module with and without the subpackage for training data."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
made, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(made)
print(len(made), sum(n.startswith("op") or n == "pipeline" for n in made))
"""


def run_in(folder: Path) -> tuple[int, int]:
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return tuple(map(int, done.stdout.split()))


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    """The rest lists its queries, whether or not the pipeline's file is left behind."""
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    n, numbered = run_in(tmp_path / "copy")
    assert n > 100 and numbered == 0


def test_an_error_in_a_part_is_told(tmp_path):
    """What a part that is there fails to import isn't taken for its absence."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (tmp_path / "copy" / "emberlog" / "llm").mkdir()
    (tmp_path / "copy" / "emberlog" / "llm" / "__init__.py").write_text("")
    (tmp_path / "copy" / "emberlog" / "llm" / "registry.py").write_text("import no_such_module\n")
    with pytest.raises(AssertionError, match="no_such_module"):
        run_in(tmp_path / "copy")
