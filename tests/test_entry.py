"""The entry points, with and without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "region" and df.count() > 0


def test_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _copy(folder, without):
    for p in ROOT.iterdir():
        if p.name not in {".git", "tests", "odweave", *without}:
            (folder / p.name).symlink_to(p)
    (folder / "odweave").mkdir()
    for p in (ROOT / "odweave").iterdir():
        if p.name != "llm":
            (folder / "odweave" / p.name).symlink_to(p)


@pytest.mark.parametrize("without", [(), ("corpus_pipeline.py",)])
@pytest.mark.parametrize("path", ["", str(ROOT)])
def test_works_without_the_optional_parts(tmp_path, without, path):
    """A copy without the subpackage still imports and lists its own queries, with this repository on the path or not."""
    _copy(tmp_path, without)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q and not [n for n in q if n.startswith('op') and n[2].isdigit()], q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": path} if path else {})
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env=env)


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "odweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "odweave").parts:
            assert "odweave.llm" not in p.read_text()
