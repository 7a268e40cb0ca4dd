"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def _names(at: Path) -> tuple[set[str], set[str]]:
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=at, capture_output=True, text=True, timeout=120, check=True).stdout.splitlines()
    return set(out[0].split()), set(out[1].split())


@pytest.mark.parametrize("gone", [["parquarry/llm"], ["parquarry/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_parts(tmp_path, gone):
    shutil.copytree(REPO / "parquarry", tmp_path / "parquarry", ignore=shutil.ignore_patterns("__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / f).exists():
            shutil.copy(REPO / f, tmp_path / f)
    for g in gone:
        p = tmp_path / g
        if p.is_dir():
            shutil.rmtree(p)
        else:
            p.unlink(missing_ok=True)
    names, sql = _names(tmp_path)
    from parquarry import queries as core

    assert set(core.QUERIES) <= names and set(core.ORACLE) <= sql and "pipeline" not in names
    if "parquarry/llm" in gone:
        assert names == set(core.QUERIES) and sql == set(core.ORACLE)


def test_oracles_name_queries():
    names, sql = _names(REPO)
    assert sql <= names
