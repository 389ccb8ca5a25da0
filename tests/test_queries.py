"""Registered queries next to their SQL; ``tools/check.py`` runs all of them."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.plans import catalog
from cairn.plans.views import TABLES
from tools.check import norm

SF = "/root/testdata/sf0.001"
SOME = ["join2", "win1", "agg5", "sc8", "agg15", "win5", "q4", "q15", "str2", "set6", "join20", "src9"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got and got == want


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {n for n in queries if n not in catalog.QUERIES}
    assert set(queries) - set(oracles) - own == {"fn23", "gr1", "gr2", "gr10"}


def test_library_without_the_text_operators(tmp_path):
    """A copy without them still imports and keeps all queries over routes."""
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root / "cairn", copy / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, copy / name)
    names = "import __spark_entry__ as e, bench; print(*sorted(e.queries()), sep=chr(10))"
    for present in (True, False):
        if not present:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        run = subprocess.run([sys.executable, "-c", names], cwd=copy, capture_output=True, text=True, timeout=120)
        assert run.returncode == 0, run.stderr
        assert set(run.stdout.split()) == set(catalog.QUERIES)
