import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sievelog import queries as search

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 12


def plain(value):
    return tuple(value) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(search.QUERIES))
def test_query_as_sql(spark, con, name):
    df = search.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    sql = con.sql(search.ORACLES[name])
    assert sorted(sql.columns) == columns
    assert mine == sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({search.ORACLES[name]})").fetchall()), key=repr)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(search.ORACLES) == set(search.QUERIES)


_CODE = "import __spark_entry__ as e; n = e.queries(); e.oracle_sql(); assert 'search_and' in n; print(any(x.startswith('op') or x == 'pipeline' for x in n))"


def _run(copy):
    return subprocess.run([sys.executable, "-c", _CODE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)


@pytest.fixture()
def copy(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    return tmp_path / "repo"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_operators(copy, pipeline):
    """The two folders are deleted, with the pipeline's file or without: the rest imports and lists its queries."""
    shutil.rmtree(copy / "sievelog" / "llm")
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    ran = _run(copy)
    assert (ran.returncode, ran.stdout) == (0, "False\n"), ran.stderr


def test_a_broken_part_is_not_hidden(copy):
    (copy / "sievelog" / "llm").mkdir(exist_ok=True)
    (copy / "sievelog" / "llm" / "queries.py").write_text("import no_such_module")
    ran = _run(copy)
    assert ran.returncode != 0 and "no_such_module" in ran.stderr
