"""Every query with SQL gives what DuckDB gives, on the smallest tables; the entry module works without the llm part."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from orrery.plans.oracle import ORACLE
from orrery.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(v[i]) if isinstance(v[i], float) else str(v[i]) for i in order) for v in values))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    found = got.collect()
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, found) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["vec_id", "label"]


def test_without_the_language_model_part(tmp_path):
    """A copy of the repository without that part imports, and has all other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for p in ("orrery", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{p}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "orrery/llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))]
