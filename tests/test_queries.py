"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os
import pathlib
import shutil
import subprocess
import sys

import pytest

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

duckdb = pytest.importorskip("duckdb")
catalog = pytest.importorskip("tessera.catalog")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if not isinstance(v, int) or isinstance(v, bool) else float(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((x is not None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    got = rows(df.columns, df.collect())
    cur = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, D)
    assert all(len(r) == len(df.columns) for r in df.collect())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("gone", [("tessera/llm",), ("tessera/llm", "corpus_pipeline.py")], ids=["folder", "folder and pipeline"])
def test_entry_without_corpus_operators(tmp_path, gone):
    root = pathlib.Path(__file__).parents[1]
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists() and name not in gone:
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_resolve' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
