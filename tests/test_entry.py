"""The registered queries against their SQL, and an import without the optional parts."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold.plans import registry


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return c


def plain(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, con, sf, name):
    df = registry.QUERIES[name](spark, sf)
    result = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=key)
    assert got == want


def test_every_query_is_registered():
    assert registry.QUERIES.keys() <= entry.queries().keys() and registry.ORACLE_SQL.keys() <= entry.oracle_sql().keys()


def test_features_for_every_candidate(spark):
    """string_features has the pairs of all three retrievers at 20 a source, also those that the address view alone finds."""
    from kinfold.operators import simjoin, views
    from kinfold.operators.normalize import normalize
    from kinfold.plans import views as v

    a, b = v.split_sources(normalize(v.records(spark, entry.SMOKE)).cache())
    want = set()
    for name in ("combo", "skel", "addr"):
        want |= {tuple(r) for r in simjoin.retrieve(a, b, views.Retriever(name, views.RETRIEVERS[name].view, k=20)).select("s1_id", "cand_id").collect()}
    rows = registry.string_features(spark, entry.SMOKE).select("s1_id", "cand_id").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_entry_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "kinfold").mkdir()
    for x in os.listdir(f"{root}/kinfold"):
        if x != "llm":
            os.symlink(f"{root}/kinfold/{x}", tmp_path / "kinfold" / x)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; assert e.queries().keys() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries() if q[2:3].isdigit() or q == 'pipeline'); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
