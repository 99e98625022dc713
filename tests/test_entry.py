import importlib
import sys
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
import bench
from duolattice import queries as core


def test_registry_without_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("duolattice.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("duolattice.llm", "corpus_pipeline")) else found(name, *a))
    alone = importlib.reload(entry)
    assert alone.queries().keys() == core.QUERIES.keys()
    monkeypatch.undo()
    importlib.reload(entry)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["n", "ngram", "cnt"]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    got = core.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "part", "events", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(core.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    value = lambda v: round(float(v), 5) if isinstance(v, (float, Decimal)) else v
    rows = lambda found: Counter(tuple(map(value, r)) for r in found)
    assert rows(got.select(*columns).collect()) == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_bench_names_queries():
    assert set(bench.HEADLINE) <= set(entry.queries()) and "lattice_log_partition" in bench.HEADLINE
