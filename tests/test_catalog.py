"""Registered queries against their SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from lumenfold.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("retrieve_keyword", "retrieve_hybrid", "agg_exact_chunk_metrics", "fn_drop_dup_lines", "fn_header_footer", "agg_alignment", "distinct_chunks", "join_evidence_ids", "upsert_memory", "win_pair_exchanges", "source_guard", "split_table_rows")
NAMES = sorted(catalog.ORACLE_SQL) if os.environ.get("LUMENFOLD_ALL_QUERIES") else SOME


def plain(v):
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = catalog.QUERIES[name](spark, str(DATA))
    oracle = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(oracle.columns)
    at = [oracle.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in oracle.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == expected


def test_entry_points_without_the_optional_subpackage(monkeypatch):
    import importlib
    import sys

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("lumenfold.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m == "__spark_entry__" or m.startswith("lumenfold.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
