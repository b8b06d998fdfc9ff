"""Registered queries against their SQL in another engine, on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import registry

ROOT = Path(__file__).resolve().parents[1]
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.queries()[name](spark, SMALL)
    there = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(there.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[there.columns.index(c)]) for c in columns) for r in there.fetchall()), key=repr)
    assert mine == theirs


def test_anchor_group_against_a_loop(spark):
    found = {}
    for r in registry.queries()["anchor_group"](spark, SMALL).collect():
        found.setdefault(r["o_custkey"], []).append((r["price"], r["grp"]))
    for rows in found.values():
        rows.sort()
        anchor, n = None, -1
        for price, grp in rows:
            if anchor is None or abs(price - anchor) > 5000.0:
                anchor, n = price, n + 1
            assert grp == n


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", ["ahocorasick", "xxhash", "quillspark.llm", "corpus_pipeline"])
def test_entry_imports_without_optional_parts(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[0]) >= len(registry.queries()), done.stderr
