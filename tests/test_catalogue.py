"""Registered queries against their SQL twins, and the driver's entry points without the corpus operators."""

import datetime
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from graphweft import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert ours == theirs


def test_entry_points():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) >= 80


def test_pruning_reaches_the_scan(spark):
    """A count over a pattern reads the keys alone, and a filter is pushed into the files."""
    plan = catalogue.queries()["flagship"](spark, DATA)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "GreaterThan(o_totalprice,100000.0)" in physical
    assert "o_orderdate" not in physical and "c_name" not in physical


@pytest.mark.parametrize("name,most", [("expand_into", 5), ("optional_match", 2), ("exists_or", 4), ("pattern_comprehension", 2), ("graph_fns", 4), ("path_functions", 12)])
def test_tables_are_read_once(spark, name, most):
    """Rows outside a subquery are planned once; paths and ends read only tables that can hold them."""
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert plan[plan.index("== Physical Plan ==") :].count("FileScan") <= most


@pytest.mark.parametrize("name,scans", [("expand_multi_type", 2), ("edge_index_scan", 1)])
def test_unread_ends_need_no_join(spark, name, scans):
    """Of ends that only count, the edges know the labels: no sort or join of the edges, so a task's memory doesn't grow with them."""
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Join" not in physical and "Sort" not in physical and physical.count("FileScan") == scans


def test_walk_is_lazy_and_bounded(spark):
    plan = catalogue.queries()["varlen_bounded"](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_whole_tables_are_covered(spark, duck):
    """Queries over all rows grow with the tables: every order with two lines or more, every customer."""
    q = catalogue.queries()
    orders = duck.execute(f"SELECT count(*) FROM (SELECT l_orderkey FROM ({catalogue.LINES}) GROUP BY 1 HAVING count(*) > 1)").fetchone()[0]
    assert q["rel_uniqueness"](spark, DATA).count() == orders
    assert q["graph_fns"](spark, DATA).count() == duck.execute("SELECT count(*) FROM orders").fetchone()[0]
    customers, most = duck.execute("SELECT count(*), max(c_custkey) FROM customer").fetchone()
    assert q["expand_both"](spark, DATA).selectExpr("max(a)").first()[0] == most
    assert q["varlen_cycle_trail"](spark, DATA).select("c").distinct().count() > customers // 2
