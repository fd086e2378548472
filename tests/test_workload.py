"""Every workload query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from mnemo import errors as E
from mnemo import workload as W

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else str(x) if hasattr(x, "isoformat") else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(W.QUERIES))
def test_query(spark, duck, name):
    df = W.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(W.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert norm(df.select(*[f"`{c}`" for c in cols]).collect()) == norm([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Tables whose region r1, customers c1 and c5 and order o1 each reach more nodes than a traversal's default limit."""
    folder, con, n = str(tmp_path_factory.mktemp("wide")), duckdb.connect(), 100_002
    for name, rows in {
        "nation": "select i as n_nationkey, i % 5 as n_regionkey from range(25) t(i)",
        "supplier": "select i as s_suppkey, i as s_nationkey from range(25) t(i)",
        "customer": f"select i as c_custkey, 6 as c_nationkey from range({n}) t(i)",
        "orders": f"select i as o_orderkey, 1 as o_custkey from range({n}) t(i)",
        "lineitem": f"select 1 as l_orderkey, i as l_partkey, i % 25 as l_suppkey from range({n}) t(i)",
    }.items():
        con.execute(f"copy ({rows}) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["bfs_in", "bfs_out", "bfs_both", "bfs_any_type", "bfs_min2"])
def test_traversal_of_any_width(spark, wide, name):
    folder, con = wide
    rows = norm(W.QUERIES[name](spark, folder).select("start", "node", "depth").collect())
    assert len(rows) > 100_000
    assert rows == norm(con.execute(W.ORACLES[name]).fetchall())


def test_an_engine_limits_traversals_by_default(spark, wide):
    with pytest.raises(E.BfsVisitedExceeded):
        W._graph(spark, wide[0]).bfs(["r1"], ["LOCATED_IN"], "in", 1, 2)
