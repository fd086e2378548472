"""Predicates, vectors, formulas, traversal and write rules as pure functions."""

import pytest
from pyspark.sql import functions as F

from mnemo import errors as E
from mnemo.functions import predicates as P
from mnemo.functions.formula import Formula
from mnemo.functions.vectors import cosine, quantized, storage_bytes
from mnemo.operators import changes, graph, policy, vector
from mnemo.operators.graph import Step


def test_null_rules(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (None, "b_")], "i int, s string")
    got = df.select(P.in_list(F.col("i"), [1, None], True).alias("a"), P.like(F.col("s"), "a%", True).alias("b"), P.like(F.col("s"), "_b").alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, False, True), (True, True, False), (None, True, False)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [0.6, 0.8])], "id int, v array<float>")
    got = {r.id: round(r.s, 4) for r in df.select("id", cosine(F.col("v"), [1.0, 0.0]).alias("s")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.6}
    assert [r.id for r in vector.top_k(df, "v", [1.0, 0.0], 2, "id").collect()] == [1, 5]
    same = spark.createDataFrame([([0.5, 0.5],), ([0.0, 1.0, 0.3],)], "v array<float>").select(quantized(F.col("v"), "SQ4").alias("q")).collect()
    assert same[0].q == [0.5, 0.5] and abs(same[1].q[2] - 0.3) < 1 / 15
    assert (storage_bytes(128), storage_bytes(128, "SQ8"), storage_bytes(5, "SQ4")) == (512, 136, 11)
    with pytest.raises(E.UnboundedVectorSearch):
        vector.top_k(df, "v", [1.0, 0.0], None, "id")


def test_formula(spark):
    f = Formula("coalesce({a}, 1.5) * ({b} + 2) + {vector_score}")
    assert f.columns == ["a", "b", "vector_score"]
    df = spark.createDataFrame([(None, True, 0.5), (2.0, False, 0.0), (1.0, None, 0.0)], "a double, b boolean, vector_score double")
    assert [r[0] for r in df.select(f.column(F.col)).collect()] == [5.0, 4.0, None]
    for bad in ("{a} -", "coalesce({a}, {b})", "{a} {b}", "max({a})"):
        with pytest.raises(E.RankPolicyInvalid):
            Formula(bad)


def test_traversal_edge_cases(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "y"), ("d", "e", "y"), ("e", "f", "y")], "source_id string, target_id string, edge_type string")
    starts = spark.createDataFrame([("a",), ("a",), (None,)], "start string")
    got = {r.node: r.depth for r in graph.bfs(edges, starts, None, "out", 1, 10).collect()}
    assert got == {"b": 1, "c": 2, "d": 3, "e": 4, "f": 5}
    assert {r.node for r in graph.bfs(edges, starts, ["x"], "both", 1, 1).collect()} == {"b", "c"}
    with pytest.raises(E.BfsVisitedExceeded):
        graph.bfs(edges, starts, None, "out", 1, 5, most_visited=3)
    assert graph.bfs(edges, starts.limit(0), None, "out", 1, 3).count() == 0
    pattern = graph.match(edges, starts, [Step("x", "out", 1, 2, "m"), Step("y", "out", 1, 1, "z")])
    assert [tuple(r) for r in pattern.collect()] == [("a", "c", "d", "d", 3)]
    assert graph.has_cycle(edges, "x") and not graph.has_cycle(edges, "y")


def test_write_rules(spark):
    cur = spark.createDataFrame([(1, "a", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 2), (2, "d", 3), (None, "e", 4)], "k int, v string, o int")
    assert sorted((r.k or 0, r.v) for r in policy.unique_noop(cur, new, ["k"], "o").collect()) == [(0, "e"), (2, "c")]
    assert sorted((r.k, r.v) for r in policy.upsert(cur, new.where("k is not null"), ["k"], ["v"], "o").collect()) == [(1, "b"), (2, "d")]
    rows = spark.createDataFrame([(1, 10, 5), (2, None, 6), (3, 2**63 - 1, 7)], "id int, e long, lsn long")
    assert [r.id for r in policy.unexpired(rows, 100, expires="e").collect()] == [2, 3]
    assert [r.id for r in policy.unexpired(rows, 100, expires="e", lsn="lsn", sync_watermark=5).collect()] == [1, 2, 3]
    assert [r.id for r in policy.unexpired(rows, 100, created="e", ttl_ms=50).collect()] == [2, 3]


def test_change_policies(spark):
    local = spark.createDataFrame([(1, "l", 5), (2, "l", 5)], "k int, v string, lsn int")
    feed = spark.createDataFrame([(1, "r", 6, "upsert"), (2, "r", 4, "upsert"), (3, "r", 1, "upsert")], "k int, v string, lsn int, op string")
    get = lambda p: sorted((r.k, r.v) for r in changes.apply_changes(local, feed, ["k"], p).collect())
    assert get("LatestWins") == [(1, "r"), (2, "l"), (3, "r")]
    assert get("ServerWins") == get("InsertIfNotExists") == [(1, "l"), (2, "l"), (3, "r")]
    assert get("EdgeWins") == [(1, "r"), (2, "r"), (3, "r")]
    assert changes.conflicts(local, feed, ["k"], "InsertIfNotExists").count() == 0
    assert changes.remapped("ServerWins") == "EdgeWins"


def test_reaches_long_path(spark):
    edges = spark.range(70).selectExpr("cast(id as string) as source_id", "cast(id + 1 as string) as target_id", "'x' as edge_type")
    pair = spark.createDataFrame([("70", "0"), ("71", "0")], "source_id string, target_id string")
    assert [tuple(r) for r in graph.reaches(edges, pair, "x").collect()] == [("70", "0")]
