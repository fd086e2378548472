"""Named queries on the driver tables, run by the engine, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.operators import changes, policy
from mnemo.session import Engine
from mnemo.sources.shared import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Written edges and loaded engines that queries only read, by Spark application and folder.
_GRAPHS: dict = {}
_LOADED: dict = {}
#: The first half of the events.
_EARLY = "event_id * 2 < (select max(event_id) from events)"


def _engine(spark, d, *names: str) -> Engine:
    """A new engine with driver tables attached."""
    db = Engine(spark)
    for n in names:
        db.attach(n, table(spark, d, n))
    return db


def _loaded(spark, d, name: str, columns: str) -> Engine:
    """A new engine with a driver table inserted into its store."""
    db = Engine(spark)
    db.execute(f"CREATE TABLE {name} ({columns})")
    db.insert_rows(name, table(spark, d, name))
    return db


def _halves(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), "event_type", "value", "event_id")
    last = rows.agg(F.max("event_id")).first()[0]
    return rows.where(F.col("event_id") * 2 < last), rows.where(F.col("event_id") * 2 >= last)


def _two_commits(spark, d):
    """(engine, number before, number between): the latest event of each user, after each half of the events."""
    db, (early, late) = Engine(spark), _halves(spark, d)
    db.execute("CREATE TABLE latest (user_id INTEGER PRIMARY KEY, event_id INTEGER, event_type TEXT)")
    before = db.snapshot()
    db.upsert_rows("latest", early.orderBy("event_id"), "user_id", ["event_id", "event_type"])
    between = db.snapshot()
    db.upsert_rows("latest", late.orderBy("event_id"), "user_id", ["event_id", "event_type"])
    return db, before, between


def _vectors(spark, d, kind: str) -> Engine:
    """An engine with embeddings, and labels for their rank policy, loaded once per application, folder and kind."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _LOADED:
        db = _LOADED[key] = Engine(spark)
        db.execute("CREATE TABLE labels (doc_id INTEGER PRIMARY KEY, quality INTEGER, toxic INTEGER)")
        db.execute(f"CREATE TABLE vectors (vec_id INTEGER PRIMARY KEY, embedding {kind})")
        if "RANK_POLICY" in kind:
            db.insert_rows("labels", table(spark, d, "labels"))
        db.insert_rows("vectors", table(spark, d, "embeddings").orderBy("vec_id"))
    return _LOADED[key]


def _policy(formula: str) -> str:
    return f"VECTOR(64) RANK_POLICY (JOIN labels ON doc_id, FORMULA '{formula}', SORT_KEY eff)"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# Scans, projection, predicates


@query("select n_nationkey as id, n_name as nation, n_regionkey + 1 as region_plus from nation")
def scan_project_alias(spark, d):
    return _engine(spark, d, "nation").execute("SELECT n_nationkey AS id, n_name AS nation, n_regionkey + 1 AS region_plus FROM nation")


@query("select * from region")
def select_star(spark, d):
    return _engine(spark, d, "region").execute("SELECT * FROM region")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where (l_quantity > 45 and l_discount >= 0.05) or not (l_tax <> 0.0 or l_quantity <= 40)")
def filter_compare_and_or_not(spark, d):
    return _engine(spark, d, "lineitem").execute("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_discount >= 0.05) OR NOT (l_tax <> 0.0 OR l_quantity <= 40)")


@query("select o_orderkey, o_orderpriority from orders where (nullif(o_orderstatus, 'F') = 'O' or nullif(o_orderpriority, '1-URGENT') is null) and not (nullif(o_orderstatus, 'P') is null)")
def filter_null_kleene(spark, d):
    db = _engine(spark, d)
    db.attach("holed", table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"), F.nullif("o_orderstatus", F.lit("P")).alias("t")))
    return db.execute("SELECT o_orderkey, o_orderpriority FROM holed WHERE (s = 'O' OR p IS NULL) AND NOT (t IS NULL)")


@query("select p_partkey, p_size from part where p_size in (1, 5, 9)")
def in_list(spark, d):
    return _engine(spark, d, "part").execute("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, NULL)")


@query("select p_partkey, p_size from part where p_size not in (1, 5, 9)")
def not_in_list_null(spark, d):
    return _engine(spark, d, "part").execute("SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 5, 9, NULL)")


@query("select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def in_subquery(spark, d):
    return _engine(spark, d, "orders", "customer").execute("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")


@query("select c_custkey, c_name from customer where c_custkey is not null and c_custkey not in (select nullif(o_custkey, 7) from orders where nullif(o_custkey, 7) is not null)")
def not_in_subquery(spark, d):
    db = _engine(spark, d, "customer")
    db.attach("holed", table(spark, d, "orders").select(F.nullif("o_custkey", F.lit(7)).alias("k")))
    return db.execute("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM holed)")


@query("select p_partkey, p_name from part where p_name like '%a%e_'")
def like(spark, d):
    return _engine(spark, d, "part").execute("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e_'")


@query("select p_partkey, p_type from part where not coalesce(nullif(p_type, 'ECONOMY') like 'S%', false)")
def not_like_null(spark, d):
    db = _engine(spark, d)
    db.attach("holed", table(spark, d, "part").select("p_partkey", "p_type", F.nullif("p_type", F.lit("ECONOMY")).alias("k")))
    return db.execute("SELECT p_partkey, p_type FROM holed WHERE k NOT LIKE 'S%'")


@query("select o_orderkey, o_totalprice from orders where o_totalprice between 1000 and 50000")
def between(spark, d):
    return _engine(spark, d, "orders").execute("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")


@query("select o_orderkey, o_totalprice from orders where not (o_totalprice between 1000 and 50000)")
def not_between(spark, d):
    return _engine(spark, d, "orders").execute("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 50000)")


@query("select p_partkey, p_size // 3 as third, p_size * 2 - 7 as shifted from part")
def arith_int_trunc(spark, d):
    return _engine(spark, d, "part").execute("SELECT p_partkey, p_size / 3 AS third, p_size * 2 - 7 AS shifted FROM part")


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / l_quantity as unit from lineitem where l_quantity > 0")
def arith_mixed(spark, d):
    return _engine(spark, d, "lineitem").execute("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / l_quantity AS unit FROM lineitem WHERE l_quantity > 0")


@query("select p_partkey, -p_size as neg, -(p_retailprice) as negprice from part")
def unary_neg(spark, d):
    return _engine(spark, d, "part").execute("SELECT p_partkey, -p_size AS neg, -(p_retailprice) AS negprice FROM part")


@query("select p_partkey, coalesce(nullif(p_size, 1), nullif(p_size, 2), -1) as size from part")
def coalesce_mixed(spark, d):
    db = _engine(spark, d)
    db.attach("holed", table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("a"), F.nullif("p_size", F.lit(2)).alias("b")))
    return db.execute("SELECT p_partkey, COALESCE(a, b, -1) AS size FROM holed")


@query("select r_regionkey, 42 as answer, 2.5 as half, 'it''s' as quoted, true as yes from region")
def literals(spark, d):
    return _engine(spark, d, "region").execute("SELECT r_regionkey, 42 AS answer, 2.5 AS half, 'it''s' AS quoted, TRUE AS yes FROM region")


@query("select c_custkey, c_acctbal from customer where c_mktsegment = 'MACHINERY' and c_acctbal > 100")
def params(spark, d):
    return _engine(spark, d, "customer").execute("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = $segment AND c_acctbal > $least", {"segment": "MACHINERY", "least": 100})


@query("select event_id, ts from events where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-12 00:00:00'")
def timestamp_range(spark, d):
    return _engine(spark, d, "events").execute("SELECT event_id, ts FROM events WHERE ts >= '2024-01-10 00:00:00' AND ts < '2024-01-12 00:00:00'")


@query("select * from orders where o_orderkey = 77")
def point_lookup(spark, d):
    return _engine(spark, d, "orders").point_lookup("orders", "o_orderkey", 77)


# Joins


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def join_inner(spark, d):
    return _engine(spark, d, "nation", "region").execute("SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey")


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000")
def join_left(spark, d):
    return _engine(spark, d, "customer", "orders").execute("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")


@query("select s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA'")
def join_chain(spark, d):
    return _engine(spark, d, "supplier", "nation", "region").execute("SELECT s_name, n_name, r_name FROM supplier INNER JOIN nation ON s_nationkey = n_nationkey INNER JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")


@query("select a.n_name as low, b.n_name as high from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    return _engine(spark, d, "nation").execute("SELECT a.n_name AS low, b.n_name AS high FROM nation a INNER JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("with big as (select o_custkey as k, o_orderkey from orders where o_totalprice > 200000) select c_name, o_orderkey from customer join big on c_custkey = k")
def join_cte(spark, d):
    return _engine(spark, d, "orders", "customer").execute("WITH big AS (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_totalprice > 200000) SELECT c_name, o_orderkey FROM customer INNER JOIN big ON c_custkey = k")


# Aggregation, ordering


@query("select count(*) as n from orders where o_orderstatus = 'F'")
def count_star(spark, d):
    return _engine(spark, d, "orders").execute("SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'")


@query("select count(nullif(o_orderpriority, '5-LOW')) as n from orders")
def count_col(spark, d):
    db = _engine(spark, d)
    db.attach("holed", table(spark, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")))
    return db.execute("SELECT COUNT(p) AS n FROM holed")


@query("select count(*) as all_rows, count(o_orderkey) as keyed, count(nullif(o_orderstatus, 'F')) as open_rows from orders")
def multi_count(spark, d):
    db = _engine(spark, d)
    db.attach("holed", table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s")))
    return db.execute("SELECT COUNT(*) AS all_rows, COUNT(o_orderkey) AS keyed, COUNT(s) AS open_rows FROM holed")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct(spark, d):
    return _engine(spark, d, "lineitem").execute("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


@query("select p_partkey, nullif(p_size, 50) as size from part order by size desc nulls first, p_partkey limit 25")
def order_limit_nulls(spark, d):
    db = _engine(spark, d)
    db.attach("holed", table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(50)).alias("size")))
    return db.execute("SELECT p_partkey, size FROM holed ORDER BY size DESC, p_partkey LIMIT 25")


@query("select 1 as one, 'x' as letter")
def dual_select(spark, d):
    return _engine(spark, d).execute("SELECT 1 AS one, 'x' AS letter")


# Graph.  The SQL of the traversals bounds no visited nodes, so they lift the engine's default limit.


def edges_of(spark, d):
    """Edges from the driver tables' foreign keys; ids are a letter and a key."""
    t = lambda n: table(spark, d, n)
    e = lambda df, a, b, kind: df.select(F.expr(a).alias("source_id"), F.expr(b).alias("target_id"), F.lit(kind).alias("edge_type"))
    parts = [
        e(t("supplier"), "concat('s', s_suppkey)", "concat('n', s_nationkey)", "LOCATED_IN"),
        e(t("customer"), "concat('c', c_custkey)", "concat('n', c_nationkey)", "LOCATED_IN"),
        e(t("nation"), "concat('n', n_nationkey)", "concat('r', n_regionkey)", "LOCATED_IN"),
        e(t("orders"), "concat('c', o_custkey)", "concat('o', o_orderkey)", "PLACED"),
        e(t("lineitem"), "concat('o', l_orderkey)", "concat('p', l_partkey)", "CONTAINS").distinct(),
        e(t("lineitem"), "concat('p', l_partkey)", "concat('s', l_suppkey)", "SUPPLIED_BY").distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES = """edges as (
 select 's' || s_suppkey as a, 'n' || s_nationkey as b, 'LOCATED_IN' as t from supplier
 union all select 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN' from customer
 union all select 'n' || n_nationkey, 'r' || n_regionkey, 'LOCATED_IN' from nation
 union all select 'c' || o_custkey, 'o' || o_orderkey, 'PLACED' from orders
 union all select distinct 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS' from lineitem
 union all select distinct 'p' || l_partkey, 's' || l_suppkey, 'SUPPLIED_BY' from lineitem)"""


def _graph(spark, d) -> Engine:
    """An engine with the edges as an attached table, written once per application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _GRAPHS:
        _GRAPHS[key] = cut(edges_of(spark, d), "edges")
    db = Engine(spark)
    db.attach("edges", _GRAPHS[key])
    return db


def _bfs_sql(starts: str, hops: str, least: int, most: int) -> str:
    return f"""with recursive {EDGES}, hops as ({hops}), walk(start, node, depth) as (
 select s, s, 0 from (values {starts}) v(s) union select w.start, h.b, w.depth + 1 from walk w join hops h on w.node = h.a where w.depth < {most})
select start, node, min(depth) as depth from walk group by start, node having min(depth) between {least} and {most} and node <> start"""


@query(_bfs_sql("('c1'), ('c2'), ('c3')", "select a, b from edges where t in ('PLACED', 'CONTAINS')", 1, 2))
def bfs_out(spark, d):
    return _graph(spark, d).bfs(["c1", "c2", "c3"], ["PLACED", "CONTAINS"], "out", 1, 2, most_visited=None)


@query(_bfs_sql("('r1')", "select b as a, a as b from edges where t = 'LOCATED_IN'", 1, 2))
def bfs_in(spark, d):
    return _graph(spark, d).bfs(["r1"], ["LOCATED_IN"], "in", 1, 2, most_visited=None)


@query(_bfs_sql("('s0'), ('c5')", "select a, b from edges where t = 'LOCATED_IN' union all select b, a from edges where t = 'LOCATED_IN'", 1, 3))
def bfs_both(spark, d):
    return _graph(spark, d).bfs(["s0", "c5"], ["LOCATED_IN"], "both", 1, 3, most_visited=None)


@query(_bfs_sql("('o1'), ('o2')", "select a, b from edges", 1, 4))
def bfs_any_type(spark, d):
    return _graph(spark, d).bfs(["o1", "o2"], None, "out", 1, 4, most_visited=None)


@query(_bfs_sql("('c1')", "select a, b from edges where t in ('PLACED', 'CONTAINS', 'SUPPLIED_BY')", 2, 3))
def bfs_min2(spark, d):
    return _graph(spark, d).bfs(["c1"], ["PLACED", "CONTAINS", "SUPPLIED_BY"], "out", 2, 3, most_visited=None)


@query(f"""with recursive {EDGES}, walk(start, node, depth) as (
 select s, s, 0 from (select 's' || s_suppkey as s from supplier where s_nationkey = 3) union select w.start, h.b, w.depth + 1 from walk w join edges h on w.node = h.a and h.t = 'LOCATED_IN' where w.depth < 2)
select start, node, min(depth) as depth from walk where node <> start group by start, node""")
def bfs_multi_start(spark, d):
    starts = table(spark, d, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("start"))
    return _graph(spark, d).bfs(starts, ["LOCATED_IN"], "out", 1, 2, most_visited=None)


@query("""select 'c' || min(o_custkey) as a, 'o' || l_orderkey as o, 'p' || l_partkey as p, 'p' || l_partkey as id, 2 as depth
from orders join lineitem on o_orderkey = l_orderkey where o_custkey in (1, 2, 4) group by l_orderkey, l_partkey""")
def match_two_step(spark, d):
    pattern = "edges MATCH (a)-[:PLACED]->(o)-[:CONTAINS]->(p) WHERE a.id IN ('c1', 'c2', 'c4') COLUMNS (a.id AS a, o.id AS o, p.id AS p, id, depth)"
    return _graph(spark, d).execute(f"SELECT a, o, p, id, depth FROM GRAPH_TABLE({pattern})")


@query("""select 's0' as a, 'n' || s.s_nationkey as n, 'c' || c_custkey as c, 'c' || c_custkey as id, 2 as depth from supplier s join customer on c_nationkey = s.s_nationkey where s.s_suppkey = 0
union all select 's0', 'n' || s.s_nationkey, 's' || o.s_suppkey, 's' || o.s_suppkey, 2 from supplier s join supplier o on o.s_nationkey = s.s_nationkey where s.s_suppkey = 0""")
def match_mixed_dir(spark, d):
    pattern = "edges MATCH (a)-[:LOCATED_IN]->(n)<-[:LOCATED_IN]-(c) WHERE a.id = 's0' COLUMNS (a.id AS a, n.id AS n, c.id AS c, id, depth)"
    return _graph(spark, d).execute(f"SELECT a, n, c, id, depth FROM GRAPH_TABLE({pattern})")


@query(f"""with recursive {EDGES}, walk(node, depth) as (
 select 'r2', 0 union select h.a, w.depth + 1 from walk w join edges h on w.node = h.b and h.t = 'LOCATED_IN' where w.depth < 2)
select s_name, s_acctbal, min(depth) as depth from walk join supplier on node = 's' || s_suppkey where s_acctbal > 0 group by s_name, s_acctbal""")
def graph_join_filter(spark, d):
    db = _graph(spark, d)
    db.attach("sites", table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), "s_name", "s_acctbal"))
    near = "WITH near AS (SELECT node, depth FROM GRAPH_TABLE(edges MATCH (r)<-[:LOCATED_IN]-{1,2}(b) WHERE r.id = 'r2' COLUMNS (b.id AS node, depth)))"
    return db.execute(f"{near} SELECT s.s_name, s.s_acctbal, n.depth FROM near n INNER JOIN sites s ON n.node = s.id WHERE s.s_acctbal > 0")


@query(f"with {EDGES} select a as source_id, count(*) as n from edges where t = 'PLACED' group by a")
def edge_count(spark, d):
    return _graph(spark, d).edge_counts("PLACED")


# Vectors and ranking


def _probe(spark, d, vec_id: int = 0) -> list[float]:
    """One query vector, by its key."""
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


_COS = "list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[])"


@query(f"select vec_id, label, round({_COS}, 6) as score from embeddings order by {_COS} desc, vec_id limit 10")
def vector_topk(spark, d):
    got = _engine(spark, d, "embeddings").execute("SELECT vec_id, label, score FROM embeddings ORDER BY embedding <=> $q LIMIT 10", {"q": _probe(spark, d)})
    return got.withColumn("score", F.round("score", 6))


@query(f"select vec_id, label, round({_COS}, 6) as score from embeddings where label in (1, 2, 3) order by {_COS} desc, vec_id limit 7")
def vector_prefilter(spark, d):
    got = _engine(spark, d, "embeddings").execute("SELECT vec_id, label, score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY embedding <=> $q LIMIT 7", {"q": _probe(spark, d)})
    return got.withColumn("score", F.round("score", 6))


@query(f"select vec_id, round({_COS}, 6) as score from embeddings where {_COS} >= 0.3 order by {_COS} desc, vec_id limit 200")
def vector_min_similarity(spark, d):
    got = _engine(spark, d, "embeddings").semantic_search("embeddings", "embedding", _probe(spark, d), 200, min_similarity=0.3)
    return got.select("vec_id", F.round("vector_score", 6).alias("score"))


@query(f"""select vec_id, round({_COS}, 6) as score from embeddings
where label in (select c_nationkey % 10 from customer where c_custkey in (1, 2)) order by {_COS} desc, vec_id limit 5""")
def vector_in_neighbourhood(spark, d):
    db = _graph(spark, d)
    near = db.bfs(["c1", "c2"], ["LOCATED_IN"], "out", 1, 1, most_visited=None)
    db.attach("near", near.select((F.expr("cast(substring(node, 2) as int)") % 10).alias("l")))
    db.attach("embeddings", table(spark, d, "embeddings"))
    got = db.execute("SELECT vec_id, score FROM embeddings WHERE label IN (SELECT l FROM near) ORDER BY embedding <=> $q LIMIT 5", {"q": _probe(spark, d)})
    return got.withColumn("score", F.round("score", 6))


def _quantized_sql(levels: int) -> str:
    return f"""with e as (select vec_id, embedding::double[] as v, list_min(embedding)::double as lo, list_max(embedding)::double as hi from embeddings),
q as (select vec_id, list_transform(v, lambda x: lo + floor((x - lo) / ((hi - lo) / {levels}.0) + 0.5) * ((hi - lo) / {levels}.0)) as v from e),
s as (select vec_id, list_cosine_similarity(v, (select embedding from embeddings where vec_id = 0)::double[]) as s from q)
select vec_id, round(s, 5) as score from s order by s desc, vec_id limit 10"""


@query(_quantized_sql(255))
def vector_sq8(spark, d):
    db = _vectors(spark, d, "VECTOR(64) WITH (quantization = 'SQ8')")
    got = db.execute("SELECT vec_id, score FROM vectors ORDER BY embedding <=> $q LIMIT 10", {"q": _probe(spark, d)})
    return got.withColumn("score", F.round("score", 5))


@query(_quantized_sql(15))
def vector_sq4(spark, d):
    db = _vectors(spark, d, "VECTOR(64) WITH (quantization = 'SQ4')")
    got = db.execute("SELECT vec_id, score FROM vectors ORDER BY embedding <=> $q LIMIT 10", {"q": _probe(spark, d)})
    return got.withColumn("score", F.round("score", 5))


@query(f"""select vec_id, round({_COS}, 6) as vector_score, round({_COS} * (coalesce(quality, 1) + 0.5), 6) as rank from embeddings left join labels on vec_id = doc_id
order by {_COS} * (coalesce(quality, 1) + 0.5) desc, {_COS} desc, vec_id desc limit 10""")
def rank_policy(spark, d):
    db = _vectors(spark, d, _policy("{vector_score} * (coalesce({quality}, 1.0) + 0.5)"))
    got = db.execute("SELECT vec_id, vector_score, rank FROM vectors ORDER BY embedding <=> $q USE RANK eff LIMIT 10", {"q": _probe(spark, d)})
    return got.select("vec_id", F.round("vector_score", 6).alias("vector_score"), F.round("rank", 6).alias("rank"))


@query(f"""select vec_id, round({_COS}, 6) as vector_score from embeddings left join labels on vec_id = doc_id
order by quality is null, {_COS} * quality desc, {_COS} desc, vec_id desc limit 300""")
def rank_null_fallback(spark, d):
    db = _vectors(spark, d, _policy("{vector_score} * {quality}"))
    got = db.execute("SELECT vec_id, vector_score FROM vectors ORDER BY embedding <=> $q USE RANK eff LIMIT 300", {"q": _probe(spark, d)})
    return got.select("vec_id", F.round("vector_score", 6).alias("vector_score"))


@query(f"""select vec_id, round({_COS} + coalesce(quality, 0.0), 6) as rank from embeddings left join labels on vec_id = doc_id where {_COS} >= 0.0
order by {_COS} + coalesce(quality, 0.0) desc, {_COS} desc, vec_id desc limit 20""")
def rank_orphan(spark, d):
    db = _vectors(spark, d, _policy("{vector_score} + coalesce({quality}, 0.0)"))
    got = db.semantic_search("vectors", "embedding", _probe(spark, d), 20, "eff", min_similarity=0.0)
    return got.select("vec_id", F.round("rank", 6).alias("rank"))


@query(f"""with top as (select vec_id, label from embeddings order by {_COS} desc, vec_id limit 5), reached as (select distinct d.doc_id from top join documents d on d.doc_id % 10 = top.label)
select d.doc_id, d.lang, l.quality from reached r join documents d on r.doc_id = d.doc_id join labels l on l.doc_id = d.doc_id where l.quality = 1""")
def flagship_recall(spark, d):
    """Vector search, then a two-step traversal from what it finds, then a join with a status filter, in one statement."""
    db, e, docs = _engine(spark, d), table(spark, d, "embeddings"), table(spark, d, "documents")
    db.attach("notes", e.select("vec_id", F.concat(F.lit("v"), "vec_id").alias("id"), "embedding"))
    seen = e.select(F.concat(F.lit("v"), "vec_id").alias("source_id"), F.concat(F.lit("l"), "label").alias("target_id"), F.lit("SEEN_AT").alias("edge_type"))
    rests = docs.select(F.concat(F.lit("d"), "doc_id").alias("source_id"), F.concat(F.lit("l"), F.col("doc_id") % 10).alias("target_id"), F.lit("RESTS_ON").alias("edge_type"))
    db.attach("ties", seen.unionByName(rests))
    db.attach("papers", docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), "doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id"))
    return db.execute(
        """WITH top AS (SELECT id FROM notes ORDER BY embedding <=> $q LIMIT 5),
        reached AS (SELECT paper FROM GRAPH_TABLE(ties MATCH (v)-[:SEEN_AT]->(l)<-[:RESTS_ON]-(p) WHERE v.id IN (SELECT id FROM top) COLUMNS (p.id AS paper)))
        SELECT p.doc_id, p.lang, p.quality FROM papers p INNER JOIN reached r ON p.id = r.paper WHERE p.quality = 1""",
        {"q": _probe(spark, d)},
    )


# Writes and feeds, as pure functions over events: a key user_id, a commit number event_id


@query("""with f as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by event_id) as r from events where event_id >= 2000)
select user_id, event_type, event_id from f where r = 1 and not exists (select 1 from events e where e.event_id < 2000 and e.user_id = f.user_id and e.event_type = f.event_type)""")
def unique_noop(spark, d):
    db, rows = _engine(spark, d), table(spark, d, "events").select("event_id", "user_id", "event_type").orderBy("event_id")
    db.execute("CREATE TABLE firsts (event_id INTEGER PRIMARY KEY, user_id INTEGER, event_type TEXT, UNIQUE (user_id, event_type))")
    db.insert_rows("firsts", rows.where("event_id < 2000"))
    before = db.snapshot()
    db.insert_rows("firsts", rows.where("event_id >= 2000"))
    return db.scan("firsts").where(F.col("__lsn") > before).select("user_id", "event_type", "event_id")


@query(f"""with cur as (select user_id, arg_max(event_type, event_id) as kind, arg_max(value, event_id) as value from events where {_EARLY} group by user_id),
new as (select user_id, arg_max(event_type, event_id) as kind, arg_max(value, event_id) as value from events where not {_EARLY} group by user_id)
select coalesce(cur.user_id, new.user_id) as user_id, coalesce(cur.kind, new.kind) as kind, coalesce(new.value, cur.value) as value from cur full join new on cur.user_id = new.user_id""")
def upsert_merge(spark, d):
    early, late = _halves(spark, d)
    db = _engine(spark, d)
    db.execute("CREATE TABLE users (user_id INTEGER PRIMARY KEY, kind TEXT, value REAL)")
    db.insert_rows("users", early.groupBy("user_id").agg(F.max_by("kind", "event_id").alias("kind"), F.max_by("value", "event_id").alias("value")))
    db.upsert_rows("users", late.orderBy("event_id"), "user_id", ["value"])
    return db.execute("SELECT user_id, kind, value FROM users")


@query("select c_custkey, c_name, case when c_mktsegment = 'BUILDING' then c_acctbal + 100 else c_acctbal end as c_acctbal from customer")
def update_where(spark, d):
    db = _loaded(spark, d, "customer", "c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_acctbal REAL, c_mktsegment TEXT")
    db.execute("UPDATE customer SET c_acctbal = c_acctbal + 100 WHERE c_mktsegment = 'BUILDING'")
    return db.execute("SELECT c_custkey, c_name, c_acctbal FROM customer")


@query("select s_suppkey, s_name from supplier where not coalesce(s_acctbal < 0, false)")
def delete_where(spark, d):
    db = _loaded(spark, d, "supplier", "s_suppkey INTEGER PRIMARY KEY, s_name TEXT, s_acctbal REAL")
    db.execute("DELETE FROM supplier WHERE s_acctbal < 0")
    return db.execute("SELECT s_suppkey, s_name FROM supplier")


@query("""with a as (select user_id, arg_min(event_type, event_id) as old, arg_max(event_type, event_id) as new from events group by user_id)
select user_id, old, new from a where old <> new and not ((old = 'view' and new in ('click', 'purchase')) or (old = 'click' and new = 'purchase'))""")
def state_machine_invalid(spark, d):
    rows = table(spark, d, "events").groupBy("user_id")
    before, after = rows.agg(F.min_by("event_type", "event_id").alias("status")), rows.agg(F.max_by("event_type", "event_id").alias("status"))
    return policy.invalid_transitions(before, after, "user_id", "status", {"view": ["click", "purchase"], "click": ["purchase"]})


@query("""select 'deals' as moved, o_orderkey as id, 'held' as status from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
union all select 'clients', c_custkey, 'closed' from customer where c_mktsegment = 'BUILDING'""")
def propagate_fk(spark, d):
    db = _engine(spark, d)
    db.execute("CREATE TABLE clients (id INTEGER PRIMARY KEY, segment TEXT, status TEXT)")
    db.execute("CREATE TABLE deals (id INTEGER PRIMARY KEY, client INTEGER REFERENCES clients(id) ON STATE closed PROPAGATE SET held, status TEXT)")
    db.insert_rows("clients", table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit("open").alias("status")))
    db.insert_rows("deals", table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("client"), F.col("o_orderstatus").alias("status")))
    db.execute("UPDATE clients SET status = 'closed' WHERE segment = 'BUILDING'")
    moved = lambda t, state: db.execute(f"SELECT '{t}' AS moved, id, status FROM {t} WHERE status = '{state}'")
    return moved("clients", "closed").unionByName(moved("deals", "held"))


@query("select event_id, user_id from events where epoch_ms(timestamp '2024-01-20 00:00:00') - epoch_ms(ts) <= 864000000 or event_id >= 9000")
def retain_prune(spark, d):
    rows = table(spark, d, "events").withColumn("created", F.unix_millis(F.col("ts").cast("timestamp")))
    return policy.unexpired(rows, 1705708800000, created="created", ttl_ms=864000000, lsn="event_id", sync_watermark=9000).select("event_id", "user_id")


@query(f"""select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events where {_EARLY} group by user_id""")
def snapshot_read(spark, d):
    db, _, between = _two_commits(spark, d)
    return db.execute("SELECT user_id, event_id, event_type FROM latest", at=between)


@query(f"""select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events where not {_EARLY} group by user_id""")
def changes_latest(spark, d):
    db, _, between = _two_commits(spark, d)
    return db.changes_since("latest", between).select("user_id", "event_id", "event_type")


#: Every event reaches one of the two sides; some users are on one side only.
_THERE = "(user_id % 7 = 1 or (user_id % 3 <> 0 and event_id % 2 = 0))"


def _sides(spark, d):
    op = F.when(F.col("event_type") == "view", "delete").otherwise("update")
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), "value", F.col("event_id").alias("lsn"), op.alias("op"))
    side = lambda where: changes.changes_since(rows.where(where).drop("event_id"), -1, ["user_id"])
    return side(f"not {_THERE}"), side(_THERE)


_SIDES = f"""with l as (select user_id, max(event_id) as lsn, arg_max(event_type, event_id) as kind, arg_max(value, event_id) as value from events where not {_THERE} group by user_id),
r as (select user_id, max(event_id) as lsn, arg_max(event_type, event_id) as kind, arg_max(value, event_id) as value from events where {_THERE} group by user_id),
j as (select coalesce(l.user_id, r.user_id) as user_id, l.user_id is not null as here, r.user_id is not null as there, l.lsn as ll, r.lsn as rl, l.kind as lk, r.kind as rk, l.value as lv, r.value as rv from l full join r on l.user_id = r.user_id)"""


@query(f"""{_SIDES} select user_id, case when there and (not here or rl > ll) then rk else lk end as kind, case when there and (not here or rl > ll) then rv else lv end as value from j where not (there and rk = 'view')""")
def apply_latest_wins(spark, d):
    local, incoming = _sides(spark, d)
    return changes.apply_changes(local, incoming, ["user_id"], "LatestWins").select("user_id", "kind", "value")


@query(f"""{_SIDES} select user_id, case when there and not here then rk else lk end as kind, case when there and not here then rv else lv end as value from j where not (there and rk = 'view')""")
def apply_server_wins(spark, d):
    local, incoming = _sides(spark, d)
    return changes.apply_changes(local, incoming, ["user_id"], "ServerWins").select("user_id", "kind", "value")


@query(f"""{_SIDES} select user_id, case when there then rk else lk end as kind, case when there then rv else lv end as value from j where not (there and rk = 'view')""")
def apply_edge_wins(spark, d):
    local, incoming = _sides(spark, d)
    return changes.apply_changes(local, incoming, ["user_id"], "EdgeWins").select("user_id", "kind", "value")


