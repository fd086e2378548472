"""The engine's SQL surface, write rules and feeds, on small seeds."""

import pytest

from mnemo import errors as E
from mnemo.plans.parser import parse
from mnemo.session import Plugin


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def products(engine):
    engine.execute("CREATE TABLE products (id INTEGER PRIMARY KEY, price INTEGER, category TEXT, note TEXT)")
    engine.execute("INSERT INTO products VALUES (1, 10, 'food', 'x'), (2, 20, 'food', NULL), (3, 10, 'drink', 'y'), (4, 30, 'drink', NULL)")
    return engine


def test_select_surface(products):
    q = lambda s, **p: rows(products.execute(s, p))
    assert q("SELECT id FROM products WHERE price > 10 ORDER BY id") == [(2,), (4,)]
    assert q("SELECT id FROM products WHERE price NOT IN (10, NULL) ORDER BY id") == [(2,), (4,)]
    assert q("SELECT id FROM products WHERE note NOT LIKE 'x%' ORDER BY id") == [(2,), (3,), (4,)]
    assert q("SELECT id FROM products WHERE NOT (price BETWEEN 15 AND 25) ORDER BY id DESC") == [(4,), (3,), (1,)]
    assert q("SELECT price / 3 AS p FROM products WHERE id = 1") == [(3,)]
    assert q("SELECT -price AS p, COALESCE(note, 'none') AS n FROM products WHERE id = $i", i=2) == [(-20, "none")]
    assert q("SELECT COUNT(*) AS n, COUNT(note) AS m FROM products") == [(4, 2)]
    assert q("SELECT DISTINCT category FROM products ORDER BY category") == [("drink",), ("food",)]
    assert q("SELECT id, note FROM products ORDER BY note, id LIMIT 3") == [(1, "x"), (3, "y"), (2, None)]
    assert q("SELECT id FROM products ORDER BY note DESC, id LIMIT 2") == [(2,), (4,)]
    assert q("SELECT 1 AS one") == [(1,)]
    assert products.execute("SELECT * FROM products").columns == ["id", "price", "category", "note"]
    with pytest.raises(E.ParseError):
        products.execute("SELECT COUNT(*), id FROM products")
    with pytest.raises(E.MissingParameter):
        q("SELECT id FROM products WHERE id = $nope")
    with pytest.raises(E.ColumnNotFound):
        q("SELECT nope FROM products")


def test_joins_and_subqueries(products):
    products.execute("CREATE TABLE tags (pid INTEGER, tag TEXT)")
    products.execute("INSERT INTO tags VALUES (1, 'a'), (1, 'b'), (3, 'a'), (NULL, 'c')")
    q = lambda s: rows(products.execute(s))
    assert q("SELECT p.id, t.tag FROM products p INNER JOIN tags t ON p.id = t.pid ORDER BY p.id, t.tag") == [(1, "a"), (1, "b"), (3, "a")]
    assert q("SELECT p.id FROM products p LEFT JOIN tags t ON p.id = t.pid WHERE t.tag IS NULL ORDER BY p.id") == [(2,), (4,)]
    assert q("SELECT id FROM products WHERE id IN (SELECT pid FROM tags) ORDER BY id") == [(1,), (3,)]
    assert q("SELECT id FROM products WHERE id NOT IN (SELECT pid FROM tags) ORDER BY id") == [(2,), (4,)]
    assert q("SELECT id FROM products WHERE id IN (SELECT pid FROM tags) OR price = 30 ORDER BY id") == [(1,), (3,), (4,)]
    assert q("WITH cheap AS (SELECT id FROM products WHERE price = 10) SELECT t.tag FROM cheap c INNER JOIN tags t ON c.id = t.pid ORDER BY tag") == [("a",), ("a",), ("b",)]
    with pytest.raises(E.AmbiguousColumn):
        q("SELECT id FROM products a INNER JOIN products b ON a.id = b.id")


@pytest.mark.parametrize(
    "sql, error",
    [
        ("WITH RECURSIVE a AS (SELECT 1) SELECT * FROM a", E.RecursiveCteNotSupported), ("SELECT a FROM t GROUP BY a", E.ParseError), ("SELECT row_number() OVER (x) FROM t", E.WindowFunctionNotSupported),
        ("SELECT * FROM t WHERE a MATCH 'x'", E.FullTextSearchNotSupported), ("CREATE FUNCTION f", E.StoredProcNotSupported), ("SELECT * FROM t WHERE a = (SELECT 1)", E.SubqueryNotSupported),
        ("SELECT * FROM t ORDER BY v <=> [1,2]", E.UnboundedVectorSearch), ("SELECT * FROM GRAPH_TABLE(e MATCH (a)-[:X]->+(b))", E.UnboundedTraversal),
        ("SELECT * FROM GRAPH_TABLE(e MATCH (a)-[:X]->{1,11}(b))", E.BfsDepthExceeded), ("SELECT * FROM GRAPH_TABLE(e MATCH (a)-[:X]->{0,2}(b))", E.ParseError), ("SELECT a FROM t, u", E.ParseError),
        ("SELECT CASE WHEN a THEN b END FROM t", E.ParseError), ("INSERT INTO t SELECT 1", E.ParseError), ("SELECT a FROM t UNION SELECT b FROM u", E.ParseError), ("SELECT a FROM t LIMIT 1 OFFSET 2", E.ParseError),
    ],
)
def test_rejections(sql, error):
    with pytest.raises(error):
        parse(sql)


def test_keys_constraints_and_upsert(engine):
    ex = engine.execute
    ex("CREATE TABLE people (id TEXT PRIMARY KEY, mail TEXT UNIQUE, name TEXT NOT NULL DEFAULT 'anon', version INTEGER, born TEXT IMMUTABLE)")
    assert ex("INSERT INTO people (id, mail, name, version) VALUES ('a', 'm1', 'A', 1), ('b', 'm1', 'B', 1), ('c', NULL, 'C', 1)").rows_affected == 2
    with pytest.raises(E.UniqueViolation):
        ex("INSERT INTO people (id, version) VALUES ('a', 2)")
    with pytest.raises(E.NotNullViolation):
        ex("INSERT INTO people (id, name) VALUES ('z', NULL)")
    with pytest.raises(E.ColumnNotFound):
        ex("INSERT INTO people (id, nope) VALUES ('z', 1)")
    ex("INSERT INTO people (id, name, version) VALUES ('a', 'A2', 2), ('d', 'D', 1) ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name, version = EXCLUDED.version")
    assert rows(ex("SELECT id, name, version, mail FROM people ORDER BY id")) == [("a", "A2", 2, "m1"), ("c", "C", 1, None), ("d", "D", 1, None)]
    with pytest.raises(E.ImmutableColumn):
        ex("UPDATE people SET born = 'x' WHERE id = 'a'")
    with pytest.raises(E.UniqueViolation):
        ex("UPDATE people SET mail = 'm1' WHERE id = 'c'")
    assert ex("UPDATE people SET version = version + 10 WHERE id IN ('a', 'c')").rows_affected == 2
    assert ex("DELETE FROM people WHERE version > 10").rows_affected == 2
    assert rows(ex("SELECT id FROM people")) == [("d",)]
    ex("CREATE TABLE log (id INTEGER PRIMARY KEY, owner TEXT REFERENCES people(id)) IMMUTABLE")
    with pytest.raises(E.ForeignKeyViolation):
        ex("INSERT INTO log VALUES (1, 'nobody')")
    ex("INSERT INTO log VALUES (1, 'd'), (2, NULL)")
    with pytest.raises(E.ImmutableTable):
        ex("DELETE FROM log WHERE id = 1")
    assert rows(ex("SELECT COUNT(*) AS n FROM log")) == [(2,)]


def test_transactions_and_snapshots(products):
    ex = products.execute
    before = products.snapshot()
    ex("BEGIN")
    ex("INSERT INTO products VALUES (5, 50, 'x', NULL)")
    assert rows(ex("SELECT COUNT(*) AS n FROM products")) == [(5,)]
    ex("DELETE FROM products WHERE id = 5")
    with pytest.raises(E.UniqueViolation):
        ex("INSERT INTO products VALUES (1, 1, 'x', NULL)")
    ex("ROLLBACK")
    assert rows(ex("SELECT COUNT(*) AS n FROM products")) == [(4,)]
    ex("BEGIN")
    ex("UPDATE products SET price = 99 WHERE id = 1")
    ex("DELETE FROM products WHERE id = 2")
    ex("COMMIT")
    assert rows(ex("SELECT id, price FROM products ORDER BY id")) == [(1, 99), (3, 10), (4, 30)]
    assert rows(ex("SELECT id, price FROM products ORDER BY id", at=before)) == [(1, 10), (2, 20), (3, 10), (4, 30)]
    from mnemo.session import Engine

    again = Engine(products.spark, products.store.path)
    assert rows(again.execute("SELECT id FROM products ORDER BY id")) == [(1,), (3,), (4,)]
    again.execute("INSERT INTO products VALUES (9, 1, 'z', NULL)")
    with pytest.raises(E.CommitConflict):
        ex("INSERT INTO products VALUES (10, 1, 'z', NULL)")


def test_graph_and_vector(engine):
    ex = engine.execute
    ex("CREATE TABLE entities (id TEXT PRIMARY KEY, name TEXT)")
    ex("CREATE TABLE edges (source_id TEXT, target_id TEXT, edge_type TEXT) DAG ('BASED_ON')")
    ex("CREATE TABLE obs (id TEXT PRIMARY KEY, kind TEXT, embedding VECTOR(4))")
    ex("INSERT INTO entities VALUES ('A', 'a'), ('B', 'b'), ('C', 'c'), ('D', 'd'), ('E', 'e')")
    assert ex("INSERT INTO edges VALUES ('A', 'B', 'BASED_ON'), ('B', 'C', 'BASED_ON'), ('C', 'D', 'BASED_ON'), ('D', 'E', 'BASED_ON'), ('A', 'B', 'BASED_ON')").rows_affected == 4
    with pytest.raises(E.CycleDetected):
        ex("INSERT INTO edges VALUES ('D', 'A', 'BASED_ON')")
    got = ex("SELECT t, depth FROM GRAPH_TABLE(edges MATCH (a)-[:BASED_ON]->{1,3}(t) WHERE a.id = 'A' COLUMNS (t.id AS t, depth AS depth)) ORDER BY depth")
    assert rows(got) == [("B", 1), ("C", 2), ("D", 3)]
    got = ex("SELECT id, depth FROM GRAPH_TABLE(edges MATCH (a)<-[:BASED_ON]-{2,2}(b) WHERE a.name = 'c') WHERE depth = 2")
    assert rows(got) == [("A", 2)]
    ex("INSERT INTO obs VALUES ('o1', 'x', [1, 0, 0, 0]), ('o2', 'y', [0.9, 0.1, 0, 0]), ('o3', 'x', '[0, 1, 0, 0]'), ('o4', 'x', NULL)")
    assert rows(ex("SELECT id FROM obs ORDER BY embedding <=> $q LIMIT 2", {"q": [1.0, 0, 0, 0]})) == [("o1",), ("o2",)]
    assert rows(ex("SELECT id, score FROM obs WHERE kind = 'x' ORDER BY embedding <=> '[1,0,0,0]' LIMIT 5")) == [("o1", 1.0), ("o3", 0.0)]
    with pytest.raises(E.VectorDimensionMismatch):
        ex("SELECT id FROM obs ORDER BY embedding <=> [1, 2] LIMIT 2")
    with pytest.raises(E.VectorDimensionMismatch):
        ex("INSERT INTO obs VALUES ('o5', 'x', [1, 2])")
    assert rows(ex("SHOW VECTOR_INDEXES").select("vector_count", "bytes")) == [(3, 48)]
    assert engine.insert_edge("E", "F", "LIKES", {"w": 1}) and not engine.insert_edge("E", "F", "LIKES")
    assert engine.edge_properties("E", "F", "LIKES") == {"w": 1}
    path = engine.query_bfs("C", most=3).where("node = 'F'").first()
    assert path.depth == 3 and [p.node for p in path.path] == ["D", "E", "F"]
    assert engine.edge_count("A") == 1 and engine.delete_edge("E", "F", "LIKES")


def test_hybrid_recall(engine):
    """Which open repair orders rest on the machine that similar sensor readings were taken at."""
    ex = engine.execute
    ex("CREATE TABLE repairs (id TEXT PRIMARY KEY, what TEXT, open BOOLEAN)")
    ex("CREATE TABLE readings (id TEXT PRIMARY KEY, shape VECTOR(3))")
    ex("CREATE TABLE links (source_id TEXT, target_id TEXT, edge_type TEXT)")
    ex("INSERT INTO repairs VALUES ('r1', 'new bearing', TRUE), ('r2', 'oil', FALSE), ('r3', 'belt', TRUE)")
    ex("INSERT INTO readings VALUES ('x1', [0, 1, 0]), ('x2', [0, 0.9, 0.2]), ('x3', [1, 0, 0])")
    ex("INSERT INTO links VALUES ('x1', 'press', 'TAKEN_AT'), ('x2', 'press', 'TAKEN_AT'), ('x3', 'lathe', 'TAKEN_AT'), ('r1', 'press', 'CONCERNS'), ('r2', 'press', 'CONCERNS'), ('r3', 'lathe', 'CONCERNS')")
    got = ex(
        """WITH alike AS (SELECT id FROM readings ORDER BY shape <=> $q LIMIT 2),
        near AS (SELECT job FROM GRAPH_TABLE(links MATCH (x)-[:TAKEN_AT]->(m)<-[:CONCERNS]-(j) WHERE x.id IN (SELECT id FROM alike) COLUMNS (j.id AS job)))
        SELECT r.id, r.what FROM repairs r INNER JOIN near n ON r.id = n.job WHERE r.open""",
        {"q": [0.0, 1.0, 0.0]},
    )
    assert rows(got) == [("r1", "new bearing")]
    plan = engine.explain("SELECT id FROM repairs WHERE open = TRUE")
    assert "Scan parquet" in plan and "PushedFilters" in plan


def test_state_machine_and_propagation(engine):
    ex = engine.execute
    ex("CREATE TABLE recipes (id TEXT PRIMARY KEY, status TEXT) STATE MACHINE (status: draft -> [live], live -> [withdrawn])")
    ex("CREATE TABLE batches (id TEXT PRIMARY KEY, status TEXT, recipe TEXT REFERENCES recipes(id) ON STATE withdrawn PROPAGATE SET recalled, taste VECTOR(2)) STATE MACHINE (status: sold -> [recalled], made -> [recalled, sold]) PROPAGATE ON EDGE MADE_FROM INCOMING STATE recalled SET recalled PROPAGATE ON STATE recalled EXCLUDE VECTOR")
    ex("CREATE TABLE uses (source_id TEXT, target_id TEXT, edge_type TEXT)")
    ex("INSERT INTO recipes VALUES ('soup', 'live'), ('cake', 'draft')")
    ex("INSERT INTO batches VALUES ('b1', 'made', 'soup', [0, 1]), ('b2', 'sold', NULL, [0, 1]), ('b3', 'made', 'cake', [0, 1])")
    ex("INSERT INTO uses VALUES ('b2', 'b1', 'MADE_FROM')")
    with pytest.raises(E.InvalidStateTransition):
        ex("UPDATE recipes SET status = 'withdrawn' WHERE id = 'cake'")
    got = ex("UPDATE recipes SET status = 'withdrawn' WHERE id = 'soup'")
    assert got.details["propagated"] == {"batches": 2}
    assert rows(ex("SELECT id, status FROM batches ORDER BY id")) == [("b1", "recalled"), ("b2", "recalled"), ("b3", "made")]
    assert rows(ex("SELECT id FROM batches ORDER BY taste <=> [0, 1] LIMIT 5")) == [("b3",)]
    assert [r.id for r in engine.query_vector("batches", "taste", [0.0, 1.0], 5).collect()] == ["b3"]
    assert [r.id for r in engine.semantic_search("batches", "taste", [0.0, 1.0], 5).collect()] == ["b3"]


def test_dropped_values_stay_gone(engine):
    ex = engine.execute
    ex("CREATE TABLE t (id INTEGER PRIMARY KEY, x INTEGER, y INTEGER)")
    ex("INSERT INTO t VALUES (1, 7, 8)")
    ex("ALTER TABLE t DROP COLUMN x")
    ex("ALTER TABLE t ADD COLUMN x INTEGER")
    assert rows(ex("SELECT id, x, y FROM t")) == [(1, None, 8)]
    ex("ALTER TABLE t RENAME COLUMN y TO z")
    ex("INSERT INTO t (id, x, z) VALUES (2, 5, 6)")
    before = engine.current_lsn
    ex("DELETE FROM t WHERE id = 1")
    assert rows(ex("SELECT id, x, z FROM t")) == [(2, 5, 6)]
    assert [(r.id, r.z, r.op) for r in engine.changes_since("t", before).collect()] == [(1, 8, "delete")]
    engine.compact("t")
    assert rows(ex("SELECT id, x, z FROM t")) == [(2, 5, 6)]


def test_upsert_keeps_unique_keys(engine):
    ex = engine.execute
    ex("CREATE TABLE u (id INTEGER PRIMARY KEY, mail TEXT UNIQUE)")
    ex("INSERT INTO u VALUES (1, 'a'), (2, 'b')")
    with pytest.raises(E.UniqueViolation):
        ex("INSERT INTO u VALUES (2, 'a') ON CONFLICT (id) DO UPDATE SET mail = EXCLUDED.mail")
    assert rows(ex("SELECT id, mail FROM u ORDER BY id")) == [(1, "a"), (2, "b")]


def test_codes_are_small(spark, engine):
    """Vectors as codes take at most a third of their bytes as floats, and search finds the same neighbours."""
    import os

    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    data = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=256)]) for i in range(600)], "id long, v array<float>").coalesce(1)
    size, found = {}, {}
    for kind in ("F32", "SQ8", "SQ4"):
        engine.execute(f"CREATE TABLE v_{kind} (id INTEGER PRIMARY KEY, v VECTOR(256) WITH (quantization = '{kind}'))")
        engine.insert_rows(f"v_{kind}", data)
        parts = f"{engine.store.path}/parts/v_{kind}"
        size[kind] = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(parts) for f in names if f.endswith(".parquet"))
        found[kind] = {r.id for r in engine.execute(f"SELECT id FROM v_{kind} ORDER BY v <=> $q LIMIT 10", {"q": [1.0] + [0.5] * 255}).collect()}
    assert 3 * size["SQ8"] <= size["F32"] and size["SQ4"] < size["SQ8"]
    assert len(found["F32"] & found["SQ8"]) >= 9


def test_push_and_pull(spark, engine, tmp_path):
    from mnemo.session import Engine

    class Hides(Plugin):
        def on_sync_push(self, feed):
            return feed.where("id <> 3")

    engine.plugins.append(Hides())
    ex = engine.execute
    ex("CREATE TABLE a (id INTEGER PRIMARY KEY, v TEXT)")
    ex("CREATE TABLE b (id INTEGER PRIMARY KEY)")
    ex("INSERT INTO a VALUES (1, 'x'), (2, 'y'), (3, 'z')")
    ex("INSERT INTO b VALUES (1)")
    other = Engine(spark, str(tmp_path / "other"))
    other.pull(engine, directions={"b": "Push"})
    assert other.table_names() == ["a", "b"] and rows(other.execute("SELECT id, v FROM a ORDER BY id")) == [(1, "x"), (2, "y")]
    assert rows(other.execute("SELECT COUNT(*) AS n FROM b")) == [(0,)]
    mark = engine.current_lsn
    ex("DELETE FROM a WHERE id = 1")
    other.pull(engine, mark)
    assert rows(other.execute("SELECT id FROM a")) == [(2,)]


def test_visited_limit(spark, engine):
    engine.attach("e", spark.range(50).selectExpr("'hub' as source_id", "concat('n', id) as target_id", "'T' as edge_type"))
    with pytest.raises(E.BfsVisitedExceeded):
        engine.bfs(["hub"], ["T"], most_visited=49)
    assert engine.bfs(["hub"], ["T"], most_visited=50).count() == 50
    with pytest.raises(E.ImmutableTable):
        engine.execute("DELETE FROM e WHERE source_id = 'hub'")


def test_propagation_abort(engine):
    ex = engine.execute
    ex("CREATE TABLE parents (id TEXT PRIMARY KEY, status TEXT)")
    ex("CREATE TABLE kids (id TEXT PRIMARY KEY, status TEXT, parent_id TEXT REFERENCES parents(id) ON STATE gone PROPAGATE SET lost ABORT ON FAILURE) STATE MACHINE (status: open -> [closed])")
    ex("INSERT INTO parents VALUES ('p', 'here')")
    ex("INSERT INTO kids VALUES ('k', 'open', 'p')")
    with pytest.raises(E.PropagationAborted):
        ex("UPDATE parents SET status = 'gone' WHERE id = 'p'")
    assert rows(ex("SELECT status FROM parents")) == [("here",)]


def test_rank_policy(engine):
    ex = engine.execute
    ex("CREATE TABLE outcomes (id TEXT PRIMARY KEY, decision_id TEXT, success BOOLEAN, weight REAL)")
    with pytest.raises(E.RankPolicyInvalid):
        ex("CREATE TABLE bad (id TEXT PRIMARY KEY, v VECTOR(2) RANK_POLICY (JOIN outcomes ON decision_id, FORMULA '{weight}', SORT_KEY k))")
    ex("CREATE INDEX o_d ON outcomes (decision_id)")
    ex("CREATE TABLE decisions (id TEXT PRIMARY KEY, confidence REAL, v VECTOR(2) RANK_POLICY (JOIN outcomes ON decision_id, FORMULA 'coalesce({confidence}, 1.0) * coalesce({success}, 0.5) * {vector_score}', SORT_KEY eff))")
    ex("INSERT INTO decisions VALUES ('a', 0.5, [1, 0]), ('b', NULL, [1, 0]), ('c', 1.0, [0.6, 0.8])")
    ex("INSERT INTO outcomes VALUES ('x', 'a', TRUE, 1.0), ('y', 'b', FALSE, 1.0)")
    ex("INSERT INTO outcomes VALUES ('z', 'b', TRUE, 1.0)")
    assert [r[0] for r in rows(ex("SELECT id, score FROM decisions ORDER BY v <=> [1, 0] USE RANK eff LIMIT 3"))] == ["b", "a", "c"]
    got = engine.semantic_search("decisions", "v", [1.0, 0.0], 3, "eff", 0.7).collect()
    assert [(r.id, round(r.rank, 3)) for r in got] == [("b", 1.0), ("a", 0.5)]
    with pytest.raises(E.RankPolicyNotFound):
        ex("SELECT id FROM decisions ORDER BY v <=> [1, 0] USE RANK nope LIMIT 3")
    with pytest.raises(E.RankPolicyInvalid):
        ex("DROP TABLE outcomes")


def test_ddl(products):
    ex = products.execute
    ex("ALTER TABLE products ADD COLUMN stock INTEGER")
    assert rows(ex("SELECT stock FROM products WHERE id = 1")) == [(None,)]
    ex("ALTER TABLE products RENAME COLUMN price TO cost")
    ex("INSERT INTO products (id, cost) VALUES (7, 70)")
    assert rows(ex("SELECT id, cost FROM products WHERE cost >= 30 ORDER BY id")) == [(4, 30), (7, 70)]
    ex("CREATE INDEX by_cost ON products (cost DESC, id)")
    with pytest.raises(E.DuplicateIndex):
        ex("CREATE INDEX by_cost ON products (id)")
    with pytest.raises(E.ColumnInIndex):
        ex("ALTER TABLE products DROP COLUMN cost RESTRICT")
    assert ex("ALTER TABLE products DROP COLUMN cost CASCADE").details == {"dropped_indexes": ["by_cost"]}
    text = products.render_schema("products")
    meta = parse(text)
    assert [c["name"] for c in meta["columns"]] == ["id", "category", "note", "stock"]
    with pytest.raises(E.TableExists):
        ex("CREATE TABLE products (id INTEGER)")
    ex("CREATE TABLE IF NOT EXISTS products (id INTEGER)")
    ex("SET SYNC_CONFLICT_POLICY 'server_wins'")
    assert rows(ex("SHOW SYNC_CONFLICT_POLICY")) == [("default", "ServerWins")]
    ex("SET DISK_LIMIT '1K'")
    with pytest.raises(E.BudgetExceeded):
        ex("INSERT INTO products (id) VALUES (70)")
    ex("SET DISK_LIMIT 'none'")
    products.compact("products")
    assert rows(ex("SELECT COUNT(*) AS n FROM products")) == [(5,)]
    ex("DROP TABLE products")
    assert products.table_names() == []


def test_feed_apply_and_retention(spark, engine, tmp_path):
    from mnemo.session import Engine

    other = Engine(spark, str(tmp_path / "other"))
    for e in (engine, other):
        e.execute("CREATE TABLE notes (id TEXT PRIMARY KEY, body TEXT, until TIMESTAMP EXPIRES) RETAIN 1 DAYS")
    engine.execute("INSERT INTO notes VALUES ('a', 'one', NULL), ('b', 'two', '2020-01-01T00:00:00Z'), ('c', 'three', 'infinity')")
    mark = engine.current_lsn
    engine.execute("UPDATE notes SET body = 'uno' WHERE id = 'a'")
    engine.execute("DELETE FROM notes WHERE id = 'c'")
    assert sorted((r.id, r.op, r.body) for r in engine.changes_since("notes", mark).collect()) == [("a", "upsert", "uno"), ("c", "delete", "three")]
    got = other.apply_changes("notes", engine.changes_since("notes", 0))
    assert rows(other.execute("SELECT id, body FROM notes ORDER BY id")) == [("a", "uno"), ("b", "two")]
    other.execute("UPDATE notes SET body = 'local' WHERE id = 'a'")
    got = other.apply_changes("notes", engine.changes_since("notes", 0), "ServerWins")
    assert got.details["conflicts"] == 2 and got.rows_affected == 0
    other.apply_changes("notes", engine.changes_since("notes", 0), "EdgeWins")
    assert rows(other.execute("SELECT body FROM notes WHERE id = 'a'")) == [("uno",)]
    assert engine.prune() == {"notes": 1}
    assert rows(engine.execute("SELECT id FROM notes")) == [("a",)]


def test_subscriptions_and_plugins(spark, tmp_path):
    from mnemo.session import Engine

    class Guard(Plugin):
        seen = []

        def pre_commit(self, tables, rows):
            if rows > 2:
                raise E.PluginRejected("too many rows")

        def post_commit(self, event):
            self.seen.append(event.tables)

    e = Engine(spark, str(tmp_path / "s"), (Guard(),))
    e.execute("CREATE TABLE t (id INTEGER)")
    s = e.subscribe(capacity=1)
    e.execute("INSERT INTO t VALUES (1)")
    e.execute("INSERT INTO t VALUES (2)")
    assert (s.delivered, s.dropped) == (1, 1) and s.poll().tables == ("t",)
    with pytest.raises(E.PluginRejected):
        e.execute("INSERT INTO t VALUES (3), (4), (5)")
    assert rows(e.execute("SELECT COUNT(*) AS n FROM t")) == [(2,)]
    assert Guard.seen == [("t",), ("t",)] and e.subscription_health() == [{"delivered": 1, "dropped": 1, "closed": False}]
