from pyspark.sql import functions as F

from mnemo.session import Engine
from mnemo.streaming import feed as S


def test_feed_replicates(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "a")), Engine(spark, str(tmp_path / "b"))
    for e in (a, b):
        e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    a.execute("INSERT INTO t VALUES (1, 'x'), (2, 'y')")
    a.execute("UPDATE t SET v = 'z' WHERE id = 1")
    S.replicate(a.store.path, b, "t", "id", str(tmp_path / "c"), pull=False).awaitTermination(120)
    assert [tuple(r) for r in b.execute("SELECT id, v FROM t ORDER BY id").collect()] == [(1, "z"), (2, "y")]
    a.execute("INSERT INTO t VALUES (3, 'w')")
    S.replicate(a.store.path, b, "t", "id", str(tmp_path / "c"), pull=False).awaitTermination(120)
    assert b.execute("SELECT id FROM t").count() == 3


def test_deletes_and_lost_feeds_replicate(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "a")), Engine(spark, str(tmp_path / "b"))
    for e in (a, b):
        e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    a.execute("INSERT INTO t VALUES (1, 'x'), (2, 'y'), (3, 'z')")
    sync = lambda: S.replicate(a.store.path, b, "t", "id", str(tmp_path / "c"), pull=False).awaitTermination(120)
    sync()
    feed, a._feed_missing = a._feed_missing, lambda: None  # a writer that is lost between commit and feed
    a.execute("DELETE FROM t WHERE id = 2")
    a.execute("UPDATE t SET v = 'w' WHERE id = 3")
    a = Engine(spark, a.store.path)
    sync()
    read = lambda e: [tuple(r) for r in e.execute("SELECT id, v FROM t ORDER BY id").collect()]
    assert read(b) == read(a) == [(1, "x"), (3, "w")]
    a.execute("DELETE FROM t WHERE id = 1")
    S.replicate(a.store.path, b, "t", "id", str(tmp_path / "c"), pull=True, directions={"t": "Push"}).awaitTermination(120)
    assert len(read(b)) == 2


def test_window_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-02 00:00:00", "b")], "t string, k string").withColumn("ts", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.counts_by_window(stream, "ts", "k").writeStream.outputMode("append").format("memory").queryName("wins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.table("wins").collect()) == [("a", 2), ("b", 1)]
