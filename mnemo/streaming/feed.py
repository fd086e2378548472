"""Structured Streaming over a store's change feed.

Every commit appends its rows to <store>/feed as Parquet: table, op ('insert' or 'delete'), row_id, lsn and the row as
JSON.  The stream's own checkpoint tracks which files a reader has seen, so a restarted reader continues where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemo.operators.changes import changes_since, for_direction, remapped
from mnemo.sources.store import schema_of

SCHEMA = "table string, op string, row_id long, lsn long, row string"


def feed(spark: SparkSession, store_path: str, tables: list[str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The feed of a store as a stream, of all tables or of some."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(f"{store_path}/feed")
    return df.where(F.col("table").isin(tables)) if tables else df


def typed(rows: DataFrame, engine, table: str) -> DataFrame:
    """Feed rows of one table with the table's columns in place of JSON; delete rows carry the row as it was."""
    schema = schema_of(engine.table_meta(table))
    return rows.where(F.col("table") == table).select("op", "lsn", "row_id", F.from_json("row", schema).alias("r")).select("op", "lsn", "row_id", "r.*")


def replicate(source_path: str, target, table: str, key: str, checkpoint: str, policy: str = "LatestWins", pull: bool = True, every: str | None = None, directions: dict[str, str] | None = None) -> StreamingQuery:
    """Apply a store's feed for one table to another engine, one commit per micro-batch, under a conflict policy.

    An update arrives as a delete of the old row and an insert of the new one, a delete as the row that it removed; of
    several events of a key in a batch the last counts.  directions maps tables to Push, Pull, Both or None; others go
    both ways.  every gives a processing-time trigger ('500 milliseconds'), otherwise all that is available is applied
    and the query ends.
    """
    rule = remapped(policy) if pull else policy

    def apply(batch: DataFrame, _: int) -> None:
        rows = typed(for_direction(batch, "Pull" if pull else "Push", directions or {}), target, table)
        if not rows.take(1):
            return
        order = F.struct("lsn", F.col("op") == "insert", "row_id")  # a commit's inserts come after its deletes
        last = changes_since(rows.withColumn("__order", order), -1, [key], "lsn", "__order")
        last = last.withColumn("op", F.when(F.col("op") == "delete", "delete").otherwise("upsert")).drop("row_id", "__order")
        target.apply_changes(table, last, rule)

    writer = feed(target.spark, source_path, [table]).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counts_by_window(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extra: tumbling-window counts per key with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
