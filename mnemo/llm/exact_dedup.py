"""Exact dedup: an extendible-hash index over texts, kept as shared files, without user functions.

Build: texts are pre-aggregated on (64-bit key, text), which compares bytes and folds copies before the shuffle, so a
group that holds a third of all rows reaches the index as one entry per map task.  The directory starts from the key's
leading bits and doubles where a bucket overflows: a bucket's local depth is the first depth at which its prefix holds
no more entries than the capacity.  Owner tasks take ranges of (bucket, key), number the entries that share a key
(the collision chain) and write their range to the shared folder.  Probe: documents join the index on the key alone, 16
bytes a row; only keys with a chain of two or more, that is true collisions of the hash, are probed by their bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import discard, first_of_repeats, table, written

#: Index entries that a bucket may hold before it splits.
CAPACITY = 1 << 16


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(t)
    if key_bits < 64:  # tests force collisions with few bits
        key = F.shiftleft(key, 64 - key_bits)
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), t.alias("t"))


def directory(entries: DataFrame, n_entries: int, capacity: int) -> tuple[DataFrame, int]:
    """(slot, local_depth, bucket) for each used slot of the directory, and its global depth.

    The global depth leaves three doublings above an even spread.  The directory has about 8 n / capacity rows and
    stays a DataFrame.  A bucket is named by its prefix, padded to the global depth, so its number orders key ranges.
    """
    depth = max(1, math.ceil(math.log2(max(1, n_entries / capacity))) + 3)
    slot = F.shiftrightunsigned("key", 64 - depth)
    used = entries.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    depths = used.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    prefix = F.expr(f"shiftrightunsigned(slot, {depth} - d)")
    load = depths.groupBy("d", prefix.alias("prefix")).agg(F.sum("n").alias("load"))
    fits = depths.select("slot", "d", prefix.alias("prefix")).join(load, ["d", "prefix"]).where((F.col("load") <= capacity) | (F.col("d") == depth))
    local = fits.groupBy("slot").agg(F.min("d").cast("int").alias("local_depth"))
    return local.select("slot", "local_depth", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - local_depth), {depth} - local_depth)").alias("bucket")), depth


def build_index(keyed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The written index: one entry per distinct text (bucket, key, chain, chain_length, keep_id, group_size, text_sha256)."""
    entries = written(
        keyed.groupBy("key", "t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("key", "keep_id", "group_size", F.sha2("t", 256).alias("text_sha256")),
        "dedup-entries",
    )
    n = entries.count()
    slots, depth = directory(entries, n, capacity)
    placed = entries.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(slots, "slot")
    owners = max(1, math.ceil(n / capacity))
    chain = Window.partitionBy("bucket", "key")
    owned = placed.repartitionByRange(owners, "bucket", "key").withColumn("chain", F.row_number().over(chain.orderBy("text_sha256", "keep_id"))).withColumn("chain_length", F.count(F.lit(1)).over(chain))
    index = written(owned.select("bucket", "local_depth", "key", "chain", "chain_length", "keep_id", "group_size", "text_sha256"), "dedup-index")
    discard(entries)
    return index


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Null counts as the empty text.  Of equal texts the largest doc_id stays; null ids lose to any other, and rows that
    repeat the staying id with the same text cannot be told apart and are all marked kept.  Other columns of docs are
    not read.  An empty table gives an empty result.
    """
    keyed = _keyed(docs, id_col, text_col, key_bits)
    index = build_index(keyed, capacity)
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain"]
    found = keyed.select("doc_id", "key").join(index.where("chain_length = 1"), "key").select(*out)
    collided = index.where("chain_length > 1").select("key", "bucket", "text_sha256", "chain", "keep_id", "group_size")
    if collided.take(1):
        probed = keyed.join(collided.select("key").distinct(), "key", "left_semi")
        texts = probed.groupBy("key", "t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("text_sha256", F.sha2("t", 256))
        texts = texts.join(collided.select("key", "bucket", "text_sha256", "chain"), ["key", "text_sha256"])
        found = found.unionByName(probed.join(texts, ["key", "t"]).select(*out))
    return found


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row of docs for each different text, a row with its largest id; all columns stay, whatever their names.

    Of rows that repeat the staying id with the same text, the one with the least hash of all columns stays.
    """
    groups = written(exact_groups(docs, id_col, text_col, capacity).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"), "dedup-groups")
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    mine = docs[id_col].eqNullSafe(F.col("__id")) & (sha == F.col("__sha"))
    kept = docs.join(groups.where("not kept").select("__id", "__sha").distinct(), mine, "left_anti")
    again = groups.where("kept").groupBy("__id", "__sha").count().where("count > 1").select("__id", "__sha")
    return first_of_repeats(kept, again, mine)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
"""
