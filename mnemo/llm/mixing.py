"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a hash of the id; a source's blocks are drawn in a permuted order, the
whole order once per epoch, until its target of words is met.  The number of blocks drawn from each source (the quotas)
is split exactly among output shards by a binary tree: at each node the left half of the shards takes a multivariate
hypergeometric draw from the node's quotas, the right half the rest.  So shards hold disjoint stretches of each
source's permuted block order, every shard is a fair sample of the mix, and no random number is drawn per document.

Only a row per source comes to the driver; blocks (about the square root of the rows, per source) and documents stay
distributed, keyed by (source, block), so that a source with a third of all rows spreads over its blocks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import GAP, SPACES, discard, table, written

#: No document is taken, and no source repeated, more often than this.
MAX_EPOCHS = 3
#: Times that a source's last gap is filled with the largest unused document that fits; once more, one may overshoot less than it lacks.
FILL_ROUNDS = 3
#: Sources up to which the driver's tables, a few rows a source, are broadcast; beyond it they are joined.
MOST_BROADCAST = 10_000


def word_count(text_col: str):
    """Words of a text, on the JVM; null has none."""
    t = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, GAP))).cast("long")


def source_targets(sizes: list[int], cycle=(1, 2, 3), most: int = MAX_EPOCHS) -> list[float]:
    """Target words of each source, in the order of sizes.

    Sources weigh cycle, repeated, and share the sum of sizes by weight.  A target above most times its source's size
    stops there, and the excess is shared among the others by weight until no target is above.
    """
    weights, total = [cycle[i % len(cycle)] for i in range(len(sizes))], sum(sizes)
    full: set[int] = set()
    while True:
        open_weight = sum(w for i, w in enumerate(weights) if i not in full)
        left = total - most * sum(sizes[i] for i in full)
        share = [most * s if i in full else left * weights[i] / open_weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and share[i] > most * s}
        if not over:
            return [float(x) for x in share]
        full |= over


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact counts (source, shard) with the given row sums; shard sums differ by one at most."""
    rng, out = np.random.Generator(np.random.PCG64(seed)), np.zeros((len(quotas), shards), dtype=np.int64)
    total = int(sum(quotas))
    room = [total // shards + (j < total % shards) for j in range(shards)]

    def split(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = q
            return
        mid = (lo + hi) // 2
        left, rest, need = np.zeros_like(q), int(q.sum()), sum(room[lo:mid])
        for i, have in enumerate(q):  # a chain of hypergeometric draws is one multivariate draw
            rest -= int(have)
            left[i] = rng.hypergeometric(int(have), rest, need) if need and have else 0
            need -= int(left[i])
        split(lo, mid, left)
        split(mid, hi, q - left)

    if len(quotas):
        split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 64, seed: int = 9) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, shards (the shard of each copy).

    Null texts have size 0, a null source is a source of its own (the last), sources of size 0 have target 0 and give
    nothing.  Repeated rows are rows like any other: each has its size and is taken on its own.  Documents are taken
    whole; a source's words come as near its target as a few unused documents allow, which the tree deals like blocks of
    their own.  A rerun, on any number
    of executors, gives the same mix.  Other columns of docs are not read.  An empty table gives an empty result.
    """
    plan = _planned(docs, id_col, text_col, source_col, shards, seed)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "shards")


def _small(df: DataFrame, sources: int) -> DataFrame:
    """A table of the driver's, broadcast where its rows, a few per source, are known to be few."""
    return F.broadcast(df) if sources <= MOST_BROADCAST else df


def _keys(docs: DataFrame, id_col: str, text_col: str, seed: int):
    """Hashes of a row's id and of its text."""
    return F.xxhash64(F.lit(seed), docs[id_col]), F.xxhash64(F.lit(seed), F.coalesce(docs[text_col], F.lit("")))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int, seed: int) -> DataFrame:
    """mix_plan with the hashes u of the id and v of the text, and the source."""
    spark = docs.sparkSession
    u, v = _keys(docs, id_col, text_col, seed)
    narrow = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), u.alias("u"), v.alias("v")), "mix-sizes")
    stats = sorted(narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    n_blocks = max(1, min(1 << 16, math.isqrt(sum(r.n for r in stats))))
    targets = source_targets([r.size for r in stats])
    plan = []
    for i, (r, target) in enumerate(zip(stats, targets, strict=True)):
        epochs = min(MAX_EPOCHS, int(target // r.size)) if r.size else 0
        rest = target - epochs * r.size if r.size and epochs < MAX_EPOCHS else 0.0
        plan.append((r.source, i, r.size, target, epochs, rest))
    by_source = _small(spark.createDataFrame(plan, "src string, src_no int, source_size long, target double, epochs int, rest double"), len(plan))
    placed = narrow.withColumn("block", F.expr(f"cast(pmod(u, {n_blocks}) as int)"))
    cells = placed.groupBy("source", "block").agg(F.sum("size").alias("words")).withColumn("turn", F.xxhash64(F.lit(seed + 1), "source", "block"))
    order = Window.partitionBy("source").orderBy("turn", "block")
    cells = cells.withColumn("at", F.row_number().over(order) - 1).withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source")))
    cells = cells.join(by_source, F.col("source").eqNullSafe(F.col("src"))).withColumn("room", F.col("rest") - F.coalesce("before", F.lit(0)))
    cells = written(cells.select("src_no", "src", F.col("block").alias("b"), "at", "n", "source_size", "target", "epochs", "room"), "mix-blocks")

    rows = placed.join(cells, (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("src")))
    inside = Window.partitionBy("src_no", "b").orderBy("u", "doc_id", "v", "size")  # rows that tie are alike
    rows = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("nth", F.row_number().over(inside))
    rows = rows.withColumn("extra", ((F.col("upto") <= F.col("room")) & (F.col("size") > 0)).cast("int"))
    rows = written(rows.select("doc_id", "source", "u", "v", "size", "src_no", "b", "nth", "at", "n", "source_size", "target", "epochs", "extra"), "mix-rows")
    discard(narrow)

    # Where the next document no longer fits, a gap stays; unused documents near it in size fill it.
    taken = rows.groupBy("src_no").agg(F.sum(F.col("size") * (F.col("epochs") + F.col("extra"))).alias("words")).collect()
    gap, chosen = {r.src_no: plan[r.src_no][3] - r.words for r in taken if plan[r.src_no][4] < MAX_EPOCHS}, []
    spare = rows.where("extra = 0 and size > 0").select("src_no", "u", "v", "b", "nth", "size")
    fill_schema = "no int, fill_b int, fill_nth int, fill_at long"
    drawn = {r.src_no: r for r in cells.groupBy("src_no").agg(F.max("n").alias("n"), F.max("epochs").alias("epochs"), F.sum((F.col("room") > 0).cast("long")).alias("more")).collect()}
    quotas = [int(drawn[i].epochs * drawn[i].n + drawn[i].more) if i in drawn else 0 for i in range(len(plan))]
    is_fill = (F.col("src_no") == F.col("no")) & (F.col("b") == F.col("fill_b")) & (F.col("nth") == F.col("fill_nth"))
    for turn in range(FILL_ROUNDS + 1):
        if not (left := [(i, g) for i, g in gap.items() if g >= 1]):
            break
        unused = spare.join(_small(spark.createDataFrame(chosen, fill_schema), len(plan)), is_fill, "left_anti") if chosen else spare
        fits = unused.join(_small(spark.createDataFrame(left, "no int, gap double"), len(plan)), F.col("src_no") == F.col("no"))
        fits = fits.where("size <= gap" if turn < FILL_ROUNDS else "size < 2 * gap").select("src_no", F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "u", "v", "b", "nth", "size").alias("c"))
        for r in fits.groupBy("src_no").agg(F.min("c").alias("best")).collect():
            chosen.append((r.src_no, r.best.b, r.best.nth, quotas[r.src_no]))  # a fill comes after all the source's blocks
            quotas[r.src_no] += 1
            gap[r.src_no] -= r.best.size

    ends = np.cumsum(split_tree(quotas, shards, seed), axis=1)
    stretch = _small(spark.createDataFrame([(i, [int(x) for x in e]) for i, e in enumerate(ends)], "of int, ends array<long>"), len(plan))
    fill = _small(spark.createDataFrame(chosen, fill_schema), len(plan))
    out = rows.join(stretch, F.col("src_no") == F.col("of")).join(fill, is_fill, "left").withColumn("copies", F.col("epochs") + F.col("extra") + F.col("fill_at").isNotNull().cast("int"))
    turns = "concat(slice(transform(sequence(0, epochs), e -> cast(e * n + at as long)), 1, epochs + extra), if(fill_at is null, array(), array(fill_at)))"
    return out.withColumn("shards", F.expr(f"transform({turns}, t -> cast(size(filter(ends, x -> x <= t)) as int))"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 64, seed: int = 9) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns kept, in shards, shuffled within each.

    Rows that share an id, a text and a source are numbered, in the order of a hash of all their columns, and take the
    plan's rows for them in the order of their shards.
    """
    u, v = _keys(docs, id_col, text_col, seed)
    plan = _planned(docs, id_col, text_col, source_col, shards, seed).select(F.col("u").alias("__pu"), F.col("v").alias("__pv"), F.col("source").alias("__ps"), F.col("shards").alias("__shards"))
    plan = plan.withColumn("__pk", F.row_number().over(Window.partitionBy("__pu", "__pv", "__ps").orderBy("__shards"))).where(F.size("__shards") > 0)
    own = docs.withColumn("__u", u).withColumn("__v", v).withColumn("__s", F.col(source_col).cast("string"))
    own = own.withColumn("__k", F.row_number().over(Window.partitionBy("__u", "__v", "__s").orderBy(F.xxhash64(*[docs[c] for c in docs.columns]))))
    same = (F.col("__u") == F.col("__pu")) & (F.col("__v") == F.col("__pv")) & F.col("__s").eqNullSafe(F.col("__ps")) & (F.col("__k") == F.col("__pk"))
    dealt = own.join(plan, same).withColumn("__shard", F.explode("__shards"))
    parts = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))  # pieces of a shard, so that all partitions have work
    dealt = dealt.repartition("__shard", F.pmod(F.col("__u"), F.lit(parts))).sortWithinPartitions("__shard", F.xxhash64(F.lit(seed), "__u", "__v", "__shard"))
    return dealt.select(*[f"`{c}`" for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))
