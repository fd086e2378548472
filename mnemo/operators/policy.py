"""Write rules as DataFrame transformations: uniqueness, upsert, state machines, propagation, retention.

Each is a pure function over the current rows and the incoming ones; the engine runs them before it publishes a commit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.sources.shared import cut


def _all_set(keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of incoming rows with equal keys the first by order; rows with a NULL in the key are all kept."""
    whole = rows.where(_all_set(keys)).groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("__row")).select("__row.*")
    return whole.unionByName(rows.where(~_all_set(keys)))


def unique_noop(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The incoming rows that a UNIQUE key lets in: duplicates of current rows, or of earlier incoming ones, are no-ops."""
    return first_of_each(incoming, keys, order).join(current.select(*keys), keys, "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], updated: list[str], order: str) -> DataFrame:
    """current after INSERT … ON CONFLICT (keys) DO UPDATE SET c = EXCLUDED.c for c in updated; the last incoming row of a key wins."""
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*incoming.columns), F.col(order)).alias("__new"))
    rows = current.select(*keys, F.struct(*current.columns).alias("__old")).join(last, keys, "full")
    cols = [
        F.when(F.col("__old").isNull() | (F.col("__new").isNotNull() & F.lit(c in updated)), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) if c in incoming.columns else F.col(f"__old.{c}").alias(c)
        for c in current.columns
    ]
    return rows.select(*cols)


def invalid_transitions(before: DataFrame, after: DataFrame, key: str, state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(key, old, new) of changed states that the machine does not list; an unchanged state is fine."""
    ok = F.lit(False)
    for old, new in allowed.items():
        ok = ok | ((F.col("old") == old) & F.col("new").isin(list(new)))
    pairs = before.select(F.col(key), F.col(state).alias("old")).join(after.select(F.col(key), F.col(state).alias("new")), key)
    return pairs.where(~F.col("old").eqNullSafe(F.col("new")) & ~F.coalesce(ok, F.lit(False)))


@dataclass(frozen=True)
class ForeignRule:
    """Children of a parent in state `on` move to state `to`: child[column] = parent id, along at most `most` levels."""

    parent: str
    child: str
    column: str
    on: str
    to: str
    most: int = 10
    abort: bool = False


@dataclass(frozen=True)
class EdgeRule:
    """Neighbours, in the same table, over an edge type move to `to` when a row reaches `on`."""

    table: str
    edge_type: str
    direction: str
    on: str
    to: str
    most: int = 10
    abort: bool = False


def propagate(tables: dict[str, DataFrame], changed: DataFrame, rules: list, edges: DataFrame | None = None, state: str = "status", key: str = "id", allowed: dict[str, dict[str, list[str]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(moves, refused): rows (table, id, to, depth) that state propagation moves, and those a state machine refuses.

    changed: (table, id, to).  A frontier of moved rows advances one join per rule and level; a row moves once.  A move
    that the table's state machine does not allow is skipped, or, where the rule aborts, marked so in refused.
    """
    from mnemo.operators.graph import adjacency

    allowed = allowed or {}
    moves = changed.select("table", F.col("id").cast("string").alias("id"), "to").distinct().withColumn("depth", F.lit(0))
    frontier, refused = moves, None
    for depth in range(1, max((r.most for r in rules), default=0) + 1):
        found = []
        for r in rules:
            if depth > r.most:
                continue
            if isinstance(r, ForeignRule):
                hit = frontier.where((F.col("table") == r.parent) & (F.col("to") == r.on)).select(F.col("id").alias("__from"))
                child = tables[r.child].select(F.col(key).cast("string").alias("id"), F.col(r.column).cast("string").alias("__ref"), F.col(state).alias("__old"))
                rows, name = child.join(hit, F.col("__ref") == F.col("__from")), r.child
            else:
                hit = frontier.where((F.col("table") == r.table) & (F.col("to") == r.on)).select(F.col("id").alias("__from"))
                near = adjacency(edges, [r.edge_type], r.direction).join(hit, F.col("a").cast("string") == F.col("__from")).select(F.col("b").cast("string").alias("id"))
                rows, name = tables[r.table].select(F.col(key).cast("string").alias("id"), F.col(state).alias("__old")).join(near, "id"), r.table
            machine, ok = allowed.get(name), F.lit(True)
            if machine is not None:
                ok = F.col("__old") == r.to
                for old, new in machine.items():
                    ok = ok | ((F.col("__old") == old) & F.lit(r.to in new))
            found.append(rows.select(F.lit(name).alias("table"), "id", F.lit(r.to).alias("to"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(r.abort).alias("abort"), F.lit(depth).alias("depth")))
        if not found:
            break
        step = found[0]
        for more in found[1:]:
            step = step.unionByName(more)
        step = step.join(moves.select("table", "id"), ["table", "id"], "left_anti")
        step = cut(step.groupBy("table", "id").agg(F.min_by(F.struct("to", "ok", "abort", "depth"), F.struct(~F.col("ok"), "to")).alias("m")).select("table", "id", "m.*"), "propagate")
        bad = step.where("not ok")
        refused = bad if refused is None else refused.unionByName(bad)
        frontier = step.where("ok").select("table", "id", "to", "depth")
        if not frontier.take(1):
            break
        moves = moves.unionByName(frontier)
    if refused is None:
        refused = moves.limit(0).withColumn("ok", F.lit(False)).withColumn("abort", F.lit(False)).select("table", "id", "to", "ok", "abort", "depth")
    return moves, refused


def unexpired(rows: DataFrame, now_ms: int, created: str | None = None, ttl_ms: int | None = None, expires: str | None = None, lsn: str | None = None, sync_watermark: int | None = None) -> DataFrame:
    """The rows that retention keeps.

    With an expires column, a row goes once that time has passed (NULL and infinity, the largest long, never do);
    otherwise once its age exceeds the time to live.  With sync_watermark, rows not yet synced stay in any case.
    """
    if expires is not None:
        gone = F.col(expires).isNotNull() & (F.col(expires) != 2**63 - 1) & (F.col(expires) <= now_ms)
    else:
        gone = F.lit(now_ms) - F.col(created) > ttl_ms
    if sync_watermark is not None:
        gone = gone & (F.col(lsn) < sync_watermark)
    return rows.where(~F.coalesce(gone, F.lit(False)))
