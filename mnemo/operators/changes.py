"""Change feeds: extraction by commit number, and application under conflict policies.

A feed is a DataFrame with a key, an operation column op ('insert', 'update' or 'delete') and a commit number lsn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("InsertIfNotExists", "ServerWins", "EdgeWins", "LatestWins")
DIRECTIONS = ("Push", "Pull", "Both", "None")


def changes_since(feed: DataFrame, watermark: int, keys: list[str], lsn: str = "lsn", tie: str | None = None) -> DataFrame:
    """The net change per key after a commit number: its last event, so delete and insert of one key become an upsert."""
    order = F.struct(F.col(lsn), F.col(tie)) if tie else F.col(lsn)
    new = feed.where(F.col(lsn) > watermark)
    return new.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.max_by(F.struct(*feed.columns), order).alias("__row")).select("__row.*")


def apply_changes(local: DataFrame, incoming: DataFrame, keys: list[str], policy: str = "LatestWins", lsn: str = "lsn", op: str = "op", txid: str | None = None, guard: Column | None = None) -> DataFrame:
    """local after incoming under a policy, with columns __applied and __conflict per surviving or deleted-away key removed.

    Missing rows are inserted; deletes apply under every policy.  For a row that exists, InsertIfNotExists and ServerWins
    keep the local one, EdgeWins takes the incoming one, LatestWins the one with the higher lsn, then txid; ties stay
    local.  guard, over structs l and r, can veto an update (a state machine).
    """
    return merged(local, incoming, keys, policy, lsn, op, txid, guard).where(F.col("__keep")).select(*local.columns)


def conflicts(local: DataFrame, incoming: DataFrame, keys: list[str], policy: str = "LatestWins", lsn: str = "lsn", op: str = "op", txid: str | None = None) -> DataFrame:
    """Keys that both sides hold and whose policy records a conflict (ServerWins, EdgeWins, a LatestWins loss), and who won."""
    rows = merged(local, incoming, keys, policy, lsn, op, txid, None)
    return rows.where("__conflict").select(*[f"__k_{k}" for k in keys], F.when(F.col("__remote"), "incoming").otherwise("local").alias("winner"))


def merged(local: DataFrame, incoming: DataFrame, keys: list[str], policy: str, lsn: str, op: str, txid: str | None, guard: Column | None) -> DataFrame:
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    l = local.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*local.columns).alias("l"))
    r = incoming.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*incoming.columns).alias("r"))
    rows = l.join(r, [f"__k_{k}" for k in keys], "full")
    here, there = F.col("l").isNotNull(), F.col("r").isNotNull()
    gone = there & (F.col(f"r.{op}") == "delete")
    if policy == "EdgeWins":
        newer = F.lit(True)
    elif policy == "LatestWins":
        newer = F.col(f"r.{lsn}") > F.col(f"l.{lsn}")
        if txid:
            newer = newer | ((F.col(f"r.{lsn}") == F.col(f"l.{lsn}")) & (F.col(f"r.{txid}") > F.col(f"l.{txid}")))
    else:
        newer = F.lit(False)
    if guard is not None:
        newer = newer & guard
    remote = there & (~here | F.coalesce(newer, F.lit(False)))
    conflict = here & there & ~gone & (F.lit(policy in ("ServerWins", "EdgeWins")) | (F.lit(policy == "LatestWins") & ~F.coalesce(newer, F.lit(False))))
    cols = [(F.when(remote, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")) if c in incoming.columns else F.col(f"l.{c}")).alias(c) for c in local.columns]
    return rows.select(*[f"__k_{k}" for k in keys], *cols, (~gone).alias("__keep"), remote.alias("__remote"), conflict.alias("__conflict"))


def for_direction(feed: DataFrame, direction: str, tables: dict[str, str], table_col: str = "table") -> DataFrame:
    """Rows of tables whose sync direction allows this way ('Push' or 'Pull'); tables without a setting go both ways."""
    allowed = F.lit(True)
    for name, way in tables.items():
        if way not in (direction, "Both"):
            allowed = allowed & (F.col(table_col) != name)
    return feed.where(allowed)


def remapped(policy: str) -> str:
    """A policy seen from the other side: on a pull, ServerWins and EdgeWins change places."""
    return {"ServerWins": "EdgeWins", "EdgeWins": "ServerWins"}.get(policy, policy)
