"""The engine: SQL and library calls over one store, with transactions, policies, subscriptions and plugins.

A SELECT gives a lazy DataFrame.  DML gives a Result.  Statements outside BEGIN … COMMIT commit by themselves; inside,
later statements see earlier ones.  A write stages parts and becomes visible when its manifest is published.
"""

from __future__ import annotations

import json
import queue
import re
import time
import uuid
from copy import deepcopy
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo import errors as E
from mnemo.functions.formula import Formula
from mnemo.functions.vectors import storage_bytes
from mnemo.operators import changes as C
from mnemo.operators import graph, policy, vector
from mnemo.plans.parser import parse
from mnemo.plans.planner import Planner, Scope, anchor_column, constant, searchable, vector_of
from mnemo.sources.shared import cut
from mnemo.sources.store import HIDDEN, Store, name_stored, schema_of

EDGE_COLUMNS = ("source_id", "target_id", "edge_type")
#: The table of edges that belong to no user table.
EDGES = "__edges"
_UUID = re.compile(r"[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}")
FOREVER = 2**63 - 1
#: Nodes that a traversal from one start may reach.
MOST_VISITED = 100_000


@dataclass
class Result:
    """What a statement other than SELECT did."""

    rows_affected: int = 0
    lsn: int | None = None
    details: dict = field(default_factory=dict)


@dataclass(frozen=True)
class CommitEvent:
    source: str
    lsn: int
    tables: tuple[str, ...]
    rows: int


class Plugin:
    """Hooks around the engine; a hook that raises vetoes what it precedes."""

    def on_open(self, engine) -> None: ...
    def on_close(self, engine) -> None: ...
    def on_query(self, sql: str) -> None: ...
    def post_query(self, sql: str, seconds: float) -> None: ...
    def on_ddl(self, statement: dict) -> None: ...
    def pre_commit(self, tables: list[str], rows: int) -> None: ...
    def post_commit(self, event: CommitEvent) -> None: ...
    def on_sync_push(self, feed: DataFrame) -> DataFrame:
        return feed

    def on_sync_pull(self, feed: DataFrame) -> DataFrame:
        return feed

    def health(self) -> str:
        return "ok"

    def describe(self) -> dict:
        return {"name": type(self).__name__}


class Subscription:
    """A bounded queue of commit events; events beyond its capacity are dropped and counted."""

    def __init__(self, capacity: int):
        self._queue, self.delivered, self.dropped, self.closed = queue.Queue(capacity), 0, 0, False

    def offer(self, event: CommitEvent) -> None:
        try:
            self._queue.put_nowait(event)
            self.delivered += 1
        except queue.Full:
            self.dropped += 1

    def poll(self) -> CommitEvent | None:
        try:
            return self._queue.get_nowait()
        except queue.Empty:
            return None

    def close(self) -> None:
        self.closed = True


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None, plugins: tuple[Plugin, ...] = ()):
        self.spark, self.store, self.plugins = spark, Store(spark, path), list(plugins)
        self._tx: dict | None = None
        self._subscriptions: list[Subscription] = []
        self._attached: dict[str, DataFrame] = {}
        self._feed_missing()
        for p in self.plugins:
            p.on_open(self)

    def close(self) -> None:
        for p in self.plugins:
            p.on_close(self)
        for s in self._subscriptions:
            s.close()

    # State

    @property
    def state(self) -> dict:
        return self._tx["state"] if self._tx else self.store.state

    @property
    def current_lsn(self) -> int:
        return self.store.state["lsn"]

    def snapshot(self) -> int:
        """The commit number that reads see now; execute(..., at=snapshot) reads it again later."""
        return self.current_lsn

    def table_names(self) -> list[str]:
        return sorted(t for t in self.state["tables"] if t != EDGES)

    def attach(self, name: str, rows: DataFrame) -> None:
        """Make a DataFrame a table that statements read but do not write, for this engine only; its types stay."""
        self._attached[name] = rows

    def _metas(self) -> dict:
        """Metadata of the store's tables and of attached ones."""
        kinds = {"string": "TEXT", "int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "boolean": "BOOLEAN"}
        out = dict(self.state["tables"])
        for name, df in self._attached.items():
            cols = [{"name": n, "type": kinds.get(t, "TIMESTAMP" if t.startswith("timestamp") else "VECTOR" if t.startswith("array") else "TEXT"), "dimension": None, "quantization": "F32"} for n, t in df.dtypes]
            out[name] = {"columns": cols, "uniques": [], "options": {}, "indexes": {}}
        return out

    def table_meta(self, table: str) -> dict:
        if table in self._attached:
            return self._metas()[table]
        if table not in self.state["tables"]:
            raise E.TableNotFound(table)
        return self.state["tables"][table]

    def scan(self, table: str, at: int | None = None) -> DataFrame:
        """Visible rows with hidden columns __row_id, __lsn, __created_at; an attached table as it is."""
        if table in self._attached:
            return self._attached[table]
        self.table_meta(table)
        return self.store.read(self.state, table, at)

    def rows(self, table: str, at: int | None = None) -> DataFrame:
        return self.scan(table, at).drop(*HIDDEN)

    def scan_filter(self, table: str, condition, at: int | None = None) -> DataFrame:
        return self.scan(table, at).where(condition)

    def point_lookup(self, table: str, column: str, value, at: int | None = None) -> DataFrame:
        return self.rows(table, at).where(F.col(column) == value).limit(1)

    def rows_by_row_id(self, table: str, ids: list[int]) -> DataFrame:
        """The rows of the given ids, in the order of the list."""
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "__at int, __row_id long")
        return self.scan(table).join(F.broadcast(wanted), "__row_id").orderBy("__at").drop("__at")

    def edges(self, name: str | None = None, at: int | None = None) -> DataFrame:
        """Edges of a table with the edge columns, or of all such tables."""
        state, parts = self.state, []
        named = name in self._attached or (name in state["tables"] and set(EDGE_COLUMNS) <= set(schema_of(state["tables"][name]).names))
        for t, meta in state["tables"].items():
            if set(EDGE_COLUMNS) <= set(schema_of(meta).names) and (not named or t in (name, EDGES)):
                parts.append(self.store.read(state, t, at).select(*EDGE_COLUMNS))
        parts += [df.select(*EDGE_COLUMNS) for t, df in self._attached.items() if set(EDGE_COLUMNS) <= set(df.columns) and (not named or t == name)]
        if not parts:
            return self.spark.createDataFrame([], "source_id string, target_id string, edge_type string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct() if len(parts) > 1 else out

    # SQL

    def execute(self, sql: str, params: dict | None = None, at: int | None = None) -> DataFrame | Result:
        """Run a statement; at reads all models at a commit number."""
        begun = time.time()
        for p in self.plugins:
            p.on_query(sql)
        s = parse(sql)
        out = self._run(s, params or {}, at)
        for p in self.plugins:
            p.post_query(sql, time.time() - begun)
        return out

    execute_at_snapshot = execute

    def explain(self, sql: str, params: dict | None = None) -> str:
        df = self._select(parse(sql), params or {}, None)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def _run(self, s: dict, params: dict, at: int | None):
        do = s["do"]
        if do == "select":
            return self._select(s, params, at)
        if do in ("begin", "commit", "rollback"):
            getattr(self, do)()
            return Result()
        if do == "show":
            return self._show(s["what"])
        if do in ("insert", "update", "delete"):
            if s["table"] in self._attached:
                raise E.ImmutableTable(s["table"])
            return self._autocommit(lambda: getattr(self, f"_{do}")(s, params))
        for p in self.plugins:
            p.on_ddl(s)
        return self._ddl(s)

    def _planner(self, params: dict, at: int | None = None) -> Planner:
        def tables(name: str) -> DataFrame:
            if name in self._attached:
                return self._attached[name]
            if name not in self.state["tables"]:
                raise E.TableNotFound(name)
            return self.store.read(self.state, name, at)

        return Planner(tables, self._metas(), lambda g: self.edges(g, at), params, self.spark)

    def _select(self, s: dict, params: dict, at: int | None) -> DataFrame:
        return self._planner(params, at).query(s)

    # Transactions

    def begin(self) -> None:
        if self._tx is None:
            self._tx = {"state": self.store.draft(), "base": self.store.state["version"], "lsn": self.store.state["lsn"] + 1, "tables": {}}

    def rollback(self) -> None:
        self._tx = None

    def commit(self) -> int | None:
        """Check what holds for the whole write set, publish it, tell subscribers; gives the commit number."""
        tx = self._tx
        if tx is None:
            return None
        try:
            if not tx["tables"]:
                return None
            self._check_foreign_keys(tx)
            rows = sum(tx["tables"].values())
            for p in self.plugins:
                p.pre_commit(sorted(tx["tables"]), rows)
            limit = tx["state"]["settings"].get("disk_limit")
            if limit is not None and self.store.size() > limit:
                raise E.BudgetExceeded(f"the store is over {limit} bytes")
            if tx["base"] != self.store.state["version"]:
                raise E.CommitConflict("another commit came first")
            tx["state"]["lsn"] = tx["lsn"]
            self.store.publish(tx["state"])
        finally:
            self._tx = None
        self._feed_missing()
        event = CommitEvent("local", tx["lsn"], tuple(sorted(tx["tables"])), rows)
        self._subscriptions = [s for s in self._subscriptions if not s.closed]
        for s in self._subscriptions:
            s.offer(event)
        for p in self.plugins:
            p.post_commit(event)
        return tx["lsn"]

    def _autocommit(self, f):
        if self._tx is not None:
            keep = (deepcopy(self._tx["state"]), dict(self._tx["tables"]))
            try:
                return f()
            except Exception:  # a failed statement leaves the transaction as it was
                self._tx["state"], self._tx["tables"] = keep
                raise
        self.begin()
        try:
            out = f()
            out.lsn = self.commit()
            return out
        finally:
            self._tx = None

    def _stage(self, table: str, rows: DataFrame | None = None, dead: DataFrame | None = None, count: int = 0) -> None:
        tx = self._tx
        if dead is not None:
            self.store.add_graves(tx["state"], table, dead, tx["lsn"])
        if rows is not None:
            self.store.add_rows(tx["state"], table, rows, tx["lsn"])
        tx["tables"][table] = tx["tables"].get(table, 0) + count

    def _feed_missing(self) -> None:
        """Append commits to the feed folder that streams read.

        The manifest says what was committed, and a mark is left after each commit that is in the feed; so a commit
        whose writer was lost is appended by the next one to open the store.  A commit may then be there twice, never
        missing; readers go by commit numbers.
        """
        state, done = self.store.state, self.store.marked("fed")
        for lsn in sorted({p["lsn"] for parts in state["parts"].values() for p in parts if p["lsn"] > done}):
            for table, parts in state["parts"].items():
                if not any(p["lsn"] == lsn for p in parts):
                    continue
                born = self.store.born(state, table, lsn).withColumn("op", F.lit("insert"))
                gone = self.store.dead(state, table, lsn - 1).where(F.col("__lsn") == lsn).withColumn("op", F.lit("delete"))
                rows = born.unionByName(gone)
                cols = [f"`{c}`" for c in schema_of(state["tables"][table]).names]
                out = rows.select(F.lit(table).alias("table"), "op", F.col("__row_id").alias("row_id"), F.col("__lsn").alias("lsn"), F.to_json(F.struct(*cols)).alias("row"))
                out.write.mode("append").parquet(f"{self.store.path}/feed")
            self.store.mark("fed", lsn)

    # Values

    def _coerced(self, c: dict, v):
        """A Python value as the column stores it."""
        kind, name = c["type"], c["name"]
        if v is None:
            return None
        if kind == "VECTOR":
            v = json.loads(v) if isinstance(v, str) else v
            if len(v) != c["dimension"]:
                raise E.VectorDimensionMismatch(f"{name} has {c['dimension']} values, got {len(v)}")
            return [float(x) for x in v]
        if kind == "UUID":
            if isinstance(v, uuid.UUID):
                return str(v)
            if _UUID.fullmatch(str(v)):
                return str(uuid.UUID(str(v)))
            return str(v)  # readable ids are accepted
        if kind == "TIMESTAMP" and isinstance(v, str):
            if v.lower() == "infinity":
                return FOREVER
            when = datetime.fromisoformat(v.replace("Z", "+00:00"))
            return int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1000)
        if kind in ("INTEGER", "TIMESTAMP", "TXID"):
            if isinstance(v, bool) or int(v) != v:
                raise E.ParseError(f"{name} takes whole numbers")
            return int(v)
        if kind == "REAL":
            return float(v)
        if kind == "BOOLEAN":
            return bool(v)
        return v if isinstance(v, str) else json.dumps(v)

    def _keys(self, meta: dict) -> tuple[list[str], list[list[str]]]:
        primary = [c["name"] for c in meta["columns"] if c.get("primary")]
        return primary, [[c["name"]] for c in meta["columns"] if c.get("unique")] + meta.get("uniques", [])

    # INSERT

    def _insert(self, s: dict, params: dict) -> Result:
        if s["table"].upper() == "GRAPH" or s["table"] == EDGES:
            self._edge_table()
            s = s | {"table": EDGES}
        meta = self.table_meta(s["table"])
        cols = {c["name"]: c for c in meta["columns"]}
        names = s["columns"] or list(cols)
        if unknown := [n for n in names if n not in cols]:
            raise E.ColumnNotFound(", ".join(unknown))
        rows = []
        for values in s["rows"]:
            if len(values) != len(names):
                raise E.ParseError("as many values as columns are needed")
            got = {n: constant(v, params) for n, v in zip(names, values, strict=True)}
            for n, c in cols.items():
                if n not in got:
                    got[n] = constant(tuple(c["default"]), params) if c.get("default") is not None else None
                if got[n] is None and c.get("required"):
                    raise E.NotNullViolation(n)
            rows.append(tuple([*[self._coerced(c, got[n]) for n, c in cols.items()], len(rows)]))
        schema = T.StructType([*schema_of(meta).fields, T.StructField("__ord", T.LongType())])
        df = self.spark.createDataFrame(rows, schema)
        if s["conflict"]:
            return self._upsert(s["table"], df, s["conflict"][0], s["conflict"][1], params, names)
        return self._insert_frame(s["table"], df)

    def insert_rows(self, table: str, rows: DataFrame) -> Result:
        """Insert a DataFrame under the table's rules; missing columns are NULL."""
        meta = self.table_meta(table)
        have = set(rows.columns)
        df = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(meta).fields], F.monotonically_increasing_id().alias("__ord"))
        for c in meta["columns"]:
            if c.get("required") and df.where(F.col(c["name"]).isNull()).take(1):
                raise E.NotNullViolation(c["name"])
        return self._autocommit(lambda: self._insert_frame(table, df))

    def upsert_rows(self, table: str, rows: DataFrame, key: str, updated: list[str]) -> Result:
        """INSERT … ON CONFLICT (key) DO UPDATE of a DataFrame: the last row of a key counts, in the order of rows."""
        fields = schema_of(self.table_meta(table)).fields
        have = set(rows.columns)
        df = cut(rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], F.monotonically_increasing_id().alias("__ord")), "upsert")
        sets = [(c, ("col", "EXCLUDED", c)) for c in updated]
        return self._autocommit(lambda: self._upsert(table, df, [key], sets, {}, rows.columns))

    def insert_row(self, table: str, values: dict) -> Result:
        meta = self.table_meta(table)
        given = [n for n in schema_of(meta).names if n in values]
        return self._autocommit(lambda: self._insert({"table": table, "columns": given, "rows": [[("lit", values[n]) for n in given]], "conflict": None}, {}))

    def _insert_frame(self, table: str, df: DataFrame) -> Result:
        meta = self.table_meta(table)
        current = self.scan(table)
        primary, uniques = self._keys(meta)
        for k in primary:
            if df.where(F.col(k).isNotNull()).groupBy(k).count().where("count > 1").take(1) or df.join(current.select(k), k, "left_semi").take(1):
                raise E.UniqueViolation(f"{table}.{k}")
        for keys in uniques:
            df = policy.unique_noop(current, df, keys, "__ord")
        if set(EDGE_COLUMNS) <= set(df.columns):
            df = policy.unique_noop(current, df, list(EDGE_COLUMNS), "__ord")
            self._check_dag(meta, df)
        n = df.count()
        if n:
            self._stage(table, df.drop("__ord"), count=n)
        return Result(n)

    def _check_dag(self, meta: dict, new: DataFrame) -> None:
        for kind in meta["options"].get("dag", []):
            mine = new.where(F.col("edge_type") == kind).select(*EDGE_COLUMNS)
            if not mine.take(1):
                continue
            if mine.where("source_id = target_id").take(1) or graph.reaches(self.edges().unionByName(mine), mine, kind).take(1):
                raise E.CycleDetected(kind)

    def _upsert(self, table: str, df: DataFrame, keys: list[str], sets: list, params: dict, given: list[str]) -> Result:
        meta = self.table_meta(table)
        if meta["options"].get("immutable"):
            raise E.ImmutableTable(table)
        frozen = {c["name"] for c in meta["columns"] if c.get("immutable")}
        if bad := [c for c, _ in sets if c in frozen]:
            raise E.ImmutableColumn(", ".join(bad))
        key, total = keys[0], df.count()
        last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), "__ord").alias("__new"))
        hit = self.scan(table).join(last, key)
        names = schema_of(meta).names
        scope = Scope([(None, names)])
        planner, values = self._planner(params), {}
        for c, e in sets:
            values[c] = F.col(f"__new.{e[2]}") if e[0] == "col" and (e[1] or "").upper() == "EXCLUDED" else planner.expr(e, scope)
        kinds = {f.name: f.dataType for f in schema_of(meta).fields}
        changed = hit.select("__row_id", *[(values[n].cast(kinds[n]) if n in values else F.col(n)).alias(n) for n in names])
        machine = meta["options"].get("state_machine")
        if machine and machine["column"] in values:
            self._check_states(table, self.scan(table), changed, machine)
        self._check_unique(table, changed, set(values))
        fresh = df.join(self.scan(table).select(key), key, "left_anti")
        fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*fresh.columns), "__ord").alias("__r")).select("__r.*")
        n_old = changed.count()
        if n_old:
            self._stage(table, changed.select(*names), changed.select("__row_id"), n_old)
        n_new = fresh.count()
        if n_new:
            self._insert_frame(table, fresh.select(*names, "__ord"))
        return Result(total)

    def upsert_row(self, table: str, key: str, values: dict) -> Result:
        sets = [(c, ("col", "EXCLUDED", c)) for c in values if c != key]
        names = list(values)
        return self._autocommit(lambda: self._insert({"table": table, "columns": names, "rows": [[("lit", values[n]) for n in names]], "conflict": ([key], sets)}, {}))

    # UPDATE and DELETE

    def _where_rows(self, table: str, where: tuple | None, params: dict) -> DataFrame:
        planner, df = self._planner(params), self.scan(table)
        return planner._where(df.alias(table), where, Scope([(table, df.columns)], dict(df.dtypes))).select(*[f"`{table}`.`{c}`" for c in df.columns])

    def _update(self, s: dict, params: dict) -> Result:
        table, meta = s["table"], self.table_meta(s["table"])
        names = schema_of(meta).names
        if unknown := [c for c, _ in s["set"] if c not in names]:
            raise E.ColumnNotFound(", ".join(unknown))
        if meta["options"].get("immutable"):
            raise E.ImmutableTable(table)
        frozen = {c["name"] for c in meta["columns"] if c.get("immutable")}
        if bad := [c for c, _ in s["set"] if c in frozen]:
            raise E.ImmutableColumn(", ".join(bad))
        old = self._where_rows(table, s["where"], params)
        planner, scope = self._planner(params), Scope([(None, old.columns)], dict(old.dtypes))
        by, fields = {c["name"]: c for c in meta["columns"]}, {f.name: f.dataType for f in schema_of(meta).fields}
        values = {}
        for c, e in s["set"]:
            if e[0] in ("lit", "param", "vector", "neg"):
                v = self._coerced(by[c], vector_of(e, params) if by[c]["type"] == "VECTOR" and constant(e, params) is not None else constant(e, params))
                values[c] = (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(fields[c])
            else:
                values[c] = planner.expr(e, scope).cast(fields[c])
        new = old.select("__row_id", *[values.get(n, F.col(n)).alias(n) for n in names])
        return self._replace(table, old, new, set(values))

    def _replace(self, table: str, old: DataFrame, new: DataFrame, changed: set[str], propagate: bool = True) -> Result:
        meta = self.table_meta(table)
        names, machine = schema_of(meta).names, meta["options"].get("state_machine")
        if machine and machine["column"] in changed:
            self._check_states(table, old, new, machine)
        self._check_unique(table, new, changed)
        n = new.count()
        if not n:
            return Result(0)
        moved = None
        state_col = machine["column"] if machine else "status"
        if propagate and state_col in changed and self._rules():
            before = old.select("__row_id", F.col(state_col).alias("__was"))
            moved = new.join(before, "__row_id").where(~F.col("__was").eqNullSafe(F.col(state_col))).select(F.lit(table).alias("table"), F.col("id").cast("string").alias("id"), F.col(state_col).alias("to"))
            moved = cut(moved, "moved")
        self._stage(table, new.select(*names), new.select("__row_id"), n)
        done = {}
        if moved is not None:
            done = self._propagate(moved)
        return Result(n, details={"propagated": done})

    def _check_unique(self, table: str, new: DataFrame, changed: set[str]) -> None:
        """Refuse changed rows whose keys another row has."""
        meta = self.table_meta(table)
        for keys in [[k] for k in self._keys(meta)[0]] + self._keys(meta)[1]:
            if changed & set(keys):
                rest = self.scan(table).join(new.select("__row_id"), "__row_id", "left_anti")
                both = rest.select(*keys).unionByName(new.select(*keys)).where(policy._all_set(keys))
                if both.groupBy(*keys).count().where("count > 1").take(1):
                    raise E.UniqueViolation(f"{table}.{','.join(keys)}")

    def _check_states(self, table: str, old: DataFrame, new: DataFrame, machine: dict) -> None:
        if bad := policy.invalid_transitions(old, new, "__row_id", machine["column"], machine["moves"]).take(1):
            raise E.InvalidStateTransition(f"{table}: {bad[0].old} -> {bad[0].new}")

    def _rules(self) -> list:
        out = []
        for t, meta in self.state["tables"].items():
            for c in meta["columns"]:
                for r in c.get("propagate", []):
                    out.append(policy.ForeignRule(c["references"][0], t, c["name"], r["on"], r["to"], r["most"], r["abort"]))
            for r in meta["options"].get("propagate_edge", []):
                out.append(policy.EdgeRule(t, r["edge_type"], r["direction"], r["on"], r["to"], r["most"], r["abort"]))
        return out

    def _propagate(self, moved: DataFrame) -> dict[str, int]:
        rules = self._rules()
        metas = self.state["tables"]
        allowed = {t: m["options"]["state_machine"]["moves"] for t, m in metas.items() if m["options"].get("state_machine")}
        touched = {r.child if isinstance(r, policy.ForeignRule) else r.table for r in rules}
        tables = {t: self.scan(t) for t in touched}
        moves, refused = policy.propagate(tables, moved, rules, self.edges(), "status", "id", allowed)
        if bad := refused.where("abort").take(1):
            raise E.PropagationAborted(f"{bad[0].table} {bad[0].id} cannot become {bad[0].to}")
        done = {}
        for t in sorted(touched):
            mine = moves.where((F.col("table") == t) & (F.col("depth") > 0)).select(F.col("id").alias("__mid"), F.col("to").alias("__to"))
            names = schema_of(metas[t]).names
            new = self.scan(t).join(mine, F.col("id").cast("string") == F.col("__mid")).select("__row_id", *[(F.col("__to") if n == "status" else F.col(n)).alias(n) for n in names])
            if n := new.count():
                self._stage(t, new.select(*names), new.select("__row_id"), n)
                done[t] = n
        return done

    def _delete(self, s: dict, params: dict) -> Result:
        meta = self.table_meta(s["table"])
        if meta["options"].get("immutable"):
            raise E.ImmutableTable(s["table"])
        dead = self._where_rows(s["table"], s["where"], params).select("__row_id")
        n = dead.count()
        if n:
            self._stage(s["table"], None, dead, n)
        return Result(n)

    def delete_row(self, table: str, row_id: int) -> Result:
        if self.table_meta(table)["options"].get("immutable"):
            raise E.ImmutableTable(table)

        def run():
            dead = self.scan(table).where(F.col("__row_id") == row_id).select("__row_id")
            n = dead.count()
            if n:
                self._stage(table, None, dead, n)
            return Result(n)

        return self._autocommit(run)

    def _check_foreign_keys(self, tx: dict) -> None:
        for t in tx["tables"]:
            for c in tx["state"]["tables"][t]["columns"]:
                if "references" in c:
                    parent, key = c["references"]
                    if parent not in tx["state"]["tables"]:
                        raise E.TableNotFound(parent)
                    child = self.store.read(tx["state"], t).where((F.col("__lsn") == tx["lsn"]) & F.col(c["name"]).isNotNull()).select(F.col(c["name"]).alias("__ref"))
                    known = self.store.read(tx["state"], parent).select(F.col(key).alias("__key"))
                    if bad := child.join(known, F.col("__ref") == F.col("__key"), "left_anti").take(1):
                        raise E.ForeignKeyViolation(f"{t}.{c['name']} = {bad[0][0]}")

    # DDL: never part of a transaction

    def _ddl(self, s: dict) -> Result:
        state = self.store.draft()
        out = getattr(self, f"_ddl_{s['do']}")(state, s) or Result()
        state["lsn"] += 1
        state["log"].append({"lsn": state["lsn"], "ddl": {k: v for k, v in s.items()}})
        self.store.publish(state)
        if self._tx is not None:  # staged parts go on over the new catalog
            tx = self._tx["state"]
            self._tx["state"] = state | {"version": self.store.state["version"], "parts": tx["parts"], "next_row": max(tx["next_row"], state["next_row"])}
            self._tx["base"], self._tx["lsn"] = self.store.state["version"], state["lsn"] + 1
        out.lsn = state["lsn"]
        return out

    def _edge_table(self) -> None:
        if EDGES not in self.state["tables"]:
            cols = [{"name": n, "type": "TEXT", "required": True} for n in EDGE_COLUMNS] + [{"name": "properties", "type": "JSON"}]
            self._ddl({"do": "create_table", "name": EDGES, "columns": cols, "uniques": [], "options": {}, "if_not_exists": True})

    def _ddl_create_table(self, state: dict, s: dict) -> Result:
        name = s["name"]
        if name in state["tables"]:
            if s["if_not_exists"]:
                return Result()
            raise E.TableExists(name)
        meta = {"columns": s["columns"], "uniques": s["uniques"], "options": s["options"], "indexes": {}}
        for c in meta["columns"]:
            name_stored(meta, c)
            if c.get("expires") and c["type"] != "TIMESTAMP":
                raise E.ParseError("EXPIRES needs a TIMESTAMP column")
            if c.get("primary"):
                meta["indexes"][f"__pk_{c['name']}"] = [[c["name"], "ASC"]]
            if c.get("unique"):
                meta["indexes"][f"__unique_{c['name']}"] = [[c["name"], "ASC"]]
        state["tables"][name] = meta
        state["parts"][name] = []
        for c in meta["columns"]:
            if "rank_policy" in c:
                self._check_rank_policy(state, name, c)
        return Result()

    def _check_rank_policy(self, state: dict, table: str, column: dict) -> None:
        p, meta = column["rank_policy"], state["tables"][table]
        if column["type"] != "VECTOR":
            raise E.RankPolicyInvalid("a rank policy belongs to a vector column")
        if p["join"] not in state["tables"]:
            raise E.RankPolicyInvalid(f"no table {p['join']}")
        other = state["tables"][p["join"]]
        if not any(cols[0][0] == p["on"] for cols in other["indexes"].values()):
            raise E.RankPolicyInvalid(f"{p['join']} needs an index led by {p['on']}")
        anchor_column(meta, table, other, p["on"])
        kinds = {c["name"]: c["type"] for c in other["columns"]} | {c["name"]: c["type"] for c in meta["columns"]}
        for c in Formula(p["formula"]).columns:
            if c == "vector_score":
                continue
            if c == "id" and "id" in {x["name"] for x in meta["columns"]} & {x["name"] for x in other["columns"]}:
                raise E.RankPolicyInvalid("id is ambiguous")
            if kinds.get(c) not in ("REAL", "INTEGER", "BOOLEAN"):
                raise E.RankPolicyInvalid(f"{c} is no number")

    def _dependents(self, state: dict, table: str, column: str | None = None) -> list[str]:
        out = []
        for t, meta in state["tables"].items():
            for c in meta["columns"]:
                p = c.get("rank_policy")
                if p and t != table and p["join"] == table and (column is None or column == p["on"] or column in Formula(p["formula"]).columns):
                    out.append(f"{t}.{c['name']}")
                if p and t == table and column is not None and column != c["name"] and column in Formula(p["formula"]).columns:
                    out.append(f"{t}.{c['name']}")
        return out

    def _ddl_drop_table(self, state: dict, s: dict) -> Result:
        if s["name"] not in state["tables"]:
            return Result()
        if used := self._dependents(state, s["name"]):
            raise E.RankPolicyInvalid(f"used by {', '.join(used)}")
        del state["tables"][s["name"]], state["parts"][s["name"]]
        return Result()

    def _ddl_alter(self, state: dict, s: dict) -> Result:
        if s["table"] not in state["tables"]:
            raise E.TableNotFound(s["table"])
        meta, action = state["tables"][s["table"]], s["action"]
        names = [c["name"] for c in meta["columns"]]
        if action == "add":
            c = s["column"]
            if c["name"] in names:
                raise E.ParseError(f"{c['name']} exists")
            if c.get("primary"):
                raise E.ParseError("a primary key cannot be added")
            if c.get("expires") and c["type"] != "TIMESTAMP":
                raise E.ParseError("EXPIRES needs a TIMESTAMP column")
            name_stored(meta, c)
            meta["columns"].append(c)
            if "rank_policy" in c:
                self._check_rank_policy(state, s["table"], c)
        elif action in ("drop", "rename"):
            if s["column"] not in names:
                raise E.ColumnNotFound(s["column"])
            c = meta["columns"][names.index(s["column"])]
            if used := self._dependents(state, s["table"], s["column"]):
                raise E.RankPolicyInvalid(f"used by {', '.join(used)}")
            if c.get("immutable"):
                raise E.ImmutableColumn(c["name"])
            if action == "rename":
                if s["to"] in names:
                    raise E.ParseError(f"{s['to']} exists")
                c["name"] = s["to"]
                for cols in meta["indexes"].values():
                    for x in cols:
                        x[0] = s["to"] if x[0] == s["column"] else x[0]
                return Result()
            if c.get("primary"):
                raise E.ParseError("a primary key cannot be dropped")
            used = [n for n, cols in meta["indexes"].items() if any(x[0] == c["name"] for x in cols)]
            if [n for n in used if not n.startswith("__")] and not s["cascade"]:
                raise E.ColumnInIndex(", ".join(used))
            for n in used:
                del meta["indexes"][n]
            meta["columns"].remove(c)
            return Result(details={"dropped_indexes": used})
        elif action == "set_retain":
            if meta["options"].get("immutable"):
                raise E.ImmutableTable(s["table"])
            meta["options"]["retain"] = s["retain"]
        elif action == "drop_retain":
            meta["options"].pop("retain", None)
        elif action == "set_policy":
            meta["options"]["conflict_policy"] = s["policy"]
        else:
            meta["options"].pop("conflict_policy", None)
        return Result()

    def _ddl_create_index(self, state: dict, s: dict) -> Result:
        if s["table"] not in state["tables"]:
            raise E.TableNotFound(s["table"])
        meta = state["tables"][s["table"]]
        kinds = {c["name"]: c["type"] for c in meta["columns"]}
        for c, _ in s["columns"]:
            if c not in kinds:
                raise E.ColumnNotFound(c)
            if kinds[c] in ("JSON", "VECTOR"):
                raise E.ColumnNotIndexable(c)
        if s["name"] in meta["indexes"] or s["name"].startswith(("__pk_", "__unique_")):
            raise E.DuplicateIndex(s["name"])
        meta["indexes"][s["name"]] = [list(x) for x in s["columns"]]
        return Result()

    def _ddl_drop_index(self, state: dict, s: dict) -> Result:
        if s["table"] not in state["tables"]:
            raise E.TableNotFound(s["table"])
        if s["name"] not in state["tables"][s["table"]]["indexes"] and not s["if_exists"]:
            raise E.IndexNotFound(s["name"])
        state["tables"][s["table"]]["indexes"].pop(s["name"], None)
        return Result()

    def _ddl_set_policy(self, state: dict, s: dict) -> Result:
        state["settings"]["conflict_policy"] = s["policy"]
        return Result()

    def _ddl_set_limit(self, state: dict, s: dict) -> Result:
        state["settings"][s["what"]] = s["bytes"]
        return Result()

    def _show(self, what: str) -> DataFrame:
        state = self.state
        if what == "sync_conflict_policy":
            rows = [("default", state["settings"].get("conflict_policy", "LatestWins"))] + [(t, m["options"]["conflict_policy"]) for t, m in sorted(state["tables"].items()) if "conflict_policy" in m["options"]]
            return self.spark.createDataFrame(rows, "scope string, policy string")
        if what == "vector_indexes":
            parts = []
            for t, m in sorted(state["tables"].items()):
                for c in m["columns"]:
                    if c["type"] == "VECTOR":
                        size = storage_bytes(c["dimension"], c["quantization"])
                        parts.append(self.scan(t).agg(F.count(c["name"]).alias("vector_count")).select(F.lit(t).alias("table"), F.lit(c["name"]).alias("column"), F.lit(c["dimension"]).alias("dimension"), F.lit(c["quantization"]).alias("quantization"), "vector_count", (F.col("vector_count") * size).alias("bytes")))
            if not parts:
                return self.spark.createDataFrame([], "table string, column string, dimension int, quantization string, vector_count long, bytes long")
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        limit = state["settings"].get(what)
        used = self.store.size() if what == "disk_limit" else 0
        return self.spark.createDataFrame([(limit, used, None if limit is None else limit - used)], "limit long, used long, available long")

    def render_schema(self, table: str) -> str:
        """CREATE TABLE text of a table; parsing it gives the same metadata."""
        meta = self.table_meta(table)
        lines = []
        for c in meta["columns"]:
            kind = f"VECTOR({c['dimension']}) WITH (quantization = '{c['quantization']}')" if c["type"] == "VECTOR" else c["type"]
            words = [c["name"], kind]
            words += ["NOT NULL"] * bool(c.get("required")) + ["PRIMARY KEY"] * bool(c.get("primary")) + ["UNIQUE"] * bool(c.get("unique"))
            if c.get("default") is not None:
                words.append(f"DEFAULT {_literal(c['default'])}")
            if "references" in c:
                words.append(f"REFERENCES {c['references'][0]}({c['references'][1]})")
            for r in c.get("propagate", []):
                words.append(f"ON STATE {r['on']} PROPAGATE SET {r['to']} MAX DEPTH {r['most']}" + " ABORT ON FAILURE" * r["abort"])
            words += ["EXPIRES"] * bool(c.get("expires")) + ["IMMUTABLE"] * bool(c.get("immutable"))
            if p := c.get("rank_policy"):
                words.append(f"RANK_POLICY (JOIN {p['join']} ON {p['on']}, FORMULA '{p['formula']}', SORT_KEY {p['sort_key']})")
            lines.append("  " + " ".join(words))
        lines += [f"  UNIQUE ({', '.join(u)})" for u in meta.get("uniques", [])]
        o, tail = meta["options"], []
        tail += ["IMMUTABLE"] * bool(o.get("immutable"))
        if m := o.get("state_machine"):
            tail.append("STATE MACHINE (" + ", ".join(f"{m['column']}: {a} -> [{', '.join(b)}]" for a, b in m["moves"].items()) + ")")
        if o.get("dag"):
            tail.append("DAG (" + ", ".join(f"'{x}'" for x in o["dag"]) + ")")
        for r in o.get("propagate_edge", []):
            way = {"in": "INCOMING", "out": "OUTGOING", "both": "BOTH"}[r["direction"]]
            tail.append(f"PROPAGATE ON EDGE {r['edge_type']} {way} STATE {r['on']} SET {r['to']} MAX DEPTH {r['most']}" + " ABORT ON FAILURE" * r["abort"])
        tail += [f"PROPAGATE ON STATE {x} EXCLUDE VECTOR" for x in o.get("exclude_vector", [])]
        if r := o.get("retain"):
            tail.append(f"RETAIN {r['ttl_ms'] // 1000} SECONDS" + " SYNC SAFE" * r["sync_safe"])
        return f"CREATE TABLE {table} (\n" + ",\n".join(lines) + "\n)" + "".join(f"\n{x}" for x in tail)

    # Graph and vector calls

    def insert_edge(self, source: str, target: str, edge_type: str, properties: dict | None = None) -> bool:
        self._edge_table()
        return self.insert_row(EDGES, {"source_id": source, "target_id": target, "edge_type": edge_type, "properties": json.dumps(properties or {})}).rows_affected == 1

    def delete_edge(self, source: str, target: str, edge_type: str) -> bool:
        if EDGES not in self.state["tables"]:
            return False
        where = ("and", ("cmp", "=", ("col", None, "source_id"), ("lit", source)), ("and", ("cmp", "=", ("col", None, "target_id"), ("lit", target)), ("cmp", "=", ("col", None, "edge_type"), ("lit", edge_type))))
        return self._autocommit(lambda: self._delete({"table": EDGES, "where": where}, {})).rows_affected > 0

    def edge_properties(self, source: str, target: str, edge_type: str) -> dict | None:
        if EDGES not in self.state["tables"]:
            return None
        got = self.rows(EDGES).where((F.col("source_id") == source) & (F.col("target_id") == target) & (F.col("edge_type") == edge_type)).take(1)
        return json.loads(got[0].properties or "{}") if got else None

    def edge_count(self, source: str, edge_type: str | None = None, at: int | None = None) -> int:
        e = self.edges(None, at).where(F.col("source_id") == source)
        return (e.where(F.col("edge_type") == edge_type) if edge_type else e).count()

    def edge_counts(self, edge_type: str, at: int | None = None) -> DataFrame:
        """(source_id, n): outgoing edges of a type, for every source that has one."""
        return self.edges(None, at).where(F.col("edge_type") == edge_type).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))

    def query_bfs(self, start: str, edge_types=None, direction: str = "out", most: int = 3, at: int | None = None) -> DataFrame:
        starts = self.spark.createDataFrame([(start,)], "start string")
        return graph.bfs_paths(self.edges(None, at), starts, edge_types, direction, most)

    def bfs(self, starts: list[str] | DataFrame, edge_types=None, direction: str = "out", least: int = 1, most: int = 1, at: int | None = None, name: str | None = None, most_visited: int | None = MOST_VISITED) -> DataFrame:
        """(start, node, depth) from many starts at once: ids, or a DataFrame with a column start.

        A start that reaches more than most_visited nodes is an error; None sets no limit.
        """
        first = starts if isinstance(starts, DataFrame) else self.spark.createDataFrame([(x,) for x in starts], "start string")
        return graph.bfs(self.edges(name, at), first, edge_types, direction, least, most, most_visited)

    def query_vector(self, table: str, column: str, query: list[float], k: int, at: int | None = None) -> DataFrame:
        c = next((c for c in self.table_meta(table)["columns"] if c["name"] == column and c["type"] == "VECTOR"), None)
        if c is None:
            raise E.UnknownVectorIndex(f"{table}.{column}")
        if c["dimension"] not in (None, len(query)):
            raise E.VectorDimensionMismatch(f"{column} has {c['dimension']} values")
        rows = self._searchable(table, self.scan(table, at), column)
        return vector.top_k(rows, column, query, k, "__row_id" if "__row_id" in rows.columns else rows.columns[0])

    def _searchable(self, table: str, rows: DataFrame, column: str) -> DataFrame:
        """Rows with a vector, without those whose state is excluded from vector search."""
        return searchable(rows.where(F.col(column).isNotNull()), self.table_meta(table))

    def semantic_search(self, table: str, column: str, query: list[float], limit: int, sort_key: str | None = None, min_similarity: float | None = None, where: str | None = None, params: dict | None = None) -> DataFrame:
        """Rows with vector_score and, with a sort key, rank; min_similarity bounds the similarity before the formula."""
        rows = self.scan(table)
        if where:
            cond = parse(f"SELECT * FROM {table} WHERE {where}")["body"]["where"]
            rows = self._where_rows(table, cond, params or {})
        rows = self._searchable(table, rows, column)
        if sort_key:
            got = self._planner(params or {}).ranked(rows, table, column, query, sort_key, limit, min_similarity)
            return got.drop("__row_id", "__lsn", "__created_at")
        got = vector.top_k(rows, column, query, limit, "__row_id" if "__row_id" in rows.columns else rows.columns[0], min_similarity)
        return got.withColumnRenamed("score", "vector_score").drop("__row_id", "__lsn", "__created_at")

    # Feeds, retention, subscriptions

    def subscribe(self, capacity: int = 64) -> Subscription:
        self._subscriptions.append(Subscription(capacity))
        return self._subscriptions[-1]

    def subscription_health(self) -> list[dict]:
        return [{"delivered": s.delivered, "dropped": s.dropped, "closed": s.closed} for s in self._subscriptions]

    def changes_since(self, table: str, lsn: int) -> DataFrame:
        """Net changes of a table after a commit number: its columns, op ('upsert' or 'delete') and lsn, a row per key."""
        meta = self.table_meta(table)
        keys = self._keys(meta)[0] or ([EDGE_COLUMNS[0], EDGE_COLUMNS[1], EDGE_COLUMNS[2]] if set(EDGE_COLUMNS) <= set(schema_of(meta).names) else [])
        names = schema_of(meta).names
        born = self.scan(table).where(F.col("__lsn") > lsn).select(*names, F.lit("upsert").alias("op"), F.col("__lsn").alias("lsn"))
        dead = self.store.dead(self.state, table, lsn).select(*names, F.lit("delete").alias("op"), F.col("__lsn").alias("lsn"))
        if not keys:
            return born.unionByName(dead)
        gone = dead.join(self.scan(table).select(*keys), keys, "left_anti")
        return C.changes_since(born.unionByName(gone), lsn, keys)

    def push(self, target, table: str, since: int = 0, policy_name: str | None = None) -> Result:
        """Apply a table's changes after a commit number to another engine, through this one's push hooks."""
        feed = self.changes_since(table, since)
        for p in self.plugins:
            feed = p.on_sync_push(feed)
        return target.apply_changes(table, feed, policy_name)

    def pull(self, source, since: int = 0, directions: dict[str, str] | None = None, policy_name: str | None = None) -> dict[str, Result]:
        """Bring another engine's tables here: its statements that made or changed tables, then their changes.

        directions maps a table to Push, Pull, Both or None; tables without one go both ways.
        """
        for entry in source.ddl_log_since(since):
            s = entry["ddl"]
            if s["do"] == "create_table" and s["name"] in self.state["tables"]:
                continue
            self._ddl(deepcopy(s))
        out = {}
        for t in source.table_names():
            if (directions or {}).get(t, "Both") in ("Pull", "Both"):
                out[t] = source.push(self, t, since, policy_name and C.remapped(policy_name))
        return out

    def ddl_log_since(self, lsn: int) -> list[dict]:
        return [x for x in self.store.state["log"] if x["lsn"] > lsn]

    def apply_changes(self, table: str, feed: DataFrame, policy_name: str | None = None) -> Result:
        """Apply a feed of changes_since under the table's conflict policy, in one commit."""
        for p in self.plugins:
            feed = p.on_sync_pull(feed)
        meta = self.table_meta(table)
        keys = self._keys(meta)[0]
        if not keys:
            raise E.ParseError("a feed needs a primary key")
        rule = policy_name or meta["options"].get("conflict_policy") or self.state["settings"].get("conflict_policy", "LatestWins")
        names = schema_of(meta).names
        feed = feed.select(*[F.col(n) if n in feed.columns else F.lit(None).alias(n) for n in names], "op", "lsn")
        lost = C.conflicts(self.scan(table).withColumn("lsn", F.col("__lsn")).select(*names, "lsn"), feed, keys, rule).count()

        def run():
            local = self.scan(table).select(*names, F.col("__lsn").alias("lsn"), "__row_id")
            guard, machine = None, meta["options"].get("state_machine")
            if machine:
                guard = F.col(f"l.{machine['column']}").eqNullSafe(F.col(f"r.{machine['column']}"))
                for old, to in machine["moves"].items():
                    guard = guard | ((F.col(f"l.{machine['column']}") == old) & F.col(f"r.{machine['column']}").isin(to))
            both = C.merged(local, feed, keys, rule, "lsn", "op", None, guard)
            fresh = both.where("__keep and __remote")
            gone = both.where("(not __keep or __remote) and __row_id is not null").select("__row_id")
            n_new, n_gone = fresh.count(), gone.count()
            if n_new or n_gone:
                self._stage(table, fresh.select(*names) if n_new else None, gone if n_gone else None, n_new + n_gone)
            return Result(n_new + n_gone, details={"conflicts": lost})

        return self._autocommit(run)

    def prune(self, now_ms: int | None = None, sync_watermark: int = 0) -> dict[str, int]:
        """Remove expired rows of tables with RETAIN; SYNC SAFE keeps rows from the watermark on."""
        now, out = now_ms if now_ms is not None else int(time.time() * 1000), {}
        for t, meta in self.state["tables"].items():
            keep = meta["options"].get("retain")
            if not keep:
                continue
            expires = next((c["name"] for c in meta["columns"] if c.get("expires")), None)
            rows = self.scan(t)
            kept = policy.unexpired(rows, now, "__created_at", keep["ttl_ms"], expires, "__lsn", sync_watermark if keep["sync_safe"] else None)

            def run(t=t, rows=rows, kept=kept):
                dead = rows.join(kept.select("__row_id"), "__row_id", "left_anti").select("__row_id")
                n = dead.count()
                if n:
                    self._stage(t, None, dead, n)
                return Result(n)

            if n := self._autocommit(run).rows_affected:
                out[t] = n
        return out

    run_pruning_cycle = prune

    def compact(self, table: str) -> None:
        """Rewrite a table's parts as one."""
        state = self.store.draft()
        self.store.compact(state, table, state["lsn"])
        self.store.publish(state)


def _literal(e) -> str:
    if e[0] == "call":
        return "NOW()"
    if e[0] == "neg":
        return f"-{_literal(e[1])}"
    v = e[1]
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

