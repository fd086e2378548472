"""Parsed SELECTs to DataFrames; Catalyst does all optimization.

Where the surface semantics leave a choice, this planner takes the documented one: errors in predicates surface, an outer
WHERE over GRAPH_TABLE applies, predicates on later nodes of a pattern filter after the traversal, ORDER BY also sees
select aliases, and ties are broken by row id.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo import errors as E
from mnemo.functions import predicates as P
from mnemo.operators import graph, vector


def constant(e: tuple, params: dict):
    """The Python value of an expression without columns."""
    kind = e[0]
    if kind == "lit":
        return e[1]
    if kind == "param":
        if e[1] not in params:
            raise E.MissingParameter(e[1])
        return params[e[1]]
    if kind == "vector":
        return [float(constant(x, params)) for x in e[1]]
    if kind == "neg":
        return -constant(e[1], params)
    if kind == "call" and e[1] == "now" and not e[2]:
        return int(time.time() * 1000)
    if kind in ("+", "-", "*", "/"):
        a, b = constant(e[1], params), constant(e[2], params)
        if kind == "/" and isinstance(a, int) and isinstance(b, int):
            return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[kind]()
    raise E.ParseError("expected a constant")


def vector_of(e: tuple, params: dict) -> list[float]:
    v = constant(e, params)
    if isinstance(v, str):
        v = json.loads(v)
    return [float(x) for x in v]


class Scope:
    """Which columns a query sees: (alias, columns) per input, in order."""

    def __init__(self, inputs: list[tuple[str | None, list[str]]], types: dict[str, str] | None = None):
        self.inputs, self.types = inputs, types or {}

    def whole(self, e: tuple, params: dict) -> bool:
        """Whether an expression is an integer."""
        if e[0] in ("lit", "param"):
            v = constant(e, params)
            return isinstance(v, int) and not isinstance(v, bool)
        if e[0] == "col":
            return self.types.get(e[2]) in ("bigint", "int")
        return e[0] in ("neg", "+", "-", "*", "/") and all(self.whole(x, params) for x in e[1:])

    def find(self, qualifier: str | None, name: str) -> Column:
        if qualifier is not None:
            for alias, cols in self.inputs:
                if alias == qualifier and name in cols:
                    return F.col(f"`{alias}`.`{name}`")
            for alias, cols in self.inputs:  # a graph's columns are named node.id
                if f"{qualifier}.{name}" in cols:
                    return F.col(f"`{alias}`.`{qualifier}.{name}`") if alias else F.col(f"`{qualifier}.{name}`")
            raise E.ColumnNotFound(f"{qualifier}.{name}")
        hits = [alias for alias, cols in self.inputs if name in cols]
        if not hits:
            raise E.ColumnNotFound(name)
        if len(hits) > 1:
            raise E.AmbiguousColumn(name)
        return F.col(f"`{hits[0]}`.`{name}`") if hits[0] else F.col(f"`{name}`")


class Planner:
    """tables: name -> DataFrame (with hidden columns); metas: name -> metadata; edges: graph name -> edge DataFrame."""

    def __init__(self, tables, metas: dict, edges, params: dict, spark):
        self.tables, self.metas, self.edges, self.params, self.spark = tables, metas, edges, params, spark
        self.ctes: dict[str, DataFrame] = {}

    def query(self, q: dict) -> DataFrame:
        for name, body in q["ctes"]:
            self.ctes[name] = self.select(body)
        return self.select(q["body"])

    # Sources

    def source(self, s: dict | None) -> tuple[DataFrame, str, str | None]:
        """(rows, alias, table name)"""
        if s is None:
            raise E.ParseError("no FROM")
        if "graph" in s:
            return self._graph(s), s["alias"] or "__graph", None
        if s["table"] in self.ctes:
            return self.ctes[s["table"]], s["alias"] or s["table"], None
        return self.tables(s["table"]), s["alias"] or s["table"], s["table"]

    def _graph(self, g: dict) -> DataFrame:
        edges, first, later = self.edges(g["graph"]), None, []
        for part in _conjuncts(g["where"]):
            names = _qualifiers(part)
            if names <= {g["start"]}:
                own = self._starts(part, g["start"])
                first = own if first is None else first.join(own, "start", "left_semi")
            else:
                later.append(part)
        if first is None:
            first = edges.select(F.col("source_id").alias("start")).unionByName(edges.select(F.col("target_id").alias("start"))).distinct()
        rows = graph.match(edges, first, g["steps"], g["start"])
        nodes = [g["start"], *[s.name for s in g["steps"]]]
        rows = rows.select(*[F.col(f"`{n}`").alias(f"{n}.id") for n in nodes], "id", "depth")
        scope = Scope([(None, rows.columns)])
        for part in later:
            rows = rows.where(self.expr(part, scope))
        if g["columns"] is None:
            return rows
        return rows.select(*[self.expr(e, scope).alias(a or (e[2] if e[0] == "col" else "expr")) for e, a in g["columns"]])

    def _starts(self, part: tuple, start: str) -> DataFrame:
        """Start nodes that a predicate on the start selects."""
        if part[0] == "insub" and not part[3] and part[1][2] == "id":
            sub = self.select(part[2])
            return sub.select(F.col(f"`{sub.columns[0]}`").cast("string").alias("start"))
        if part[0] == "cmp" and part[1] == "=" and part[2][0] == "col" and part[2][2] == "id":
            return self._ids([constant(part[3], self.params)])
        if part[0] == "in" and not part[3] and part[1][0] == "col" and part[1][2] == "id":
            return self._ids([constant(x, self.params) for x in part[2]])
        out = None  # another property: every table that has it, and an id
        needed = {c[2] for c in _columns(part)} | {"id"}
        for name, meta in self.metas.items():
            if needed <= {c["name"] for c in meta["columns"]}:
                rows = self.tables(name)
                own = rows.where(self.expr(part, Scope([(start, rows.columns)]), bare=True)).select(F.col("id").cast("string").alias("start"))
                out = own if out is None else out.unionByName(own)
        if out is None:
            raise E.ColumnNotFound(", ".join(sorted(needed - {"id"})))
        return out.distinct()

    def _ids(self, values: list) -> DataFrame:
        return self.spark.createDataFrame([(None if v is None else str(v),) for v in values], "start string")

    # SELECT

    def select(self, s: dict) -> DataFrame:
        if s["from"] is None:
            rows, scope, base = self.spark.range(1).drop("id"), Scope([]), None
        else:
            df, alias, base = self.source(s["from"])
            inputs, types = [(alias, df.columns)], dict(df.dtypes)
            rows = df.alias(alias)
            for how, right, on in s["joins"]:
                other, name, _ = self.source(right)
                inputs.append((name, other.columns))
                types |= dict(other.dtypes)
                rows = rows.join(other.alias(name), self.expr(on, Scope(inputs)), "left" if how == "left" else "inner")
            scope = Scope(inputs, types)
        rows = self._where(rows, s["where"], scope)
        if s["items"] and any(e[0] == "call" and e[1] == "count" for e, _ in s["items"]):
            return self._counts(rows, s, scope)
        if s["order"] and s["order"][0][0][0] == "cosine":
            return self._vector(rows, s, scope, base)
        return self._project(rows, s, scope)

    def _where(self, rows: DataFrame, where: tuple | None, scope: Scope) -> DataFrame:
        for n, part in enumerate(_conjuncts(where)):
            if part[0] == "insub":
                sub = self._one_column(part[2], f"__s{n}")
                needle = self.expr(part[1], scope)
                if part[3]:
                    rows = rows.where(needle.isNotNull()).join(sub.where(F.col(f"__s{n}").isNotNull()), needle == F.col(f"__s{n}"), "left_anti")
                else:
                    rows = rows.join(sub, needle == F.col(f"__s{n}"), "left_semi")
            else:
                rows, part = self._flag(rows, part, scope, [0])
                rows = rows.where(self.expr(part, scope))
        return rows

    def _one_column(self, select: dict, name: str) -> DataFrame:
        sub = self.select(select)
        if len(sub.columns) != 1:
            raise E.SubqueryNotSupported("IN takes a subquery of one column")
        return sub.toDF(name)

    def _flag(self, rows: DataFrame, part: tuple, scope: Scope, count: list[int]) -> tuple[DataFrame, tuple]:
        """IN (SELECT) under OR or NOT becomes a flag that a left join on distinct values sets."""
        if part[0] == "insub":
            count[0] += 1
            name = f"__f{count[0]}_{id(part) % 100000}"
            sub = self._one_column(part[2], name).where(F.col(name).isNotNull()).distinct()
            rows = rows.join(sub, self.expr(part[1], scope) == F.col(name), "left")
            hit = ("raw", F.when(self.expr(part[1], scope).isNotNull(), F.col(name).isNotNull()))
            return rows, ("not", hit) if part[3] else hit
        if part[0] in ("and", "or", "not"):
            kids = []
            for k in part[1:]:
                rows, k = self._flag(rows, k, scope, count)
                kids.append(k)
            return rows, (part[0], *kids)
        return rows, part

    def _counts(self, rows: DataFrame, s: dict, scope: Scope) -> DataFrame:
        out = []
        for e, alias in s["items"]:
            if e[0] != "call" or e[1] != "count" or len(e[2]) != 1:
                raise E.ParseError("mixed aggregate and non-aggregate columns without GROUP BY")
            arg = F.lit(1) if e[2][0] == ("star",) else self.expr(e[2][0], scope)
            out.append(F.count(arg).alias(alias or "count"))
        got = rows.agg(*out)
        return got.limit(s["limit"]) if s["limit"] is not None else got

    def _named(self, s: dict, scope: Scope) -> list[Column]:
        if s["items"] is None:
            seen: dict[str, int] = {}
            for _, cols in scope.inputs:
                for c in cols:
                    seen[c] = seen.get(c, 0) + 1
            return [scope.find(alias, c).alias(c if seen[c] == 1 else f"{alias}.{c}") if alias else F.col(f"`{c}`") for alias, cols in scope.inputs for c in cols if not c.startswith("__")]
        return [self.expr(e, scope).alias(a or (e[2] if e[0] == "col" else "expr")) for e, a in s["items"]]

    def _project(self, rows: DataFrame, s: dict, scope: Scope) -> DataFrame:
        aliases = {a: e for e, a in s["items"] or [] if a}
        keys = []
        for e, desc in s["order"]:
            if e[0] == "col" and e[1] is None and e[2] in aliases and not any(e[2] in cols for _, cols in scope.inputs):
                e = aliases[e[2]]
            keys.append(P.order(self.expr(e, scope), desc))
        out = self._named(s, scope)
        if s["distinct"]:
            got = rows.select(*out)
            if keys:  # the first of equal rows in the order keeps its place
                at = [f"__o{i}" for i in range(len(keys))]
                plain = [self.expr(aliases.get(e[2], e) if e[0] == "col" and e[1] is None and e[2] in aliases else e, scope) for e, _ in s["order"]]
                with_keys = rows.select(*out, *[k.alias(a) for k, a in zip(plain, at, strict=True)])
                names = [f"`{c}`" for c in got.columns]
                picks = [(F.min if not d else F.max)(a).alias(a) for a, (_, d) in zip(at, s["order"], strict=True)]
                got = with_keys.groupBy(*names).agg(*picks).orderBy(*[P.order(F.col(a), d) for a, (_, d) in zip(at, s["order"], strict=True)]).drop(*at)
            else:
                got = got.distinct()
        else:
            if keys:
                ties = [F.col(f"`{a}`.`__row_id`").asc() for a, cols in scope.inputs if "__row_id" in cols]
                rows = rows.orderBy(*keys, *ties)
            elif s["limit"] is not None and scope.inputs and "__row_id" in scope.inputs[0][1]:
                rows = rows.orderBy(F.col(f"`{scope.inputs[0][0]}`.`__row_id`"))
            got = rows.select(*out)
        return got.limit(s["limit"]) if s["limit"] is not None else got

    def _vector(self, rows: DataFrame, s: dict, scope: Scope, base: str | None) -> DataFrame:
        column, query = s["order"][0][0][1], vector_of(s["order"][0][0][2], self.params)
        owner = None
        for alias, cols in scope.inputs:
            if column[2] in cols and column[1] in (None, alias):
                owner = alias
        if owner is None:
            raise E.UnknownVectorIndex(column[2])
        cols = next(c for a, c in scope.inputs if a == owner)
        meta = self.metas.get(base) if owner == scope.inputs[0][0] else None
        spec = next((c for c in (meta or {}).get("columns", []) if c["name"] == column[2]), None)
        if meta is not None:
            if spec is None or spec["type"] != "VECTOR":
                raise E.UnknownVectorIndex(column[2])
            if spec["dimension"] not in (None, len(query)):
                raise E.VectorDimensionMismatch(f"{column[2]} has {spec['dimension']} values, the query {len(query)}")
        own = rows.select(*[F.col(f"`{owner}`.`{c}`").alias(c) for c in cols])
        if len(scope.inputs) > 1 and "__row_id" in cols:
            own = own.dropDuplicates(["__row_id"])
        own = own.where(F.col(f"`{column[2]}`").isNotNull())
        own = searchable(own, meta or {})
        tie = "__row_id" if "__row_id" in cols else cols[0]
        if s["rank"]:
            got = self.ranked(own, base, column[2], query, s["rank"], s["limit"]).withColumn("score", F.col("rank"))
        else:
            got = vector.top_k(own, column[2], query, s["limit"], tie)
        inner = Scope([(owner, got.columns)])
        got = got.alias(owner)
        if s["items"] is None:
            got = got.select(*[f"`{c}`" for c in got.columns if not c.startswith("__")])
        else:
            got = got.select(*self._named(s, inner))
        return got.distinct() if s["distinct"] else got

    def ranked(self, rows: DataFrame, table: str, column: str, query: list[float], sort_key: str, k: int, min_similarity: float | None = None) -> DataFrame:
        meta = self.metas[table]
        policy = next((c["rank_policy"] for c in meta["columns"] if c["name"] == column and c.get("rank_policy", {}).get("sort_key") == sort_key), None)
        if policy is None:
            raise E.RankPolicyNotFound(sort_key)
        joined = self.tables(policy["join"])
        anchor = anchor_column(meta, table, self.metas[policy["join"]], policy["on"])
        return vector.ranked(rows, column, query, policy["formula"], k, "__row_id", joined, anchor, policy["on"], "__row_id", min_similarity)

    # Expressions

    def expr(self, e: tuple, scope: Scope, bare: bool = False) -> Column:
        kind = e[0]
        sub = lambda x: self.expr(x, scope, bare)
        if kind == "raw":
            return e[1]
        if kind in ("lit", "param", "vector"):
            v = constant(e, self.params)
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        if kind == "col":
            return F.col(f"`{e[2]}`") if bare else scope.find(e[1], e[2])
        if kind == "neg":
            return -sub(e[1])
        if kind in ("+", "-", "*"):
            a, b = sub(e[1]), sub(e[2])
            return a + b if kind == "+" else a - b if kind == "-" else a * b
        if kind == "/":
            return P.divide(sub(e[1]), sub(e[2]), scope.whole(e[1], self.params) and scope.whole(e[2], self.params))
        if kind == "cmp":
            a, b = sub(e[2]), sub(e[3])
            return {"=": a == b, "!=": a != b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]
        if kind == "and":
            return sub(e[1]) & sub(e[2])
        if kind == "or":
            return sub(e[1]) | sub(e[2])
        if kind == "not":
            return ~sub(e[1])
        if kind == "null":
            return sub(e[1]).isNull()
        if kind == "between":
            return P.between(sub(e[1]), sub(e[2]), sub(e[3]))
        if kind == "in":
            return P.in_list(sub(e[1]), [constant(x, self.params) for x in e[2]], e[3])
        if kind == "like":
            return P.like(sub(e[1]), constant(e[2], self.params), e[3])
        if kind == "call":
            if e[1] == "coalesce":
                return F.coalesce(*map(sub, e[2]))
            if e[1] == "now":
                return P.now_millis()
            raise E.ParseError(f"unknown function: {e[1]}")
        raise E.ParseError(f"{kind} cannot stand here")


def searchable(rows: DataFrame, meta: dict) -> DataFrame:
    """rows without those in a state that the table excludes from vector search."""
    options = meta.get("options", {})
    for state in options.get("exclude_vector", []):
        at = (options.get("state_machine") or {"column": "status"})["column"]
        rows = rows.where(~F.coalesce(F.col(at) == state, F.lit(False)))
    return rows


def anchor_column(meta: dict, table: str, other: dict, on: str) -> str:
    """The column of the anchor table that meets the joined table's column."""
    names = [c["name"] for c in meta["columns"]]
    primary = next((c["name"] for c in meta["columns"] if c.get("primary")), None)
    if next((c for c in other["columns"] if c["name"] == on), {}).get("primary"):
        for name in (f"{table.removesuffix('s')}_id", f"{table}_id", on):
            if name in names and name != primary:
                return name
    if on in names and on != "id":
        return on
    if primary:
        return primary
    if "id" in names:
        return "id"
    raise E.RankPolicyInvalid(f"nothing in {table} meets {on}")


def _conjuncts(e: tuple | None) -> list[tuple]:
    if e is None:
        return []
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _columns(e) -> list[tuple]:
    if isinstance(e, tuple):
        if e and e[0] == "col":
            return [e]
        if e and e[0] == "insub":
            return _columns(e[1])
        return [c for x in e[1:] for c in _columns(x)]
    return [c for x in e for c in _columns(x)] if isinstance(e, list) else []


def _qualifiers(e: tuple) -> set:
    return {c[1] for c in _columns(e)}

