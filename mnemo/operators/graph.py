"""Bounded traversal of an edge table (source_id, target_id, edge_type).

A traversal advances all starts together, one join and one anti-join a level.  Each level is written to the shared folder,
so plans stay small, nothing is computed twice and a lost executor costs one level at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.errors import BfsDepthExceeded, BfsVisitedExceeded, ParseError, UnboundedTraversal
from mnemo.sources.shared import cut

MOST_DEPTH = 10
#: Levels between two cuts of lineage, of paths and of cycle checks.
CUT_EVERY = 3


@dataclass(frozen=True)
class Step:
    """One arrow of a pattern: edge type (None: any), direction out, in or both, least and most hops, target's name."""

    edge_type: str | None = None
    direction: str = "out"
    least: int = 1
    most: int | None = 1
    name: str = "b"

    def checked(self) -> Step:
        if self.most is None:
            raise UnboundedTraversal("give the traversal an upper bound")
        if self.most > MOST_DEPTH:
            raise BfsDepthExceeded(f"{self.most} hops; at most {MOST_DEPTH}")
        if self.least < 1 or self.least > self.most:
            raise ParseError("a quantifier {m,n} needs 1 <= m <= n")
        return self


def adjacency(edges: DataFrame, edge_types=None, direction: str = "out") -> DataFrame:
    """(a, b) for every hop that a traversal may take."""
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(list(edge_types)))
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def bfs(edges: DataFrame, starts: DataFrame, edge_types=None, direction: str = "out", least: int = 1, most: int = 1, most_visited: int | None = None) -> DataFrame:
    """(start, node, depth): each node once per start, at its least depth, where that is within least..most.

    The start itself is never returned.  starts has a column start; repeated starts count once, NULL starts reach
    nothing.  most_visited bounds the nodes of one start; they are counted by start once all starts together reach more.
    """
    Step(least=least, most=most).checked()
    hops = adjacency(edges, edge_types, direction)
    first = starts.select("start").where("start is not null").distinct()
    if most == 1:  # single hops need no set of visited nodes
        found = first.join(hops, F.col("start") == F.col("a")).where("b != start").select("start", F.col("b").alias("node"), F.lit(1).alias("depth")).distinct()
        if most_visited is not None and found.groupBy("start").count().where(F.col("count") > most_visited).take(1):
            raise BfsVisitedExceeded(f"more than {most_visited} nodes")
        return found
    # Each level is written, so that it is computed once and the next join knows its size: a small frontier is broadcast
    # to the edges, which then are not shuffled.
    seen = frontier = cut(first.withColumn("node", F.col("start")).withColumn("depth", F.lit(0)), "bfs")
    total = 0
    for depth in range(1, most + 1):
        step = frontier.select("start", "node").join(hops, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        new = frontier.count()
        if not new:
            break
        seen, total = seen.unionByName(frontier), total + new
        if most_visited is not None and total > most_visited and seen.groupBy("start").count().where(F.col("count") > most_visited + 1).take(1):
            raise BfsVisitedExceeded(f"more than {most_visited} nodes")
    return seen.where((F.col("depth") >= least) & (F.col("depth") <= most) & (F.col("depth") > 0))


def bfs_paths(edges: DataFrame, starts: DataFrame, edge_types=None, direction: str = "out", most: int = 1) -> DataFrame:
    """bfs from depth 1 with one shortest path per node, an array of (node, edge_type) after the start."""
    Step(least=1, most=most).checked()
    typed = edges.where(F.col("edge_type").isin(list(edge_types))) if edge_types else edges
    out = typed.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "edge_type")
    back = typed.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "edge_type")
    hops = {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)
    path = F.expr("cast(array() as array<struct<node:string,edge_type:string>>)")
    seen = starts.select("start").where("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), path.alias("path"))
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.join(hops, F.col("node") == F.col("a"))
        step = step.select("start", F.col("b").alias("node"), F.concat("path", F.array(F.struct(F.col("b").cast("string").alias("node"), F.col("edge_type").cast("string").alias("edge_type")))).alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        frontier = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(depth).alias("depth"), "path")
        seen = cut(seen.unionByName(frontier), "paths") if depth % CUT_EVERY == 0 and depth < most else seen.unionByName(frontier)
    return seen.where("depth > 0")


def match(edges: DataFrame, starts: DataFrame, steps: list[Step], start_name: str = "a") -> DataFrame:
    """Bindings of a pattern: <start>, one column per step, id (the last target) and depth (of all steps together).

    Each step traverses on its own from every binding so far, and may return to earlier nodes.  Equal tuples of targets
    are one binding, with its least depth and, among equals, its least start.
    """
    rows = starts.select(F.col("start").alias(start_name)).where(f"`{start_name}` is not null").distinct().withColumn("depth", F.lit(0))
    last, names = start_name, []
    for s in map(Step.checked, steps):
        reach = bfs(edges, rows.select(F.col(last).alias("start")), [s.edge_type] if s.edge_type else None, s.direction, s.least, s.most)
        reach = reach.select(F.col("start").alias("__from"), F.col("node").alias(s.name), F.col("depth").alias("__more"))
        rows = rows.join(reach, F.col(last) == F.col("__from")).withColumn("depth", F.col("depth") + F.col("__more")).drop("__from", "__more")
        names.append(s.name)
        rows = rows.groupBy(*names).agg(F.min(F.struct("depth", start_name)).alias("__best")).select(f"__best.{start_name}", *names, "__best.depth")
        last = s.name
    return rows.select(start_name, *names, F.col(last).alias("id"), "depth")


def reaches(edges: DataFrame, pairs: DataFrame, edge_type: str) -> DataFrame:
    """The (source_id, target_id) rows of pairs whose target already leads to the source: edges that would close a cycle.

    Paths of any length count: the search ends when nothing new is reached.
    """
    hops = adjacency(edges, [edge_type], "out")
    seen = pairs.select(F.col("source_id"), F.col("target_id"), F.col("target_id").alias("node")).distinct()
    frontier = seen
    for depth in count():
        step = frontier.join(hops, F.col("node") == F.col("a")).select("source_id", "target_id", F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen, ["source_id", "target_id", "node"], "left_anti"), "cycle")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
        if depth % CUT_EVERY == 2:
            seen = cut(seen, "cycle-seen")
    return seen.where("node = source_id").select("source_id", "target_id").distinct()


def has_cycle(edges: DataFrame, edge_type: str) -> bool:
    """Whether the edges of one type close a cycle: nodes without incoming edges are peeled off until none is left."""
    left = cut(edges.where(F.col("edge_type") == edge_type).select("source_id", "target_id").distinct(), "peel")
    n = left.count()
    while n:
        inner = left.select(F.col("target_id").alias("t")).distinct()
        left = cut(left.join(inner, F.col("source_id") == F.col("t"), "left_semi"), "peel")
        m = left.count()
        if m == n:
            return True
        n = m
    return False
