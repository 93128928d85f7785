"""Routes counted without being listed, and one shortest route to each node.

Where a graph has no cycle every walk is a simple path, so the numbers of
routes of each length are sums over edges, hop by hop.  Simple paths never
return to a strongly connected component that they left, so in general routes
are listed only within such components and their numbers are summed between
them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .traverse import check_bounds, closure, paths

#: Numbers of routes beyond a long stay at its largest value.
MOST = 2**63 - 1


def total(n: Column) -> Column:
    return F.coalesce(F.try_sum(n), F.lit(MOST))


def times(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.lit(MOST))


def trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges ``(src, dst)`` left once those are gone that start where none
    ends or end where none starts, again and again.
    """
    rest, n = stored(edges, "trimmed")
    while n:
        ends, starts = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
        fewer, left = stored(rest.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"), "trimmed")
        if left == n:
            break
        rest, n = fewer, left
    return rest, n


def coloured(edges: DataFrame) -> DataFrame:
    """``(node, colour)``: the largest node that leads to each, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now, _ = stored(nodes.withColumn("colour", F.col("node")).withColumn("grew", F.lit(True)), "colours")
    while True:
        sent = now.where("grew").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_in"))
        best = F.greatest("colour", F.coalesce("_in", "colour"))
        now, _ = stored(now.join(sent, "node", "left").select("node", best.alias("colour"), (best > F.col("colour")).alias("grew")), "colours")
        if now.where("grew").isEmpty():
            return now.select("node", "colour")


def knots(edges: DataFrame) -> DataFrame | None:
    """``(node, knot)``: the strongly connected components of two nodes or
    more, each named by its largest node; None where there is no cycle.

    Edges that all lead to larger ids, or all to smaller ones, have no cycle.
    Else every cycle holds an edge of the rarer direction, so only nodes that
    lead to such an edge and are led to from one are looked at: the largest
    node that reaches a node is its colour, and what leads back to that node
    within its colour is one component.
    """
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    up, down = edges.agg(F.coalesce(F.count_if(F.col("src") < F.col("dst")), F.lit(0)), F.coalesce(F.count_if(F.col("src") > F.col("dst")), F.lit(0))).first()
    if not up or not down:
        return None
    turns, _ = stored(edges.where("src < dst" if up < down else "src > dst"), "turns")
    behind = closure(edges, turns.select(F.col("src").alias("node")))
    ahead = closure(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")), turns.select(F.col("dst").alias("node")))
    both = behind.join(ahead, "node", "left_semi")
    inside = edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi")
    found: list[DataFrame] = []
    rest, n = trimmed(inside)
    while n:
        colour = coloured(rest)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}"))  # noqa: B023, E731
        same, _ = stored(rest.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst"), "coloured")
        roots = colour.where("node = colour").select("node")
        members, _ = stored(closure(same, roots).join(colour, "node").select("node", F.col("colour").alias("knot")), "members")
        large = members.groupBy("knot").agg(F.count("*").alias("_n")).where("_n > 1").select("knot")
        found.append(stored(members.join(large, "knot", "left_semi"), "knots")[0])
        rest = rest.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        rest, n = trimmed(rest.select("src", "dst"))
    return reduce(DataFrame.unionByName, found).select("node", "knot") if found else None


def route_counts(edges: DataFrame, seeds: DataFrame, max_hops: int, most: int | None = None) -> DataFrame:
    """``(source, node, hop, n)``: the number of simple paths of each length
    from ``seeds (ordinal, node)`` along ``edges (edge_id, src, dst)``.

    Parallel edges make different routes, and a seed given twice gives its
    routes twice.  A hop has at most one row for each source and node.  Only
    within strongly connected components are routes listed; over ``most`` of
    one length there raise BudgetError.
    """
    check_bounds(max_hops)
    edges, _ = stored(edges.where("src <> dst").select("edge_id", "src", "dst"), "edges")
    knot = knots(edges)
    between, within = edges, None
    start = seeds.groupBy(F.col("node").alias("source")).agg(F.count("*").alias("n")).select("source", F.col("source").alias("node"), "n")
    if knot is not None:
        of = lambda end: knot.select(F.col("node").alias(end), F.col("knot").alias(f"_{end}"))
        tagged, _ = stored(edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left").withColumn("_in", F.coalesce(F.col("_src") == F.col("_dst"), F.lit(False))), "tagged")
        between = tagged.where("NOT _in").select("edge_id", "src", "dst")
        doors = between.select(F.col("dst").alias("node")).union(start.select("node")).distinct().join(knot, "node", "left_semi").select("node", F.lit(0).alias("ordinal"))
        listed = paths(tagged.where("_in").select("edge_id", "src", "dst"), doors, max_hops, checkpoint=True, most=most)
        within, _ = stored(listed.groupBy(F.col("source").alias("door"), F.col("hop").alias("steps"), F.col("tail").alias("to")).agg(F.count("*").alias("m")), "within")
    step, _ = stored(between.groupBy(F.col("src").alias("_at"), F.col("dst").alias("to")).agg(F.count("*").alias("m")), "steps")
    entered, levels = [start], []
    for hop in range(max_hops + 1):
        parts = [entered[hop]]
        if within is not None:
            for steps in range(1, hop + 1):
                parts.append(entered[hop - steps].join(within.where(F.col("steps") == steps), F.col("node") == F.col("door")).select("source", F.col("to").alias("node"), times(F.col("n"), F.col("m")).alias("n")))
        level = reduce(DataFrame.unionByName, parts)
        level, rows = stored(level.groupBy("source", "node").agg(total(F.col("n")).alias("n")), "routes")
        if not rows:
            break
        levels.append(level.select("source", "node", F.lit(hop).alias("hop"), "n"))
        grown = level.join(step, F.col("node") == F.col("_at")).groupBy("source", F.col("to").alias("node")).agg(total(times(F.col("n"), F.col("m"))).alias("n"))
        entered.append(grown if within is None else stored(grown, "entered")[0])
    return reduce(DataFrame.unionByName, levels).where("hop > 0") if levels else start.select("source", "node", F.lit(0).alias("hop"), "n")


def shortest_routes(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """``(source, node, hop, nodes, edges)``: the first by its edges of the
    shortest routes from each of ``sources (node)`` to each other node.
    """
    check_bounds(max_hops)
    step, _ = stored(edges.groupBy(F.col("src").alias("_at"), F.col("dst").alias("to")).agg(F.min("edge_id").alias("edge_id")), "steps")
    front = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop"), F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("edges")).distinct()
    seen, n = stored(front, "shortest")
    front = seen
    for hop in range(1, max_hops + 1):
        if not n:
            break
        best = F.min(F.struct(F.concat("edges", F.array("edge_id")).alias("edges"), F.concat("nodes", F.array("to")).alias("nodes")))
        grown = front.join(step, F.col("node") == F.col("_at")).join(seen.select("source", F.col("node").alias("to")), ["source", "to"], "left_anti")
        grown = grown.groupBy("source", F.col("to").alias("node")).agg(best.alias("b"))
        front, n = stored(grown.select("source", "node", F.lit(hop).alias("hop"), "b.nodes", "b.edges"), "shortest")
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def counted(counts: DataFrame, routes: DataFrame) -> DataFrame:
    """``(source, node, hop, path_count, nodes, edges)``: each node's routes of
    all lengths, and the first shortest one.
    """
    n = counts.groupBy("source", "node").agg(total(F.col("n")).alias("path_count"))
    return routes.join(n, ["source", "node"]).select("source", "node", "hop", "path_count", "nodes", "edges")
