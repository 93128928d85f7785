"""Bucketed edge tables: same answers, and no shuffle of the edges."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import graph as g
from trailmark.operators import traverse
from trailmark.sources import edge_tables


@pytest.fixture
def tables(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(60), rng.randrange(60)) for i in range(400)]
    graph = g.Graph(spark, {}, {"resolves_to": spark.createDataFrame(rows, "edge_id long, src long, dst long"), "depended_on_by": spark.createDataFrame([(i, b, a) for i, a, b in rows], "edge_id long, src long, dst long")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = edge_tables.scratch_tables(graph, ("resolves_to",), 4)
    yield graph, found
    found.drop()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def edge_side(df):
    """What stands over the scan of the edges in the physical plan, up to the join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: max(x.find("+-"), x.find(":-"))
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "_by_" in x)
    now, out = depth(lines[at]), []
    for x in reversed(lines[:at]):
        if depth(x) < now:
            now = depth(x)
            if "Join" in x:
                return out
            out.append(x)
    return out


def test_a_hop_shuffles_no_edges(spark, tables):
    _, t = tables
    front = spark.range(50).select(F.lit(1).cast("long").alias("source"), F.col("id").alias("node")).repartition(3)
    for edges in (t.by_src("resolves_to"), t.backwards("resolves_to")):
        step = traverse.steps(edges, True)
        hop = front.join(step, front["node"] == step["_at"])
        side = edge_side(hop)
        assert side is not None and not any("Exchange" in x for x in side), side
        assert hop._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # the front's own, and the repartition above
    ids = spark.range(20)
    near = g.neighbours(t.graph(g.Graph(spark)), "resolves_to", "out", ids, 3)
    assert not any("Exchange" in x for x in edge_side(near))


def test_answers_are_the_same(spark, tables):
    graph, t = tables
    seeds = spark.createDataFrame([(1, 1), (2, 7)], "source long, node long")
    kept = t.graph(graph)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for rel in ("resolves_to", "depended_on_by"):
        assert same(traverse.reach(kept.edge(rel), seeds, 4, in_place=True), traverse.reach(graph.edge(rel), seeds, 4))
    sets = traverse.as_sets(seeds, "source", "node")
    assert same(traverse.reach_sets(kept.edge("resolves_to"), sets, 4, in_place=True), traverse.reach_sets(graph.edge("resolves_to"), sets, 4))
    assert same(g.neighbours(kept, "resolves_to", "both", spark.range(30), 5).select("id", "rank", "neighbour", "edge_id"), g.neighbours(graph, "resolves_to", "both", spark.range(30), 5).select("id", "rank", "neighbour", "edge_id"))
