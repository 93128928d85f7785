"""The property graph: a typed DataFrame per node label and edge type.

Inside, unknown numbers and texts are null.  Edges have ``edge_id, src, dst``
and the properties of their type.  Node ids are those of insertion, so order
by id is order of insertion.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Labels, properties and edge types of the data model.
NODES = {
    "packages": "id long, key string, ecosystem string, name string, weekly_downloads long",
    "versions": "id long, key string, ecosystem string, name string, version string, published_at_ms long, has_install_script boolean",
    "maintainers": "id long, key string, ecosystem string, username string",
    "services": "id long, key string, name string, source string",
    "advisories": "id long, key string, ghsa_id string, published_at_ms long, modified_at_ms long, summary string",
}
EDGES = {
    "version_of": ("versions", "packages", ""),
    "depends_on": ("versions", "packages", "version_range string"),
    "resolves_to": ("versions", "versions", ""),
    "depended_on_by": ("versions", "versions", ""),
    "maintains": ("maintainers", "packages", ""),
    "resolved": ("services", "versions", "resolved_at_ms long"),
    "affects": ("advisories", "packages", "introduced string, fixed string"),
    "affects_version": ("advisories", "versions", ""),
    "typosquat_of": ("versions", "packages", "edit_distance int"),
}
COVERAGE = "subject_kind string, key string, level int"


def edge_schema(rel: str) -> str:
    return "edge_id long, src long, dst long" + (f", {EDGES[rel][2]}" if EDGES[rel][2] else "")


@dataclass
class Graph:
    """Node tables, edge tables and what is known of their completeness."""

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    coverage: DataFrame | None = None

    def node(self, label: str) -> DataFrame:
        return self.nodes[label] if label in self.nodes else self.spark.createDataFrame([], NODES[label])

    def edge(self, rel: str) -> DataFrame:
        if rel in self.edges:
            return self.edges[rel]
        if rel == "depended_on_by" and "resolves_to" in self.edges:  # the same edges read backwards
            return self.edges["resolves_to"].select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        return self.spark.createDataFrame([], edge_schema(rel))

    def claims(self) -> DataFrame:
        return self.coverage if self.coverage is not None else self.spark.createDataFrame([], COVERAGE)

    def narrow_edges(self, *rels: str) -> DataFrame:
        """``(rel_type, edge_id, src, dst)`` of several types."""
        parts = [self.edge(r).select(F.lit(r).alias("rel_type"), "edge_id", "src", "dst") for r in rels or EDGES]
        return reduce(DataFrame.unionByName, parts)


def resolve_keys(graph: Graph, label: str, keys: DataFrame) -> DataFrame:
    """``(key, id)`` of the keys that exist; others have no row."""
    return keys.select("key").join(graph.node(label).select("key", "id"), "key")


def read_nodes(graph: Graph, label: str, ids: DataFrame) -> DataFrame:
    """The nodes of the ids that exist."""
    return graph.node(label).join(ids.select("id").distinct(), "id", "left_semi")


def list_nodes(graph: Graph, label: str, limit: int) -> DataFrame:
    """The first ``limit`` ids of a label, in order of insertion."""
    _at_least_one(limit=limit)
    return graph.node(label).select("id").orderBy("id").limit(limit)


def neighbours(graph: Graph, rel: str, direction: str, ids: DataFrame, limit: int, window: tuple[str, int, int] | None = None) -> DataFrame:
    """One hop from each of ``ids (id)``: ``(id, rank, neighbour, edge_id, ...)``.

    ``direction`` is ``out``, ``in`` or ``both``, the outgoing ones first.
    ``window`` is a numeric property with bounds, the upper one excluded.  Each
    id keeps its first ``limit`` edges.
    """
    _at_least_one(limit=limit)
    edges = graph.edge(rel)
    if window:
        prop, low, high = window
        edges = edges.where((F.col(prop) >= low) & (F.col(prop) < high))
    rest = [c for c in edges.columns if c not in ("edge_id", "src", "dst")]
    out = edges.select(F.col("src").alias("id"), F.lit(0).alias("side"), F.col("dst").alias("neighbour"), "edge_id", *rest)
    back = edges.select(F.col("dst").alias("id"), F.lit(1).alias("side"), F.col("src").alias("neighbour"), "edge_id", *rest)
    hops = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    rank = F.row_number().over(Window.partitionBy("id").orderBy("side", "edge_id"))
    return hops.join(ids.select("id").distinct(), "id", "left_semi").withColumn("rank", rank).where(F.col("rank") <= limit).drop("side")


def counts(graph: Graph) -> DataFrame:
    """``(kind, name, n)`` of every label and edge type."""
    parts = [graph.node(x).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(x).alias("name"), "n") for x in NODES]
    parts += [graph.edge(x).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit(x).alias("name"), "n") for x in EDGES]
    return reduce(DataFrame.unionByName, parts)


def slice_counts(graph: Graph) -> DataFrame:
    """One row: nodes by label, and edges that resolve a dependency."""
    c = counts(graph)
    of = lambda name: F.sum(F.when(F.col("name") == name, F.col("n")).otherwise(0))
    return c.agg(*[of(x).alias(x) for x in NODES], (of("resolves_to") + of("resolved")).alias("resolution_edges"))


def is_empty(graph: Graph) -> bool:
    """A graph without versions answers nothing."""
    return graph.node("versions").isEmpty()


def claimed_levels(graph: Graph, kind: str) -> DataFrame:
    """``(key, level)`` of the keys that are listed, the weakest claim of each."""
    return graph.claims().where(F.col("subject_kind") == kind).groupBy("key").agg(F.min("level").alias("level"))


def coverage_of(graph: Graph, kind: str, keys: DataFrame) -> DataFrame:
    """``(key, level)``; an unlisted key is absent."""
    claims = claimed_levels(graph, kind)
    return keys.select("key").distinct().join(claims, "key", "left").select("key", F.coalesce("level", F.lit(0)).alias("level"))


def weakest_coverage(graph: Graph, kind: str, keys: DataFrame, *by: str) -> DataFrame:
    """``level``: the least of the keys, for each group of the columns ``by``
    or, without them, of all; closed if there are none.
    """
    rows = keys.select(*by, "key").distinct().join(coverage_of(graph, kind, keys), "key")
    return rows.groupBy(*by).agg(F.coalesce(F.min("level"), F.lit(2)).alias("level"), F.count("*").alias("n"))


def last_write_wins(rows: DataFrame, order: Column) -> DataFrame:
    """Of rows with one id the last by ``order``."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order.desc()))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def assign_ids(known: DataFrame, keys: DataFrame) -> DataFrame:
    """Extend an id map ``(label, key, id)`` by new ``(label, key)`` pairs.

    New ids follow the largest, in key order: ranks within hash-free ranges of
    keys plus the sizes of the ranges before.
    """
    fresh = keys.select("label", "key").distinct().join(known, ["label", "key"], "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranged = fresh.repartitionByRange("label", "key").sortWithinPartitions("label", "key").withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("label", "key"))).persist()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.join(F.broadcast(before.select("_part", "_before")), "_part").select("label", "key", (F.lit(top) + F.col("_before") + F.col("_rank")).alias("id"))
    return known.select("label", "key", "id").unionByName(numbered)


def _at_least_one(**values: int) -> None:
    for name, v in values.items():
        if v < 1:
            raise ValueError(f"{name} must be 1 or more, not {v}")
