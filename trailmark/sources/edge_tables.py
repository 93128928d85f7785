"""Edges in tables bucketed and sorted by their ends.

Each edge type is kept twice, by ``src`` and by ``dst``: a hop in either
direction joins a table that is already dealt out by the key of the join, so
the edges stay where they are and only the walk's own rows are shuffled.  Spark
plans that by itself; there is nothing to look up at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import EDGES, Graph
from ..storage import scratch


@dataclass
class EdgeTables:
    """Names of tables that ``save_edges`` made begin with ``prefix``."""

    spark: SparkSession
    prefix: str

    def by_src(self, rel: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{rel}_by_src")

    def by_dst(self, rel: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{rel}_by_dst")

    def backwards(self, rel: str) -> DataFrame:
        """``(edge_id, src, dst)`` read from dst to src, dealt by the new ``src``."""
        return self.by_dst(rel).select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))

    def graph(self, graph: Graph) -> Graph:
        """``graph`` with its edges read from the tables."""
        edges = {rel: self.by_src(rel) for rel in EDGES if self.spark.catalog.tableExists(f"{self.prefix}_{rel}_by_src")}
        if "resolves_to" in edges and "depended_on_by" not in edges:
            edges["depended_on_by"] = self.backwards("resolves_to")
        return Graph(graph.spark, graph.nodes, edges, graph.coverage)

    def drop(self) -> None:
        """Forget the tables and delete their files."""
        for rel in EDGES:
            for end in ("src", "dst"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{rel}_by_{end}")


def save_edges(graph: Graph, prefix: str, rels: tuple[str, ...], buckets: int = 64, path: str | None = None) -> EdgeTables:
    """Write the edges of some types as tables in the warehouse, or below
    ``path`` in the shared folder, in ``buckets`` buckets.

    A bucket is one task of a hop, so take as many as the edges fill well; all
    edges of one node are in one bucket.  A bucket is written as one file for
    each end, sorted by it.
    """
    tables = EdgeTables(graph.spark, prefix)
    for rel in rels:
        for end in ("src", "dst"):
            writer = graph.edge(rel).repartition(buckets, end).write.mode("overwrite").bucketBy(buckets, end).sortBy(end, "edge_id")
            writer = writer.option("path", f"{path}/{rel}_by_{end}") if path else writer
            writer.saveAsTable(f"{prefix}_{rel}_by_{end}")
    return tables


def scratch_tables(graph: Graph, rels: tuple[str, ...], buckets: int = 64) -> EdgeTables:
    """The same under a new name in the shared folder."""
    at = scratch(graph.spark, "edges")
    return save_edges(graph, at.rsplit("/", 1)[1].replace("-", "_"), rels, buckets, at)
