"""Merging graphs on natural keys, and checking their integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import EDGES, NODES, Graph


def first_known(rows: DataFrame, order: str) -> DataFrame:
    """One row per key: of each column the first value that is known."""
    cols = [c for c in rows.columns if c not in ("key", order)]
    return rows.groupBy("key").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def merge_nodes(first: DataFrame, second: DataFrame, properties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of both by ``key`` and ``(key, property, kept, dropped)`` for each
    true disagreement.  A known value beats an unknown one from either side;
    of two known ones the first is kept.
    """
    a = first.select("key", *[F.col(p).alias(f"a_{p}") for p in properties], F.lit(True).alias("in_first"))
    b = first_known(second.withColumn("_ord", F.monotonically_increasing_id() if "id" not in second.columns else F.col("id")).drop("id"), "_ord").select("key", *[F.col(p).alias(f"b_{p}") for p in properties])
    both = a.join(b, "key", "full_outer")
    merged = both.select("key", *[F.coalesce(f"a_{p}", f"b_{p}").alias(p) for p in properties], F.coalesce("in_first", F.lit(False)).alias("in_first"))
    clashes = F.filter(F.array(*[F.when(F.col(f"a_{p}") != F.col(f"b_{p}"), F.struct(F.lit(p).alias("property"), F.col(f"a_{p}").cast("string").alias("kept"), F.col(f"b_{p}").cast("string").alias("dropped"))) for p in properties]), lambda x: x.isNotNull())
    return merged, both.select("key", F.explode(clashes).alias("c")).select("key", "c.*")


def merge_coverage(*claims: DataFrame) -> DataFrame:
    """The weaker claim wins where several make one; others are kept."""
    return reduce(DataFrame.unionByName, claims).groupBy("subject_kind", "key").agg(F.min("level").alias("level"))


def merge_edges(*edges: DataFrame) -> DataFrame:
    """Edges between keys ``(src_key, dst_key, ...)``; a repeated one with the
    same properties is kept once, parallel ones with others all are.
    """
    return reduce(DataFrame.unionByName, edges).dropDuplicates()


def keyed_edges(graph: Graph, rel: str) -> DataFrame:
    """Edges by the keys of their ends."""
    src, dst, _ = EDGES[rel]
    rest = [c for c in graph.edge(rel).columns if c not in ("edge_id", "src", "dst")]
    e = graph.edge(rel).join(graph.node(src).select(F.col("id").alias("src"), F.col("key").alias("src_key")), "src").join(graph.node(dst).select(F.col("id").alias("dst"), F.col("key").alias("dst_key")), "dst")
    return e.select("src_key", "dst_key", *rest)


def number_rows(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Dense numbers from 1 in order of ``by``: ranks within ranges plus the
    sizes of the ranges before.
    """
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).persist()
    ranged = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*by)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")


def merge_graphs(first: Graph, second: Graph) -> tuple[Graph, DataFrame]:
    """Both graphs as one, with new ids, and all conflicts."""
    spark = first.spark
    nodes: dict[str, DataFrame] = {}
    conflicts: list[DataFrame] = []
    for label, schema in NODES.items():
        props = [f.strip().split(" ")[0] for f in schema.split(",")][2:]
        merged, clash = merge_nodes(first.node(label), second.node(label), props)
        nodes[label] = number_rows(merged.drop("in_first"), ["key"], "id").select("id", "key", *props)
        conflicts.append(clash.select(F.lit(label).alias("label"), "*"))
    edges: dict[str, DataFrame] = {}
    for rel, (src, dst, _) in EDGES.items():
        e = merge_edges(keyed_edges(first, rel), keyed_edges(second, rel))
        e = e.join(nodes[src].select(F.col("id").alias("src"), F.col("key").alias("src_key")), "src_key").join(nodes[dst].select(F.col("id").alias("dst"), F.col("key").alias("dst_key")), "dst_key").drop("src_key", "dst_key")
        rest = [c for c in e.columns if c not in ("src", "dst")]
        edges[rel] = number_rows(e, ["src", "dst", *rest], "edge_id").select("edge_id", "src", "dst", *rest)
    return Graph(spark, nodes, edges, merge_coverage(first.claims(), second.claims())), reduce(DataFrame.unionByName, conflicts)


def merge_all(graphs: list[Graph]) -> tuple[Graph, DataFrame]:
    """Fold several graphs, in order."""
    out, conflicts = graphs[0], []
    for g in graphs[1:]:
        out, clash = merge_graphs(out, g)
        conflicts.append(clash)
    empty = out.spark.createDataFrame([], "label string, key string, property string, kept string, dropped string")
    return out, reduce(DataFrame.unionByName, conflicts, empty)


def duplicate_ids(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate {name} id").alias("issue"), "id")


def dangling(edges: DataFrame, side: str, nodes: DataFrame, name: str) -> DataFrame:
    """Edges whose end isn't a node of the label that its type asks for."""
    return edges.join(nodes.select(F.col("id").alias(side)), side, "left_anti").select(F.lit(f"{name}: no such {side}").alias("issue"), F.col("edge_id").alias("id"))


def unusable_keys(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.coalesce(F.trim("key"), F.lit("")) == "").select(F.lit(f"{name}: unusable key").alias("issue"), "id")


def property_issues(raw: DataFrame, wanted: list[str]) -> DataFrame:
    """Missing and unexpected names in ``raw (id, properties MAP)``."""
    names = F.array(*[F.lit(w) for w in wanted])
    lost, extra = F.array_except(names, F.map_keys("properties")), F.array_except(F.map_keys("properties"), names)
    both = F.concat(F.transform(lost, lambda x: F.concat(F.lit("missing property "), x)), F.transform(extra, lambda x: F.concat(F.lit("unexpected property "), x)))
    return raw.select(F.explode(both).alias("issue"), "id")


def integrity_issues(graph: Graph) -> DataFrame:
    """``(issue, id)``: duplicate ids, dangling ends, unusable keys."""
    parts = []
    for label in NODES:
        parts += [duplicate_ids(graph.node(label), "id", label), unusable_keys(graph.node(label), label)]
    for rel, (src, dst, _) in EDGES.items():
        e = graph.edge(rel)
        parts += [duplicate_ids(e, "edge_id", rel), dangling(e, "src", graph.node(src), rel), dangling(e, "dst", graph.node(dst), rel)]
    return reduce(DataFrame.unionByName, parts)


def upsert_nodes(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes by id; new values replace old ones where both have the id."""
    cols = [c for c in known.columns if c != "id"]
    a, b = known.select("id", *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a")), fresh.select("id", *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b"))
    return a.join(b, "id", "full_outer").select("id", *[F.when(F.col("_b").isNotNull(), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in cols])


def append_edges(known: DataFrame, fresh: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Known edges and those new ones whose ends exist and that add something."""
    good = fresh.join(src.select(F.col("id").alias("src")), "src", "left_semi").join(dst.select(F.col("id").alias("dst")), "dst", "left_semi")
    rest = [c for c in known.columns if c != "edge_id"]
    same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in rest])
    return known.unionByName(good.alias("n").join(known.alias("k"), same, "left_anti").select(*known.columns))
