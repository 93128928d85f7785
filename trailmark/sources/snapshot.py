"""Snapshots: a graph as a JSON document, or as a folder of Parquet tables.

A document of any size is written as pieces, files of whole lines that make up
the document when they are put together in the order of their names; each line
holds one node or edge, so pieces are written and read by many tasks.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.graph import COVERAGE, EDGES, NODES, Graph, edge_schema

MANIFEST = "version int, generatedAtMs long, ecosystems array<string>, closedPackageKeys array<string>, partialPackageKeys array<string>, closedServiceKeys array<string>, notes array<string>, counts map<string,bigint>"
SNAPSHOT = f"""formatVersion int, generatedAtMs long, source string, manifest struct<{MANIFEST.replace(" ", ":").replace(",:", ",")}>,
nodes array<struct<id:bigint,label:string,properties:map<string,string>>>,
edges array<struct<id:bigint,relType:string,fromNodeId:bigint,toNodeId:bigint,properties:map<string,string>>>"""
ITEM = "id long, label string, relType string, fromNodeId long, toNodeId long, properties map<string,string>"
#: Names of labels, edge types and properties in the JSON document.
LABELS = {"packages": "Package", "versions": "Version", "maintainers": "Maintainer", "services": "Service", "advisories": "Advisory"}
FORMAT_VERSION = 1


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.strip().split(" ")) for f in schema.split(",")]


def _typed(raw: Column, kind: str) -> Column:
    value = raw.try_cast(kind)
    return keys.known_text(value) if kind == "string" else keys.known_number(value) if kind in ("long", "int") else value


def _graph_of(nodes_: DataFrame, edges_: DataFrame, claims: DataFrame | None) -> Graph:
    prop = lambda name, kind: _typed(F.col("properties")[_camel(name)], kind).alias(name)
    nodes = {t: nodes_.where(F.col("label") == LABELS[t]).select("id", *[prop(f, k) for f, k in _fields(schema) if f != "id"]) for t, schema in NODES.items()}
    edges = {}
    for rel, (_, _, extra) in EDGES.items():
        own = edges_.where(F.col("relType") == rel.upper())
        edges[rel] = own.select(F.col("id").alias("edge_id"), F.col("fromNodeId").alias("src"), F.col("toNodeId").alias("dst"), *[prop(f, k) for f, k in (_fields(extra) if extra else [])])
    return Graph(nodes_.sparkSession, nodes, edges, claims)


def read_snapshot(spark: SparkSession, path: str) -> Graph:
    """A graph from a JSON document in one file; unknown values become null."""
    doc = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    n = doc.select(F.explode("nodes").alias("n")).select("n.*")
    e = doc.select(F.explode("edges").alias("e")).select("e.*")
    return _graph_of(n, e, coverage_claims(doc.select("manifest.*")))


def read_pieces(spark: SparkSession, path: str) -> Graph:
    """The same from the pieces that ``write_pieces`` made, line by line; they
    hold no manifest.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("line")).where("line LIKE '{\"id\":%'")
    items = lines.select(F.from_json("line", ITEM).alias("i")).select("i.*")
    return _graph_of(items.where("label IS NOT NULL"), items.where("relType IS NOT NULL"), None)


def coverage_claims(manifests: DataFrame) -> DataFrame:
    """``(subject_kind, key, level)`` of manifest rows."""
    one = lambda col, kind, level: manifests.select(F.lit(kind).alias("subject_kind"), F.explode(col).alias("key"), F.lit(level).alias("level"))
    return one("closedPackageKeys", "package", 2).unionByName(one("partialPackageKeys", "package", 1)).unionByName(one("closedServiceKeys", "service", 2))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def snapshot_lines(graph: Graph, source: str, generated_at_ms: int) -> DataFrame:
    """``(section, id, kind, line)``: the lines of the document; sorted by the
    first three, and put together, they are it.  Nodes and edges go by id,
    which must be unique within a label or edge type.
    """

    def raw(name: str, kind: str) -> Column:
        c = F.col(name)
        return (keys.raw_text(c) if kind == "string" else keys.raw_number(c) if kind in ("long", "int") else c).cast("string")

    def props(fields: list[tuple[str, str]]) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(_camel(f)) for f, _ in fields]), F.array(*[raw(f, k) for f, k in fields])) if fields else F.create_map().cast("map<string,string>")

    def lines(section: int, parts: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, parts)
        first = rows.agg(F.min(F.struct("id", "kind")).alias("f")).first()["f"]  # one row
        comma = F.lit("") if first is None else F.when((F.col("id") == first["id"]) & (F.col("kind") == first["kind"]), "").otherwise(",")
        return rows.select(F.lit(section).alias("section"), "id", "kind", F.concat(comma, "line").alias("line"))

    item = lambda *c: F.to_json(F.struct(*c)).alias("line")
    nodes = [graph.node(t).select("id", F.lit(LABELS[t]).alias("kind"), item("id", F.lit(LABELS[t]).alias("label"), props([f for f in _fields(s) if f[0] != "id"]).alias("properties"))) for t, s in NODES.items()]
    edges = [graph.edge(r).select(F.col("edge_id").alias("id"), F.lit(r.upper()).alias("kind"), item(F.col("edge_id").alias("id"), F.lit(r.upper()).alias("relType"), F.col("src").alias("fromNodeId"), F.col("dst").alias("toNodeId"), props(_fields(x) if x else []).alias("properties"))) for r, (_, _, x) in EDGES.items()]
    head = json.dumps({"formatVersion": FORMAT_VERSION, "generatedAtMs": generated_at_ms, "source": source})[:-1] + ', "nodes": ['
    frame = graph.spark.createDataFrame([(0, 0, "", head), (2, 0, "", '], "edges": ['), (4, 0, "", "]}")], "section int, id long, kind string, line string")
    return frame.unionByName(lines(1, nodes)).unionByName(lines(3, edges))


def write_pieces(graph: Graph, path: str, source: str, generated_at_ms: int) -> None:
    """Write the document as pieces, range by range of its lines."""
    snapshot_lines(graph, source, generated_at_ms).orderBy("section", "id", "kind").select("line").write.text(path)


def write_tables(graph: Graph, path: str) -> None:
    """One Parquet table per label and edge type, and the coverage."""
    for t in NODES:
        graph.node(t).write.mode("overwrite").parquet(f"{path}/nodes/{t}")
    for r in EDGES:
        edge = graph.edge(r)
        if r == "depended_on_by" and r not in graph.edges and "resolves_to" in graph.edges:  # written just before
            back = graph.spark.read.schema(edge_schema("resolves_to")).parquet(f"{path}/edges/resolves_to")
            edge = back.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        edge.write.mode("overwrite").parquet(f"{path}/edges/{r}")
    graph.claims().write.mode("overwrite").parquet(f"{path}/coverage")


def read_tables(spark: SparkSession, path: str) -> Graph:
    nodes = {t: spark.read.schema(s).parquet(f"{path}/nodes/{t}") for t, s in NODES.items()}
    edges = {r: spark.read.schema(edge_schema(r)).parquet(f"{path}/edges/{r}") for r in EDGES}
    return Graph(spark, nodes, edges, spark.read.schema(COVERAGE).parquet(f"{path}/coverage"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``(label, key, id)`` of a tab-separated file."""
    return spark.read.schema("label string, key string, id long").csv(path, sep="\t")


def write_id_map(ids: DataFrame, path: str) -> None:
    ids.orderBy("id").select("label", "key", "id").write.mode("overwrite").csv(path, sep="\t")
