"""The record of what a graph covers that several runs write into.

A run knows its own half only.  So sizes are counted back from the graph, and
claims are merged with those on record: the weaker one wins, and what only one
run claims stays.  A record is a folder of numbered versions.  Its claims are
written first and its one row last, which makes the version valid: a run that
dies in between leaves the version before in force, and the next run takes its
number and overwrites what it left.  Runs take turns; there is no lock.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import COVERAGE, NODES, Graph, slice_counts
from .merge import merge_coverage

SIZES = [*NODES, "resolution_edges"]
RECORD = f"generated_at_ms long, notes array<string>, {', '.join(f'{s} long' for s in SIZES)}"
COUNTED_BACK = "Sizes were counted back from the graph, so they cover every run that wrote into it."


def _version(spark: SparkSession, path: str) -> int:
    """The last valid version, 0 if there is none.  A record that exists but
    can't be read raises: it holds another run's claims.
    """
    try:
        rows = spark.read.schema(f"{RECORD}, version int").parquet(f"{path}/record")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise
    return rows.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """The one row in force ``(version, generated_at_ms, notes, sizes...)``, or none."""
    version = _version(spark, path)
    if not version:
        return spark.createDataFrame([], f"version int, {RECORD}")
    return spark.read.schema(RECORD).parquet(f"{path}/record/version={version}").select(F.lit(version).alias("version"), "*")


def recorded_claims(spark: SparkSession, path: str) -> DataFrame:
    """``(subject_kind, key, level)`` in force; none where nothing is on record."""
    version = _version(spark, path)
    return spark.read.schema(COVERAGE).parquet(f"{path}/claims/version={version}") if version else spark.createDataFrame([], COVERAGE)


def record_coverage(graph: Graph, written: DataFrame, path: str, generated_at_ms: int, notes: list[str] | None = None) -> int:
    """Record what ``graph`` holds after a run that claims ``written``; returns
    the version.  Notes of earlier runs stay before those of this one, each once.
    """
    spark, version = graph.spark, _version(graph.spark, path)
    merge_coverage(recorded_claims(spark, path), written.select("subject_kind", "key", "level")).write.mode("overwrite").parquet(f"{path}/claims/version={version + 1}")
    own = notes or []
    before = [n for r in read_record(spark, path).select("notes").collect() for n in r["notes"]]  # one row
    said = [*(n for n in before if n not in own and n != COUNTED_BACK), *own, COUNTED_BACK]
    sizes = slice_counts(graph).select(*SIZES)
    row = sizes.select(F.lit(generated_at_ms).cast("long").alias("generated_at_ms"), F.array(*[F.lit(n) for n in said]).alias("notes"), *SIZES)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/record/version={version + 1}")
    return version + 1


def covered(graph: Graph, path: str) -> Graph:
    """The graph with the claims on record."""
    return Graph(graph.spark, graph.nodes, graph.edges, recorded_claims(graph.spark, path))
