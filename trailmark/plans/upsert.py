"""Tables by id whose upserts rewrite only the partitions that they touch.

Rows are dealt out by a hash of the id into a fixed number of partitions,
folders of a Parquet table.  An upsert reads the partitions of its own ids
alone, by pruning, and replaces those by Spark's dynamic partition overwrite;
the files of all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .merge import upsert_nodes

PART = "_part"


def dealt(rows: DataFrame, parts: int, id_col: str = "id") -> DataFrame:
    return rows.withColumn(PART, F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(parts)).cast("int"))


def write_by_id(rows: DataFrame, path: str, parts: int = 256) -> None:
    """Write ``rows (id, ...)`` as a table of ``parts`` partitions, a file each."""
    if parts < 1:
        raise ValueError("parts must be 1 or more")
    dealt(rows, parts).repartition(PART).write.partitionBy(PART).mode("errorifexists").parquet(path)


def read_by_id(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table, with the partition of each; ``schema`` is without it."""
    return spark.read.schema(f"{schema}, {PART} int").parquet(path)


def upsert_by_id(spark: SparkSession, path: str, fresh: DataFrame, schema: str, parts: int = 256) -> list[int]:
    """Bring ``fresh`` rows, one an id, into a table that ``write_by_id`` made
    with as many ``parts``; new values replace old ones.  Returns the touched
    partitions.

    What the touched partitions will hold is written aside first, so the table
    is never read while it is replaced, and a job that dies before leaves it
    as it was.  An empty ``fresh`` touches nothing.
    """
    fresh, _ = stored(dealt(fresh, parts), "fresh")
    touched = sorted(r[0] for r in fresh.select(PART).distinct().collect())  # at most ``parts``
    if not touched:
        return []
    old = read_by_id(spark, path, schema).where(F.col(PART).isin(touched)).drop(PART)
    merged, _ = stored(upsert_nodes(old, fresh.drop(PART).select(*old.columns)), "upserted")
    dealt(merged, parts).repartition(PART).write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched


def append_by_src(spark: SparkSession, path: str, fresh: DataFrame, schema: str, parts: int = 256) -> list[int]:
    """The same for edges dealt out by ``src``: those of ``fresh`` that add
    nothing, all properties equal to a known edge of the partition, are left
    out; others are added as files of their own, so nothing is rewritten.
    """
    fresh, _ = stored(dealt(fresh.dropDuplicates([c for c in fresh.columns if c != "edge_id"]), parts, "src"), "fresh")
    touched = sorted(r[0] for r in fresh.select(PART).distinct().collect())  # at most ``parts``
    if not touched:
        return []
    old = read_by_id(spark, path, schema).where(F.col(PART).isin(touched))
    rest = [c for c in old.columns if c not in ("edge_id", PART)]
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in rest]
    new, n = stored(fresh.alias("n").join(old.alias("k"), same, "left_anti").select("edge_id", *rest, PART), "appended")
    if n:
        new.repartition(PART).write.partitionBy(PART).mode("append").parquet(path)
    return sorted(r[0] for r in new.select(PART).distinct().collect())


def write_by_src(edges: DataFrame, path: str, parts: int = 256) -> None:
    """Write edges as a table of ``parts`` partitions by ``src``."""
    dealt(edges, parts, "src").repartition(PART).write.partitionBy(PART).mode("errorifexists").parquet(path)
