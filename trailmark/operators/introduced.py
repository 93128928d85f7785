"""Introduced version: the first affected version of a package per advisory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, semver, verdict
from .graph import Graph, coverage_of, is_empty


def affected_versions(graph: Graph) -> DataFrame:
    """``(advisory, package_key, version_key, version, published_ms, sort_key)``."""
    v = graph.node("versions").select(F.col("id").alias("dst"), F.col("key").alias("version_key"), "ecosystem", "name", "version", keys.readable_instant(F.col("published_at_ms")).alias("published_ms"))
    rows = graph.edge("affects_version").select(F.col("src").alias("advisory"), "dst").distinct().join(v, "dst")
    return rows.select("advisory", keys.package_key(F.col("ecosystem"), F.col("name")).alias("package_key"), "version_key", "version", "published_ms", semver.semver_key(F.col("version")).alias("sort_key"))


def order() -> list[Column]:
    """Published first; unknown times after known ones, then by precedence,
    what can't be placed last, then by key: a total order.
    """
    return [F.col("published_ms").isNull(), F.col("published_ms"), F.col("sort_key").isNull(), F.col("sort_key"), F.col("version_key")]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("advisory", "package_key").orderBy(*order())))


def earliest_affected(rows: DataFrame) -> DataFrame:
    """By precedence alone: the least readable version per package."""
    return rows.where("sort_key IS NOT NULL").groupBy("advisory", "package_key").agg(F.min_by("version", F.struct("sort_key", "version_key")).alias("earliest"))


def stated_range(graph: Graph) -> DataFrame:
    """The first stated range per (advisory, package); open ends are null."""
    p = graph.node("packages").select(F.col("id").alias("dst"), F.col("key").alias("package_key"))
    rows = graph.edge("affects").join(p, "dst")
    per = rows.groupBy(F.col("src").alias("advisory"), "package_key").agg(F.min_by(F.struct("introduced", "fixed"), "edge_id").alias("r"))
    return per.select("advisory", "package_key", keys.known_text(F.col("r.introduced")).alias("stated_introduced"), keys.known_text(F.col("r.fixed")).alias("stated_fixed"))


def introduced_versions(graph: Graph, max_versions: int = 10_000) -> DataFrame:
    """The introducing version, the stated range and a verdict, for every
    (advisory, package) that has either.

    Of more than ``max_versions`` affected versions the first by key are looked
    at and the cap is a limit; versions without time and precedence are another.
    """
    if max_versions < 1:
        raise ValueError("max_versions must be 1 or more")
    rows = affected_versions(graph)
    by = Window.partitionBy("advisory", "package_key")
    rows = rows.withColumn("total", F.count("*").over(by)).withColumn("_n", F.row_number().over(by.orderBy("version_key"))).where(F.col("_n") <= max_versions)
    undecidable = F.col("published_ms").isNull() & F.col("sort_key").isNull()
    first = ordered(rows).groupBy("advisory", "package_key").agg(
        F.min_by("version_key", "rank").alias("introduced_key"), F.min_by("version", "rank").alias("introduced_version"), F.count("*").alias("n_versions"), F.max("total").alias("total"), F.count_if(undecidable).alias("n_undecidable")
    )
    out = first.join(stated_range(graph), ["advisory", "package_key"], "full_outer").na.fill(0, ["n_versions", "total", "n_undecidable"])
    level = coverage_of(graph, "package", out.select(F.col("package_key").alias("key"))).withColumnRenamed("key", "package_key")
    out = out.join(level, "package_key").join(graph.node("advisories").select(F.col("id").alias("advisory"), F.col("key").alias("advisory_key")), "advisory")
    own = verdict.limits(
        (F.col("total") > F.col("n_versions"), verdict.limit("scan_capped", examined=F.col("n_versions"), total=F.col("total"))),
        (F.col("n_undecidable") > 0, verdict.limit("undecidable_versions", n=F.col("n_undecidable"))),
    )
    out = out.withColumn("a", verdict.decide(F.col("n_versions") > 0, F.col("level"), F.lit(is_empty(graph)), own, F.col("package_key")))
    told = F.when(F.col("introduced_version").isNull(), F.col("a.rationale")).otherwise(F.concat(F.lit("First affected is "), F.col("introduced_version"), F.coalesce(F.concat(F.lit(", fixed in "), F.col("stated_fixed")), F.lit(", no fix stated")), F.lit(". "), F.col("a.rationale")))
    return out.select("advisory_key", "package_key", "introduced_key", "introduced_version", "stated_introduced", "stated_fixed", "n_versions", "n_undecidable", "a.verdict", told.alias("rationale"), "a.limits")
