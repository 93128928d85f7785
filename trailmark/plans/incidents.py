"""Incident packs as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from ..operators.graph import Graph
from ..sources.packs import pack_tables
from .build import build_graph


def packs_graph(packs: DataFrame) -> Graph:
    """All packs in one graph; of a version that several rows name, the first
    stated facts count (compromised before pinned).
    """
    t = pack_tables(packs)
    spark = packs.sparkSession
    ident = ["ecosystem", "name", "version"]
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("load_ord", "slug")))
    versions = t["versions"].groupBy(*ident).agg(known("published_at_ms").alias("published_at_ms"), F.bool_or("has_install_script").alias("has_install_script")).withColumn("is_complete", F.lit(True))
    none = spark.createDataFrame([], "ecosystem string, name string, version string, to_ecosystem string, to_name string, to_version string, version_range string")
    opened = F.array(F.struct(F.lit("introduced").alias("kind"), F.coalesce(F.nullif("introduced", F.lit("")), F.lit("0")).alias("version")))
    ended = F.when(F.coalesce("fixed", F.lit("")) != "", F.array(F.struct(F.lit("fixed").alias("kind"), F.col("fixed").alias("version")))).otherwise(F.array().cast("array<struct<kind:string,version:string>>"))
    affects = t["affects"].select("ghsa_id", "ecosystem", "name", F.nullif("introduced", F.lit("")).alias("introduced"), F.nullif("fixed", F.lit("")).alias("fixed"), F.array().cast("array<string>").alias("listed"), semver.affected_intervals(F.concat(opened, ended)).alias("intervals"))
    return build_graph({
        "versions": versions,
        "packages": versions.select("ecosystem", "name").distinct().withColumn("weekly_downloads", F.lit(None).cast("long")),
        "resolutions": none.drop("version_range"), "dependencies": none.drop("to_version"),
        "maintainers": spark.createDataFrame([], "ecosystem string, username string, name string"),
        "services": t["services"].groupBy("key").agg(F.min_by("name", "slug").alias("name")).withColumn("source", F.lit("seed")),
        "pins": t["resolved"], "advisories": t["advisories"], "affects": affects,
    })
