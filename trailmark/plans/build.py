"""Building a graph from registry records and service pins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats, keys
from ..operators.graph import Graph
from ..operators.sweep import affects_pairs
from ..operators.traverse import closure
from ..storage import cut, stored
from .merge import number_rows

SUMMARY, RANGE = 480, 200


def plan_versions(fetched: DataFrame, referenced: DataFrame) -> DataFrame:
    """``(key, is_stub)``: fetched versions and, as stubs, those that are only
    referred to.
    """
    stubs = referenced.select("key").distinct().join(fetched.select("key"), "key", "left_anti")
    return fetched.select("key").distinct().withColumn("is_stub", F.lit(False)).unionByName(stubs.withColumn("is_stub", F.lit(True)))


def split_selectable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key can be looked up, and the others."""
    ok = keys.is_selectable(F.col("key"))
    return rows.where(ok), rows.where(~ok)


def partial_closures(resolves_to: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Versions that are incomplete or lead to one that is (``node``)."""
    return closure(resolves_to.select("src", "dst"), incomplete.select("node"))


def package_levels(versions: DataFrame, partial: DataFrame) -> DataFrame:
    """``(subject_kind, key, level)``: a package is closed if none of its
    versions (``node, package_key``) is partial.
    """
    rows = versions.join(partial.select("node").withColumn("p", F.lit(1)), "node", "left")
    return rows.groupBy(F.col("package_key").alias("key")).agg(F.min(F.when(F.col("p").isNull(), 2).otherwise(1)).alias("level")).select(F.lit("package").alias("subject_kind"), "key", "level")


def service_levels(pins: DataFrame, partial: DataFrame) -> DataFrame:
    """A service is closed if all that it pins (``service_key, node``) is;
    others make no claim.
    """
    rows = pins.join(partial.select("node").withColumn("p", F.lit(1)), "node", "left")
    return rows.groupBy(F.col("service_key").alias("key")).agg(F.bool_and(F.col("p").isNull()).alias("ok")).where("ok").select(F.lit("service").alias("subject_kind"), "key", F.lit(2).alias("level"))


def build_graph(slices: dict[str, DataFrame]) -> Graph:
    """A graph of ``slices``:

    ``versions (ecosystem, name, version, published_at_ms, has_install_script,
    is_complete)``, ``packages (ecosystem, name, weekly_downloads)``,
    ``resolutions`` and ``dependencies`` between versions and packages,
    ``maintainers (ecosystem, username, name)``, ``services (key, name,
    source)``, ``pins (service_key, ecosystem, name, version,
    resolved_at_ms)``, ``advisories (ghsa_id, ...)``, ``affects (ghsa_id,
    ecosystem, name, introduced, fixed, listed, intervals)``.  Nodes come
    before edges; what is only referred to becomes a stub without facts.
    """
    vkey = keys.version_key(F.col("ecosystem"), F.col("name"), F.col("version"))
    pkey = keys.package_key(F.col("ecosystem"), F.col("name"))
    fetched = stored(slices["versions"].withColumn("key", vkey).dropDuplicates(["key"]), "nodes")[0]
    spark = fetched.sparkSession
    res, pins = slices["resolutions"], slices["pins"].withColumn("key", vkey)
    to = res.select(F.col("to_ecosystem").alias("ecosystem"), F.col("to_name").alias("name"), F.col("to_version").alias("version"))
    referenced = to.unionByName(pins.select("ecosystem", "name", "version")).withColumn("key", vkey)
    stubs = referenced.dropDuplicates(["key"]).join(fetched.select("key"), "key", "left_anti").select("ecosystem", "name", "version", "key", F.lit(None).cast("long").alias("published_at_ms"), F.lit(False).alias("has_install_script"), F.lit(False).alias("is_complete"))
    usable, _ = split_selectable(fetched.select(*stubs.columns).unionByName(stubs))
    versions = stored(number_rows(usable, ["key"], "id"), "nodes")[0]
    known = slices["packages"].withColumn("key", pkey)
    wanted = reduce(DataFrame.unionByName, [versions.select("ecosystem", "name"), slices["affects"].select("ecosystem", "name"), slices["maintainers"].select("ecosystem", "name"), slices["dependencies"].select(F.col("to_ecosystem").alias("ecosystem"), F.col("to_name").alias("name"))])
    packages = known.select("ecosystem", "name", "key", "weekly_downloads").unionByName(wanted.distinct().withColumn("key", pkey).withColumn("weekly_downloads", F.lit(None).cast("long")))
    packages, _ = split_selectable(packages.groupBy("key", "ecosystem", "name").agg(F.max("weekly_downloads").alias("weekly_downloads")))
    packages = stored(number_rows(packages, ["key"], "id"), "nodes")[0]
    accounts = slices["maintainers"].select("ecosystem", "username").distinct().withColumn("key", keys.maintainer_key(F.col("ecosystem"), F.col("username")))
    accounts = stored(number_rows(accounts, ["key"], "id"), "nodes")[0]
    services = stored(number_rows(slices["services"].dropDuplicates(["key"]), ["key"], "id"), "nodes")[0]
    advisories = slices["advisories"].dropDuplicates(["ghsa_id"]).withColumn("key", F.col("ghsa_id")).withColumn("summary", formats.collapse(F.col("summary"), SUMMARY))
    advisories = stored(number_rows(advisories, ["key"], "id"), "nodes")[0]

    ids = lambda df, key, side: df.select(F.col("key").alias(key), F.col("id").alias(side))
    own = versions.withColumn("pkey", pkey)
    edges = {"version_of": own.join(ids(packages, "pkey", "dst"), "pkey").select(F.col("id").alias("src"), "dst")}
    r = res.select(keys.version_key(F.col("ecosystem"), F.col("name"), F.col("version")).alias("a"), keys.version_key(F.col("to_ecosystem"), F.col("to_name"), F.col("to_version")).alias("b")).distinct()
    edges["resolves_to"], _ = stored(r.join(ids(versions, "a", "src"), "a").join(ids(versions, "b", "dst"), "b").select("src", "dst"), "resolves-to")
    edges["depended_on_by"] = edges["resolves_to"].select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    d = slices["dependencies"].select(keys.version_key(F.col("ecosystem"), F.col("name"), F.col("version")).alias("a"), keys.package_key(F.col("to_ecosystem"), F.col("to_name")).alias("b"), formats.collapse(F.col("version_range"), RANGE).alias("version_range")).distinct()
    edges["depends_on"] = d.join(ids(versions, "a", "src"), "a").join(ids(packages, "b", "dst"), "b").select("src", "dst", "version_range")
    m = slices["maintainers"].select(keys.maintainer_key(F.col("ecosystem"), F.col("username")).alias("a"), pkey.alias("b")).distinct()
    edges["maintains"] = m.join(ids(accounts, "a", "src"), "a").join(ids(packages, "b", "dst"), "b").select("src", "dst")
    p = pins.select(F.col("service_key").alias("a"), F.col("key").alias("b"), "resolved_at_ms").distinct()
    edges["resolved"] = p.join(ids(services, "a", "src"), "a").join(ids(versions, "b", "dst"), "b").select("src", "dst", "resolved_at_ms")
    f = slices["affects"].withColumn("b", pkey).withColumnRenamed("ghsa_id", "a")
    edges["affects"] = f.join(ids(advisories, "a", "src"), "a").join(ids(packages, "b", "dst"), "b").select("src", "dst", "introduced", "fixed").distinct()
    hit = affects_pairs(f.withColumnRenamed("a", "ghsa_id"), versions).withColumnRenamed("ghsa_id", "a")
    hit = hit.join(versions.select("ecosystem", "name", "version", F.col("id").alias("dst")), ["ecosystem", "name", "version"])
    edges["affects_version"] = hit.join(ids(advisories, "a", "src"), "a").select("src", "dst").distinct()
    edges = {k: stored(number_rows(e, ["src", "dst", *[c for c in e.columns if c not in ("src", "dst")]], "edge_id"), k)[0] for k, e in edges.items()}

    partial = partial_closures(edges["resolves_to"], versions.where(~F.coalesce("is_complete", F.lit(False))).select(F.col("id").alias("node")))
    claims = package_levels(own.select(F.col("id").alias("node"), F.col("pkey").alias("package_key")), partial)
    held = edges["resolved"].join(services.select(F.col("id").alias("src"), F.col("key").alias("service_key")), "src").select("service_key", F.col("dst").alias("node"))
    claims = claims.unionByName(service_levels(held, partial))
    nodes = {"packages": packages, "versions": versions.drop("is_complete"), "maintainers": accounts, "services": services, "advisories": advisories}
    return Graph(spark, nodes, edges, claims)


def manifest_counts(graph: Graph) -> DataFrame:
    """One row: what the manifest says of a graph's size and coverage."""
    from ..operators.graph import slice_counts

    c = graph.claims()
    of = lambda kind, level, name: F.count_if((F.col("subject_kind") == kind) & (F.col("level") == level)).alias(name)
    return slice_counts(graph).crossJoin(c.agg(of("package", 2, "closed_packages"), of("package", 1, "partial_packages"), of("service", 2, "closed_services")))  # one row each


def crawl_level(frontier: DataFrame, seen: DataFrame, max_depth: int, max_packages: int) -> DataFrame:
    """The next packages to fetch ``(key, depth)``: unseen ones, nearest first,
    within the depth and package budgets.
    """
    fresh = frontier.where(F.col("depth") <= max_depth).groupBy("key").agg(F.min("depth").alias("depth")).join(seen.select("key"), "key", "left_anti")
    room = max(0, max_packages - seen.count())
    return fresh.orderBy("depth", "key").limit(room)


def crawl(seeds: DataFrame, dependencies: DataFrame, max_depth: int, max_packages: int) -> DataFrame:
    """``(key, depth)`` that a level-by-level crawl of ``dependencies (key,
    dependency)`` reaches within its budgets.
    """
    now = seeds.select("key").distinct().withColumn("depth", F.lit(0))
    seen = now.limit(0)
    for _ in range(max_depth + 1):
        now = cut(crawl_level(now, seen, max_depth, max_packages))
        if now.isEmpty():
            break
        seen = cut(seen.unionByName(now))
        now = now.join(dependencies, "key").select(F.col("dependency").alias("key"), (F.col("depth") + 1).alias("depth")).distinct()
    return seen
