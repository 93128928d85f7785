"""Records of public registries, from files: npm, PyPI, deps.dev and OSV.

All are rows ``(json)``; nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, semver

PACKUMENT = "name string, `dist-tags` map<string,string>, time map<string,string>, versions map<string,struct<version:string,scripts:map<string,string>,dependencies:map<string,string>>>, maintainers array<struct<name:string>>"
DOWNLOADS = "downloads long, package string"
PYPI = "info struct<name:string,version:string,author:string,maintainer:string,requires_dist:array<string>>, releases map<string,array<struct<upload_time_iso_8601:string,yanked:boolean>>>, ownership struct<roles:array<struct<user:string>>>"
DEPS = "nodes array<struct<versionKey:struct<system:string,name:string,version:string>,relation:string>>, edges array<struct<fromNode:int,toNode:int,requirement:string>>"
OSV = """id string, aliases array<string>, summary string, published string, modified string, withdrawn string,
affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<type:string,events:array<map<string,string>>>>>>"""
INSTALL_SCRIPTS = ("preinstall", "install", "postinstall")


def npm_versions(packuments: DataFrame) -> DataFrame:
    """``(name, version, published_at_ms, has_install_script, is_latest,
    is_unpublished)``; an unpublished version has a time but no manifest.
    """
    p = packuments.select(F.from_json("json", PACKUMENT).alias("p")).select("p.*")
    script = lambda v: F.exists(F.array(*[F.lit(s) for s in INSTALL_SCRIPTS]), lambda s: F.map_contains_key(F.coalesce(v["scripts"], F.create_map().cast("map<string,string>")), s))
    # times and manifests as rows of their own, folded by version: no row holds another's
    time = F.transform(F.map_entries("time"), lambda e: F.struct(e["key"].alias("version"), e["value"].alias("at"), F.lit(None).cast("boolean").alias("script")))
    live = F.transform(F.map_entries("versions"), lambda e: F.struct(e["key"].alias("version"), F.lit(None).cast("string").alias("at"), script(e["value"]).alias("script")))
    none = F.array().cast("array<struct<version:string,at:string,script:boolean>>")
    rows = p.withColumn("_doc", F.monotonically_increasing_id()).select("_doc", "name", F.col("`dist-tags`")["latest"].alias("latest"), F.explode(F.concat(F.coalesce(time, none), F.coalesce(live, none))).alias("e")).select("_doc", "name", "latest", "e.*")
    per = rows.groupBy("_doc", "name", "latest", "version").agg(F.max("at").alias("at"), F.bool_or("script").alias("script"))
    is_live = F.col("script").isNotNull()
    per = per.where(is_live | ~F.col("version").isin("created", "modified", "unpublished"))
    return per.select("name", "version", keys.instant_ms(F.col("at")).alias("published_at_ms"), F.coalesce("script", F.lit(False)).alias("has_install_script"), F.when(is_live, F.col("version") == F.col("latest")).otherwise(F.lit(False)).alias("is_latest"), (~is_live).alias("is_unpublished"))


def npm_dependencies(packuments: DataFrame) -> DataFrame:
    """``(name, version, dependency, version_range)``."""
    p = packuments.select(F.from_json("json", PACKUMENT).alias("p")).select("p.name", F.explode(F.map_entries("p.versions")).alias("e"))
    return p.select("name", F.col("e.key").alias("version"), F.explode(F.map_entries("e.value.dependencies")).alias("d")).select("name", "version", F.col("d.key").alias("dependency"), F.col("d.value").alias("version_range"))


def npm_maintainers(packuments: DataFrame) -> DataFrame:
    p = packuments.select(F.from_json("json", PACKUMENT).alias("p"))
    return p.select("p.name", F.explode("p.maintainers.name").alias("username")).distinct()


def npm_downloads(records: DataFrame) -> DataFrame:
    """``(name, weekly_downloads)`` of single and of bulk answers."""
    one = F.from_json("json", DOWNLOADS)
    bulk = F.filter(F.map_entries(F.from_json("json", f"map<string,struct<{DOWNLOADS.replace(' ', ':').replace(',:', ',')}>>")), lambda e: e["value"]["downloads"].isNotNull())
    alone = records.select(one.alias("d")).where("d.package IS NOT NULL").select(F.col("d.package").alias("name"), F.col("d.downloads").alias("weekly_downloads"))
    many = records.where(one["package"].isNull()).select(F.explode(bulk).alias("e")).select(F.col("e.key").alias("name"), F.col("e.value.downloads").alias("weekly_downloads"))
    return alone.unionByName(many)


def with_downloads(packages: DataFrame, downloads: DataFrame) -> DataFrame:
    """``packages`` with ``weekly_downloads``, null where no answer has it."""
    return packages.drop("weekly_downloads").join(downloads.groupBy("name").agg(F.max("weekly_downloads").alias("weekly_downloads")), "name", "left")


def pypi_versions(projects: DataFrame) -> DataFrame:
    """``(name, version, published_at_ms, is_yanked)``: the first upload of a
    release; yanked if all of its files are.
    """
    p = projects.select(F.from_json("json", PYPI).alias("p")).select("p.info.name", F.explode(F.map_entries("p.releases")).alias("e"))
    times = F.filter(F.transform("e.value", lambda f: keys.instant_ms(f["upload_time_iso_8601"])), lambda t: t.isNotNull())
    yanked = (F.size("e.value") > 0) & F.forall("e.value", lambda f: F.coalesce(f["yanked"], F.lit(False)))
    name = F.lower(F.regexp_replace("name", r"[-_.]+", "-"))
    return p.select(name.alias("name"), F.col("e.key").alias("version"), F.array_min(times).alias("published_at_ms"), yanked.alias("is_yanked"))


def pypi_owners(projects: DataFrame) -> DataFrame:
    """``(name, username)``: stated roles, else the author or maintainer."""
    p = projects.select(F.from_json("json", PYPI).alias("p"))
    roles = F.coalesce(F.transform("p.ownership.roles", lambda r: r["user"]), F.array().cast("array<string>"))
    named = F.filter(F.array("p.info.maintainer", "p.info.author"), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return p.select(F.lower(F.regexp_replace("p.info.name", r"[-_.]+", "-")).alias("name"), F.explode(F.when(F.size(roles) > 0, roles).otherwise(F.slice(named, 1, 1))).alias("username"))


def dependency_nodes(graphs: DataFrame) -> DataFrame:
    """``(graph, node, ecosystem, name, version, relation)`` of rows ``(graph, json)``."""
    g = graphs.select("graph", F.from_json("json", DEPS).alias("g")).select("graph", F.posexplode("g.nodes").alias("node", "n"))
    return g.select("graph", "node", keys.ecosystem_of(F.col("n.versionKey.system")).alias("ecosystem"), "n.versionKey.name", "n.versionKey.version", "n.relation")


def dependency_edges(graphs: DataFrame) -> DataFrame:
    g = graphs.select("graph", F.from_json("json", DEPS).alias("g")).select("graph", F.explode("g.edges").alias("e"))
    return g.select("graph", F.col("e.fromNode").alias("from_node"), F.col("e.toNode").alias("to_node"), "e.requirement")


def direct_resolutions(graphs: DataFrame) -> DataFrame:
    """Versions that the root of each dependency graph resolves to."""
    nodes = dependency_nodes(graphs)
    roots = nodes.where("relation = 'SELF'").select("graph", F.col("node").alias("from_node"))
    to = nodes.select("graph", F.col("node").alias("to_node"), "ecosystem", "name", "version")
    return dependency_edges(graphs).join(roots, ["graph", "from_node"]).join(to, ["graph", "to_node"]).select("graph", "ecosystem", "name", "version", "requirement")


def osv_advisories(records: DataFrame) -> DataFrame:
    """``(ghsa_id, published_at_ms, modified_at_ms, summary)``; withdrawn ones
    are left out.
    """
    o = records.select(F.from_json("json", OSV).alias("o")).select("o.*").where("id IS NOT NULL AND withdrawn IS NULL")
    return o.select(keys.ghsa_id(F.col("id"), F.col("aliases")).alias("ghsa_id"), keys.instant_ms(F.col("published")).alias("published_at_ms"), keys.instant_ms(F.col("modified")).alias("modified_at_ms"), "summary")


def osv_affected(records: DataFrame) -> DataFrame:
    """``(ghsa_id, ecosystem, name, listed, intervals, introduced, fixed)``: a
    row per affected package; ranges of git commits are left out.
    """
    o = records.select(F.from_json("json", OSV).alias("o")).select("o.*").where("id IS NOT NULL AND withdrawn IS NULL")
    rows = o.select(keys.ghsa_id(F.col("id"), F.col("aliases")).alias("ghsa_id"), F.explode("affected").alias("a"))
    event = lambda e: F.struct(F.map_keys(e)[0].alias("kind"), F.map_values(e)[0].alias("version"))
    ranges = F.filter(F.coalesce("a.ranges", F.array().cast("array<struct<type:string,events:array<map<string,string>>>>")), lambda r: r["type"] != "GIT")
    intervals = F.flatten(F.transform(ranges, lambda r: semver.affected_intervals(F.transform(r["events"], event))))
    rows = rows.select("ghsa_id", keys.ecosystem_of(F.col("a.package.ecosystem")).alias("ecosystem"), "a.package.name", F.coalesce("a.versions", F.array().cast("array<string>")).alias("listed"), intervals.alias("intervals"))
    return rows.where("ecosystem IS NOT NULL").select("*", F.try_element_at("intervals", F.lit(1))["introduced"].alias("introduced"), F.try_element_at("intervals", F.lit(-1))["fixed"].alias("fixed"))


def affected_pairs(affected: DataFrame, versions: DataFrame) -> DataFrame:
    """``(ghsa_id, ecosystem, name, version, bucket)`` for every version of an
    affected package: affected, unaffected or undecided.
    """
    rows = affected.join(versions.select("ecosystem", "name", "version"), ["ecosystem", "name"])
    bucket = semver.affected_bucket(semver.is_affected(F.col("version"), F.col("listed"), F.col("intervals")))
    return rows.select("ghsa_id", "ecosystem", "name", "version", bucket.alias("bucket"))


def select_versions(versions: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` versions of each package: the latest, then unpublished
    ones, then others, newest first.
    """
    tier = F.when(F.col("is_latest"), 0).when(F.col("is_unpublished"), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("name").orderBy(tier, F.col("published_at_ms").desc_nulls_last(), "version"))
    return versions.withColumn("rank", rank).where(F.col("rank") <= most)
