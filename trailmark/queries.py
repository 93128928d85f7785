"""The operators bound to the relational tables.

Each query takes (spark, sf_dir) and returns whole results; ``oracles`` has
the same in DuckDB SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import file_queries
from .functions import formats, keys, semver, verdict
from .operators import bitemporal, blast_radius, history, introduced, lockfile, maintainers, persistence, replay, routes, scan, traverse, typosquat
from .operators import graph as g
from .oracles import ORACLES
from .plans import build, merge, upsert
from .plans.projection import epoch_ms, maintains, most_depended_on, named_packages, part_facts, pins, plain_packages, project, resolved, resolves_to, table
from .sources import edge_tables
from .sources.registries import select_versions
from .storage import checkpoint_dir, scratch
from .streaming import first_pin

HOPS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def dependents(spark: SparkSession, d: str) -> DataFrame:
    return resolves_to(spark, d).select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


@query
def q01_counts(spark, d):
    """Nodes and edges by label and type."""
    return g.counts(project(spark, d))


@query
def q01_slice_counts(spark, d):
    return g.slice_counts(project(spark, d))


@query
def q02_read_nodes(spark, d):
    """Keys of every ordered part and one that doesn't exist, resolved and read."""
    graph = project(spark, d)
    wanted = part_facts(spark, d).select(F.concat(F.lit("npm:part-"), F.col("id").cast("string")).alias("key"))
    wanted = wanted.union(spark.createDataFrame([("npm:none",)], "key string"))
    ids = g.resolve_keys(graph, "packages", wanted)
    return g.read_nodes(graph, "packages", ids).select("id", "key", "weekly_downloads")


@query
def q02_list_nodes(spark, d):
    """The first hundred services."""
    return g.list_nodes(project(spark, d), "services", 100)


@query
def q03_neighbours(spark, d):
    """Both sides of each part's dependencies, the first eight edges."""
    graph = project(spark, d)
    ids = graph.node("versions").select("id")
    return g.neighbours(graph, "resolves_to", "both", ids, 8).select("id", "rank", "neighbour", "edge_id")


@query
def q03_pins_in_window(spark, d):
    """Pins of 1997 of each part, the first twenty."""
    graph = project(spark, d)
    ids = graph.node("versions").select("id")
    return g.neighbours(graph, "resolved", "in", ids, 20, ("resolved_at_ms", 852076800000, 883612800000)).select("id", "rank", "neighbour", "resolved_at_ms")


@query
def q04_paths(spark, d):
    """Simple paths of up to eight hops from the parts most depended on."""
    found = traverse.paths(dependents(spark, d), most_depended_on(spark, d), HOPS, checkpoint=True)
    return found.groupBy("source", "tail", "hop").agg(F.count("*").alias("n_paths"), F.min(F.array_join("nodes", ">")).alias("least_path"))


@query
def q04_first_paths(spark, d):
    """The first two hundred in breadth-first order."""
    found = traverse.paths(dependents(spark, d), most_depended_on(spark, d), HOPS, path_count=200, checkpoint=True)
    return found.select("ordinal", "hop", "tail", F.array_join("nodes", ">").alias("path"))


@query
def q05_reach(spark, d):
    """Least distances, linear in the edges."""
    seeds = most_depended_on(spark, d).select(F.col("node").alias("source"), "node")
    return traverse.reach(dependents(spark, d), seeds, HOPS)


@query
def q05_bucketed_reach(spark, d):
    """The same from tables bucketed by the ends of their edges."""
    seeds = most_depended_on(spark, d).select(F.col("node").alias("source"), "node")
    tables = edge_tables.scratch_tables(g.Graph(spark, {}, {"resolves_to": resolves_to(spark, d)}), ("resolves_to",), 16)
    return traverse.reach(tables.backwards("resolves_to"), seeds, HOPS, in_place=True)


@query
def q05_version_exposures(spark, d):
    found = blast_radius.reachable_by_counts(dependents(spark, d), most_depended_on(spark, d), HOPS)
    return found.select("source", "node", "hop", "path_count", F.array_join("nodes", ">").alias("route"))


@query
def q05_service_exposures(spark, d):
    seeds = most_depended_on(spark, d)
    reached = blast_radius.with_source(blast_radius.reachable_by_counts(dependents(spark, d), seeds, HOPS), seeds)
    return blast_radius.service_exposures(reached, resolved(spark, d)).select("source", "service", "hop", "is_direct", "path_count", "resolved_at_ms")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    f = part_facts(spark, d)
    return f.select(F.col("id").alias("advisory"), F.col("id").alias("version"), F.col("published_at_ms").alias("published_ms"), F.col("disclosed_at_ms").alias("disclosed_ms")).where("disclosed_ms IS NOT NULL")


@query
def q06_resolved_while_live(spark, d):
    """Who pinned a part between its first order and its first return."""
    return bitemporal.victims(resolved(spark, d), _windows(spark, d)).select("version", "service", "resolved_at_ms", "ms_before_disclosure")


@query
def q06_answers(spark, d):
    """A verdict per advisory."""
    return bitemporal.answers(project(spark, d)).select("advisory_key", "window_ms", "n_victims", "first_pin_ms", "verdict")


@query
def q07_timeline(spark, d):
    w = _windows(spark, d)
    return bitemporal.timeline(w, bitemporal.victims(resolved(spark, d), w)).select("version", "at_ms", "kind", "service", "kind_rank")


@query
def q08_as_of(spark, d):
    """Exposures of the parts most depended on, as known at the start of 1998."""
    seeds = most_depended_on(spark, d).select(F.col("node").alias("source"), "node")
    reached = traverse.reach(dependents(spark, d), seeds, HOPS, include_seeds=True)  # no routes are asked for
    rows = blast_radius.restrict_to_instant(blast_radius.service_exposures(reached, resolved(spark, d)), 883612800000)
    return rows.groupBy("source", "bucket").agg(F.count("*").alias("services"), F.min("hop").alias("nearest"))


@query
def q09_introduced(spark, d):
    graph = project(spark, d)
    return introduced.introduced_versions(graph).select("advisory_key", "package_key", "introduced_key", "stated_introduced", "n_versions", "n_undecidable", "verdict")


@query
def q09_rationales(spark, d):
    """What is said of the introducing version of every advisory."""
    return introduced.introduced_versions(project(spark, d)).select("advisory_key", "introduced_version", "stated_fixed", "rationale")


@query
def q09_affected_order(spark, d):
    """Versions by name, ordered by publication, precedence and key."""
    f = part_facts(spark, d).select("id", "published_at_ms")
    rows = table(spark, d, "part").join(f, F.col("p_partkey") == F.col("id"), "left")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), F.lit("0"))
    rows = rows.select(F.lit(1).alias("advisory"), F.col("p_name").alias("package_key"), F.concat_ws(":", F.lit("npm"), F.col("p_name"), version, F.col("p_partkey").cast("string")).alias("version_key"), F.when(F.col("p_size") > 25, F.col("published_at_ms")).alias("published_ms"), semver.semver_key(version).alias("sort_key"))
    return introduced.ordered(rows).select("package_key", "version_key", "rank")


@query
def q10_affected_versions(spark, d):
    """Versions of each brand in the range that the brand states."""
    part = table(spark, d, "part")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    number = F.substring("p_brand", 7, 9).cast("int")
    event = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("version"))
    events = F.array(event("introduced", F.concat(number.cast("string"), F.lit(".5.0"))), event("fixed", F.concat((number + 10).cast("string"), F.lit(".2.1"))))
    hit = semver.is_affected(version, F.array().cast("array<string>"), semver.affected_intervals(events))
    return part.select("p_partkey", version.alias("version"), semver.affected_bucket(hit).alias("bucket"))


@query
def q10_earliest_affected(spark, d):
    part = table(spark, d, "part")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    rows = part.select(F.lit(1).alias("advisory"), F.col("p_brand").alias("package_key"), version.alias("version"), F.col("p_partkey").cast("string").alias("version_key"), semver.semver_key(version).alias("sort_key"))
    return introduced.earliest_affected(rows).select("package_key", "earliest")


@query
def q11_publish_rights(spark, d):
    return maintainers.publish_rights(project(spark, d))


@query
def q11_leaderboard(spark, d):
    """Every account with what it reaches."""
    rows = maintainers.surfaces(project(spark, d))
    return maintainers.leaderboard(rows).select("maintainer_key", "packages", "services", "nearest_service_hop", "direct_dependents", "dependents_with_install_script", "weekly_downloads", "packages_without_downloads", "downloads_basis", "verdict", "rationale")


@query
def q11_top_accounts(spark, d):
    rows = maintainers.surfaces(project(spark, d), with_dependents=False)
    return maintainers.leaderboard(rows, 10).select("rank", "maintainer_key", "services")


@query
def q11_candidates(spark, d):
    """Modelled candidates: packages of others two hops away."""
    graph = project(spark, d)
    rights = maintainers.publish_rights(graph)
    reached = maintainers.account_reach(graph, maintainers.seed_versions(graph, rights), 2)
    return maintainers.dependents(graph, reached, rights)


@query
def q11_unranked(spark, d):
    """Accounts with no right to every 23rd part."""
    graph = project(spark, d)
    return maintainers.unranked(g.Graph(spark, graph.nodes, {"maintains": graph.edge("maintains").where("dst % 23 = 0")}))


@query
def q12_verdicts(spark, d):
    """A verdict per part on whether anybody returned it."""
    graph = project(spark, d)
    level = g.coverage_of(graph, "package", graph.node("packages"))
    rows = graph.node("packages").join(level, "key").join(graph.edge("affects").select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(True)), "id", "left")
    own = verdict.limits((F.coalesce("weekly_downloads", F.lit(0)) > 35, verdict.limit("path_limit", path_count=35)))
    decided = verdict.decide(F.coalesce("hit", F.lit(False)), F.col("level"), F.lit(False), own, F.col("key"))
    return rows.withColumn("a", decided).select("key", "a.verdict", F.array_join(F.transform("a.limits", lambda x: x["kind"]), ",").alias("limit_kinds"))


@query
def q12_weakest_coverage(spark, d):
    """The weakest claim over each supplier's parts."""
    graph = project(spark, d)
    held = maintains(spark, d).join(graph.node("packages").select(F.col("id").alias("dst"), "key"), "dst")
    whole = g.weakest_coverage(graph, "package", table(spark, d, "part").where("p_size % 3 < 2").select(F.concat(F.lit("npm:part-"), F.col("p_partkey").cast("string")).alias("key")))
    return g.weakest_coverage(graph, "package", held, "src").unionByName(whole.withColumn("src", F.lit(-1).cast("long")))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Exposure to the part most depended on and what depends on it."""
    seeds = most_depended_on(spark, d, 1)
    reached = traverse.reach(dependents(spark, d), seeds.select(F.col("node").alias("source"), "node"), HOPS, include_seeds=True)
    rows = blast_radius.service_exposures(reached, resolved(spark, d)).withColumnRenamed("source", "version")
    rows = replay.with_blind_spot(rows, rows.limit(0), 852076800000, 883612800000)
    instants = replay.frame_instants(spark, 820454400000, 946684800000, spark.createDataFrame([(883612800000, "disclosed")], "at_ms long, label string"), interval_ms=2592000000)
    return replay.cumulative_frames(instants, rows, 883612800000, table(spark, d, "customer").count())


@query
def q13_frames(spark, d):
    return _frames(spark, d).select("frame", "at_ms", "exposed", "newly_exposed", "blind_spots", "advisory_public", "not_seen_exposed")


@query
def q13_bars(spark, d):
    return replay.frame_bars(_frames(spark, d)).select("frame", F.round("height", 6).alias("height"), "advisory_public")


@query
def q14_frame_as_of(spark, d):
    return replay.frame_as_of(_frames(spark, d), 900000000000).select("frame", "at_ms", "exposed")


@query
def q15_edit_distance(spark, d):
    """Names one edit apart."""
    p = typosquat.profiles(named_packages(spark, d))
    s, t = typosquat._sides(p, p)
    return typosquat.near_names(s, t, 1).select("suspect", "target", F.col("signal.distance").alias("distance"), F.col("signal.plain").alias("plain"))


@query
def q15_levenshtein(spark, d):
    """Names within two plain edits, by segments."""
    p = typosquat.profiles(plain_packages(spark, d))
    s, t = typosquat._sides(p, p)
    return typosquat.near_names(s, t, 2).where("signal.plain <= 2").select("suspect", "target", F.col("signal.plain").alias("plain"))


@query
def q15_homoglyphs(spark, d):
    a = named_packages(spark, d)
    b = a.withColumn("name", F.translate("name", "i", "1"))
    s, t = typosquat._sides(typosquat.profiles(a), typosquat.profiles(b))
    return typosquat.homoglyphs(s, t).select("suspect", "target", F.col("signal.form").alias("form"))


@query
def q15_separators(spark, d):
    s, t = typosquat._sides(typosquat.profiles(named_packages(spark, d)), typosquat.profiles(named_packages(spark, d, "_")))
    return typosquat.separators_or_case(s, t).select("suspect", "target", "signal.form", "signal.case_differs", "signal.separators_differ")


@query
def q15_padding(spark, d):
    """Names with a token before, within or behind another name."""
    a = named_packages(spark, d)
    at = F.split("name", "-")
    every = plain_packages(spark, d).select("name").union(a.select(F.concat_ws("-", at[1], at[2]))).union(a.select(F.concat_ws("-", at[0], at[2]))).distinct()
    s, t = typosquat._sides(typosquat.profiles(a), typosquat.profiles(every.select(F.lit("npm").alias("ecosystem"), "name", F.lit(1).cast("long").alias("weekly_downloads"))))
    return typosquat.paddings(s, t).select("suspect", "target", "signal.position", "signal.token", "signal.is_filler")


@query
def q15_scope(spark, d):
    """Scopes dropped, added, swapped and folded into the name."""
    a = named_packages(spark, d)
    head = F.substring("name", 1, 1)
    b = a.withColumn("name", F.concat(F.lit("@"), head, F.lit("/"), "name"))
    more = a.where("name LIKE '%1'").withColumn("name", F.concat(F.lit("@z/"), "name")).unionByName(a.where("name LIKE '%2'").withColumn("name", F.concat(head, F.lit("-"), "name")))
    s, t = typosquat._sides(typosquat.profiles(a.unionByName(more)), typosquat.profiles(a.unionByName(b)))
    return typosquat.scope_confusions(s, t).select("suspect", "target", "signal.variety", "signal.form")


@query
def q16_findings(spark, d):
    """Confidence and rank of names that imitate one ten times as popular."""
    found = typosquat.findings(named_packages(spark, d), plain_packages(spark, d), typosquat.Options(max_distance=2, min_ratio=10, max_findings=50))
    return found.select("suspect", "target", "confidence", "edit_distance", "matched", "rank", F.array_join(F.transform("signals", lambda s: s["kind"]), ",").alias("kinds"))


@query
def q16_mirrored(spark, d):
    """Pairs one edit apart, either way round, folded."""
    found = q15_edit_distance(spark, d).select(F.lit("npm").alias("ecosystem"), "suspect", "target", F.lit("medium").alias("confidence"), F.col("distance").alias("edit_distance"), F.lit(0).cast("long").alias("target_downloads"))
    return typosquat.fold_mirrored(found).select("a", "b", "is_mirrored", "edit_distance")


@query
def q16_compared(spark, d):
    both = named_packages(spark, d).unionByName(plain_packages(spark, d).withColumn("ecosystem", F.lit("pypi")))
    return typosquat.scan_counts(both, both)


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a lockfile: its parts, at the part's own version unless
    the line's quantity is large.
    """
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    version = F.when(F.col("l_quantity") > 40, F.concat(F.col("p_size").cast("string"), F.lit(".9.9"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0.0")))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("path"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"), version.alias("version")).repartition(history.tasks_for(li), "path").distinct()


@query
def q17_scan(spark, d):
    """Every line of every order against the advisories."""
    rows = scan.scan_dependencies(project(spark, d), _dependencies(spark, d))
    return rows.select("path", "name", "version", "match", "verdict", F.size("advisories").alias("n_advisories"))


@query
def q17_file_verdicts(spark, d):
    rows = scan.scan_dependencies(project(spark, d), _dependencies(spark, d))
    report = rows.groupBy("path").agg(F.count("*").alias("dependencies")).withColumns({"format": F.lit("npm-lock-v2"), "error": F.lit(None).cast("string"), "unparsable": F.lit(0).cast("long"), "unpinned": F.lit(0).cast("long"), "truncated": F.lit(False)})
    return scan.file_verdicts(rows, report).select("path", "exposed", "unknown", "not_exposed", "verdict")


LINE_PATTERNS = {"license": r"(?i)licensed under the \w+ license", "credential": r"(?i)\b(?:password|secret|token)\b", "table": r"\w+ \| \w+ \| \w+"}


@query
def q18_line_scan(spark, d):
    """The first matching line of three patterns in every document."""
    return persistence.scan_lines(table(spark, d, "documents").select("doc_id", "text"), LINE_PATTERNS)


@query
def q19_merged_nodes(spark, d):
    """Two readings of the parts: what either knows, the first one's on conflict."""
    first, second = _readings(spark, d)
    return merge.merge_nodes(first, second, ["name", "size", "brand"])[0]


@query
def q19_conflicts(spark, d):
    first, second = _readings(spark, d)
    return merge.merge_nodes(first, second, ["name", "size", "brand"])[1]


def _readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    key = F.concat(F.lit("npm:part-"), F.col("p_partkey").cast("string")).alias("key")
    first = p.where("p_size <= 30").select(F.col("p_partkey").alias("id"), key, F.col("p_name").alias("name"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"), F.when(F.col("p_type") == "ECONOMY", F.col("p_brand")).alias("brand"))
    second = p.where("p_size >= 20").select(F.col("p_partkey").alias("id"), key, F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return first, second


@query
def q19_coverage(spark, d):
    """Claims of two manifests: the weaker wins."""
    p = table(spark, d, "part")
    claim = lambda rows, level: rows.select(F.lit("package").alias("subject_kind"), F.concat(F.lit("npm:part-"), F.col("p_partkey").cast("string")).alias("key"), level.alias("level"))
    return merge.merge_coverage(claim(p.where("p_size < 30"), F.when(F.col("p_size") % 2 == 0, 2).otherwise(1)), claim(p.where("p_size > 10"), F.when(F.col("p_size") % 3 == 0, 2).otherwise(1)))


@query
def q19_upsert(spark, d):
    """The second reading written over the first, by id."""
    first, second = _readings(spark, d)
    return merge.upsert_nodes(first, second)


@query
def q19_partitioned_upsert(spark, d):
    """The same into a table of which only the touched partitions are rewritten."""
    first, second = _readings(spark, d)
    at, schema = scratch(spark, "by-id"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema)
    upsert.write_by_id(first, at, 16)
    upsert.upsert_by_id(spark, at, second.select(*first.columns), schema, 16)
    return upsert.read_by_id(spark, at, schema).select(*first.columns)


@query
def q20_integrity(spark, d):
    """Lines that repeat an (order, number) pair, and orders without lines."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    edges = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return merge.duplicate_ids(edges, "edge_id", "line").unionByName(merge.dangling(edges, "src", nodes, "line").distinct())


@query
def q21_partial_closure(spark, d):
    """Parts that are absent or lead to one that is."""
    marked = table(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))
    return build.partial_closures(resolves_to(spark, d), marked)


@query
def q21_coverage_levels(spark, d):
    """What the closure leaves closed."""
    part = table(spark, d, "part")
    partial = build.partial_closures(resolves_to(spark, d), part.where("p_size = 50").select(F.col("p_partkey").alias("node")))
    versions = part.select(F.col("p_partkey").alias("node"), F.concat(F.lit("npm:"), "p_name").alias("package_key"))
    services = resolved(spark, d).select(F.concat(F.lit("svc:"), F.col("src").cast("string")).alias("service_key"), F.col("dst").alias("node"))
    return build.package_levels(versions, partial).unionByName(build.service_levels(services, partial))


@query
def q22_history(spark, d):
    """First and last time that each customer had each part."""
    o = table(spark, d, "orders")
    o = o.select("o_orderkey", "o_custkey", epoch_ms(o, "o_orderdate").alias("at_ms"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    tasks = history.tasks_for(li)
    li, o = li.repartition(tasks, "l_orderkey"), o.repartition(tasks, "o_orderkey")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("service"), F.col("l_partkey").alias("version"), F.col("o_orderkey").alias("revision"), "at_ms")
    return history.fold_history(rows, tasks)


@query
def q22_history_coverage(spark, d):
    o = table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").cast("string").alias("service")).agg(F.count("*").alias("revisions"), F.count_if(F.col("o_orderstatus") == "P").alias("skipped"), F.lit(0).cast("long").alias("unreadable"), F.lit(False).alias("is_shallow"), (F.min(epoch_ms(o, "o_orderdate")) < 852076800000).alias("reaches_window"))
    return history.history_coverage(per).select("service", "is_partial", F.array_join("reasons", "; ").alias("reasons"))


@query
def q23_trace(spark, d):
    """Nodes of the routes to the parts most depended on."""
    seeds = most_depended_on(spark, d)
    reached = blast_radius.with_source(routes.shortest_routes(dependents(spark, d), seeds, HOPS), seeds)
    rows = blast_radius.service_exposures(reached, resolved(spark, d))
    steps = blast_radius.route(F.concat(F.lit("svc:"), F.col("service").cast("string")), F.transform("nodes", lambda n: n.cast("string")), F.col("resolved_at_ms"))
    return replay.trace_nodes(rows.where("hop > 1").select(F.concat_ws("/", "service", "source").alias("service_key"), steps.alias("steps")))


@query
def q24_requirements(spark, d):
    """Each customer's parts written as requirements and parsed again."""
    rows = pins(spark, d).select("src", "dst").join(table(spark, d, "part").select(F.col("p_partkey").alias("dst"), "p_size"), "dst")  # the days are not asked for
    line = F.concat(F.lit("Part_"), F.col("dst").cast("string"), F.when(F.col("p_size") > 40, F.concat(F.lit(" >= "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("=="), F.col("p_size").cast("string"), F.lit(".0 ; python_version > '3'  # pinned"))))
    files = rows.groupBy(F.concat(F.col("src").cast("string"), F.lit("/requirements.txt")).alias("path")).agg(F.concat(F.lit("# made\n-r other.txt\n"), F.array_join(F.sort_array(F.collect_set(line)), "\n")).alias("content"))
    return lockfile.parse_lockfiles(files, ("requirements-txt",))[0].select("path", "ecosystem", "name", "version", "is_dev_only")


@query
def q24_package_lock(spark, d):
    """Each order written as a package lock and parsed again."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"), F.bool_and(F.col("l_returnflag") == "N").alias("dev"))
    where = F.concat(F.when(F.col("n") > 4, F.lit("node_modules/outer/")).otherwise(F.lit("")), F.lit("node_modules/part-"), F.col("l_partkey").cast("string"))
    entry = F.struct(where.alias("k"), F.struct(F.concat(F.col("n").cast("string"), F.lit(".0.0")).alias("version"), F.col("dev").alias("dev")).alias("v"))
    packages = F.map_from_entries(F.collect_list(entry))
    files = li.groupBy(F.concat(F.col("l_orderkey").cast("string"), F.lit("/package-lock.json")).alias("path")).agg(F.to_json(F.struct(F.lit(3).alias("lockfileVersion"), packages.alias("packages"))).alias("content"))
    return lockfile.parse_lockfiles(files, ("npm-lock-v2",))[0].select("path", "name", "version", "is_dev_only", "depth")


@query
def q25_stream_first_pin(spark, d):
    """The earliest pin of each customer and part, from a stream of orders
    that is read to its end.
    """
    o = table(spark, d, "orders")
    o = o.select("o_orderkey", "o_custkey", F.timestamp_millis(epoch_ms(o, "o_orderdate")).alias("resolved_at"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    at = f"{checkpoint_dir(spark)}/first-pin-{uuid.uuid4().hex}"
    rows.select(F.col("o_custkey").alias("service"), F.col("l_partkey").alias("version"), "resolved_at").write.parquet(f"{at}/in")
    first_pin.run_available(first_pin.first_pins(first_pin.read_pins(spark, f"{at}/in")), f"{at}/out", f"{at}/state")
    return first_pin.earliest(spark, f"{at}/out")


@query
def q25_expiring_first_pin(spark, d):
    """The first click of each user in an event's type, with keyed state that
    expires.
    """
    e = table(spark, d, "events")
    at = f"{checkpoint_dir(spark)}/first-click-{uuid.uuid4().hex}"
    kind = F.dense_rank().over(Window.orderBy("event_type"))
    kinds = e.select("event_type").distinct().withColumn("version", kind.cast("long"))  # a row a type
    e.join(kinds, "event_type").select(F.col("user_id").cast("long").alias("service"), "version", F.timestamp_millis(epoch_ms(e, "ts")).alias("resolved_at")).write.parquet(f"{at}/in")
    first_pin.run_available(first_pin.expiring_first_pins(first_pin.read_pins(spark, f"{at}/in"), late="3650 days"), f"{at}/out", f"{at}/state")
    return first_pin.earliest(spark, f"{at}/out")


@query
def q26_keys(spark, d):
    """Keys made and taken apart."""
    p = table(spark, d, "part")
    scoped = F.concat(F.lit("@"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(":")))
    key = keys.version_key(F.lit("npm"), scoped, F.concat(F.col("p_size").cast("string"), F.lit(".0.0")))
    parsed = keys.parse_version_key(key)
    return p.select("p_partkey", key.alias("key"), parsed["name"].alias("name"), parsed["version"].alias("version"), keys.version_name(key).alias("shown"), keys.is_selectable(key).alias("is_selectable"), keys.package_of_version(key).alias("package_key"))


@query
def q26_formats(spark, d):
    """Counts, days and spans as text."""
    f = part_facts(spark, d)
    return f.select("id", formats.format_count(F.col("lines") * 1000).alias("shown_count"), formats.format_day(F.col("published_at_ms")).alias("day"), formats.span_unit(F.col("disclosed_at_ms") - F.col("published_at_ms")).alias("unit"), formats.span_amount(F.col("disclosed_at_ms") - F.col("published_at_ms")).alias("amount"))


@query
def q26_summaries(spark, d):
    """Texts with white space collapsed, cut to 480 characters."""
    return table(spark, d, "documents").select("doc_id", F.md5(formats.collapse(F.col("text"), build.SUMMARY).cast("binary")).alias("digest"))


@query
def q27_crawl(spark, d):
    """Parts that a crawl of three levels reaches within its budget."""
    seeds = most_depended_on(spark, d).select(F.col("node").alias("key"))
    return build.crawl(seeds, dependents(spark, d).select(F.col("src").alias("key"), F.col("dst").alias("dependency")), 3, 150)


@query
def q27_select_versions(spark, d):
    """The three parts of each name that a crawl would fetch."""
    f = part_facts(spark, d).select("id", "published_at_ms")
    rows = table(spark, d, "part").join(f, F.col("p_partkey") == F.col("id"), "left")
    rows = rows.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("version"), "published_at_ms", (F.col("p_size") == 50).alias("is_latest"), (F.col("p_size") < 5).alias("is_unpublished"))
    return select_versions(rows, 3).select("name", "version", "rank")


@query
def q28_id_map(spark, d):
    """Ids for keys: known ones stay, new ones follow in key order."""
    p = table(spark, d, "part").select(F.lit("Package").alias("label"), F.format_string("part-%08d", "p_partkey").alias("key"), "p_partkey", "p_size")
    known = p.where("p_size <= 25").select("label", "key", F.col("p_partkey").alias("id"))
    return g.assign_ids(known, p.select("label", "key"))


@query
def q28_last_write(spark, d):
    """Of an order's lines with one number, the one shipped last."""
    li = table(spark, d, "lineitem")
    rows = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), epoch_ms(li, "l_shipdate").alias("ship_ms"), "l_partkey", "l_suppkey", "l_quantity")
    return g.last_write_wins(rows, F.struct("ship_ms", "l_partkey", "l_suppkey", "l_quantity")).select("id", "ship_ms", "l_partkey")


@query
def q29_reach_of_names(spark, d):
    """Dependents and services of every part."""
    same = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst"))
    return typosquat.reach_of_names(resolves_to(spark, d), same, resolved(spark, d))


@query
def q30_event_exposure(spark, d):
    """Users between their first error and their first purchase, by event time."""
    e = table(spark, d, "events")
    at = epoch_ms(e, "ts")
    per = e.groupBy(F.col("user_id").alias("version")).agg(F.min(F.when(F.col("event_type") == "error", at)).alias("published_ms"), F.min(F.when(F.col("event_type") == "purchase", at)).alias("disclosed_ms"))
    pins_ = e.where("event_type = 'click'").select(F.col("user_id").alias("dst"), F.col("event_id").alias("src"), at.alias("resolved_at_ms"))
    hit = bitemporal.in_window_pins(pins_, per)
    return hit.groupBy(F.col("version").alias("user_id")).agg(F.count("*").alias("clicks"), F.min("resolved_at_ms").alias("first_ms"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **file_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{k: v for k, v in ORACLES.items() if k in QUERIES}, **file_queries.ORACLES}
