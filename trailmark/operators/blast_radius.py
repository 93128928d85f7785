"""Blast radius: who depends on a bad version, over which route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, verdict
from ..storage import stored
from .graph import Graph, coverage_of, is_empty
from .routes import counted, route_counts, shortest_routes, total
from .traverse import BudgetError, check_bounds, path_count_limit_reached, paths


@dataclass(frozen=True)
class Bounds:
    """Caps of a question.  ``rows_a_level`` is for walks that list no routes."""

    max_hops: int = 8
    path_count: int = 20_000
    max_services: int = 5_000
    resolved_per_service: int = 20_000
    paths_a_level: int = 1_000_000
    rows_a_level: int | None = None


def reachable(found: DataFrame) -> DataFrame:
    """``(source, node, hop, path_count, nodes, edges)``: of all ``paths`` to a
    node the least hops, the first shortest route and the number of routes.
    """
    first = F.struct("hop", "ordinal", "edges")
    return found.groupBy("source", F.col("tail").alias("node")).agg(F.min("hop").alias("hop"), F.count("*").alias("path_count"), F.min_by("nodes", first).alias("nodes"), F.min_by("edges", first).alias("edges"))


def reachable_by_counts(edges: DataFrame, seeds: DataFrame, max_hops: int, most: int | None = None) -> DataFrame:
    """The same without listing routes: what can be reached from ``seeds``."""
    return counted(route_counts(edges, seeds, max_hops, most), shortest_routes(edges, seeds, max_hops))


def with_source(reached: DataFrame, sources: DataFrame) -> DataFrame:
    """The reachable versions and the source itself, at hop 0 by one route;
    ``reached`` may lack routes or their number.
    """
    own = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop"), F.lit(1).cast("long").alias("path_count"), F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("edges"))
    return own.select(*reached.columns).distinct().unionByName(reached)


def service_exposures(reached: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(source, service, hop, is_direct, path_count, resolved_at_ms, nodes)``.

    ``reached`` includes the source.  A service's hop is one more than the
    nearest version that it pins, its routes are those of all its pins, and
    ``nodes`` the route from the pin to the source; where ``reached`` lacks
    routes or their number, so does the result.  Among pins of the best hop the
    earliest supplies the time (unknown last), then the lowest edge.
    """
    pins = resolved.select(F.col("edge_id").alias("pin"), F.col("src").alias("service"), F.col("dst").alias("node"), "resolved_at_ms")
    both = pins.join(reached, "node")
    best = F.struct("hop", F.col("resolved_at_ms").isNull(), "resolved_at_ms", "pin")
    known = {"path_count": total(F.col("path_count")).alias("path_count"), "nodes": F.min_by(F.reverse("nodes"), best).alias("nodes")}
    per = both.groupBy("source", "service").agg((F.min("hop") + 1).alias("hop"), F.min_by(F.col("resolved_at_ms"), best).alias("resolved_at_ms"), *[known[c] for c in known if c in reached.columns])
    return per.withColumn("is_direct", F.col("hop") == 1)


def route(service_key: Column, version_keys: Column, resolved_at_ms: Column) -> Column:
    """Steps of an exposure, from the service to the bad version:
    ``array<struct<key, via, resolved_at_ms>>``; the first has no ``via``, the
    second was pinned, the others are dependencies.
    """
    none = F.lit(None).cast("string")
    start = F.array(F.struct(service_key.alias("key"), none.alias("via"), F.lit(None).cast("long").alias("resolved_at_ms")))
    rest = F.transform(version_keys, lambda k, i: F.struct(k.alias("key"), F.when(i == 0, "resolved").otherwise("resolves_to").alias("via"), F.when(i == 0, resolved_at_ms).alias("resolved_at_ms")))
    return F.concat(start, rest)


def version_route(version_keys: Column) -> Column:
    """The same for a version without a service."""
    return F.transform(version_keys, lambda k, i: F.struct(k.alias("key"), F.when(i > 0, F.lit("resolves_to")).alias("via"), F.lit(None).cast("long").alias("resolved_at_ms")))


def key_routes(routes: DataFrame, versions: DataFrame, by: list[str]) -> DataFrame:
    """Replace the ids in ``nodes`` by version keys (``node_keys``)."""
    flat = routes.select(*by, F.posexplode("nodes").alias("pos", "id")).join(versions.select("id", F.col("key").alias("k")), "id")
    named = flat.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k"))), lambda s: s["k"]).alias("node_keys"))
    return routes.join(named, by)


def restrict_to_instant(exposures: DataFrame, at_ms: int) -> DataFrame:
    """``exposures`` with ``bucket``: ``kept`` if pinned at or before the
    instant, ``later``, or ``undated``.
    """
    at = F.col("resolved_at_ms")
    return exposures.withColumn("bucket", F.when(at.isNull() | (at <= 0), "undated").when(at <= at_ms, "kept").otherwise("later"))


def deepest_hop(reached: DataFrame) -> DataFrame:
    return reached.groupBy("source").agg(F.max("hop").alias("max_hop_reached"))


@dataclass
class BoundedReach:
    """What was ``reached`` (as by ``reachable``), by how many routes of which
    greatest length, and what ``stopped`` the search, if anything did.
    """

    reached: DataFrame
    n_paths: int
    longest: int
    stopped: str | None = None


def bounded_reach(edges: DataFrame, seeds: DataFrame, bounds: Bounds) -> BoundedReach:
    """The first ``path_count`` routes from ``seeds``, by hops, and what they
    reach.

    Routes are counted first.  A hop with over ``paths_a_level`` of them is
    left out, and stops the search; only where there are as many as
    ``path_count`` or more are they listed, up to the hop where that is met.
    """
    stopped, hops = None, bounds.max_hops
    try:
        counts = route_counts(edges, seeds, hops, bounds.paths_a_level)
    except BudgetError as e:
        stopped, hops = str(e), e.hop
        counts = route_counts(edges, seeds, max(1, hops), bounds.paths_a_level).where(F.col("hop") <= hops)
    counts, _ = stored(counts, "counts")
    sizes = {r["hop"]: r["n"] for r in counts.groupBy("hop").agg(total(F.col("n")).alias("n")).collect()}  # a row a hop
    sum_, full, listing = 0, 0, False
    for hop in sorted(sizes):
        if sizes[hop] > bounds.paths_a_level:
            stopped = str(BudgetError(full, bounds.paths_a_level))
            break
        if sum_ + sizes[hop] >= bounds.path_count:
            listing = True
            break
        sum_, full = sum_ + sizes[hop], hop
    if not listing:
        counts = counts.where(F.col("hop") <= full)
        return BoundedReach(counted(counts, shortest_routes(edges, seeds, max(1, full)).where(F.col("hop") <= full)), sum_, full, stopped)
    found = paths(edges, seeds, full + 1, bounds.path_count, checkpoint=True).persist()
    return BoundedReach(reachable(found), *found.agg(F.count("*"), F.max("hop")).first(), stopped)


@dataclass
class BlastRadius:
    """``answer`` has one row; the others are its evidence."""

    answer: DataFrame
    versions: DataFrame
    services: DataFrame


def blast_radius(graph: Graph, key: str, bounds: Bounds | None = None, at_ms: int | None = None) -> BlastRadius:
    """Who transitively depends on the version ``key``.

    Every cap that is met becomes a limit of the answer.  With ``at_ms`` only
    pins at or before that instant count, and undated ones are a limit.
    """
    bounds = bounds or Bounds()
    check_bounds(bounds.max_hops, bounds.path_count)
    spark = graph.spark
    parsed = spark.createDataFrame([(key,)], "key string").select(keys.parse_version_key(F.col("key")).alias("p")).first()["p"]
    if parsed is None:
        raise ValueError(f"not a version key: {key}")
    versions = graph.node("versions")
    source = versions.where(F.col("key") == key).select(F.lit(0).alias("ordinal"), F.col("id").alias("node"))
    dependents = graph.edge("depended_on_by").select("edge_id", "src", "dst")
    found = bounded_reach(dependents, source, bounds)
    deepest = (deepest_hop(found.reached).first() or {"max_hop_reached": 0})["max_hop_reached"]
    reached = found.reached

    services = graph.node("services")
    total = services.count()
    examined = services.orderBy("id").limit(bounds.max_services)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("edge_id"))
    pins = graph.edge("resolved").join(examined.select(F.col("id").alias("src")), "src", "left_semi").withColumn("_rank", rank)
    n_pins = pins.where(F.col("_rank") > bounds.resolved_per_service).count()
    pins = pins.where(F.col("_rank") <= bounds.resolved_per_service).drop("_rank")
    exposed = service_exposures(with_source(reached, source), pins)
    exposed = key_routes(exposed, versions, ["source", "service"]).join(services.select(F.col("id").alias("service"), F.col("key").alias("service_key"), F.col("name").alias("service_name")), "service")
    exposed = exposed.withColumn("steps", route(F.col("service_key"), F.col("node_keys"), F.col("resolved_at_ms")))
    n_undated = 0
    if at_ms is not None:
        exposed = restrict_to_instant(exposed, at_ms)
        n_undated = exposed.where("bucket = 'undated'").count()
        exposed = exposed.where("bucket = 'kept'").drop("bucket")
    exposed = exposed.select("service_key", "service_name", "hop", "is_direct", "path_count", "resolved_at_ms", "steps").orderBy("hop", "service_name")

    listed = key_routes(reached, versions, ["source", "node"]).join(versions.select(F.col("id").alias("node"), F.col("key").alias("version_key")), "node")
    listed = listed.select("version_key", keys.version_name(F.col("version_key")).alias("shown"), "hop", "path_count", version_route(F.reverse("node_keys")).alias("steps")).orderBy("hop", "version_key")

    package = spark.createDataFrame([(f"{parsed['ecosystem']}:{parsed['name']}",)], "key string")
    level = coverage_of(graph, "package", package).first()["level"]
    known = source.isEmpty() is False
    own = verdict.limits(
        (F.lit(found.longest >= bounds.max_hops), verdict.limit("hop_limit", max_hops=bounds.max_hops)),
        (F.lit(path_count_limit_reached(found.n_paths, bounds.path_count)), verdict.limit("path_limit", path_count=bounds.path_count)),
        (F.lit(found.stopped is not None), verdict.limit("budget_rejected", operation=found.stopped or "")),
        (F.lit(total > bounds.max_services), verdict.limit("scan_capped", examined=bounds.max_services, total=total)),
        (F.lit(n_pins > 0), verdict.limit("scan_capped", examined=bounds.resolved_per_service, total=bounds.resolved_per_service + n_pins)),
        (F.lit(n_undated > 0), verdict.limit("timestamp_missing", field="resolved_at_ms")),
    )
    counts = listed.agg(F.count("*").alias("n_versions")).crossJoin(exposed.agg(F.count("*").alias("n_services")))  # one row each
    decided = verdict.decide(F.col("n_versions") + F.col("n_services") > 0 if at_ms is None else F.col("n_services") > 0, F.lit(level if known else 0), F.lit(is_empty(graph)), own, F.lit(key))
    answer = counts.withColumn("a", decided).select(F.lit(key).alias("version_key"), "a.verdict", "a.rationale", "a.limits", "n_versions", "n_services", F.lit(deepest).alias("max_hop_reached"), F.lit(min(total, bounds.max_services)).cast("long").alias("services_considered"))
    return BlastRadius(answer, listed, exposed)
