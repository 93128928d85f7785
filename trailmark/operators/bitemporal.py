"""Resolved while live: who pinned a version between publication (valid time)
and its advisory (known time).  Windows are half-open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, verdict
from .graph import Graph, coverage_of, is_empty


def window_ms(start: Column, end: Column) -> Column:
    """Length of the window; 0 if it is inverted, null if a clock is unknown."""
    a, b = keys.placed_instant(start), keys.placed_instant(end)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(b - a, F.lit(0)))


def pairs(graph: Graph) -> DataFrame:
    """``(advisory, version, package_key, published_ms, disclosed_ms)`` of each
    version that an advisory affects.
    """
    versions = graph.node("versions").select(F.col("id").alias("version"), F.col("key").alias("version_key"), "ecosystem", "name", keys.placed_instant(F.col("published_at_ms")).alias("published_ms"))
    advisories = graph.node("advisories").select(F.col("id").alias("advisory"), F.col("key").alias("advisory_key"), keys.placed_instant(F.col("published_at_ms")).alias("disclosed_ms"))
    both = graph.edge("affects_version").select(F.col("src").alias("advisory"), F.col("dst").alias("version")).distinct()
    both = both.join(versions, "version").join(advisories, "advisory")
    return both.withColumn("package_key", keys.package_key(F.col("ecosystem"), F.col("name"))).drop("ecosystem", "name")


def in_window_pins(resolved: DataFrame, windows: DataFrame) -> DataFrame:
    """Pins within their version's window: an equi-join on the version with
    the bounds as residual conditions.
    """
    pins = resolved.select(F.col("src").alias("service"), F.col("dst").alias("version"), "resolved_at_ms")
    at = F.col("resolved_at_ms")
    return pins.join(windows, "version").where((at >= F.col("published_ms")) & (at < F.col("disclosed_ms")))


def victims(resolved: DataFrame, windows: DataFrame) -> DataFrame:
    """``(advisory, version, service, resolved_at_ms, ms_before_disclosure)``:
    the earliest pin in the window, per service.
    """
    hit = in_window_pins(resolved, windows)
    per = hit.groupBy("advisory", "version", "service").agg(F.min("resolved_at_ms").alias("resolved_at_ms"), F.first("disclosed_ms").alias("disclosed_ms"))
    return per.withColumn("ms_before_disclosure", F.col("disclosed_ms") - F.col("resolved_at_ms")).drop("disclosed_ms")


def timeline(windows: DataFrame, found: DataFrame) -> DataFrame:
    """``(advisory, version, at_ms, kind, service)`` in order: publication,
    then pins, then disclosure, at one instant too.
    """
    none = F.lit(None).cast("long")
    events = [
        windows.select("advisory", "version", F.col("published_ms").alias("at_ms"), F.lit("published").alias("kind"), none.alias("service"), F.lit(0).alias("kind_rank")),
        found.select("advisory", "version", F.col("resolved_at_ms").alias("at_ms"), F.lit("resolved").alias("kind"), "service", F.lit(1).alias("kind_rank")),
        windows.select("advisory", "version", F.col("disclosed_ms").alias("at_ms"), F.lit("disclosed").alias("kind"), none.alias("service"), F.lit(2).alias("kind_rank")),
    ]
    return reduce(DataFrame.unionByName, events).where("at_ms IS NOT NULL")


def unreadable_clocks(published: Column, disclosed: Column) -> Column:
    """Names of the clocks that can't be read, joined by ``and``."""
    return F.concat_ws(" and ", F.when(published.isNull(), "the publication time"), F.when(disclosed.isNull(), "the disclosure time"))


def answers(graph: Graph) -> DataFrame:
    """A verdict per (advisory, affected version).

    An empty or inverted window is ``not_exposed`` whatever the coverage, for
    that follows from the clocks; an unreadable clock is ``unknown``.
    """
    windows = pairs(graph)
    n = victims(graph.edge("resolved"), windows).groupBy("advisory", "version").agg(F.count("*").alias("n_victims"), F.min("resolved_at_ms").alias("first_pin_ms"))
    level = coverage_of(graph, "package", windows.select(F.col("package_key").alias("key"))).withColumnRenamed("key", "package_key")
    rows = windows.join(n, ["advisory", "version"], "left").join(level, "package_key").withColumn("n_victims", F.coalesce("n_victims", F.lit(0)))
    none = F.array().cast(verdict.LIMITS)
    usual = verdict.decide(F.col("n_victims") > 0, F.col("level"), F.lit(is_empty(graph)), none, F.col("version_key"))
    clocks = F.col("published_ms").isNotNull() & F.col("disclosed_ms").isNotNull()
    plain = lambda v, r: F.struct(F.lit(v).alias("verdict"), r.alias("rationale"), none.alias("limits"))
    decided = (
        F.when(~clocks, plain("unknown", F.concat(F.lit("The window can't be placed: "), unreadable_clocks(F.col("published_ms"), F.col("disclosed_ms")), F.lit(" is unknown."))))
        .when(F.col("disclosed_ms") <= F.col("published_ms"), plain("not_exposed", F.lit("It was disclosed before it was published, so nobody could pin it undisclosed.")))
        .otherwise(usual)
    )
    return rows.withColumn("a", decided).select("advisory_key", "version_key", "published_ms", "disclosed_ms", window_ms(F.col("published_ms"), F.col("disclosed_ms")).alias("window_ms"), "n_victims", "first_pin_ms", "a.verdict", "a.rationale", "a.limits")
