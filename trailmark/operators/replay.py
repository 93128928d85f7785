"""Replay of an incident: cumulative frames over a window of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, verdict
from ..storage import stored
from . import bitemporal
from .blast_radius import Bounds, service_exposures
from .graph import Graph, is_empty, weakest_coverage
from .traverse import BudgetError, reach

MIN_FRAMES, DEFAULT_FRAMES, MAX_FRAMES = 2, 60, 2_000


def frame_instants(spark: SparkSession, start_ms: int, end_ms: int, marks: DataFrame, frames: int = DEFAULT_FRAMES, interval_ms: int | None = None) -> DataFrame:
    """``(frame, at_ms, labels)``: even ticks, or one each ``interval_ms``, with
    the instants of ``marks (at_ms, label)`` in the window; distinct, in order.

    At most MAX_FRAMES ticks are made, so frames are few.
    """
    if end_ms <= start_ms:
        raise ValueError("the window must end after it starts")
    if not MIN_FRAMES <= frames <= MAX_FRAMES:
        raise ValueError(f"frames must be from {MIN_FRAMES} to {MAX_FRAMES}")
    if interval_ms is not None and (interval_ms < 1 or (end_ms - start_ms) // interval_ms >= MAX_FRAMES):
        raise ValueError(f"interval_ms must make from 1 to {MAX_FRAMES} frames")
    if interval_ms is None:
        ticks = spark.range(frames).select((F.lit(start_ms) + F.round(F.col("id") * F.lit(end_ms - start_ms) / (frames - 1))).cast("long").alias("at_ms"))
    else:
        ticks = spark.range(start_ms, end_ms + 1, interval_ms).select(F.col("id").alias("at_ms")).union(spark.range(1).select(F.lit(end_ms).cast("long")))
    named = marks.where((F.col("at_ms") >= start_ms) & (F.col("at_ms") <= end_ms)).select("at_ms", "label")
    both = ticks.select("at_ms", F.lit(None).cast("string").alias("label")).unionByName(named)
    rows = both.groupBy("at_ms").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return rows.withColumn("frame", F.row_number().over(Window.orderBy("at_ms")) - 1)


def preferred_exposures(found: DataFrame) -> DataFrame:
    """One row per service of ``(service, version, hop, resolved_at_ms)``: the
    earliest pin (unknown last), then the fewest hops, then the version.
    """
    best = F.struct(F.col("resolved_at_ms").isNull(), "resolved_at_ms", "hop", "version")
    return found.groupBy("service").agg(F.min_by("resolved_at_ms", best).alias("resolved_at_ms"), F.min_by("hop", best).alias("hop"), F.min_by("version", best).alias("version"))


def with_blind_spot(exposures: DataFrame, victims: DataFrame, published_ms: int | None, disclosed_ms: int | None) -> DataFrame:
    """``is_blind_spot``: a known victim, or pinned in the half-open window."""
    known = victims.select("service").distinct().withColumn("_hit", F.lit(True))
    at = F.col("resolved_at_ms")
    inside = F.coalesce((at >= F.lit(published_ms)) & (at < F.lit(disclosed_ms)), F.lit(False))
    return exposures.join(known, "service", "left").withColumn("is_blind_spot", F.coalesce("_hit", F.lit(False)) | inside).drop("_hit")


def cumulative_frames(instants: DataFrame, exposures: DataFrame, disclosed_ms: int | None, known_services: int) -> DataFrame:
    """Per frame: services exposed so far, blind spots among them, newly
    exposed ones, whether the advisory is public, and verdict counts.

    Instants are few and go to every pin, which finds its first frame by
    itself; only counts per frame are summed in order.  An advisory is public
    from its own instant on.
    """
    pins = exposures.where("resolved_at_ms IS NOT NULL").groupBy(F.col("resolved_at_ms").alias("at_ms")).agg(F.count("*").alias("n"), F.count_if(F.col("is_blind_spot")).alias("blind"))
    ticks = instants.agg(F.array_sort(F.collect_list("at_ms")).alias("ticks"))  # one row
    first = F.size(F.filter("ticks", lambda t: t < F.col("at_ms"))).alias("frame")
    per = pins.crossJoin(F.broadcast(ticks)).groupBy(first).agg(F.sum("n").alias("n"), F.sum("blind").alias("blind"))
    so_far = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)  # a row a frame
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    rows = instants.select("frame", "at_ms").join(per, "frame", "left").select("frame", "at_ms", total("n").alias("exposed"), total("blind").alias("blind_spots"))
    rows = rows.withColumn("newly_exposed", F.col("exposed") - F.coalesce(F.lag("exposed").over(Window.orderBy("frame")), F.lit(0)))
    public = F.lit(False) if disclosed_ms is None else F.col("at_ms") >= disclosed_ms
    return rows.select("frame", "at_ms", "exposed", "newly_exposed", "blind_spots", public.alias("advisory_public"), F.greatest(F.lit(known_services) - F.col("exposed"), F.lit(0)).alias("not_seen_exposed"))


def frame_as_of(frames: DataFrame, at_ms: int) -> DataFrame:
    """The last frame at or before the instant; the first if there is none."""
    before = frames.where(F.col("at_ms") <= at_ms).agg(F.max("frame").alias("f"))
    return frames.join(before.select(F.coalesce("f", F.lit(0)).alias("frame")), "frame")


def frame_bars(frames: DataFrame) -> DataFrame:
    """Height of each frame's bar, 1 for the greatest count."""
    top = F.max("exposed").over(Window.partitionBy())  # one row a frame
    return frames.select("frame", "at_ms", F.when(top > 0, F.col("exposed") / top).otherwise(F.lit(0.0)).alias("height"), "advisory_public")


def disclosure_index(frames: DataFrame) -> DataFrame:
    return frames.where("advisory_public").agg(F.min("frame").alias("disclosure_frame"))


def earliest(compromised: DataFrame, advisories: DataFrame) -> tuple[int | None, int | None]:
    """First publication and first disclosure; null if none is known."""
    t1 = compromised.agg(F.min(F.when(F.col("published_at_ms") > 0, F.col("published_at_ms")))).first()[0]
    t2 = advisories.agg(F.min(F.when(F.col("published_at_ms") > 0, F.col("published_at_ms")))).first()[0]
    return t1, t2


def collect_exposures(graph: Graph, compromised: DataFrame, bounds: Bounds | None = None) -> tuple[DataFrame, list[Column]]:
    """``(service, version, hop, resolved_at_ms)`` for each bad version (``id``)
    and service, in one walk from all of them that lists no routes; and the
    limits that it met.
    """
    bounds = bounds or Bounds()
    seeds = compromised.select(F.col("id").alias("source"), F.col("id").alias("node"))
    met: list[Column] = []
    try:
        reached = reach(graph.edge("depended_on_by"), seeds, bounds.max_hops, include_seeds=True, most=bounds.rows_a_level)
        if not reached.where(F.col("hop") >= bounds.max_hops).isEmpty():
            met.append(verdict.limit("hop_limit", max_hops=bounds.max_hops))
    except BudgetError as e:
        reached = e.found
        met.append(verdict.limit("budget_rejected", operation=str(e)))
    return service_exposures(reached, graph.edge("resolved")).select("service", F.col("source").alias("version"), "hop", "resolved_at_ms"), met


def with_verdicts(frames: DataFrame, met: Column, level: int, graph_is_empty: bool, subject: str) -> DataFrame:
    """``frames`` with ``verdict``, ``limits``, ``not_exposed`` and ``unknown``:
    services not seen exposed are only called safe in a frame without limits.
    """
    a = verdict.decide(F.col("exposed") > 0, F.lit(level), F.lit(graph_is_empty), met, F.lit(subject))
    rest = F.col("not_seen_exposed")
    rows = frames.withColumn("_a", a).withColumns({"verdict": F.col("_a.verdict"), "limits": F.col("_a.limits")}).drop("_a")
    sure = F.size("limits") == 0
    return rows.withColumns({"not_exposed": F.when(sure, rest).otherwise(0), "unknown": F.when(sure, 0).otherwise(rest)})


def replay(graph: Graph, compromised: DataFrame, advisories: DataFrame, start_ms: int, end_ms: int, marks: DataFrame | None = None, frames: int = DEFAULT_FRAMES, bounds: Bounds | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames and exposures of an incident.

    ``compromised (id, published_at_ms)`` are versions, ``advisories (id,
    published_at_ms)`` what disclosed them.  Services count once, by key.
    Every frame has a verdict and the limits that the walk met; coverage is
    the weakest of the compromised versions' packages.
    """
    spark = graph.spark
    # what is asked for again and again is written down once
    compromised, _ = stored(compromised.select("id", "published_at_ms"), "compromised")
    advisories, _ = stored(advisories.select("id", "published_at_ms"), "advisories")
    graph = Graph(spark, graph.nodes, {**graph.edges, "resolved": stored(graph.edge("resolved"), "pins")[0]}, graph.coverage)
    t1, t2 = earliest(compromised, advisories)
    exposures, met = collect_exposures(graph, compromised, bounds)
    found = preferred_exposures(exposures)
    windows = bitemporal.pairs(graph).join(compromised.select(F.col("id").alias("version")), "version", "left_semi").join(advisories.select(F.col("id").alias("advisory")), "advisory", "left_semi")
    rows = with_blind_spot(found, bitemporal.victims(graph.edge("resolved"), windows), t1, t2).persist()
    own = [spark.createDataFrame([(t, label)], "at_ms long, label string") for t, label in ((t1, "published"), (t2, "disclosed")) if t is not None]
    all_marks = reduce(DataFrame.unionByName, ([marks] if marks is not None else []) + own) if own or marks is not None else spark.createDataFrame([], "at_ms long, label string")
    instants = frame_instants(spark, start_ms, end_ms, all_marks, frames)
    if not rows.where(F.coalesce("resolved_at_ms", F.lit(0)) <= 0).isEmpty():
        met.append(verdict.limit("timestamp_missing", field="resolved_at_ms"))
    bad, _ = stored(graph.node("versions").join(compromised.select("id"), "id", "left_semi").select("ecosystem", "name", "key"), "bad")
    level = weakest_coverage(graph, "package", bad.select(keys.package_key(F.col("ecosystem"), F.col("name")).alias("key"))).first()["level"]
    subject = bad.agg(F.min("key")).first()[0]
    frames_ = cumulative_frames(instants, rows, t2, graph.node("services").count())
    return with_verdicts(frames_, F.array(*met).cast(verdict.LIMITS), level if subject else verdict.ABSENT, is_empty(graph), subject or "nothing"), rows


def fold_limits_of(answers: DataFrame) -> DataFrame:
    """``(identity, limit)``: each limit of many answers once."""
    from ..functions.verdict import limit_identity

    rows = answers.select(F.explode("limits").alias("limit")).withColumn("identity", limit_identity(F.col("limit")))
    return rows.groupBy("identity").agg(F.min("limit").alias("limit"))


def trace_nodes(exposures: DataFrame) -> DataFrame:
    """Nodes of all routes (``service_key, steps``): least hop from the service,
    services behind each, and whether any pins it itself.
    """
    flat = exposures.select("service_key", F.posexplode("steps").alias("pos", "step"))
    return flat.groupBy(F.col("step.key").alias("key")).agg(F.min("pos").alias("hop"), F.count_distinct("service_key").alias("services"), F.bool_or(F.coalesce(F.col("step.via") == "resolved", F.lit(False))).alias("is_pinned"))
