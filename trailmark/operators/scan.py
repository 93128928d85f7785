"""A lockfile against the advisories: a verdict per dependency and per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, verdict
from .graph import Graph, claimed_levels, is_empty
from .history import dealt


def advisory_index(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Advisories by version key and by package key, as sorted key arrays."""
    a = graph.node("advisories").select(F.col("id").alias("src"), F.col("key").alias("advisory"))
    one = lambda rel, label: graph.edge(rel).join(a, "src").join(graph.node(label).select(F.col("id").alias("dst"), "key"), "dst").groupBy("key").agg(F.array_sort(F.collect_set("advisory")).alias("advisories"))
    return one("affects_version", "versions"), one("affects", "packages")


def scan_dependencies(graph: Graph, dependencies: DataFrame) -> DataFrame:
    """``dependencies`` with ``advisories``, ``match`` and a verdict.

    ``match`` is ``exact`` if an advisory names this version, ``package`` if
    one names the package only (not looked at after an exact one), or
    ``none``.  A package match doesn't decide: the version may be outside it.
    """
    by_version, by_package = advisory_index(graph)
    rows = dependencies.withColumn("package_key", keys.package_key(F.col("ecosystem"), F.col("name")))
    rows = rows.withColumn("version_key", F.when(F.col("version").isNotNull(), keys.version_key(F.col("ecosystem"), F.col("name"), F.col("version"))))
    rows = rows.join(by_version.select(F.col("key").alias("version_key"), F.col("advisories").alias("exact")), "version_key", "left")
    rows = rows.join(by_package.select(F.col("key").alias("package_key"), F.col("advisories").alias("loose")), "package_key", "left")
    # claims are joined to the rows themselves, since asking for the distinct keys first would derive all rows once more
    claims = claimed_levels(graph, "package").withColumnRenamed("key", "package_key")
    rows = rows.where("package_key IS NOT NULL").join(claims, "package_key", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    match = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "package").otherwise("none")
    rows = rows.withColumn("match", match).withColumn("advisories", F.coalesce("exact", "loose", F.array().cast("array<string>"))).drop("exact", "loose")
    undecided = (F.col("match") == "package") | F.col("version").isNull()
    own = verdict.limits((undecided, verdict.limit("undecidable_versions", n=1)))
    rows = rows.withColumn("a", verdict.decide(F.col("match") == "exact", F.col("level"), F.lit(is_empty(graph)), own, F.coalesce("version_key", "package_key")))
    return rows.select("*", "a.verdict", "a.rationale", "a.limits").drop("a", "level")


def report_limits() -> Column:
    """Limits of a file that was read in part, of a parse report's columns."""
    lost = F.col("unparsable") + F.col("unpinned")
    return verdict.limits(
        (F.col("truncated"), verdict.limit("scan_capped", examined=F.lit(20_000), total=F.col("dependencies"))),
        (lost > 0, verdict.limit("undecidable_versions", n=lost)),
    )


def file_verdicts(scanned: DataFrame, report: DataFrame) -> DataFrame:
    """One row per file: the worst of its dependencies, exposure first; what
    was lost in parsing keeps it from being ``not_exposed``.
    """
    return folded_verdicts(report.join(verdict_counts(scanned), "path", "left"))


def verdict_counts(scanned: DataFrame) -> DataFrame:
    """Per file, its rows by verdict and their limits."""
    return scanned.groupBy("path").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("exposed", "unknown", "not_exposed")], F.flatten(F.collect_set("limits")).alias("row_limits"), F.count("*").alias("rows"))


def folded_verdicts(files: DataFrame) -> DataFrame:
    """``file_verdicts`` of reports that have ``verdict_counts`` beside them."""
    rows = files.na.fill(0, ["exposed", "unknown", "not_exposed"])
    own = report_limits()
    nothing = F.col("exposed") + F.col("unknown") + F.col("not_exposed") == 0
    worst = verdict.worst_verdict(F.col("exposed"), F.when(F.col("error").isNotNull() | nothing | (F.size(own) > 0), F.greatest(F.col("unknown"), F.lit(1))).otherwise(F.col("unknown")))
    folded = verdict.fold_limits(F.concat(own, F.coalesce("row_limits", F.array().cast(verdict.LIMITS))))
    return rows.select("path", "format", "error", "exposed", "unknown", "not_exposed", worst.alias("verdict"), folded.alias("limits"))


def row_order() -> list[Column]:
    rank = F.when(F.col("verdict") == "exposed", 0).when(F.col("verdict") == "unknown", 1).otherwise(2)
    return [rank, F.col("depth").asc_nulls_last(), F.col("is_dev_only"), F.col("package_key"), F.col("version").asc_nulls_last()]


def top_rows(scanned: DataFrame, per_bucket: int = 200, tasks: int | None = None) -> DataFrame:
    """The first rows of each verdict of each file, with ``rank``; ``tasks``
    are the partitions that rows are dealt to.
    """
    rank = F.row_number().over(Window.partitionBy("path", "verdict").orderBy(*row_order()))
    return dealt(scanned, tasks, "path", "verdict").withColumn("rank", rank).where(F.col("rank") <= per_bucket)


def advisory_summary(scanned: DataFrame, most: int = 3) -> DataFrame:
    """The first advisories of each row, and how many more there are."""
    return scanned.withColumn("shown", F.slice("advisories", 1, most)).withColumn("more", F.greatest(F.size("advisories") - most, F.lit(0)))


def limit_sentences(files: DataFrame) -> DataFrame:
    return files.withColumn("sentences", F.transform("limits", verdict.describe_limit))


def headline(files: DataFrame) -> DataFrame:
    """The sentence that sums a file up."""
    text = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("The file could not be read: "), F.col("error")))
        .when(F.col("exposed") > 0, F.concat(F.col("exposed").cast("string"), F.lit(" dependencies are affected")))
        .when(F.col("verdict") == "unknown", F.concat(F.col("unknown").cast("string"), F.lit(" dependencies can't be decided")))
        .otherwise(F.lit("No dependency is affected"))
    )
    return files.withColumn("headline", text)
