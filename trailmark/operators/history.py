"""Lockfile history: when each service was first and last seen on a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import verdict

#: Rows that one task of a fold holds.  Ids that lie close together shrink to a
#: few bytes in a shuffle, so partitions of a size in bytes hold many millions.
ROWS_A_TASK = 500_000


def tasks_for(table: DataFrame) -> int:
    """Partitions for the rows of a table, which Parquet counts in its footers."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // ROWS_A_TASK))


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    return rows.repartition(tasks, *by) if tasks else rows


def fold_history(pins: DataFrame, tasks: int | None = None) -> DataFrame:
    """``pins (service, version, revision, at_ms)`` as one row per (service,
    version): first and last seen, and in how many revisions.  ``tasks`` are
    the partitions that pins are dealt to, each pair to one.
    """
    pins = dealt(pins, tasks, "service", "version")
    return pins.groupBy("service", "version").agg(F.min("at_ms").alias("first_seen_ms"), F.max("at_ms").alias("last_seen_ms"), F.count_distinct("revision").alias("revisions"))


def new_revisions(found: DataFrame, known: DataFrame, tasks: int | None = None) -> DataFrame:
    """Revisions that an earlier run has not taken in."""
    known = dealt(known.select("service", "revision"), tasks, "service", "revision").distinct()
    return dealt(found, tasks, "service", "revision").join(known, ["service", "revision"], "left_anti")


def extend_history(old: DataFrame, fresh: DataFrame, tasks: int | None = None) -> DataFrame:
    """Fold new revisions into an earlier history."""
    both = dealt(old.unionByName(fold_history(fresh, tasks)), tasks, "service", "version")
    return both.groupBy("service", "version").agg(F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_seen_ms").alias("last_seen_ms"), F.sum("revisions").alias("revisions"))


def history_coverage(services: DataFrame) -> DataFrame:
    """``services (service, revisions, skipped, unreadable, is_shallow, reaches_window)``
    with ``reasons`` why a history is partial, and the limit that says so.
    """
    reasons = F.filter(
        F.array(
            F.when(F.col("revisions") == 0, "no revision was read"), F.when(F.col("skipped") > 0, "revisions were skipped"), F.when(F.col("unreadable") > 0, "revisions could not be read"),
            F.when(F.col("is_shallow"), "the clone is shallow"), F.when(~F.col("reaches_window"), "the history starts too late"),
        ),
        lambda r: r.isNotNull(),
    )
    rows = services.withColumn("reasons", reasons)
    partial = F.size("reasons") > 0
    return rows.withColumn("is_partial", partial).withColumn("limits", verdict.limits((partial, verdict.limit("service_history_partial", service=F.col("service"), revisions=F.col("revisions")))))
