"""Affected versions by a sweep over interval ends.

Versions and the ends of stated intervals go into one list, range-sorted by
(package, version precedence).  A running number of versions turns each
interval into a stretch of positions, and running sums of opened and closed
stretches say how many advisories affect each version.  No version is compared
with an interval, and a package that has most of the rows is spread over many
ranges like any other stretch of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semver
from ..storage import stored

PACKAGE = ("ecosystem", "name")


def running_sums(rows: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """``rows`` with running sums of ``values`` in the order of the columns
    ``order``: sums within ranges plus the totals of the ranges before, of
    which there is a row each.  Rows equal in ``order`` may be split, so it
    should end in something that tells rows apart.
    """
    summed = rows.select("*", *[v.cast("long").alias(f"_v_{k}") for k, v in values.items()])
    ranged, _ = stored(summed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(totals), "_range")
    return joined.select(*rows.columns, *[(F.sum(f"_v_{k}").over(within) + F.col(f"_b_{k}")).alias(k) for k in values])


def stretches(affected: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions with their place, and advisories as stretches of places.

    The first is ``(ecosystem, name, version, pos)`` of distinct versions, with
    places from 0 by package and precedence and a null one where the version
    can't be read.  The second is ``(ghsa_id, ecosystem, name, low, high,
    is_sure)``: places from ``low`` to before ``high``; where an end can't be
    read the stretch is unsure and reaches to the package's own end.
    """
    versions, _ = stored(versions.select(*PACKAGE, "version").distinct().withColumn("key", semver.semver_key(F.col("version"))), "versions")
    packages = versions.where("key IS NOT NULL").select(*PACKAGE).distinct()
    each = affected.join(packages, list(PACKAGE), "left_semi").select("ghsa_id", *PACKAGE, F.explode("intervals").alias("i"))
    each = each.select("ghsa_id", *PACKAGE, semver.bound_key(F.col("i.introduced")).alias("start"), F.coalesce("i.fixed", "i.last_affected").isNotNull().alias("ends"),
                       semver.semver_key(F.coalesce("i.fixed", "i.last_affected")).alias("end"), F.col("i.fixed").isNull().alias("takes_end"))
    each, _ = stored(each.withColumn("_id", F.monotonically_increasing_id()), "intervals")

    # what can't be read lies before all versions of the package or, as an end, behind them
    blank = F.lit(None)
    kind = versions.schema["key"].dataType
    far = lambda c, else_: F.when(c, F.lit(else_)).otherwise(F.lit(0))
    low = each.select(*PACKAGE, far(F.col("start").isNull(), -1).alias("far"), F.col("start").alias("key"), F.lit(0).alias("side"), F.col("_id").alias("tie"), F.lit(True).alias("is_low"), blank.cast("string").alias("version"))
    high = each.select(*PACKAGE, far(F.col("end").isNull(), 1).alias("far"), F.col("end").alias("key"), F.when(F.col("takes_end"), 2).otherwise(0).alias("side"), F.col("_id").alias("tie"), F.lit(False).alias("is_low"), blank.cast("string").alias("version"))
    points = versions.where("key IS NOT NULL").select(*PACKAGE, F.lit(0).alias("far"), "key", F.lit(1).alias("side"), F.lit(0).cast("long").alias("tie"), blank.cast("boolean").alias("is_low"), "version")
    rows = running_sums(points.unionByName(low).unionByName(high).withColumn("key", F.col("key").cast(kind)), [*PACKAGE, "far", "key", "side", "tie", "version"], n=F.col("is_low").isNull())
    rows, _ = stored(rows.select(*PACKAGE, "version", "tie", "is_low", "n"), "places")
    placed = rows.where("is_low IS NULL").select(*PACKAGE, "version", (F.col("n") - 1).alias("pos"))
    placed = placed.unionByName(versions.where("key IS NULL").select(*PACKAGE, "version", F.lit(None).cast("long").alias("pos")))
    ends = rows.where("is_low IS NOT NULL").groupBy(F.col("tie").alias("_id")).agg(F.max(F.when(F.col("is_low"), F.col("n"))).alias("low"), F.max(F.when(~F.col("is_low"), F.col("n"))).alias("high"))
    sure = F.col("start").isNotNull() & (F.col("end").isNotNull() | ~F.col("ends"))
    found = each.join(ends, "_id").where("low < high").select("ghsa_id", *PACKAGE, "low", "high", sure.alias("is_sure"))
    named = affected.select("ghsa_id", *PACKAGE, F.explode("listed").alias("version")).distinct().join(placed.where("pos IS NOT NULL"), [*PACKAGE, "version"])
    return placed, found.unionByName(named.select("ghsa_id", *PACKAGE, F.col("pos").alias("low"), (F.col("pos") + 1).alias("high"), F.lit(True).alias("is_sure")))


def merged(found: DataFrame) -> DataFrame:
    """Stretches of one advisory and package joined where they overlap or
    touch; ``(ghsa_id, ecosystem, name, low, high)``.
    """
    of = Window.partitionBy("ghsa_id", *PACKAGE)  # the intervals that one record states
    reach = F.max("high").over(of.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_new", F.coalesce(F.col("low") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(of.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("ghsa_id", *PACKAGE, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def _unplaced(affected: DataFrame, placed: DataFrame) -> DataFrame:
    """``(ecosystem, name, version, n_affected, n_undecided)`` of versions that
    can't be read: those that list them, and all others with an interval.
    """
    rows = placed.where("pos IS NULL").select(*PACKAGE, "version")
    stating = affected.where(F.size("intervals") > 0).groupBy(*PACKAGE).agg(F.count_distinct("ghsa_id").alias("n_stating"))
    lists = affected.select("ghsa_id", *PACKAGE, F.explode("listed").alias("version")).distinct()
    has = affected.groupBy("ghsa_id", *PACKAGE).agg(F.max((F.size("intervals") > 0).cast("int")).alias("states"))
    named = lists.join(has, ["ghsa_id", *PACKAGE]).groupBy(*PACKAGE, "version").agg(F.count("*").alias("n"), F.sum("states").alias("n_both"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.join(stating, list(PACKAGE), "left").join(named, [*PACKAGE, "version"], "left").select(*PACKAGE, "version", zero("n").alias("n_affected"), (zero("n_stating") - zero("n_both")).alias("n_undecided"))


def affected_counts(affected: DataFrame, versions: DataFrame) -> DataFrame:
    """``(ecosystem, name, version, n_affected, n_undecided)``: for every
    distinct version how many advisories affect it, and for how many that
    can't be decided, as ``semver.is_affected`` says of each.

    ``affected (ghsa_id, ecosystem, name, listed, intervals)`` may state a
    package in several rows of one advisory; then any of them will do.
    """
    affected, _ = stored(affected.select("ghsa_id", *PACKAGE, "listed", "intervals"), "stated")
    placed, found = stretches(affected, versions)
    found, _ = stored(found, "stretches")
    sure, all_ = merged(found.where("is_sure")), merged(found)
    turn = lambda df, which: df.select(F.explode(F.array(F.struct(F.col("low").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("high").alias("pos"), F.lit(-1).alias("d")))).alias("e")).groupBy("e.pos").agg(F.sum("e.d").alias(which))
    none = F.lit(None).cast("string")
    turns = turn(sure, "sure").join(turn(all_, "all_"), "pos", "full_outer").select("pos", F.lit(0).alias("side"), *[none.alias(c) for c in (*PACKAGE, "version")], F.coalesce("sure", F.lit(0)).alias("sure"), F.coalesce("all_", F.lit(0)).alias("all_"))
    points = placed.where("pos IS NOT NULL").select("pos", F.lit(1).alias("side"), *PACKAGE, "version", F.lit(0).alias("sure"), F.lit(0).alias("all_"))
    rows = running_sums(turns.unionByName(points), ["pos", "side"], n_affected=F.col("sure"), n_open=F.col("all_")).where("side = 1")
    return rows.select(*PACKAGE, "version", "n_affected", (F.col("n_open") - F.col("n_affected")).alias("n_undecided")).unionByName(_unplaced(affected, placed))


def affects_pairs(affected: DataFrame, versions: DataFrame) -> DataFrame:
    """``(ghsa_id, ecosystem, name, version)`` of the versions that advisories
    affect for sure; only these are made, by counting through each stretch.
    """
    affected, _ = stored(affected.select("ghsa_id", *PACKAGE, "listed", "intervals"), "stated")
    placed, found = stretches(affected, versions)
    placed, _ = stored(placed, "places")
    each = merged(found.where("is_sure")).select("ghsa_id", F.explode(F.sequence("low", F.col("high") - 1)).alias("pos"))
    pairs = each.join(placed.where("pos IS NOT NULL"), "pos").select("ghsa_id", *PACKAGE, "version")
    lists = affected.select("ghsa_id", *PACKAGE, F.explode("listed").alias("version")).distinct()
    return pairs.unionByName(lists.join(placed.where("pos IS NULL").drop("pos"), [*PACKAGE, "version"]).select("ghsa_id", *PACKAGE, "version"))
