"""Sortable version keys, affected intervals, and membership.

A version's key is a struct that Spark orders as version precedence does:
release after prerelease, numeric identifiers before alphanumeric ones, fewer
identifiers first.  What can't be read has a null key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = r"^[v=\s]*(\d{1,16})\.(\d{1,16})\.(\d{1,16})(?:-?([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?\s*$"


def semver_key(version: Column) -> Column:
    number = lambda i: F.regexp_extract(version, VERSION, i).try_cast("long")
    pre = F.regexp_extract(version, VERSION, 4)
    ids = F.transform(F.split(pre, r"\."), lambda x: F.struct((~x.rlike(r"^\d{1,16}$")).alias("is_word"), F.coalesce(F.when(x.rlike(r"^\d{1,16}$"), x.try_cast("long")), F.lit(0)).alias("number"), F.when(x.rlike(r"^\d{1,16}$"), F.lit("")).otherwise(x).alias("word")))
    none = F.array().cast("array<struct<is_word:boolean,number:bigint,word:string>>")
    return F.when(version.rlike(VERSION), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("is_release"), F.when(pre == "", none).otherwise(ids).alias("pre")))


def bound_key(version: Column) -> Column:
    """Key of an interval's start; ``0`` is before every version."""
    return semver_key(F.when(F.trim(version) == "0", F.lit("0.0.0-0")).otherwise(version))


INTERVALS = "array<struct<introduced:string,fixed:string,last_affected:string>>"


def affected_intervals(events: Column) -> Column:
    """Intervals of a range's events ``array<struct<kind, version>>`` in order.

    ``introduced`` opens one, ``fixed`` ends it before and ``last_affected``
    ends it with that version; one that is never ended stays open.  An end
    without a start counts from the beginning.
    """
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(INTERVALS).alias("done"))

    def one(introduced: Column, fixed: Column, last: Column) -> Column:
        return F.array(F.struct(introduced.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected")))

    none = F.lit(None).cast("string")

    def step(acc: Column, e: Column) -> Column:
        opened = F.coalesce(acc["open"], F.lit("0"))
        return (
            F.when(e["kind"] == "introduced", F.struct(e["version"].alias("open"), F.when(acc["open"].isNotNull(), F.concat(acc["done"], one(acc["open"], none, none))).otherwise(acc["done"]).alias("done")))
            .when(e["kind"] == "fixed", F.struct(none.alias("open"), F.concat(acc["done"], one(opened, e["version"], none)).alias("done")))
            .when(e["kind"] == "last_affected", F.struct(none.alias("open"), F.concat(acc["done"], one(opened, none, e["version"])).alias("done")))
            .otherwise(acc)
        )

    return F.aggregate(events, start, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], one(acc["open"], none, none))).otherwise(acc["done"]))


def in_interval(key: Column, introduced: Column, fixed: Column, last_affected: Column) -> Column:
    """Three-valued: null if the version or a stated bound can't be read."""
    low = key >= bound_key(introduced)
    high = F.when(fixed.isNotNull(), key < semver_key(fixed)).when(last_affected.isNotNull(), key <= semver_key(last_affected)).otherwise(F.lit(True))
    return F.when(key.isNull(), F.lit(None).cast("boolean")).otherwise(low & high)


def is_affected(version: Column, listed: Column, intervals: Column) -> Column:
    """Whether an advisory affects a version: it is listed, or lies in an
    interval; null if that can't be decided.
    """
    key = semver_key(version)
    each = F.transform(intervals, lambda i: in_interval(key, i["introduced"], i["fixed"], i["last_affected"]))
    within = F.when(F.exists(each, lambda x: F.coalesce(x, F.lit(False))), F.lit(True)).when(F.exists(each, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return F.when(F.coalesce(F.array_contains(listed, version), F.lit(False)), F.lit(True)).otherwise(F.coalesce(within, F.when(F.size(intervals) == 0, F.lit(False))))


def affected_bucket(affected: Column) -> Column:
    return F.when(affected.isNull(), "undecided").when(affected, "affected").otherwise("unaffected")


def range_admits(wanted: Column, version: Column) -> Column:
    """Whether a dependency range could resolve to a version: exact, ``*``,
    ``^``, ``~``, comparisons joined by spaces, and alternatives by ``||``.
    Null for anything else.
    """

    def padded(v: Column) -> Column:
        bare = F.regexp_replace(v, r"(\.[xX*])+$", "")
        return F.when(bare.rlike(r"^\d+$"), F.concat(bare, F.lit(".0.0"))).when(bare.rlike(r"^\d+\.\d+$"), F.concat(bare, F.lit(".0"))).otherwise(bare)

    def let(value: Column, f: Callable[[Column], Column]) -> Column:
        """``f`` of a value that is computed once, however often it is used."""
        return F.get(F.transform(F.array(value), f), 0)

    def clause(key: Column, c: Column) -> Column:
        op = F.regexp_extract(c, r"^(\^|~|>=|<=|>|<|=)?", 1)
        raw = F.regexp_replace(c, r"^(\^|~|>=|<=|>|<|=)\s*v?", "")
        return let(semver_key(padded(raw)), lambda low: compared(key, c, op, raw, low))

    def compared(key: Column, c: Column, op: Column, raw: Column, low: Column) -> Column:
        partial = raw.rlike(r"^\d+(\.\d+)?(\.[xX*])*$") & ~raw.rlike(r"^\d+\.\d+\.\d+$")
        same_major = key["major"] == low["major"]
        same_minor = same_major & (key["minor"] == low["minor"])
        caret = F.when(low["major"] > 0, same_major).when(low["minor"] > 0, same_minor).otherwise(same_minor & (key["patch"] == low["patch"]))
        tail = F.when(raw.rlike(r"^\d+(\.[xX*])*$"), same_major).otherwise(same_minor)
        return (
            F.when(c.isin("*", "", "x", "X", "latest"), key["is_release"])
            .when(low.isNull(), F.lit(None).cast("boolean"))
            .when(op == "^", (key >= low) & caret).when(op == "~", (key >= low) & tail)
            .when(op == ">=", key >= low).when(op == "<=", key <= low).when(op == ">", key > low).when(op == "<", key < low)
            .when(partial, (key >= low) & tail).otherwise(key == low)
        )

    tight = F.regexp_replace(F.trim(wanted), r"(\^|~|>=|<=|>|<|=)\s+", "$1")


    def decided(key: Column) -> Column:
        choices = F.transform(F.split(tight, r"\s*\|\|\s*"), lambda c: F.forall(F.split(c, r"\s+"), lambda x: clause(key, x)))
        return F.when(key.isNull(), F.lit(None).cast("boolean")).otherwise(F.exists(choices, lambda x: x))

    return let(semver_key(version), decided)
