"""Verdicts: exposed, not_exposed or unknown, with the limits that shaped them.

A limit is a struct with a ``kind`` and the fields that its kind uses.  No
empty result becomes ``not_exposed`` unless coverage is closed and nothing cut
the search short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of limits and the fields that identify them.
ABSENCE = ("empty_graph", "package_absent")
IDENTITY = {
    "empty_graph": (), "package_absent": ("subject",), "package_partial": ("subject",), "hop_limit": ("max_hops",), "path_limit": ("path_count",),
    "budget_rejected": ("operation",), "scan_capped": ("examined", "total"), "undecidable_versions": (), "service_history_partial": ("service",), "timestamp_missing": ("field",),
}
FIELDS = {"subject": "string", "max_hops": "int", "path_count": "long", "operation": "string", "examined": "long", "total": "long", "n": "long", "service": "string", "revisions": "long", "field": "string"}
LIMIT = "struct<kind:string," + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
LIMITS = f"array<{LIMIT}>"
ABSENT, PARTIAL, CLOSED = 0, 1, 2


def limit(kind: str, **values) -> Column:
    """A limit struct; values are columns or literals."""
    if kind not in IDENTITY:
        raise ValueError(f"no such limit: {kind}")
    unknown = set(values) - set(FIELDS)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(kind).alias("kind"), *[as_column(values.get(f)).cast(t).alias(f) for f, t in FIELDS.items()])


def limits(*pairs: tuple[Column, Column]) -> Column:
    """The limits of the (condition, limit) pairs whose condition holds."""
    if not pairs:
        return F.array().cast(LIMITS)
    return F.filter(F.array(*[F.when(c, x) for c, x in pairs]), lambda x: x.isNotNull()).cast(LIMITS)


def is_absence(x: Column) -> Column:
    return x["kind"].isin(*ABSENCE)


def is_truncating(x: Column) -> Column:
    return ~is_absence(x)


def describe_limit(x: Column) -> Column:
    text = lambda f: x[f].cast("string")
    cases = {
        "empty_graph": F.lit("the graph holds nothing"),
        "package_absent": F.concat(text("subject"), F.lit(" was never loaded")),
        "package_partial": F.concat(text("subject"), F.lit(" is loaded in part")),
        "hop_limit": F.concat(F.lit("the search ended after "), text("max_hops"), F.lit(" hops")),
        "path_limit": F.concat(F.lit("the search ended after "), text("path_count"), F.lit(" paths")),
        "budget_rejected": F.concat(F.lit("the budget did not allow "), text("operation")),
        "scan_capped": F.concat(text("examined"), F.lit(" of "), text("total"), F.lit(" candidates were looked at")),
        "undecidable_versions": F.concat(text("n"), F.lit(" versions fit no stated range")),
        "service_history_partial": F.concat(text("service"), F.lit(" has "), text("revisions"), F.lit(" known revisions")),
        "timestamp_missing": F.concat(text("field"), F.lit(" is unknown")),
    }
    return reduce(lambda out, k: F.when(x["kind"] == k, cases[k]).otherwise(out), cases, F.lit(None).cast("string"))


def limit_identity(x: Column) -> Column:
    """What makes two limits the same one; counts are no part of it."""
    return reduce(lambda out, k: F.when(x["kind"] == k, F.concat_ws("/", F.lit(k), *[x[f].cast("string") for f in IDENTITY[k]])).otherwise(out), IDENTITY, F.lit(None).cast("string"))


def fold_limits(xs: Column) -> Column:
    """One of each identity, in order; counts of undecidable versions add up."""
    total = F.aggregate(F.filter(xs, lambda x: x["kind"] == "undecidable_versions"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n"], F.lit(0)))
    summed = F.transform(xs, lambda x: F.when(x["kind"] == "undecidable_versions", x.withField("n", total)).otherwise(x))
    names = F.transform(summed, limit_identity)
    return F.filter(summed, lambda x, i: F.array_position(names, limit_identity(x)) == i + 1)


def describe_limits(xs: Column) -> Column:
    return F.concat_ws("; ", F.transform(xs, describe_limit))


def decide(found: Column, coverage: Column, graph_empty: Column, own_limits: Column, subject: Column) -> Column:
    """``struct<verdict, rationale, limits>``, by the first case that holds:
    empty graph, subject absent, evidence found, search cut short, data
    missing, and only then ``not_exposed``.
    """
    empty = graph_empty
    absent = ~empty & (F.coalesce(coverage, F.lit(ABSENT)) == ABSENT)
    partial = ~empty & (coverage == PARTIAL) & ~F.exists(own_limits, lambda x: x["kind"] == "package_partial")
    one = lambda x: F.array(x).cast(LIMITS)
    all_limits = (
        F.when(empty, F.concat(one(limit("empty_graph")), own_limits))
        .when(absent, F.concat(one(limit("package_absent", subject=subject)), own_limits))
        .when(partial, F.concat(own_limits, one(limit("package_partial", subject=subject))))
        .otherwise(own_limits)
    )
    cut_short, missing = F.exists(all_limits, is_truncating), F.exists(all_limits, is_absence)
    verdict = F.when(empty | absent, "unknown").when(found, "exposed").when(cut_short | missing, "unknown").otherwise("not_exposed")
    rationale = (
        F.when(empty, F.lit("Nothing is loaded, so the question can't be answered."))
        .when(absent, F.concat(subject, F.lit(" was never loaded, so nothing is known about it.")))
        .when(found & cut_short, F.lit("A path exists; the search was cut short, so there may be more."))
        .when(found, F.lit("A path exists, and the search was complete."))
        .when(cut_short, F.concat(F.lit("No path was seen, but the search was cut short: "), describe_limits(F.filter(all_limits, is_truncating)), F.lit(".")))
        .when(missing, F.concat(F.lit("No path was seen, but data is missing: "), describe_limits(F.filter(all_limits, is_absence)), F.lit(".")))
        .otherwise(F.concat(F.lit("No path exists; all that "), subject, F.lit(" needs is loaded and the search was complete.")))
    )
    return F.struct(verdict.alias("verdict"), rationale.alias("rationale"), all_limits.alias("limits"))


def worst_verdict(n_exposed: Column, n_unknown: Column) -> Column:
    """Of many answers: exposure first, then ignorance."""
    return F.when(n_exposed > 0, "exposed").when(n_unknown > 0, "unknown").otherwise("not_exposed")
