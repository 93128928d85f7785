"""Look-alike package names: a similarity join made of equi-joins.

Each detector yields (suspect, target) pairs by a join on a derived form, so
no pair is looked at unless some form agrees.  For the edit distance, targets
are cut into segments: a name within d edits leaves one of 2d + 1 segments
untouched (an edit touches two at most), shifted by d places at most.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import verdict

# Bounds, filler tokens, confusable characters, ranks.
MAX_NAME = 214
MAX_DISTANCE = 4
MIN_VARIANT = 2
SEGMENT_FILLERS = frozenset("js cjs esm es ts node nodejs npm py python python2 python3 lib libs core cli io dev git pkg package sdk api 2 3 4 x".split())
GLUED_FILLERS = "s 2 3 js ts io lib cli node py".split()
CONVENTIONAL_SCOPES = ("types",)
PAIRED = {"rn": "m", "vv": "w"}
SINGLE = {"1": "l", "i": "l", "0": "o", "5": "s"}
SIGNALS = ("homoglyph", "separator_or_case", "scope_confusion", "edit_distance", "padding", "popularity_gap")
CONFIDENCE = ("high", "medium", "low")


@dataclass(frozen=True)
class Options:
    max_distance: int = 2
    min_ratio: float = 50.0
    max_findings: int = 10
    max_compared: int = 10_000

    def __post_init__(self) -> None:
        if not 0 <= self.max_distance <= MAX_DISTANCE:
            raise ValueError(f"max_distance must be from 0 to {MAX_DISTANCE}")
        if self.min_ratio < 1 or self.max_findings < 1 or self.max_compared < 1:
            raise ValueError("min_ratio, max_findings and max_compared must be 1 or more")


def identity(ecosystem: Column, name: Column) -> Column:
    """The name as the registry tells names apart."""
    return F.when(ecosystem == "pypi", F.lower(F.regexp_replace(name, r"[-_.]+", "-"))).otherwise(name)


def flattened(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")


def without_separators(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9]", "")


def scope(ecosystem: Column, name: Column) -> Column:
    """The scope of an npm name without its ``@``, or null."""
    return F.when((ecosystem == "npm") & name.rlike(r"^@[^/]+/.+$"), F.regexp_extract(name, r"^@([^/]+)/", 1))


def unscoped(ecosystem: Column, name: Column) -> Column:
    return F.when(scope(ecosystem, name).isNotNull(), F.regexp_extract(name, r"^@[^/]+/(.+)$", 1)).otherwise(name)


def confusable(name: Column) -> Column:
    """Canonical form: pairs first, then single characters; no rule's output
    feeds another.
    """
    folded = reduce(lambda c, k: F.replace(c, F.lit(k), F.lit(PAIRED[k])), PAIRED, F.lower(name))
    return F.translate(folded, "".join(SINGLE), "".join(SINGLE.values()))


def substitutions(name: Column) -> Column:
    """``array<struct<written, canonical, n>>`` of the rules that fire."""
    low = F.lower(name)
    left = reduce(lambda c, k: F.replace(c, F.lit(k), F.lit("")), PAIRED, low)
    pairs = [F.struct(F.lit(k).alias("written"), F.lit(v).alias("canonical"), ((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("int").alias("n")) for k, v in PAIRED.items()]
    ones = [F.struct(F.lit(k).alias("written"), F.lit(v).alias("canonical"), (F.length(left) - F.length(F.replace(left, F.lit(k), F.lit("")))).alias("n")) for k, v in SINGLE.items()]
    return F.filter(F.array(*pairs, *ones), lambda s: s["n"] > 0)


def osa(a: str, b: str, most: int) -> int | None:
    """Edits, adjacent swaps counted as one; null beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most and (not before or min(row) > most):
            return None
        before, row = row, new
    return row[-1] if row[-1] <= most else None


def osa_within(most: int):
    """The distance as an Arrow UDF over two columns."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y, most) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return distance


def padding_of(name: str) -> list[tuple[str, str, bool, str]]:
    """(position, token, whether it is a filler, what is left) for each way to
    take one token off an unscoped name; the first way to a rest counts.
    """
    parts = [m.span() for m in re.finditer(r"[^-_.]+", name)]
    out: dict[str, tuple[str, str, bool, str]] = {}

    def take(rest: str, position: str, token: str, filler: bool) -> None:
        if len(rest) >= MIN_VARIANT and rest != name:
            out.setdefault(rest.lower(), (position, token, filler, rest))

    where = lambda i: "prefix" if i == 0 else "suffix" if i == len(parts) - 1 else "infix"
    if len(parts) > 1:
        for i, (a, b) in enumerate(parts):
            rest = name[: a - 1] + name[b:] if i else name[:a] + name[b + 1 :]
            take(rest, where(i), name[a:b], name[a:b].lower() in SEGMENT_FILLERS)
    for i, (a, b) in enumerate(parts):
        low = name[a:b].lower()
        for token in (t for t in GLUED_FILLERS if len(t) < len(low)):
            if low.endswith(token):
                take(name[: b - len(token)] + name[b:], "suffix" if i == len(parts) - 1 else "infix", token, True)
            if i == 0 and low.startswith(token):
                take(name[:a] + name[a + len(token) :], "prefix", token, True)
    return list(out.values())


def padding_variants(name: Column) -> Column:
    """``padding_of`` as an array of structs."""

    @F.pandas_udf("array<struct<position:string,token:string,is_filler:boolean,rest:string>>")
    def variants(names: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("position", "token", "is_filler", "rest"), v, strict=True)) for v in padding_of(n)] for n in names], dtype=object)

    return variants(name)


def profiles(packages: DataFrame) -> DataFrame:
    """``packages (ecosystem, name, weekly_downloads)`` with their derived
    forms; empty and overlong names are left out.
    """
    name = F.trim("name")
    rows = packages.where((F.length(name) > 0) & (F.length(name) <= MAX_NAME)).select("ecosystem", name.alias("provided"), "weekly_downloads")
    rows = rows.withColumn("identity", identity(F.col("ecosystem"), F.col("provided")))
    eco, ident = F.col("ecosystem"), F.col("identity")
    return rows.select("*", F.lower(ident).alias("lowered"), flattened(ident).alias("flat"), without_separators(ident).alias("bare"), confusable(ident).alias("canonical"), substitutions(ident).alias("subs"), scope(eco, ident).alias("scope"), unscoped(eco, ident).alias("unscoped"))


def _sides(suspects: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = suspects.select(*[F.col(c).alias(f"s_{c}") for c in suspects.columns])
    return s, targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns])


DETAIL = {"distance": "int", "plain": "int", "position": "string", "token": "string", "is_filler": "boolean", "variety": "string", "form": "string", "case_differs": "boolean", "separators_differ": "boolean", "ratio": "double"}
PAIR = ["ecosystem", "suspect", "target"]


def _signal(pairs: DataFrame, kind: str, **detail: Column) -> DataFrame:
    fields = [(detail[f] if f in detail else F.lit(None)).cast(t).alias(f) for f, t in DETAIL.items()]
    signal = F.struct(F.lit(SIGNALS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), *fields)
    return pairs.select(F.col("s_ecosystem").alias("ecosystem"), F.col("s_identity").alias("suspect"), F.col("t_identity").alias("target"), signal.alias("signal"))


def homoglyphs(s: DataFrame, t: DataFrame) -> DataFrame:
    same = (F.col("s_ecosystem") == F.col("t_ecosystem")) & (F.col("s_canonical") == F.col("t_canonical"))
    return _signal(s.join(t, same).where((F.col("s_lowered") != F.col("t_lowered")) & ((F.size("s_subs") > 0) | (F.size("t_subs") > 0))), "homoglyph", form=F.col("s_canonical"))


def separators_or_case(s: DataFrame, t: DataFrame) -> DataFrame:
    same = (F.col("s_ecosystem") == F.col("t_ecosystem")) & (F.col("s_flat") == F.col("t_flat")) & F.col("s_scope").eqNullSafe(F.col("t_scope"))
    pairs = s.where("s_flat <> ''").join(t, same).where("s_identity <> t_identity")
    return _signal(pairs, "separator_or_case", form=F.col("s_flat"), case_differs=F.col("s_bare") != F.col("t_bare"), separators_differ=F.col("s_lowered") != F.col("t_lowered"))


def scope_confusions(s: DataFrame, t: DataFrame) -> DataFrame:
    """Scope added, dropped, swapped or folded into the name; npm only, and a
    conventional scope may be added.
    """
    s, t = s.where("s_ecosystem = 'npm'"), t.where("t_ecosystem = 'npm'")
    s_in, s_out = s.where("s_scope IS NOT NULL"), s.where("s_scope IS NULL")
    t_in, t_out = t.where("t_scope IS NOT NULL"), t.where("t_scope IS NULL")
    conventional = F.lower("s_scope").isin(*CONVENTIONAL_SCOPES)
    cases = [
        ("scope_swapped", s_in.join(t_in, F.col("s_unscoped") == F.col("t_unscoped")).where("s_scope <> t_scope"), "t_unscoped"),
        ("scope_added", s_in.where(~conventional).join(t_out, F.col("s_unscoped") == F.col("t_identity")), "t_identity"),
        ("scope_dropped", s_out.join(t_in, F.col("s_identity") == F.col("t_unscoped")), "t_unscoped"),
        ("scope_flattened", s_out.join(t_in, F.col("s_flat") == F.col("t_flat")).where("s_identity <> t_unscoped"), "t_flat"),
    ]
    return reduce(DataFrame.unionByName, [_signal(p, "scope_confusion", variety=F.lit(v), form=F.col(f)) for v, p, f in cases])


def paddings(s: DataFrame, t: DataFrame) -> DataFrame:
    rows = s.withColumn("v", F.explode(padding_variants(F.col("s_unscoped"))))
    rest = F.lower(F.concat(F.coalesce(F.concat(F.lit("@"), F.col("s_scope"), F.lit("/")), F.lit("")), F.col("v.rest")))
    rows = rows.withColumn("v_rest", rest)
    pairs = rows.join(t, (F.col("s_ecosystem") == F.col("t_ecosystem")) & (F.col("v_rest") == F.col("t_lowered"))).where("s_identity <> t_identity")
    return _signal(pairs, "padding", position=F.col("v.position"), token=F.col("v.token"), is_filler=F.col("v.is_filler"), form=F.col("v_rest"))


def near_names(s: DataFrame, t: DataFrame, most: int) -> DataFrame:
    """Pairs within ``most`` edits, by segments; the threshold form of the
    built-in distance prunes before the exact one.
    """
    if not most:
        return _signal(s.join(t, F.lit(False)), "edit_distance")
    n = 2 * most + 1
    size = lambda length: length / F.lit(n)
    start = lambda k, length: F.floor(size(length) * k).cast("int")
    ks = F.sequence(F.lit(0), F.lit(n - 1))
    t_keys = t.withColumn("k", F.explode(ks)).withColumn("t_len", F.length("t_identity"))
    t_keys = t_keys.withColumn("key", F.concat_ws("|", "t_len", "k", F.expr("substring(t_identity, cast(floor(t_len / {n} * k) as int) + 1, cast(floor(t_len / {n} * (k + 1)) as int) - cast(floor(t_len / {n} * k) as int))".replace("{n}", f"{n}D"))))
    s_keys = s.withColumn("k", F.explode(ks)).withColumn("len", F.explode(F.sequence(F.greatest(F.length("s_identity") - most, F.lit(1)), F.length("s_identity") + most)))
    a, b = start(F.col("k"), F.col("len")), start(F.col("k") + 1, F.col("len"))
    s_keys = s_keys.withColumn("a", a).withColumn("w", b - a).withColumn("at", F.explode(F.filter(F.sequence(F.col("a") - most, F.col("a") + most), lambda x: (x >= 0) & (x + F.col("w") <= F.length("s_identity")))))
    s_keys = s_keys.withColumn("key", F.concat_ws("|", "len", "k", F.expr("substring(s_identity, at + 1, w)"))).drop("a", "w", "at", "len", "k").distinct()
    pairs = s_keys.join(t_keys, (F.col("s_ecosystem") == F.col("t_ecosystem")) & (s_keys["key"] == t_keys["key"])).where("s_identity <> t_identity")
    pairs = pairs.select("s_ecosystem", "s_identity", "t_identity").distinct()
    pairs = pairs.withColumn("plain", F.levenshtein("s_identity", "t_identity", 2 * most)).where("plain >= 0")
    pairs = pairs.withColumn("distance", osa_within(most)("s_identity", "t_identity")).where("distance IS NOT NULL")
    return _signal(pairs, "edit_distance", distance=F.col("distance"), plain=F.col("plain"))


def popularity(suspect: Column, target: Column, min_ratio: float) -> tuple[Column, Column]:
    """(a sibling that is no imitation, ratio of a confirmed gap or null)."""
    known = (suspect >= 0) & (target >= 0)
    ratio = target / F.greatest(suspect, F.lit(1))
    return F.coalesce(known & (ratio < min_ratio), F.lit(False)), F.when(known & (ratio >= min_ratio), ratio)


def confidence(signals: Column) -> Column:
    strong = F.exists(signals, lambda s: s["kind"].isin("homoglyph", "separator_or_case", "scope_confusion") | ((s["kind"] == "edit_distance") & (s["distance"] <= 1)))
    gap = F.exists(signals, lambda s: s["kind"] == "popularity_gap")
    return F.when(strong & gap, "high").when(strong | gap, "medium").otherwise("low")


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def findings(candidates: DataFrame, popular: DataFrame, options: Options | None = None) -> DataFrame:
    """All pairs with their signals, confidence, distance (-1: not measured)
    and rank among the suspect's; at most ``max_findings`` of each suspect.
    """
    options = options or Options()
    popular = compared(popular, options.max_compared)
    sp, tp = profiles(candidates).dropDuplicates(["ecosystem", "identity"]), profiles(popular).dropDuplicates(["ecosystem", "identity"])
    s, t = _sides(sp, tp)
    parts = [homoglyphs(s, t), separators_or_case(s, t), scope_confusions(s, t), paddings(s, t), near_names(s, t, options.max_distance)]
    pairs = reduce(DataFrame.unionByName, parts).groupBy(*PAIR).agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    down = lambda df, side: df.select("ecosystem", F.col("identity").alias(side), F.coalesce("weekly_downloads", F.lit(-1)).alias(f"{side}_downloads"))
    pairs = pairs.join(down(sp, "suspect"), ["ecosystem", "suspect"]).join(down(tp, "target"), ["ecosystem", "target"])
    sibling, ratio = popularity(F.col("suspect_downloads"), F.col("target_downloads"), options.min_ratio)
    pairs = pairs.where(~sibling).withColumn("ratio", ratio)
    blank = [F.lit(None).cast(t).alias(f) for f, t in DETAIL.items() if f != "ratio"]
    gap = F.array(F.struct(F.lit(5).alias("rank"), F.lit("popularity_gap").alias("kind"), *blank, F.col("ratio").alias("ratio")))
    pairs = pairs.withColumn("signals", F.when(F.col("ratio").isNotNull(), F.concat("signals", gap)).otherwise(F.col("signals")))
    edits = F.filter("signals", lambda x: x["kind"] == "edit_distance")
    pairs = pairs.withColumn("confidence", confidence(F.col("signals"))).withColumn("edit_distance", F.coalesce(F.try_element_at(edits, F.lit(1))["distance"], F.lit(-1)))
    return ranked(pairs, options.max_findings)


def finding_order() -> list[Column]:
    far = F.when(F.col("edit_distance") < 0, MAX_DISTANCE + 1).otherwise(F.col("edit_distance"))
    return [confidence_rank(F.col("confidence")), far, F.col("target_downloads").desc(), F.col("target")]


def ranked(pairs: DataFrame, most: int) -> DataFrame:
    """The best ``most`` findings of each suspect, with ``rank`` and how many
    there are (``matched``).
    """
    by = Window.partitionBy("ecosystem", "suspect")
    return pairs.withColumn("matched", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy(*finding_order()))).where(F.col("rank") <= most)


def compared(popular: DataFrame, most: int) -> DataFrame:
    """The names to compare with: of an ecosystem with more than ``most`` the
    most popular ones, unknown popularity last, then by name.
    """
    rank = F.row_number().over(Window.partitionBy("ecosystem").orderBy(F.col("weekly_downloads").desc_nulls_last(), "name"))
    return popular.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def scan_limits(popular: DataFrame, options: Options) -> DataFrame:
    """``(ecosystem, limits)``: what the cap on names leaves out."""
    n = popular.groupBy("ecosystem").agg(F.count("*").alias("n"))
    own = verdict.limits((F.col("n") > options.max_compared, verdict.limit("scan_capped", examined=options.max_compared, total=F.col("n"))))
    return n.select("ecosystem", own.alias("limits"))


def scan_counts(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """Per ecosystem: names to compare with, and names of other ecosystems,
    which are never compared.
    """
    n = popular.groupBy("ecosystem").agg(F.count("*").alias("compared"))
    total = popular.agg(F.count("*").alias("total"))  # one row
    own = candidates.select("ecosystem").distinct().join(n, "ecosystem", "left").crossJoin(total)
    return own.select("ecosystem", F.coalesce("compared", F.lit(0)).alias("compared"), (F.col("total") - F.coalesce("compared", F.lit(0))).alias("other_ecosystem"))


def edge_facts(found: DataFrame) -> DataFrame:
    """``(ecosystem, suspect, target, edit_distance)`` for graph edges."""
    return found.select(*PAIR, "edit_distance")


def fold_mirrored(found: DataFrame) -> DataFrame:
    """One row per unordered pair: the better of its two directions, and
    whether both were found.
    """
    best = F.struct(*[c.alias(f"o{i}") if i != 2 else (-F.col("target_downloads")).alias("o2") for i, c in enumerate(finding_order())], F.col("suspect"))
    return found.groupBy("ecosystem", F.least("suspect", "target").alias("a"), F.greatest("suspect", "target").alias("b")).agg(
        F.min_by(F.struct("suspect", "target", "confidence", "edit_distance"), best).alias("x"), (F.count("*") > 1).alias("is_mirrored")
    ).select("ecosystem", "a", "b", "x.suspect", "x.target", "x.confidence", "x.edit_distance", "is_mirrored")


def at_floor(pairs: DataFrame, floor: str) -> DataFrame:
    return pairs.where(confidence_rank(F.col("confidence")) <= CONFIDENCE.index(floor))


def count_by_confidence(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("confidence").agg(F.count("*").alias("pairs"), F.count_if(F.col("is_mirrored")).alias("mirrored"))


def split_by_pin(pairs: DataFrame, pinned: DataFrame) -> DataFrame:
    """``pairs`` with ``is_pinned``: a lockfile pins either name."""
    names = pinned.select("ecosystem", F.col("name").alias("n")).distinct().withColumn("hit", F.lit(True))
    one = lambda side: names.select("ecosystem", F.col("n").alias(side), F.col("hit").alias(f"hit_{side}"))
    both = pairs.join(one("a"), ["ecosystem", "a"], "left").join(one("b"), ["ecosystem", "b"], "left")
    return both.withColumn("is_pinned", F.coalesce("hit_a", "hit_b", F.lit(False))).drop("hit_a", "hit_b")


def reach_of_names(depends_on: DataFrame, version_of: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per package id: versions that declare it, and services that pin it."""
    declared = depends_on.groupBy(F.col("dst").alias("package")).agg(F.count_distinct("src").alias("dependents"))
    pins = version_of.select(F.col("src").alias("version"), F.col("dst").alias("package")).join(resolved.select(F.col("dst").alias("version"), "src"), "version")
    pinned = pins.groupBy("package").agg(F.count_distinct("src").alias("services"))
    return declared.join(pinned, "package", "full_outer").na.fill(0, ["dependents", "services"])


def corpus_scan(packages: DataFrame, per_candidate: int = 5, options: Options | None = None) -> DataFrame:
    """Every name against every other, best findings first."""
    options = options or Options(max_findings=per_candidate)
    return findings(packages, packages, options).orderBy(*finding_order(), "suspect")


def describe_signal(s: Column) -> Column:
    text = lambda f: s[f].cast("string")
    return (
        F.when(s["kind"] == "homoglyph", F.concat(F.lit("both read as "), s["form"], F.lit(" once look-alike characters are folded")))
        .when(s["kind"] == "separator_or_case", F.concat(F.lit("same letters, other "), F.concat_ws(" and ", F.when(s["case_differs"], "case"), F.when(s["separators_differ"], "separators"))))
        .when(s["kind"] == "scope_confusion", F.concat(F.replace(s["variety"], F.lit("_"), F.lit(" ")), F.lit(" on "), s["form"]))
        .when(s["kind"] == "edit_distance", F.concat(text("distance"), F.when(s["distance"] == 1, " edit away").otherwise(" edits away"), F.when(s["plain"] > s["distance"], ", letters swapped").otherwise("")))
        .when(s["kind"] == "padding", F.concat(F.lit("adds the "), s["position"], F.lit(" "), s["token"]))
        .otherwise(F.concat(F.lit("the other is "), F.format_number(s["ratio"], 0), F.lit(" times as popular")))
    )
