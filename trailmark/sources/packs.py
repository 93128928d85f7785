"""Incident packs: nested JSON documents, validated and taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys

PACK = """slug string, title string, ecosystem string, dataOrigin string, summary string, windowStartMs long, windowEndMs long,
compromisedVersions array<struct<ecosystem:string,name:string,version:string,publishedAtMs:bigint,hasInstallScript:boolean,note:string>>,
advisories array<struct<advisoryId:string,publishedAtMs:bigint,modifiedAtMs:bigint,summary:string,affects:array<struct<ecosystem:string,name:string,introduced:string,fixed:string>>>>,
services array<struct<key:string,name:string,description:string,resolved:array<struct<ecosystem:string,name:string,version:string,resolvedAtMs:bigint>>>>,
timeline array<struct<atMs:bigint,kind:string,label:string,sourceUrl:string>>, sources array<string>"""


def read_packs(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """One row per JSON document under ``path``: a file each, or a line each."""
    return spark.read.schema(PACK).json(path, multiLine=not lines)


def pack_issues(packs: DataFrame) -> DataFrame:
    """``(slug, issue)``: an inverted window, timeline entries outside it,
    affected packages that nothing explains, service keys used twice.
    """
    known = F.transform("compromisedVersions", lambda v: keys.package_key(v["ecosystem"], v["name"]))
    affected = F.flatten(F.transform("advisories", lambda a: F.transform(a["affects"], lambda x: keys.package_key(x["ecosystem"], x["name"]))))
    services = F.transform("services", lambda s: s["key"])
    issues = F.array(
        F.when(F.col("slug").isNull(), "the document is unreadable"),
        F.when(F.col("windowEndMs") <= F.col("windowStartMs"), "the window ends before it starts"),
        F.when(F.exists("timeline", lambda t: (t["atMs"] < F.col("windowStartMs")) | (t["atMs"] > F.col("windowEndMs"))), "a timeline entry is outside the window"),
        F.when(F.size(F.array_except(affected, known)) > 0, F.concat(F.lit("no compromised version explains "), F.array_join(F.array_except(affected, known), ", "))),
        F.when(F.size(F.array_distinct(services)) < F.size(services), "a service key is used twice"),
        F.when(F.coalesce(F.size("compromisedVersions"), F.lit(0)) <= 0, "no version is compromised"),
    )
    return packs.select("slug", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


def pack_summaries(packs: DataFrame) -> DataFrame:
    """Counts and the exposure window of each pack: from the first known
    publication to the first known disclosure, null if it isn't positive.
    """
    first = lambda c: F.array_min(F.filter(F.transform(c, lambda x: x["publishedAtMs"]), lambda t: t > 0))
    t1, t2 = first("compromisedVersions"), first("advisories")
    pins = F.aggregate("services", F.lit(0), lambda n, s: n + F.size(s["resolved"]))
    return packs.select(
        "slug", "title", "ecosystem", F.col("dataOrigin").alias("data_origin"), F.size("compromisedVersions").alias("compromised"), F.size("advisories").alias("advisories"), F.size("services").alias("services"),
        pins.alias("resolutions"), F.size("timeline").alias("timeline"), t1.alias("published_ms"), t2.alias("disclosed_ms"), F.when(t2 > t1, t2 - t1).alias("window_ms"),
    )


def pack_tables(packs: DataFrame) -> dict[str, DataFrame]:
    """Rows of all packs, in load order where a pack lists a thing twice:
    ``versions``, ``advisories``, ``affects``, ``services``, ``resolved`` and
    ``marks`` of the timeline.
    """
    part = lambda col, alias: packs.select("slug", F.posexplode(col).alias("pos", alias))
    s = part("services", "s")
    pins = s.select("slug", F.col("s.key").alias("service_key"), F.explode("s.resolved").alias("r"))
    bad = part("compromisedVersions", "v").select("slug", "v.ecosystem", "v.name", "v.version", F.col("v.publishedAtMs").alias("published_at_ms"), F.col("v.hasInstallScript").alias("has_install_script"), F.lit(0).alias("load_ord"))
    pinned = pins.select("slug", "r.ecosystem", "r.name", "r.version", F.lit(None).cast("long").alias("published_at_ms"), F.lit(False).alias("has_install_script"), F.lit(1).alias("load_ord"))
    a = part("advisories", "a")
    return {
        "versions": bad.unionByName(pinned),
        "advisories": a.select("slug", F.col("a.advisoryId").alias("ghsa_id"), F.col("a.publishedAtMs").alias("published_at_ms"), F.col("a.modifiedAtMs").alias("modified_at_ms"), "a.summary"),
        "affects": a.select("slug", F.col("a.advisoryId").alias("ghsa_id"), F.explode("a.affects").alias("x")).select("slug", "ghsa_id", "x.ecosystem", "x.name", "x.introduced", "x.fixed"),
        "services": s.select("slug", F.col("s.key").alias("key"), "s.name"),
        "resolved": pins.select("slug", "service_key", "r.ecosystem", "r.name", "r.version", F.col("r.resolvedAtMs").alias("resolved_at_ms")),
        "marks": part("timeline", "t").select("slug", F.col("t.atMs").alias("at_ms"), "t.kind", "t.label"),
    }
