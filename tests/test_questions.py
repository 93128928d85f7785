"""Questions over graphs with answers worked out by hand."""

import pytest
from graphs import PINNED, Builder, chain
from pyspark.sql import functions as F

from trailmark.functions import verdict
from trailmark.operators import bitemporal, introduced, maintainers, replay, traverse
from trailmark.operators.blast_radius import Bounds, blast_radius

BAD = "npm:flatmap-stream:0.1.1"


def kinds(row):
    return [x["kind"] for x in row["limits"]]


def test_chain(spark):
    r = blast_radius(chain(spark).build(), BAD)
    a = r.answer.first()
    assert (a["verdict"], kinds(a), a["max_hop_reached"], a["services_considered"]) == ("exposed", [], 3, 3)
    assert [(v["shown"], v["hop"]) for v in r.versions.collect()] == [("event-stream@3.3.6", 1), ("ps-tree@1.2.0", 2), ("nodemon@1.18.7", 3)]
    services = {s["service_name"]: s for s in r.services.collect()}
    assert {k: s["hop"] for k, s in services.items()} == {"checkout-api": 2, "wallet-web": 4}
    steps = services["checkout-api"]["steps"]
    assert [s["via"] for s in steps] == [None, "resolved", "resolves_to"] and [s["resolved_at_ms"] for s in steps] == [None, PINNED, None]
    assert all(len(s["steps"]) == s["hop"] + 1 for s in services.values())


def test_direct_and_diamond(spark):
    b = Builder(spark)
    bad = b.version("x", "1.0.0")
    b.edge("resolved", b.service("a"), bad, PINNED)
    b.claim("npm:x", 2)
    r = blast_radius(b.build(), bad)
    s = r.services.first()
    assert (s["hop"], s["is_direct"], s["path_count"], r.versions.count()) == (1, True, 1, 0)
    g = chain(spark)
    g.edge("resolves_to", "npm:nodemon:1.18.7", BAD)
    r = blast_radius(g.build(), BAD)
    nodemon = next(v for v in r.versions.collect() if v["shown"].startswith("nodemon"))
    assert (nodemon["hop"], nodemon["path_count"]) == (1, 2)
    web = next(v for v in r.services.collect() if v["service_name"] == "wallet-web")
    assert (web["hop"], web["path_count"]) == (2, 2)


def test_negative_needs_closed_coverage(spark):
    for level, expected, limits in ((2, "not_exposed", []), (1, "unknown", ["package_partial"]), (None, "unknown", ["package_absent"])):
        a = blast_radius(chain(spark, level).build(), "npm:nodemon:1.18.7", Bounds(max_services=5)).answer.first()
        expected = "exposed" if level else expected  # it is pinned
        assert a["verdict"] == expected and (level == 2 or kinds(a) == limits)
    b = chain(spark)
    b.version("alone", "1.0.0")
    b.claim("npm:alone", 2)
    assert blast_radius(b.build(), "npm:alone:1.0.0").answer.first()["verdict"] == "not_exposed"


def test_missing_empty_malformed(spark):
    a = blast_radius(chain(spark).build(), "npm:flatmap-stream:9.9.9").answer.first()
    assert (a["verdict"], kinds(a)) == ("unknown", ["package_absent"])
    a = blast_radius(Builder(spark).build(), BAD).answer.first()
    assert (a["verdict"], kinds(a)) == ("unknown", ["empty_graph"])
    with pytest.raises(ValueError, match="not a version key"):
        blast_radius(chain(spark).build(), "flatmap-stream")
    with pytest.raises(ValueError, match="max_hops"):
        blast_radius(chain(spark).build(), BAD, Bounds(max_hops=17))


def test_caps_become_limits(spark):
    r = blast_radius(chain(spark).build(), BAD, Bounds(max_hops=2))
    assert r.answer.first()["verdict"] == "exposed" and "hop_limit" in kinds(r.answer.first()) and r.services.count() == 1
    a = blast_radius(chain(spark).build(), BAD, Bounds(max_services=1)).answer.first()
    assert [(x["kind"], x["examined"], x["total"]) for x in a["limits"]] == [("scan_capped", 1, 3)]


def test_budget_becomes_a_limit(spark):
    r = blast_radius(chain(spark, extra=(("npm:ps-tree:1.2.0", BAD), ("npm:nodemon:1.18.7", BAD))).build(), BAD, Bounds(paths_a_level=2))
    assert r.answer.first()["verdict"] == "unknown" and "budget_rejected" in kinds(r.answer.first()) and r.answer.first()["max_hop_reached"] == 0
    with pytest.raises(traverse.BudgetError, match="more than 1 paths"):
        traverse.paths(chain(spark).build().edge("resolves_to"), spark.createDataFrame([(0, 2), (1, 2)], "ordinal long, node long"), 3, checkpoint=True, most=1)


def test_as_of(spark):
    r = blast_radius(chain(spark).build(), BAD, at_ms=PINNED - 1)
    assert r.answer.first()["verdict"] == "not_exposed" and r.services.count() == 0


def test_cycle_ends(spark):
    b = chain(spark, extra=((BAD, "npm:nodemon:1.18.7"),))
    r = blast_radius(b.build(), BAD)
    assert sorted(v["hop"] for v in r.versions.collect()) == [1, 2, 3]
    edges = b.build().edge("resolves_to").select("src", "dst")
    assert traverse.closure(edges, spark.createDataFrame([(1,)], "node long")).count() == 4


def test_paths_semantics(spark):
    e = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 2, 3), (4, 3, 1)], "edge_id long, src long, dst long")
    seeds = spark.createDataFrame([(0, 1), (1, 1)], "ordinal long, node long")
    got = traverse.paths(e, seeds, 5, checkpoint=True).collect()
    assert len(got) == 8  # parallel edges and repeated seeds each count, no node repeats
    first = traverse.paths(e, seeds, 5, path_count=3).collect()
    assert [(r["hop"], r["ordinal"], r["edges"]) for r in first] == [(1, 0, [1]), (1, 0, [2]), (1, 1, [1])]
    only = traverse.paths(e, seeds, 5, targets=spark.createDataFrame([(3,)], "id long"))
    assert {r["tail"] for r in only.collect()} == {3}
    r = traverse.reach(e, spark.createDataFrame([(1, 1)], "source long, node long"), 5, include_seeds=True)
    assert {(x["node"], x["hop"]) for x in r.collect()} == {(1, 0), (2, 1), (3, 2)}


T1, T2 = 1740787200000, 1741392000000


def bitemporal_graph(spark, pins, published=T1, disclosed=T2, level=2):
    b = Builder(spark)
    v, control = b.version("chalk", "5.3.1", published), b.version("chalk", "5.3.0", published)
    a = b.advisory("GHSA-mh6f-8j2x-4483", disclosed)
    b.edge("affects_version", a, v)
    b.claim("npm:chalk", level)
    for i, at in enumerate(pins):
        b.edge("resolved", b.service(f"s{i}"), v, at)
        b.edge("resolved", f"svc:s{i}", control, at)
    return b.build()


def test_window_is_half_open(spark):
    h = 3_600_000
    g = bitemporal_graph(spark, [T1 + 6 * h, T1 + 30 * h, T1 - h, T1, T2])
    got = bitemporal.victims(g.edge("resolved"), bitemporal.pairs(g)).orderBy("resolved_at_ms").collect()
    assert [(r["resolved_at_ms"], r["ms_before_disclosure"]) for r in got] == [(T1, T2 - T1), (T1 + 6 * h, T2 - T1 - 6 * h), (T1 + 30 * h, T2 - T1 - 30 * h)]
    t = bitemporal.timeline(bitemporal.pairs(g), bitemporal.victims(g.edge("resolved"), bitemporal.pairs(g))).orderBy("at_ms", "kind_rank").collect()
    assert [r["kind"] for r in t] == ["published", "resolved", "resolved", "resolved", "disclosed"]


@pytest.mark.parametrize(("published", "disclosed", "level", "expected"), [(T1, T2, 2, "exposed"), (T2, T1, 1, "not_exposed"), (-1, T2, 2, "unknown"), (T1, -1, 2, "unknown"), (T1, T1, 1, "not_exposed")])
def test_clock_verdicts(spark, published, disclosed, level, expected):
    a = bitemporal.answers(bitemporal_graph(spark, [T1 + 1], published, disclosed, level)).first()
    assert a["verdict"] == expected and (expected != "unknown" or kinds(a) == [])


def introduced_graph(spark, times=(1_720, 1_710, 1_700), versions=("5.2.0", "5.1.0", "5.0.0")):
    b = Builder(spark)
    p, a = b.package("chalk"), b.advisory("GHSA-3xq7-9c4h-2vpm", T2)
    b.claim("npm:chalk", 2)
    for v, t in zip(versions, times, strict=True):
        b.edge("affects_version", a, b.version("chalk", v, t if t == -1 else t * 10**9))
    b.edge("affects", a, p, "5.0.0", "5.3.0")
    return b.build()


def test_introduced(spark):
    r = introduced.introduced_versions(introduced_graph(spark)).first()
    assert (r["introduced_version"], r["stated_fixed"], r["verdict"]) == ("5.0.0", "5.3.0", "exposed")
    r = introduced.introduced_versions(introduced_graph(spark, (-1, -1, -1))).first()
    assert r["introduced_version"] == "5.0.0"
    r = introduced.introduced_versions(introduced_graph(spark, (-1, -1, -1), ("5.2.0", "odd", "5.10.0"))).first()
    assert r["introduced_version"] == "5.2.0" and kinds(r) == ["undecidable_versions"]
    r = introduced.introduced_versions(introduced_graph(spark), max_versions=2).first()
    assert kinds(r) == ["scan_capped"]


def test_maintainers(spark):
    b = Builder(spark)
    ann, idle = b.maintainer("ann"), b.maintainer("idle")
    p, q = b.package("core", 1000), b.package("util")
    v, w, far = b.version("core", "1.0.0"), b.version("util", "1.0.0"), b.version("app", "1.0.0", script=True)
    other = b.package("app", 5)
    for m, k in ((ann, p), (ann, q)):
        b.edge("maintains", m, k)
    for x, k in ((v, p), (w, q), (far, other)):
        b.edge("version_of", x, k)
    b.edge("resolves_to", far, v)
    s = b.service("shop")
    b.edge("resolved", s, v, PINNED)
    b.edge("resolved", s, far, PINNED)
    b.claim("npm:core", 2)
    g = b.build()
    r = maintainers.surfaces(g).first()
    assert (r["services"], r["nearest_service_hop"], r["direct_dependents"], r["dependents_with_install_script"]) == (1, 1, 1, 1)
    assert (r["weekly_downloads"], r["packages_without_downloads"], r["downloads_basis"], r["modelled_candidates"]) == (1000, 1, "partial", 0)
    assert r["verdict"] == "exposed" and maintainers.LOWER_BOUND in r["rationale"]
    assert [x[0] for x in maintainers.unranked(g).collect()] == [idle]
    missing = maintainers.maintainer_surface(g, "npm:nobody").first()
    assert missing["verdict"] == "unknown" and maintainers.LOWER_BOUND in missing["rationale"]
    assert maintainers.maintainer_surface(g, ann).first()["services"] == 1


def test_replay(spark):
    day = 86_400_000
    b = Builder(spark)
    bad, mid, top, chalk = b.version("flatmap-stream", "0.1.1", T1), b.version("event-stream", "3.3.6"), b.version("ps-tree", "1.2.0"), b.version("chalk", "1.0.0")
    b.edge("resolves_to", mid, bad)
    b.edge("resolves_to", top, mid)
    t2 = T1 + 8 * day
    adv = b.advisory("GHSA-x", t2)
    b.edge("affects_version", adv, bad)
    for n, v, at in (("jobs-runner", mid, T1 + 3 * day), ("search-indexer", top, T1 + 5 * day), ("ledger-api", mid, t2 + 2 * day), ("docs-site", chalk, T1 + day)):
        b.edge("resolved", b.service(n), v, at)
    g = b.build()
    frames, rows = replay.replay(g, g.node("versions").where(F.col("key") == bad), g.node("advisories"), T1 - 2 * day, t2 + 6 * day)
    got = frames.orderBy("frame").collect()
    counts = [r["exposed"] for r in got]
    assert counts == sorted(counts) and counts[-1] == 3 and got[-1]["blind_spots"] == 2
    public = [r["advisory_public"] for r in got]
    assert public == sorted(public) and next(r["at_ms"] for r in got if r["advisory_public"]) == t2
    names = {r["id"]: r["name"] for r in g.node("services").collect()}
    assert {names[r["service"]] for r in rows.collect() if r["is_blind_spot"]} == {"jobs-runner", "search-indexer"}
    with pytest.raises(ValueError):
        replay.frame_instants(spark, 5, 5, frames)


CASES = [
    (True, 2, True, [], "unknown"), (True, 0, False, [], "unknown"), (True, 2, False, ["hop_limit"], "exposed"), (False, 2, False, ["hop_limit"], "unknown"),
    (False, 1, False, [], "unknown"), (False, 2, False, [], "not_exposed"), (False, 2, False, ["package_absent"], "unknown"), (True, 1, False, [], "exposed"),
]


@pytest.mark.parametrize(("found", "coverage", "empty", "limits", "expected"), CASES)
def test_verdict_order(spark, found, coverage, empty, limits, expected):
    own = verdict.limits(*[(F.lit(True), verdict.limit(k)) for k in limits])
    r = spark.range(1).select(verdict.decide(F.lit(found), F.lit(coverage), F.lit(empty), own, F.lit("npm:x")).alias("a")).first()["a"]
    assert r["verdict"] == expected
    if coverage == 1 and not empty:
        assert "package_partial" in kinds(r)


def test_limits_fold(spark):
    xs = verdict.limits(*[(F.lit(True), verdict.limit("undecidable_versions", n=n)) for n in (2, 3)], (F.lit(True), verdict.limit("package_absent", subject="a")), (F.lit(True), verdict.limit("package_absent", subject="b")), (F.lit(True), verdict.limit("package_absent", subject="a")))
    r = spark.range(1).select(verdict.fold_limits(xs).alias("x")).first()["x"]
    assert [(x["kind"], x["n"], x["subject"]) for x in r] == [("undecidable_versions", 5, None), ("package_absent", None, "a"), ("package_absent", None, "b")]


def test_more_edges_never_clear_an_exposure(spark):
    """Adding dependencies to an exposed subject leaves it exposed."""
    keys = ["npm:event-stream:3.3.6", "npm:ps-tree:1.2.0", "npm:nodemon:1.18.7", "npm:chalk:5.3.1", BAD]
    for extra in ([(keys[3], BAD)], [(BAD, keys[3])], [(keys[0], keys[2]), (keys[3], keys[1])]):
        assert blast_radius(chain(spark, extra=extra).build(), BAD).answer.first()["verdict"] == "exposed"
