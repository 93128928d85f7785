"""Keys, versions, formats and look-alike names."""

import pytest
from pyspark.sql import functions as F

from trailmark.functions import formats, keys, semver
from trailmark.operators import typosquat as ts


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_keys(spark):
    r = one(
        spark, a=keys.parse_version_key(F.lit("npm:@a/b:c:1.0.0")), b=keys.parse_version_key(F.lit("gem:x:1")), c=keys.parse_package_key(F.lit("pypi:zope:interface")),
        d=keys.parse_package_spec(F.lit("@types/node@^1.2")), e=keys.parse_package_spec(F.lit("@types/node")), f=keys.ghsa_id(F.lit("CVE-1"), F.array(F.lit("X"), F.lit("GHSA-2"))),
        g=keys.is_selectable(F.lit("a b")), h=keys.instant_ms(F.lit("2025-03-01T00:00:00Z")), i=keys.instant_ms(F.lit("soon")), j=keys.known_number(F.lit(-1)),
    )
    assert tuple(r["a"]) == ("npm", "@a/b:c", "1.0.0") and r["b"] is None and tuple(r["c"]) == ("pypi", "zope:interface")
    assert tuple(r["d"]) == ("@types/node", "^1.2") and r["e"] is None and r["f"] == "GHSA-2" and not r["g"]
    assert (r["h"], r["i"], r["j"]) == (1740787200000, None, None)


def test_semver_order(spark):
    order = ["1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0", "1.9.0", "1.10.0"]
    rows = spark.createDataFrame([(v,) for v in [*reversed(order), "junk"]], "v string")
    got = [r[0] for r in rows.orderBy(semver.semver_key(F.col("v")).asc_nulls_last()).collect()]
    assert got == [*order, "junk"]
    assert one(spark, a=semver.semver_key(F.lit("v1.2.3+build")))["a"]["patch"] == 3


@pytest.mark.parametrize(("version", "expected"), [("1.0.0", False), ("1.5.0", True), ("2.0.0", False), ("2.5.0", True), ("x", None), ("0.9.0", True)])
def test_ranges(spark, version, expected):
    e = lambda k, v: F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version"))
    events = F.array(e("introduced", "0"), e("last_affected", "0.9.0"), e("introduced", "1.2.0"), e("fixed", "2.0.0"), e("introduced", "2.1.0"))
    assert one(spark, a=semver.is_affected(F.lit(version), F.array().cast("array<string>"), semver.affected_intervals(events)))["a"] is expected


@pytest.mark.parametrize(("wanted", "version", "expected"), [("^1.2.0", "1.9.0", True), ("^1.2.0", "2.0.0", False), ("~1.2.0", "1.3.0", False), (">=1.0.0 <2.0.0", "1.5.0", True), ("1.x || 3.0.0", "3.0.0", True), ("^0.2.1", "0.3.0", False), ("*", "9.9.9", True), ("git+ssh://x", "1.0.0", None)])
def test_range_admits(spark, wanted, version, expected):
    assert one(spark, a=semver.range_admits(F.lit(wanted), F.lit(version)))["a"] is expected


def test_formats(spark):
    r = one(
        spark, a=formats.format_count(F.lit(1234567)), b=formats.format_count(F.lit(-1)), c=formats.format_instant(F.lit(1740787200000)), d=formats.format_span(F.lit(30_171_600)), e=formats.format_span(F.lit(86_400_000)),
        f=formats.format_latency(F.lit(1500)), g=formats.redact(F.lit("token=abc /home/me/x.txt")), h=formats.collapse(F.lit("a  b\n c"), 3),
    )
    assert tuple(r) == ("1,234,567", "unknown", "2025-03-01 00:00 UTC", "8.4 hours", "1 day", "1.5 s", "token=[redacted] [path]", "a b...")


def test_edit_distance():
    assert ts.osa("axois", "axios", 1) == 1 and ts.osa("chalk", "check", 2) == 2 and ts.osa("chalk", "check", 1) is None
    assert ts.osa("react", "react-native-web", 2) is None and ts.osa("", "ab", 2) == 2 and ts.osa("lodash", "lodash", 0) == 0 and ts.osa("ca", "abc", 3) == 3


def found(spark, suspect, targets, ecosystem="npm", **options):
    a = spark.createDataFrame([(ecosystem, *suspect)], "ecosystem string, name string, weekly_downloads long")
    b = spark.createDataFrame([("npm", *t) for t in targets], a.schema)
    return [(r["target"], r["confidence"], r["edit_distance"], [s["kind"] for s in r["signals"]]) for r in ts.findings(a, b, ts.Options(**options)).orderBy("rank").collect()]


def test_typosquats(spark):
    assert found(spark, ("crossenv", 100), [("cross-env", 1_000_000)]) == [("cross-env", "high", 1, ["separator_or_case", "edit_distance", "popularity_gap"])]
    assert found(spark, ("@types/express", 100), [("express", 10_000)]) == []
    assert found(spark, ("@evil/lodash", None), [("lodash", 10_000)]) == [("lodash", "medium", -1, ["scope_confusion"])]
    assert found(spark, ("requests", 1), [("requests2", 10)], ecosystem="pypi") == []
    assert found(spark, ("lodash-js", 1), [("lodash", 1_000)], max_distance=0) == [("lodash", "medium", -1, ["padding", "popularity_gap"])]
    assert found(spark, ("axois", 10), [("axios", 100)]) == []  # a sibling: not far enough ahead
    with pytest.raises(ValueError):
        ts.Options(max_distance=5)


def test_compared_names_are_capped(spark):
    assert found(spark, ("axois", 1), [("axios", 1_000), ("axoiss", 900)], max_compared=1) == [("axios", "high", 1, ["edit_distance", "popularity_gap"])]
    popular = spark.createDataFrame([("npm", f"p{i}", i) for i in range(5)], "ecosystem string, name string, weekly_downloads long")
    assert {r["name"] for r in ts.compared(popular, 2).collect()} == {"p3", "p4"}
    x = ts.scan_limits(popular, ts.Options(max_compared=2)).first()["limits"][0]
    assert (x["kind"], x["examined"], x["total"]) == ("scan_capped", 2, 5)


def test_near_names_lose_no_pair(spark):
    import itertools
    import random

    rng = random.Random(7)
    base = ["".join(rng.choice("abc-") for _ in range(rng.randint(1, 12))) for _ in range(30)]
    names = sorted({*base, *(b[:i] + c + b[i + k :] for b in base for i, k, c in [(rng.randrange(len(b)), rng.randint(0, 1), rng.choice(["", "x", "yz"]))]), *(b[1] + b[0] + b[2:] for b in base if len(b) > 1)} - {""})
    p = ts.profiles(spark.createDataFrame([("npm", n, None) for n in names], "ecosystem string, name string, weekly_downloads long"))
    s, t = ts._sides(p, p)
    for most in (1, 2):
        got = {(r["suspect"], r["target"], r["signal"]["distance"]) for r in ts.near_names(s, t, most).collect()}
        assert got == {(a, b, d) for a, b in itertools.permutations(names, 2) if (d := ts.osa(a, b, most)) is not None}


def test_forms(spark):
    r = one(spark, a=ts.identity(F.lit("pypi"), F.lit("Zope.Interface")), b=ts.flattened(F.lit("@types/Node_Fetch")), c=ts.confusable(F.lit("rnodern-vv1i05")), d=ts.substitutions(F.lit("rn1")), e=ts.scope(F.lit("npm"), F.lit("@a/b")))
    assert (r["a"], r["b"], r["c"], r["e"]) == ("zope-interface", "typesnodefetch", "modem-wllos", "a")
    assert [tuple(x) for x in r["d"]] == [("rn", "m", 1), ("1", "l", 1)]


def test_a_range_reads_its_version_once(spark):
    wanted = semver.range_admits(F.col("w"), F.col("v"))
    plan = spark.createDataFrame([("^1.0.0 || 2", "1.2.3")], "w string, v string").select(wanted.alias("ok"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(v#") <= 16
