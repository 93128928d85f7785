"""The sweep over interval ends, against each advisory and version in turn."""

import random
import time

from pyspark.sql import functions as F

from trailmark.functions import semver
from trailmark.operators import sweep

AFFECTED = f"ghsa_id string, ecosystem string, name string, listed array<string>, intervals {semver.INTERVALS}"
VERSION = "ecosystem string, name string, version string"


def random_rows(seed=5):
    rng = random.Random(seed)
    version = lambda: rng.choice([f"{rng.randint(0, 3)}.{rng.randint(0, 2)}.{rng.randint(0, 2)}", f"{rng.randint(0, 3)}.0.0-rc.{rng.randint(0, 3)}", "unreadable", "1.2"])
    bound = lambda: rng.choice([version(), version(), version(), version(), "0"])
    rows = []
    for i in range(60):
        intervals = [(bound(), *rng.choice([(None, None), (version(), None), (None, version())])) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
        rows.append((f"G{i % 50}", "npm", rng.choice("aaab"), [version() for _ in range(rng.choice([0, 0, 1, 3]))], intervals))
    rows.append(("G0", "npm", "nowhere", ["1.0.0"], [("0", None, None)]))
    versions = [("npm", n, version()) for n in "aaaabc" for _ in range(40)]
    return rows, [*versions, ("pypi", "a", "1.0.0")]


def test_sweep_equals_each_pair(spark):
    rows, versions = random_rows()
    affected, known = spark.createDataFrame(rows, AFFECTED), spark.createDataFrame(versions, VERSION)
    pairs = known.distinct().join(affected, ["ecosystem", "name"]).withColumn("hit", semver.is_affected(F.col("version"), F.col("listed"), F.col("intervals")))
    # several rows of one advisory: any of them will do
    per = pairs.groupBy("ecosystem", "name", "version", "ghsa_id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("yes"), F.max(F.col("hit").isNull()).alias("maybe"))
    want = {tuple(r) for r in per.groupBy("ecosystem", "name", "version").agg(F.count_if("yes").alias("n"), F.count_if(F.col("maybe") & ~F.col("yes")).alias("u")).collect()}
    want |= {("npm", "c", v, 0, 0) for _, n, v in versions if n == "c"} | {("pypi", "a", "1.0.0", 0, 0)}
    got = sweep.affected_counts(affected, known).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["n_undecided"] for r in got) and any(r["n_affected"] > 3 for r in got)
    listed = [tuple(r) for r in sweep.affects_pairs(affected, known).collect()]
    assert len(listed) == len(set(listed)) and set(listed) == {tuple(r) for r in per.where("yes").select("ghsa_id", "ecosystem", "name", "version").collect()}


def test_sweep_of_nothing(spark):
    none, some = spark.createDataFrame([], AFFECTED), spark.createDataFrame([("npm", "a", "1.0.0"), ("npm", "a", "1.0.0")], VERSION)
    assert [tuple(r) for r in sweep.affected_counts(none, some).collect()] == [("npm", "a", "1.0.0", 0, 0)]
    assert sweep.affects_pairs(none, some).count() == 0
    rows, _ = random_rows()
    assert sweep.affected_counts(spark.createDataFrame(rows, AFFECTED), some.limit(0)).count() == 0


def test_a_package_with_most_rows(spark):
    """A hundred thousand versions and ten thousand advisories of one package:
    10^9 pairs that are never made.
    """
    n, m = 100_000, 10_000
    versions = spark.range(n).selectExpr("'npm' AS ecosystem", "'a' AS name", "concat(id div 1000, '.', id % 1000, '.0') AS version")
    end = "CASE WHEN id % 3 > 0 THEN concat((id % 90) + 5, '.7.0') END"
    stated = spark.range(m).selectExpr("concat('G', id) AS ghsa_id", "'npm' AS ecosystem", "'a' AS name", "array('3.3.0') AS listed", f"array(struct(IF(id % 2 = 0, '0', concat(id % 90, '.5.0')) AS introduced, IF(id % 3 = 1, {end}, NULL) AS fixed, IF(id % 3 = 2, {end}, NULL) AS last_affected)) AS intervals")
    start = time.perf_counter()
    got = {r["version"]: r["n_affected"] for r in sweep.affected_counts(stated, versions).where("version IN ('0.0.0', '3.3.0', '42.5.0', '42.7.0', '99.999.0')").collect()}
    took = time.perf_counter() - start

    def slow(major, minor):
        low = lambda i: (0, 0) if i % 2 == 0 else (i % 90, 5)
        high = lambda i: (10**6, 0) if i % 3 == 0 else ((i % 90) + 5, 7 if i % 3 == 1 else 8)
        return sum((low(i) <= (major, minor) < high(i)) or (major, minor) == (3, 3) for i in range(m))

    assert got == {f"{a}.{b}.0": slow(a, b) for a, b in ((0, 0), (3, 3), (42, 5), (42, 7), (99, 999))}
    assert took < 120
