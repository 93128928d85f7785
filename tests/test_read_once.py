"""Rows are derived once and lines are parsed once, as the plans show."""

from __future__ import annotations

from graphs import Builder
from pyspark.sql import functions as F

from trailmark import file_queries
from trailmark.operators import lockfile, scan


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_requirement_lines_are_parsed_once(spark):
    text = "# made\n-r other.txt\nFlask[async]==2.0 ; python_version > '3'  # pinned\n\nnumpy >= 1, ==1.5\nx @ https://a/b\n"
    files = spark.createDataFrame([("a/requirements.txt", text), ("b/requirements.txt", "one==1\r\nno requirement !\n"), ("c/requirements.txt", ""), ("d/requirements.txt", None)], "path string, content string")
    rows, report = lockfile.parse_lockfiles(files, ("requirements-txt",))
    assert {tuple(r) for r in rows.select("path", "name", "version").collect()} == {("a/requirements.txt", "flask", "2.0"), ("a/requirements.txt", "numpy", "1.5"), ("a/requirements.txt", "x", None), ("b/requirements.txt", "one", "1")}
    assert {r["path"]: (r["dependencies"], r["unparsable"]) for r in report.collect()}["b/requirements.txt"] == (1, 1)
    assert optimized(rows).count(lockfile.REQUIREMENT[:20]) <= 8


def test_dependencies_are_derived_once(spark):
    b = Builder(spark)
    b.package("a", 1)
    graph = b.build()
    rows = spark.range(3).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("marked-"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") > 0, "1.0").alias("version"))
    rows = rows.unionByName(rows.limit(0).select("path", "ecosystem", F.lit(None).cast("string").alias("name"), "version"))
    scanned = scan.scan_dependencies(graph, rows.where("name IS NOT NULL"))
    assert optimized(scanned).count("Range (0, 3") == optimized(rows).count("Range (0, 3")
    assert scanned.count() == 3 and {r["verdict"] for r in scanned.collect()} == {"unknown"}


def test_headlines_read_their_rows_once(spark, sf):
    assert "Join" not in optimized(file_queries.q39_headlines(spark, sf))
