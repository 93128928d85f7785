"""The record of a graph that several runs write into."""

import os
import shutil

import pytest

from trailmark.operators import graph as g
from trailmark.plans import coverage_record as record

CLAIM = "subject_kind string, key string, level int"


def graph_of(spark, packages):
    nodes = spark.createDataFrame([(i, f"npm:p{i}", "npm", f"p{i}", None) for i in range(packages)], g.NODES["packages"])
    return g.Graph(spark, {"packages": nodes})


def claims(spark, at):
    return {(r["subject_kind"], r["key"]): r["level"] for r in record.recorded_claims(spark, at).collect()}


def test_two_runs_keep_the_weaker_claims_and_count_the_whole(spark, tmp_path):
    at = str(tmp_path / "r")
    assert record.read_record(spark, at).isEmpty() and claims(spark, at) == {}
    first = spark.createDataFrame([("package", "a", 2), ("package", "b", 2), ("package", "c", 1)], CLAIM)
    assert record.record_coverage(graph_of(spark, 3), first, at, 10, ["of the registry"]) == 1
    second = spark.createDataFrame([("package", "b", 1), ("package", "c", 2), ("service", "s", 2)], CLAIM)
    assert record.record_coverage(graph_of(spark, 5), second, at, 20, ["of the incident"]) == 2
    assert claims(spark, at) == {("package", "a"): 2, ("package", "b"): 1, ("package", "c"): 1, ("service", "s"): 2}
    row = record.read_record(spark, at).first()
    assert (row["version"], row["generated_at_ms"], row["packages"], row["services"]) == (2, 20, 5, 0)
    assert row["notes"] == ["of the registry", "of the incident", record.COUNTED_BACK]
    level = g.coverage_of(record.covered(graph_of(spark, 5), at), "package", spark.createDataFrame([("a",), ("z",)], "key string"))
    assert dict(map(tuple, level.collect())) == {"a": 2, "z": 0}
    # the same run again changes nothing but the version
    assert record.record_coverage(graph_of(spark, 5), second, at, 30, ["of the incident"]) == 3
    assert len(claims(spark, at)) == 4 and record.read_record(spark, at).first()["notes"] == row["notes"]


def test_a_run_that_dies_leaves_the_record_in_force(spark, tmp_path):
    at = str(tmp_path / "r")
    one = spark.createDataFrame([("package", "a", 2)], CLAIM)
    record.record_coverage(graph_of(spark, 1), one, at, 1)
    record.record_coverage(graph_of(spark, 1), spark.createDataFrame([("package", "x", 1)], CLAIM), at, 2)
    shutil.rmtree(os.path.join(at, "record", "version=2"))  # claims were written, the row wasn't
    assert claims(spark, at) == {("package", "a"): 2}
    assert record.record_coverage(graph_of(spark, 1), spark.createDataFrame([("package", "b", 2)], CLAIM), at, 3) == 2
    assert claims(spark, at) == {("package", "a"): 2, ("package", "b"): 2}


def test_a_record_that_cannot_be_read_is_not_replaced(spark, tmp_path):
    at = tmp_path / "r"
    (at / "record" / "version=1").mkdir(parents=True)
    (at / "record" / "version=1" / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?s).+"):
        record.record_coverage(graph_of(spark, 1), spark.createDataFrame([("package", "a", 2)], CLAIM), str(at), 1)
    assert (at / "record" / "version=1" / "part-0.parquet").read_text() == "no table" and not (at / "record" / "version=2").exists()


def test_empty_graph_and_no_claims(spark, tmp_path):
    at = str(tmp_path / "r")
    record.record_coverage(g.Graph(spark), spark.createDataFrame([], CLAIM), at, 1)
    assert claims(spark, at) == {} and record.read_record(spark, at).first()["packages"] == 0
