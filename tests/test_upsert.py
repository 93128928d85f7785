"""Upserts that rewrite only what they touch."""

import os

import pytest

from trailmark.plans import merge, upsert

NODE = "id long, key string, n long"
EDGE = "edge_id long, src long, dst long, w string"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_row_rewrites_one_partition(spark, tmp_path):
    at = str(tmp_path / "t")
    nodes = spark.range(2000).selectExpr("id", "concat('k', id) AS key", "id * 2 AS n")
    upsert.write_by_id(nodes, at, 256)
    before = files(at)
    assert len(before) == 256
    fresh = spark.createDataFrame([(7, None, -1)], NODE)
    touched = upsert.upsert_by_id(spark, at, fresh, NODE, 256)
    after = files(at)
    changed = {f for f in set(before) | set(after) if before.get(f) != after.get(f)}
    assert len(touched) == 1 and {f.split("/")[0] for f in changed} == {f"_part={touched[0]}"} and len(after) == 256
    rows = lambda: sorted(map(tuple, upsert.read_by_id(spark, at, NODE).drop("_part").collect()))
    assert rows() == sorted(map(tuple, merge.upsert_nodes(nodes, fresh).collect()))
    many = spark.range(1990, 2010).selectExpr("id", "'new' AS key", "CAST(NULL AS LONG) AS n")
    want = sorted(map(tuple, merge.upsert_nodes(upsert.read_by_id(spark, at, NODE).drop("_part"), many).collect()))
    assert 1 < len(upsert.upsert_by_id(spark, at, many, NODE, 256)) <= 20 and rows() == want
    assert upsert.upsert_by_id(spark, at, many.limit(0), NODE, 256) == [] and rows() == want
    pruned = upsert.read_by_id(spark, at, NODE).where("_part IN (3)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in pruned or "PartitionFilters: [(_part" in pruned
    with pytest.raises(ValueError, match="parts"):
        upsert.write_by_id(nodes, at + "x", 0)


def test_appended_edges_rewrite_nothing(spark, tmp_path):
    at = str(tmp_path / "e")
    upsert.write_by_src(spark.createDataFrame([(i, i % 5, i, None if i % 2 else "w") for i in range(40)], EDGE), at, 8)
    before = files(at)
    fresh = spark.createDataFrame([(100, 0, 0, "w"), (101, 1, 1, None), (102, 1, 1, "other"), (103, 9, 9, None), (104, 9, 9, None)], EDGE)
    touched = upsert.append_by_src(spark, at, fresh, EDGE, 8)
    after = files(at)
    assert before.items() <= after.items() and len(after) == len(before) + len(touched)
    added = {tuple(r)[1:4] for r in upsert.read_by_id(spark, at, EDGE).where("edge_id >= 100").collect()}
    assert added == {(1, 1, "other"), (9, 9, None)}
    assert upsert.append_by_src(spark, at, fresh, EDGE, 8) == [] and files(at) == after
