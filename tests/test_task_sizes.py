"""Folds and ranks deal rows to tasks by their number, not by shuffled bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import history, scan


def test_partitions_follow_rows(spark, monkeypatch):
    least = spark.sparkContext.defaultParallelism
    assert history.tasks_for(spark.range(10)) == least
    monkeypatch.setattr(history, "ROWS_A_TASK", 100)
    assert history.tasks_for(spark.range(901)) == 10
    assert history.tasks_for(spark.range(0)) == least


def test_dealt_histories_are_the_same(spark):
    pins = spark.range(3_000).selectExpr("id % 7 service", "id % 11 version", "id % 50 revision", "id % 13 at_ms").unionAll(spark.createDataFrame([(None, 1, 2, 3), (1, None, 2, None)], "service long, version long, revision long, at_ms long"))
    old = pins.where("revision % 2 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(history.fold_history(pins, 9)) == rows(history.fold_history(pins))
    extended = history.extend_history(history.fold_history(old, 9), history.new_revisions(pins, old, 9), 9)
    assert rows(extended) == rows(history.extend_history(history.fold_history(old), history.new_revisions(pins, old)))
    # adaptive execution would put so few bytes into one partition
    folded = history.fold_history(pins, 9)
    assert folded.count() == 79 and folded.rdd.getNumPartitions() == 9


def test_dealt_ranks_are_the_same(spark):
    rows = spark.range(500).selectExpr("cast(id % 9 as string) path", "if(id % 3 = 0, 'exposed', 'unknown') verdict", "cast(null as int) depth", "false is_dev_only", "concat('npm:', id) package_key", "'1' version")
    got, plain = scan.top_rows(rows, 2, 9), scan.top_rows(rows, 2)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plain.collect()}
    assert got.count() == plain.count() and got.select(F.spark_partition_id()).rdd.getNumPartitions() == 9
