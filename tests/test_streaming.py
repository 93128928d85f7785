"""Streams: late rows, state that expires, and batches that die."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from trailmark.streaming import first_pin


def day(n):
    return datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=n)


def ms(n):
    return int(day(n).timestamp() * 1000)


def arrive(spark, path, name, *rows):
    spark.createDataFrame([(s, v, day(n)) for s, v, n in rows], first_pin.PIN).coalesce(1).write.parquet(f"{path}/{name}")


def run(spark, at, stream, out="out"):
    first_pin.run_available(stream(spark.readStream.schema(first_pin.PIN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in")), f"{at}/{out}", f"{at}/state")


def test_late_pins_are_dropped(spark, tmp_path):
    at = str(tmp_path)
    arrive(spark, f"{at}/in", "a", (1, 1, 100), (2, 1, 100), (1, 1, 99))
    run(spark, at, first_pin.windowed_counts)
    arrive(spark, f"{at}/in", "b", (1, 1, 98), (3, 1, 5), (1, 1, 101))
    run(spark, at, first_pin.windowed_counts)
    rows = first_pin.latest(spark, f"{at}/out", "w").select(F.unix_millis("w.start").alias("ms"), "pins").collect()
    assert {r["ms"]: r["pins"] for r in rows} == {ms(98): 1, ms(99): 1, ms(100): 2, ms(101): 1}


def test_a_batch_that_dies_is_replaced(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    arrive(spark, f"{at}/in", "a", (1, 1, 10), (2, 1, 11))
    run(spark, at, first_pin.first_pins)
    arrive(spark, f"{at}/in", "b", (1, 1, 8), (3, 1, 12))
    cls = type(spark.range(0))
    write = cls.write

    class Dying:
        def __init__(self, writer):
            self.writer = writer

        def mode(self, m):
            return Dying(self.writer.mode(m))

        def parquet(self, path):
            self.writer.parquet(path)
            raise RuntimeError("died after its files were written")

    monkeypatch.setattr(cls, "write", property(lambda df: Dying(write.fget(df))))
    with pytest.raises(Exception, match="died"):
        run(spark, at, first_pin.first_pins)
    monkeypatch.undo()
    run(spark, at, first_pin.first_pins)
    assert {tuple(r) for r in first_pin.earliest(spark, f"{at}/out").collect()} == {(1, 1, ms(8)), (2, 1, ms(11)), (3, 1, ms(12))}
    assert {tuple(r) for r in first_pin.latest(spark, f"{at}/out", "service", "version").collect()} == {(1, 1, ms(8)), (2, 1, ms(11)), (3, 1, ms(12))}
    assert spark.read.parquet(f"{at}/out").count() == 4  # each change once


def test_state_expires(spark, tmp_path):
    at = str(tmp_path)
    stream = lambda pins: first_pin.expiring_first_pins(pins, late="2 days", keep_ms=5 * 86_400_000)
    arrive(spark, f"{at}/in", "a", (1, 1, 10), (2, 1, 11), (1, 1, 12))
    run(spark, at, stream)
    arrive(spark, f"{at}/in", "b", (2, 1, 12), (1, 1, 30), (9, 9, 3))  # the last is late
    run(spark, at, stream)
    arrive(spark, f"{at}/in", "c", (1, 1, 31), (2, 1, 32), (None, 1, 33))
    run(spark, at, stream)
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/out").select("service", "version", "resolved_at_ms", "batch").collect()]
    assert {(1, 1, ms(10)), (2, 1, ms(11))} == {tuple(r) for r in first_pin.earliest(spark, f"{at}/out").collect()}
    # forgotten by then, so reported again; before that, later pins said nothing
    assert (2, 1, ms(32)) in {r[:3] for r in rows} and (2, 1, ms(12)) not in {r[:3] for r in rows} and not any(r[0] == 9 for r in rows)
    state = spark.read.format("state-metadata").load(f"{at}/state").collect()
    assert state and json.loads(json.dumps([r["operatorName"] for r in state]))[0].startswith("transformWithState")
    held = spark.read.format("statestore").option("stateVarName", "first").load(f"{at}/state").count()
    assert held <= 2
