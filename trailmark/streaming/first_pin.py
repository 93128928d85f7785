"""The first pin of each service and version from a stream of pins.

Every batch adds what it changed to the sink, in a folder of its own that a
repeated batch replaces, so a batch that dies half-way leaves no trace once it
has run again.  Readers fold the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PIN = "service long, version long, resolved_at timestamp"
FIRST = "service long, version long, resolved_at_ms long"
KEYED_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_pins(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of Parquet files of pins as they arrive in ``path``."""
    return spark.readStream.schema(PIN).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(pins: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Pins per window; pins later than the watermark are dropped, and windows
    that it has passed leave the state.
    """
    return pins.withWatermark("resolved_at", late).groupBy(F.window("resolved_at", window).alias("w")).agg(F.count("*").alias("pins"), F.approx_count_distinct("service").alias("services"))


def first_pins(pins: DataFrame) -> DataFrame:
    """``(service, version, resolved_at_ms)``: state is one minimum per pair,
    for good.
    """
    return pins.groupBy("service", "version").agg(F.unix_millis(F.min("resolved_at")).alias("resolved_at_ms"))


class KeepFirst(StatefulProcessor):
    """The earliest instant of a pair, forgotten ``keep_ms`` after it."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = int(min(pdf["ms"].min() for pdf in rows))
        known = self.first.get()[0] if self.first.exists() else None
        if known is None or now < known:
            if known is not None:
                self.handle.deleteTimer(known + self.keep_ms)
            self.first.update((now,))
            self.handle.registerTimer(now + self.keep_ms)
            yield pd.DataFrame({"service": [key[0]], "version": [key[1]], "resolved_at_ms": [now]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_first_pins(pins: DataFrame, late: str = "7 days", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """``(service, version, resolved_at_ms)`` whenever a pair's first pin is
    new or earlier than known.

    A pair is forgotten once the watermark, ``late`` behind the latest pin, has
    passed its first pin by ``keep_ms``; if it is pinned again it is reported
    again, and readers keep the earliest.  Pins later than the watermark are
    dropped, as are pins without a time, service or version.  So state is as
    large as the pairs of that stretch of time, however long the stream runs.
    """
    pins.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", KEYED_STATE)
    rows = pins.where("service IS NOT NULL AND version IS NOT NULL AND resolved_at IS NOT NULL").withWatermark("resolved_at", late)
    rows = rows.select("service", "version", "resolved_at", F.unix_millis("resolved_at").alias("ms"))
    return rows.groupBy("service", "version").transformWithStateInPandas(statefulProcessor=KeepFirst(keep_ms), outputStructType=FIRST, outputMode="Update", timeMode="EventTime")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Take in all that is there, then stop.  Each batch writes the rows that
    it changed to its own folder of the sink (Parquet).
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, sink: str, *by: str) -> DataFrame:
    """For each key its row of the newest batch that changed it."""
    rows = spark.read.parquet(sink)
    rest = [c for c in rows.columns if c not in by and c != "batch"]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*by, "r.*")


def earliest(spark: SparkSession, sink: str) -> DataFrame:
    """``(service, version, resolved_at_ms)``: the first pins of all batches."""
    return spark.read.parquet(sink).groupBy("service", "version").agg(F.min("resolved_at_ms").alias("resolved_at_ms"))
