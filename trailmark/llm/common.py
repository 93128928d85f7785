"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; the same set that
#: ``bytes.split()`` uses, so Python and SQL see the same words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and everything runs on one machine (tests) a temporary folder is made and
    used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="trailmark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of jobs that are done, which it does
    once the driver has collected their handles.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of texts that one Arrow batch may hold in a Python worker.
BATCH_BYTES = 32 << 20


def text_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch of texts holds, by bytes: always the same
    value, so plans made before or after run alike.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Masked:
    """A frame whose columns are called ``_c0``, ``_c1`` and so on, so that
    names that an operator makes up can't clash with any of a user's.
    """

    def __init__(self, df: DataFrame) -> None:
        self.columns = df.columns
        self.names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
        self.df = df.select(*[quoted(c).alias(n) for c, n in self.names.items()])

    def __getitem__(self, column: str) -> str:
        return self.names[column]

    def restored(self) -> list[Column]:
        """Columns to select for the original ones."""
        return [F.col(n).alias(c) for c, n in self.names.items()]


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def remainder(id_col: str, n: int):
    """``crc32(id as text) mod n``, the fold of a document."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
