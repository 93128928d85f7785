"""A store of immutable Parquet shards with size-tiered compaction.

Arrivals are appended as small shards straight from the scan, without a
shuffle.  Compaction puts shards of a similar size into groups of about the
target size, rewrites each group as one file and leaves the rest alone.  Every
change commits a new version of the manifest by an atomic rename; readers see
the version they opened.  All steps are DataFrame operations.

Layout under the root: ``data/<batch>/part-*`` and ``manifest/v<version>/``.
A shard's name is ``<batch>/part-<number>`` without Spark's own suffix.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import quoted

#: What a manifest says of each shard; it also has its ``file`` and, as JSON,
#: its ``columns``.
MANIFEST = "shard string, batch string, tier int, n_rows long, bytes long"
STORED = f"{MANIFEST}, file string, columns string"


@dataclass(frozen=True)
class Tiers:
    """Shards of ``small_bytes * fanout**k`` and more are in tier k.  Groups of
    one tier reach ``target_bytes`` or, to be worth a rewrite, hold ``fanout``
    shards at least.  Shards over half the target are left as they are.
    """

    target_bytes: int = 64 << 20
    small_bytes: int = 1 << 20
    fanout: int = 4
    arrival_rows: int = 4096
    lane_shards: int = 10_000

    def tier(self, size: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(F.log(F.greatest(size, F.lit(1)) / self.small_bytes) / F.log(F.lit(float(self.fanout)))).cast("int"))


class ConflictError(RuntimeError):
    """Another writer has committed this version first."""


def merged_columns(schemas: list[StructType]) -> StructType:
    """All columns by name, in order of first appearance; ValueError if two of
    one name have different types or two names differ only by case.
    """
    known: dict[str, StructField] = {}
    for f in (f for schema in schemas for f in schema):
        first = known.setdefault(f.name.lower(), StructField(f.name, f.dataType))
        if first.name != f.name or first.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} ({f.dataType.simpleString()}) doesn't fit {first.name} ({first.dataType.simpleString()})")
    return StructType(list(known.values()))


class ShardStore:
    """A versioned table of documents under ``root``, a path that driver and
    executors share.  Merged shards are sorted by ``order_col`` if it is given.
    """

    def __init__(self, spark: SparkSession, root: str, tiers: Tiers | None = None, order_col: str | None = None) -> None:
        self.spark, self.root, self.tiers, self.order_col = spark, root.rstrip("/"), tiers or Tiers(), order_col
        self._jvm = spark._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = path.getFileSystem(self._conf)

    def _path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}")

    def _names(self, rel: str) -> list[str]:
        path = self._path(rel)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return [int(n[1:]) for n in self._names("manifest") if n.startswith("v")]

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards of a version, the latest if none is given."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(f"{self.root}/manifest/v{version:08d}")

    def _commit(self, shards: DataFrame, version: int) -> int:
        """Write a manifest aside and move it in place in one step, which
        fails if that version is there already.
        """
        aside = f"staged/{uuid.uuid4().hex}"
        shards.select("shard", "batch", "tier", "n_rows", "bytes", "file", "columns").write.parquet(f"{self.root}/{aside}")
        self._fs.mkdirs(self._path("manifest"))
        to = self._path(f"manifest/v{version:08d}")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf)
        options = self._spark_array(self._jvm.org.apache.hadoop.fs.Options.Rename)
        try:
            files.rename(self._path(aside), to, options)
        except Py4JJavaError as e:
            if self._fs.exists(to):
                self._fs.delete(self._path(aside), True)
                raise ConflictError(f"version {version} is already committed") from e
            raise
        return version

    def _spark_array(self, kind):
        return self.spark.sparkContext._gateway.new_array(kind, 0)

    @staticmethod
    def _shard(path: Column, batch: Column) -> Column:
        name = F.regexp_extract(path, r"part-(\d+)", 1)
        piece = F.regexp_extract(path, r"-c(\d+)\.[^/]*$", 1)
        return F.concat(batch, F.lit("/part-"), name, F.lit("-"), piece)

    def _read(self, files: list[str], schema) -> DataFrame:
        """Rows of batches or single files with ``_shard``, ``_batch``,
        ``_file`` and ``_bytes``; columns are called ``_c0`` and so on here, so
        that names can't clash.  A column that a file lacks is null.
        """
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in files])
        path = F.col("_metadata.file_path")
        batch = F.regexp_extract(path, r"/data/([^/]+)/[^/]*$", 1)
        name = F.regexp_extract(path, r"/data/([^/]+/[^/]*)$", 1)
        return rows.select(*[quoted(c).alias(f"_c{i}") for i, c in enumerate(schema.names)], self._shard(path, batch).alias("_shard"), batch.alias("_batch"), name.alias("_file"), F.col("_metadata.file_size").alias("_bytes"))

    @staticmethod
    def _named(schema, *without: str) -> list[Column]:
        """The columns of ``_read`` by their own names."""
        return [F.col(f"_c{i}").alias(c) for i, c in enumerate(schema.names) if c not in without]

    def _columns(self, shards: DataFrame) -> StructType:
        """All columns of some shards, those of the oldest batch first."""
        per = shards.groupBy("columns").agg(F.min(F.substring_index("batch", "-", -1)).alias("b")).orderBy("b", "columns").collect()  # one for each set of columns
        return merged_columns([StructType.fromJson(json.loads(r["columns"])) for r in per])

    def _listed(self, batch: str, schema: StructType) -> DataFrame:
        """Manifest rows of a batch, read from its files' footers."""
        per = self._read([batch], schema).groupBy("_shard", "_batch", "_file", "_bytes").agg(F.count("*").alias("n_rows"))
        return per.select(F.col("_shard").alias("shard"), F.col("_batch").alias("batch"), self.tiers.tier(F.col("_bytes")).alias("tier"), "n_rows", F.col("_bytes").alias("bytes"), F.col("_file").alias("file"), F.lit(schema.json()).alias("columns"))

    def append(self, docs: DataFrame) -> int:
        """Append ``docs`` as small shards and commit; an empty frame commits a
        version without new shards.  Returns the version.

        Arrivals may have different columns; those that one lacks are null in
        its rows.  A column of another type than the store has by that name,
        or of a name that differs only by case, is refused with ValueError.
        """
        version = self.version() + 1
        batch = f"arrival-{version:08d}"
        manifest = self.manifest(version - 1)
        merged_columns([self._columns(manifest), docs.schema])
        docs.write.option("maxRecordsPerFile", self.tiers.arrival_rows).option("compression", "zstd").parquet(f"{self.root}/data/{batch}")
        return self._commit(manifest.unionByName(self._listed(batch, docs.schema).where("n_rows > 0")), version)

    def plan(self, manifest: DataFrame) -> DataFrame:
        """``(shard, batch, grp)`` of the shards to rewrite, groups numbered
        from 0: neighbours of a tier, in name order, up to the target size.
        """
        t = self.tiers
        open_ = manifest.where(F.col("bytes") < t.target_bytes / 2)
        lanes = F.ceil(F.count("*").over(Window.partitionBy("tier")) / t.lane_shards)
        open_ = open_.withColumn("lane", F.pmod(F.xxhash64("shard"), lanes))
        before = Window.partitionBy("tier", "lane").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        open_ = open_.withColumn("run", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / t.target_bytes))
        runs = open_.groupBy("tier", "lane", "run").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
        runs = runs.where((F.col("n") > 1) & ((F.col("n") >= t.fanout) | (F.col("total") >= t.target_bytes / 2)))
        runs = runs.withColumn("grp", (F.row_number().over(Window.orderBy("tier", "lane", "run")) - 1).cast("int"))
        return open_.join(runs, ["tier", "lane", "run"]).select("shard", "batch", "grp")

    def compact(self) -> int:
        """Merge until no tier has a group worth merging; one commit a round.
        Every round leaves fewer shards, so it ends.  Returns the version.
        """
        while True:
            version = self.version()
            manifest = self.manifest(version)
            plan = self.plan(manifest).persist()
            groups = plan.agg(F.max("grp")).first()[0]
            if groups is None:
                plan.unpersist()
                return version
            batch = f"merge-{version + 1:08d}"
            chosen = manifest.join(plan.select("shard", "grp"), "shard")
            schema = self._columns(chosen)
            moved = plan.select(F.col("shard").alias("_shard"), F.col("grp").alias("_grp"))
            files = [r[0] for r in chosen.select("file").collect()]  # names of the small shards alone
            rows = self._read(files, schema).join(moved, "_shard")
            rows = rows.repartitionById(groups + 1, F.col("_grp")).select(*self._named(schema))
            if self.order_col and self.order_col in schema.names:
                rows = rows.sortWithinPartitions(quoted(self.order_col))
            rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{batch}")
            kept = manifest.join(plan, "shard", "left_anti")
            self._commit(kept.unionByName(self._listed(batch, schema).where("n_rows > 0")), version + 1)
            plan.unpersist()

    def rows(self, version: int | None = None) -> DataFrame:
        """Documents of a version, with ``_shard`` and ``_tier``; columns of
        theirs with such a name are left out.  All columns of all arrivals
        are there, null where an arrival had none.
        """
        version = self.version() if version is None else version
        manifest = self.manifest(version)
        batches = [r[0] for r in manifest.select("batch").distinct().collect()]
        if not batches:
            raise LookupError("the store has no documents")
        schema = self._columns(manifest)
        live = manifest.select(F.col("shard").alias("_shard"), F.col("tier").alias("_tier"))
        return self._read(batches, schema).join(live, "_shard").select(*self._named(schema, "_shard", "_tier"), "_shard", "_tier")

    def expire(self, keep: int = 1) -> list[str]:
        """Forget all but the last ``keep`` versions and delete the batches
        that no kept version names.  Returns the deleted batches.
        """
        versions = self.versions()
        live: set[str] = set()
        for v in versions[-keep:]:
            live |= {r[0] for r in self.manifest(v).select("batch").distinct().collect()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifest/v{v:08d}"), True)
        gone = [b for b in self._names("data") if b not in live]
        for b in gone:
            self._fs.delete(self._path(f"data/{b}"), True)
        return gone


def shard(docs: DataFrame, root: str, tiers: Tiers | None = None, order_col: str | None = None) -> DataFrame:
    """Append ``docs`` to a store at ``root``, compact it, and return each
    document's row with ``_shard`` and ``_tier`` as the last version has it.

    Every row is kept as it is, nulls, repeats and other columns included,
    whatever their names; ``_shard`` and ``_tier`` of ``docs`` itself are
    stored but replaced in the result.  An empty frame has no rows.  Shards
    that are merged are sorted by ``order_col`` if it is given.
    """
    store = ShardStore(docs.sparkSession, root, tiers, order_col)
    store.append(docs)
    store.compact()
    store.expire()
    if store.manifest().isEmpty():
        kept = [quoted(c) for c in docs.columns if c not in ("_shard", "_tier")]
        return docs.limit(0).select(*kept, F.lit("").alias("_shard"), F.lit(0).alias("_tier"))
    return store.rows()
