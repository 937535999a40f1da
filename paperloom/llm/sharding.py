"""Shards of a table with size-tiered compaction and versioned manifests, in DataFrame operations only.

A store is a folder with data/<run>/ (immutable Parquet files, the shards) and manifest/v=<n>/ (a row per live shard).
Arrivals are appended as small shards; compaction merges shards of one size tier into files of the target size; each
of the two writes its files first and then commits the next manifest by one rename, which fails if another writer has
taken the version. Readers see the files of one manifest only.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Target bytes of a merged file, the factor between size tiers, and how many shards of a tier call for a merge.
TARGET_BYTES = 64 << 20
TIER_FACTOR = 4
FANOUT = 4
#: Rows of an arriving shard at most.
ARRIVAL_ROWS = 4096
#: Shards that one round of compaction merges at most (their paths are the file index of its read); the next round
#: goes on with the rest.
ROUND_SHARDS = 20_000
#: Seconds for which vacuum() spares a run that no version holds: a writer may be about to commit it.
GRACE = 86_400

MANIFEST = "shard string, run string, shard_rows bigint, shard_bytes bigint, tier int"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """A store in a folder that all executors reach. One object may be used by one writer at a time; any number of
    writers may race, of whom one wins each version and the others get Conflict and leave the manifest as it was.

    Rows are kept as they are: nulls in any column, empty and very long texts and repeated rows come back whole, and any
    column names will do. A merged file is bounded by its bytes, so very long texts make files of few rows. Empty
    arrivals add no shard. The commit needs a file system whose rename is atomic (HDFS, a local disk); an object store
    needs a commit of its own, such as a conditional put."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, arrival_rows: int = ARRIVAL_ROWS):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.arrival_rows = target_bytes, fanout, arrival_rows

    # --- files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The last committed version; 0 for an empty store."""
        files, path = self._path("manifest")
        if not files.exists(path):
            return 0
        return max([int(s.getPath().getName()[2:]) for s in files.listStatus(path) if s.getPath().getName().startswith("v=")], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """A row per live shard of a version; the last one by default."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={version:08d}")

    def _commit(self, shards: DataFrame, version: int) -> int:
        """Write the manifest beside its place and move it there: the rename is the commit."""
        name = f"staging/{uuid.uuid4().hex}"
        shards.select("shard", "run", "shard_rows", "shard_bytes", "tier").coalesce(1).write.parquet(f"{self.root}/{name}")
        files, source = self._path(name)
        _, folder = self._path("manifest")
        files.mkdirs(folder)
        _, target = self._path(f"manifest/v={version:08d}")
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without overwriting: fails if the version is there
            context.rename(files.makeQualified(source), files.makeQualified(target), options)
        except Py4JJavaError as error:
            files.delete(source, True)
            if not files.exists(target):
                raise
            raise Conflict(f"version {version} is taken") from error
        return version

    def _shards_of(self, run: str) -> DataFrame:
        """The shards of a run: rows are counted from the files' footers, sizes come with the scan."""
        read = self.spark.read.parquet(f"{self.root}/data/{run}")
        found = read.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("shard_bytes")).agg(F.count(F.lit(1)).alias("shard_rows"))
        name = F.regexp_extract("path", rf"data/({run}/.*)$", 1)
        return found.select(name.alias("shard"), F.lit(run).alias("run"), "shard_rows", "shard_bytes", self._tier().alias("tier"))

    def _tier(self):
        """0 for the smallest; a shard of half the target or more is in the last tier, which is not merged again."""
        steps = F.floor(F.log(float(TIER_FACTOR), F.lit(self.target_bytes / 2.0) / F.col("shard_bytes")))
        return F.when(F.col("shard_bytes") * 2 >= self.target_bytes, 99).otherwise(98 - F.least(steps, F.lit(98))).cast("int")

    # --- operations

    def append(self, rows: DataFrame) -> int:
        """Write arrivals as they are partitioned, in shards of at most arrival_rows rows: nothing is shuffled. An
        empty arrival commits a version with the same shards. The store's columns are those of its first arrival."""
        version = self.version()
        run = f"a{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        writer = rows.write.option("maxRecordsPerFile", self.arrival_rows).option("compression", "zstd")
        writer.parquet(f"{self.root}/data/{run}")
        return self._commit(self.manifest(version).unionByName(self._shards_of(run)), version + 1)

    def plan(self) -> DataFrame:
        """Shards to merge, with the file that each goes to: in every tier of `fanout` shards or more, shards in the
        order of their names fill files up to the target size."""
        tiers = Window.partitionBy("tier")
        before = Window.partitionBy("tier").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        small = self.manifest().where("tier < 99").withColumn("shards", F.count(F.lit(1)).over(tiers))
        start = F.coalesce(F.sum("shard_bytes").over(before), F.lit(0))
        small = small.where(F.col("shards") >= self.fanout).withColumn("part", F.floor(start / self.target_bytes))
        return small.select("shard", "tier", "part", F.dense_rank().over(Window.orderBy("tier", "part")).alias("file"))

    def compact(self) -> int:
        """Merge until no tier calls for it; the version. Each round reads the shards of its plan once, sends the rows
        of a file to one task (rows of a file are bounded by the target size) and commits. Old files stay readable for
        old versions until vacuum(). Every round leaves fewer shards, so the rounds end."""
        while True:
            version, run = self.version(), f"c{uuid.uuid4().hex[:12]}"
            planned = staged(self.plan().orderBy("file", "shard").limit(ROUND_SHARDS), "merges")
            plan = planned.collect()  # ROUND_SHARDS rows at most, as the file index of the read below
            files = len({r["file"] for r in plan})
            if files >= len(plan):
                return version
            paths = [f"{self.root}/data/{r['shard']}" for r in plan]
            rows = self.spark.read.parquet(*paths)
            names = rows.columns
            taken = {n.lower() for n in names}
            shard, file = (next(x for x in (f"{k}_{i}" for i in range(len(names) + 1)) if x not in taken) for k in ("shard", "file"))
            targets = planned.select(F.col("shard").alias(shard), F.col("file").alias(file))
            rows = rows.select(*(F.col(f"`{n}`") for n in names), F.regexp_extract(F.col("_metadata.file_path"), r"data/([^/]+/[^/]+)$", 1).alias(shard))
            rows = rows.join(F.broadcast(targets), shard).repartitionById(files, F.col(file) - 1)
            rows.select(*(F.col(f"`{n}`") for n in names)).write.option("compression", "zstd").parquet(f"{self.root}/data/{run}")
            merged = self._shards_of(run)
            rest = self.manifest(version).join(planned.select("shard"), "shard", "left_anti")
            self._commit(rest.unionByName(merged), version + 1)

    def vacuum(self, grace: float = GRACE) -> None:
        """Delete runs of which the last version holds no shard and that were last changed `grace` seconds ago or more
        (readers of older versions must be done; a younger run may be one that a writer is about to commit)."""
        live = {r["run"] for r in self.manifest().select("run").distinct().collect()}
        files, path = self._path("data")
        for status in files.listStatus(path) if files.exists(path) else []:
            old = status.getModificationTime() <= (time.time() - grace) * 1000 + 1
            if status.getPath().getName() not in live and (old or not grace):
                files.delete(status.getPath(), True)

    def read(self, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """The rows of a version, with the column shard if asked for (a column of that name is then replaced)."""
        paths = [f"{self.root}/data/{r['shard']}" for r in self.manifest(version).select("shard").collect()]
        if not paths:
            raise ValueError("the store has no shards")
        rows = self.spark.read.parquet(*paths)
        if with_shard:
            rows = rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"data/([^/]+/[^/]+)$", 1))
        return rows
