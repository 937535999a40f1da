"""A store that writes: objects by their content, keys that are written once, chains of manifests.

Everything below a root that driver and executors share is added by one rename of a finished folder, never changed: a
lost executor costs a task, a lost driver leaves a staging folder that nobody reads. Logs have numbered versions, and the
rename to a version that is there fails, so of two writers one decides again against what the other has committed. An
object store without such a rename needs another commit. All decisions are joins and windows; no row comes to the driver.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Media types by extension, fixed values.
MEDIA_TYPES = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".json": "application/json",
}
#: Names of documents that manifests may have, a fixed pattern.
DOCUMENT_ID = "^[A-Za-z0-9][A-Za-z0-9_-]{0,79}$"
#: How often a writer decides again after another was first.
TRIES = 20

_OBJECTS = "sha256 string, size_bytes bigint, content binary"
_KEYS = "key string, sha256 string"
_MANIFESTS = "document_id string, revision bigint, sha256 string, parent_sha256 string"


def _media_type(path: Column) -> Column:
    found = F.lit("application/octet-stream")
    for suffix, kind in MEDIA_TYPES.items():
        found = F.when(F.lower(path).endswith(suffix), kind).otherwise(found)
    return found


class ArtifactStore:
    """Objects, keys and manifests under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        for name in ("objects", "keys", "manifests", "staging"):
            files, path = self._path(name)
            files.mkdirs(path)

    def _path(self, name: str):
        path = self._fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files, files.makeQualified(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def _add(self, rows: DataFrame, name: str) -> bool:
        """Write rows and move them to their place; False if that place is taken."""
        staged = f"staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{staged}")
        (files, source), (_, target) = self._path(staged), self._path(name)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            self._fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)
        except Py4JJavaError:
            files.delete(source, True)
            if not files.exists(target):
                raise
            return False
        return True

    def _versions(self, name: str) -> int:
        files, path = self._path(name)
        return len(files.listStatus(path))

    def _decided(self, name: str, decide) -> DataFrame:
        """Commit the rows that decide() calls committed as the next version of a log; all rows with their outcome."""
        for _ in range(TRIES):
            version = self._versions(name)
            outcomes = written(decide())
            fresh = outcomes.where("outcome = 'committed'")
            if fresh.isEmpty() or self._add(fresh.drop("outcome"), f"{name}/v{version:08d}"):
                return outcomes
        raise RuntimeError(f"{name}: other writers were first {TRIES} times")

    # --- objects

    def write(self, files: DataFrame) -> DataFrame:
        """Store the bytes of files (path, content) and give a reference to each: path, artifact_id, sha256, size_bytes,
        media_type. Bytes that the store has, and equal bytes of several files, are written once; two writers at a time
        may both write an object, which reads count as one. A file without bytes (null) has a reference of nulls."""
        sha = F.sha2("content", 256)
        sized = files.select("path", sha.alias("sha256"), F.length("content").cast("bigint").alias("size_bytes"), "content")
        known = self._read("objects", _OBJECTS).select("sha256").distinct()
        new = sized.where("content IS NOT NULL").join(known, "sha256", "left_anti").dropDuplicates(["sha256"])
        self._add(new.select("sha256", "size_bytes", "content").sortWithinPartitions("sha256"), f"objects/{uuid.uuid4().hex}")
        return sized.select("path", F.concat(F.lit("sha256:"), "sha256").alias("artifact_id"), "sha256", "size_bytes", _media_type(F.col("path")).alias("media_type"))

    def read(self, refs: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
        """The bytes of references (sha256, size_bytes and more): content, or an issue of ARTIFACT_UNAVAILABLE,
        LIMIT_EXCEEDED and INTEGRITY_MISMATCH (bytes of another digest or size than the reference says)."""
        objects = self._read("objects", _OBJECTS).dropDuplicates(["sha256"])
        stored = objects.select("sha256", F.col("size_bytes").alias("stored_bytes"), F.col("content").alias("stored"))
        met = refs.join(stored, "sha256", "left")
        issue = (
            F.when(F.col("stored_bytes").isNull(), "ARTIFACT_UNAVAILABLE")
            .when(F.col("stored_bytes") > max_bytes, "LIMIT_EXCEEDED")
            .when((F.sha2("stored", 256) != F.col("sha256")) | (F.col("size_bytes") != F.length("stored")), "INTEGRITY_MISMATCH")
        )
        return met.withColumn("issue", issue).withColumn("content", F.when(F.col("issue").isNull(), F.col("stored"))).drop("stored", "stored_bytes")

    # --- keys

    def publish(self, entries: DataFrame) -> DataFrame:
        """Bind keys to digests (key, sha256), once for ever; every distinct entry with its outcome: committed, same (as
        stored already), VERSION_CONFLICT (the key has another digest, in the store or in this batch) or INVALID_INPUT
        (a null)."""

        def decide():
            stored = self._read("keys", _KEYS).withColumnRenamed("sha256", "stored")
            rivals = F.min("sha256").over(Window.partitionBy("key")) != F.max("sha256").over(Window.partitionBy("key"))
            met = entries.select("key", "sha256").distinct().withColumn("rivals", rivals).join(stored, "key", "left")
            outcome = (
                F.when(F.col("key").isNull() | F.col("sha256").isNull(), "INVALID_INPUT")
                .when(F.col("stored") == F.col("sha256"), "same")
                .when(F.col("stored").isNotNull() | F.col("rivals"), "VERSION_CONFLICT")
                .otherwise("committed")
            )
            return met.select("key", "sha256", outcome.alias("outcome"))

        return self._decided("keys", decide)

    # --- manifests

    def commit_manifests(self, manifests: DataFrame) -> DataFrame:
        """Add revisions (document_id, revision, sha256, parent_sha256) to the chains of documents; every distinct row
        with its outcome. Revision 1 has no parent; each other needs the revision before it, in the store or committed by
        this batch, with the digest that it names. Outcomes are as of publish(); a revision after one that is refused is
        VERSION_CONFLICT too."""
        by, each = Window.partitionBy("document_id").orderBy("revision"), Window.partitionBy("document_id", "revision")
        columns = ["document_id", "revision", "sha256", "parent_sha256"]

        def decide():
            stored = self._read("manifests", _MANIFESTS)
            asked = manifests.select("document_id", F.col("revision").cast("bigint").alias("revision"), "sha256", "parent_sha256").distinct()
            valid = F.coalesce(F.col("document_id").rlike(DOCUMENT_ID) & (F.col("revision") >= 1) & F.col("sha256").isNotNull(), F.lit(False))
            bad = asked.where(~valid).withColumn("outcome", F.lit("INVALID_INPUT"))
            both = asked.where(valid).withColumn("old", F.lit(0)).unionByName(stored.join(asked.select("document_id").distinct(), "document_id", "left_semi").withColumn("old", F.lit(1)))
            there = F.max(F.when(F.col("old") == 1, F.col("sha256"))).over(each)
            rivals = F.count(F.when(F.col("old") == 0, 1)).over(each) > 1
            seen = both.select(*columns, "old", there.alias("there"), rivals.alias("rivals"))
            chain = seen.where("old = 1 OR (there IS NULL AND NOT rivals)")
            after = (F.lag("revision").over(by) == F.col("revision") - 1) & (F.lag("sha256").over(by) == F.col("parent_sha256"))
            link = F.when(F.col("old") == 1, True).when(F.col("revision") == 1, F.col("parent_sha256").isNull()).otherwise(F.coalesce(after, F.lit(False)))
            linked = F.min(F.col("link").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
            new = chain.withColumn("link", link).withColumn("linked", linked).where("old = 0")
            fresh = new.select(*columns, F.when(F.col("linked") == 1, "committed").otherwise("VERSION_CONFLICT").alias("outcome"))
            rest = seen.where("old = 0 AND (there IS NOT NULL OR rivals)")
            known = rest.select(*columns, F.when(F.col("there") == F.col("sha256"), "same").otherwise("VERSION_CONFLICT").alias("outcome"))
            return fresh.unionByName(known).unionByName(bad)

        return self._decided("manifests", decide)
