"""Queries that write to a store of their own, in two batches each, and tell what became of every row of the second."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..scratch import scratch_folder
from ..sources.store import ArtifactStore
from .base import query, table


def _store(spark):
    return ArtifactStore(spark, scratch_folder(spark, "paperloom-stores"))


@query("""SELECT doc_id::VARCHAR || '.json' AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes, length(text)::INT AS n_chars, CASE WHEN text IS NULL THEN 'ARTIFACT_UNAVAILABLE' END AS issue,
  CASE WHEN doc_id IS NULL THEN 'application/octet-stream' ELSE 'application/json' END AS media_type FROM documents""")
def store_objects(spark, sf):
    store = _store(spark)
    files = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    store.write(files.where("doc_id % 2 = 0"))
    got = store.read(store.write(files))
    return got.select("path", "sha256", "size_bytes", F.length(F.decode("content", "UTF-8")).alias("n_chars"), "issue", "media_type")


@query("""WITH r AS (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 7 = 0 THEN ['v1', 'v2'] WHEN o_orderkey % 5 = 0 THEN ['v2'] ELSE ['v1'] END) AS v FROM orders)
SELECT o_orderkey::VARCHAR AS key, v AS sha256, CASE WHEN o_orderkey % 3 = 0 AND v = 'v1' THEN 'same' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'VERSION_CONFLICT' ELSE 'committed' END AS outcome FROM r""")
def store_keys(spark, sf):
    store, k = _store(spark), F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(k, k.cast("string").alias("key"))
    store.publish(orders.where(k % 3 == 0).select("key", F.lit("v1").alias("sha256")))
    digests = F.when(k % 7 == 0, F.array(F.lit("v1"), F.lit("v2"))).when(k % 5 == 0, F.array(F.lit("v2"))).otherwise(F.array(F.lit("v1")))
    return store.publish(orders.select("key", F.explode(digests).alias("sha256")))


@query("""WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision FROM orders),
b AS (SELECT *, sum(CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY revision ROWS UNBOUNDED PRECEDING) AS broken FROM m)
SELECT 'c' || o_custkey AS document_id, revision::BIGINT AS revision, CASE WHEN broken > 0 THEN 'VERSION_CONFLICT' WHEN revision <= 3 THEN 'same' ELSE 'committed' END AS outcome FROM b""")
def store_manifests(spark, sf):
    store, mine = _store(spark), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    parent = F.when(F.col("o_orderkey") % 20 == 0, "none").otherwise(F.lag(digest).over(mine))
    asked = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("document_id"), F.row_number().over(mine).alias("revision"), digest.alias("sha256"), parent.alias("parent_sha256")
    )
    store.commit_manifests(asked.where("revision <= 3"))
    return store.commit_manifests(asked).select("document_id", "revision", "outcome")
