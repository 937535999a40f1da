"""Content-addressed artifacts and chains of delivery manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .integrity import resolve_chain


def artifact_refs(files: DataFrame) -> DataFrame:
    """References of file bytes (path, content): identity is the SHA-256; equal bytes are one artifact."""
    sha = F.sha2("content", 256)
    refs = files.select(F.concat(F.lit("sha256:"), sha).alias("artifact_id"), "path", F.length("content").cast("bigint").alias("size_bytes"), sha.alias("sha256"))
    return refs.groupBy("artifact_id", "size_bytes", "sha256").agg(F.min("path").alias("uri"))


def new_artifacts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What a content-addressed store has yet to write."""
    return incoming.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti")


def publish_conflicts(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Writes by key: same bytes are idempotent, other bytes a conflict, a free key new."""
    met = incoming.join(stored.select(*keys, F.col("sha256").alias("stored_sha")), keys, "left")
    outcome = F.when(F.col("stored_sha").isNull(), "new").when(F.col("stored_sha") == F.col("sha256"), "same").otherwise("conflict")
    return met.withColumn("outcome", outcome)


def chain_status(manifests: DataFrame, by: list[str]) -> DataFrame:
    """Status of each manifest (revision, sha256, parent_sha256) against the one before: revision 1 has no parent, each
    other follows the revision before it with that one's digest."""
    mine = Window.partitionBy(*by).orderBy("revision")
    before_rev, before_sha = F.lag("revision").over(mine), F.lag("sha256").over(mine)
    status = (
        F.when(F.col("revision") == 1, F.when(F.col("parent_sha256").isNull(), "ok").otherwise("parent-of-first"))
        .when(F.col("parent_sha256").isNull(), "no-parent")
        .when(before_rev.isNull() | (before_rev != F.col("revision") - 1), "gap")
        .when(before_sha != F.col("parent_sha256"), "digest")
        .otherwise("ok")
    )
    return manifests.withColumn("status", status)


def walk_chain(manifests: DataFrame, depth: int = 500) -> DataFrame:
    """Manifests whose parents lead to revision 1 one by one, over digests: (document_id, revision, sha256, depth). It is
    for stores that hold some revisions only; chain_status needs one window where all are there. Walks are doubled in
    length each round (see resolve_chain), so a chain of 500 takes ten joins."""
    first = (F.col("revision") == 1) & F.col("parent_sha256").isNull()
    up = F.when((F.col("revision") > 1) & F.col("parent_sha256").isNotNull(), F.struct((F.col("revision") - 1).cast("long").alias("revision"), F.col("parent_sha256").alias("sha256")))
    nodes = manifests.select("document_id", F.struct(F.col("revision").cast("long").alias("revision"), "sha256").alias("style_id"), up.alias("based_on"), F.when(first, 1).alias("root"))
    found = resolve_chain(nodes, ["document_id"], "root", depth - 1).where("root IS NOT NULL")
    return found.select("document_id", "style_id.revision", "style_id.sha256", (F.col("hops") + 1).alias("depth"))


def review_state(findings: DataFrame, reviews: DataFrame, manifests: DataFrame, every_page: bool = False) -> DataFrame:
    """failed if any finding is an error, reviewed if a review is there (every_page: for each page), else pending."""
    bad = findings.where("severity = 'error'").select("document_id").distinct().withColumn("bad", F.lit(True))
    seen = reviews.groupBy("document_id").agg(F.count_distinct("page").alias("seen"))
    out = manifests.join(bad, "document_id", "left").join(seen, "document_id", "left")
    enough = F.coalesce("seen", F.lit(0)) >= (F.col("page_count") if every_page else F.lit(1))
    return out.withColumn("review", F.when(F.col("bad"), "failed").when(enough, "reviewed").otherwise("pending")).drop("bad", "seen")


def preview_gaps(previews: DataFrame, manifests: DataFrame) -> DataFrame:
    """Previews that are not exactly pages 1..n, or are bound to other bytes than the manifest's."""
    pages = previews.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("distinct"), F.min("page").alias("low"), F.max("page").alias("high"), F.collect_set("source_sha256").alias("sources")
    )
    out = manifests.join(pages, "document_id", "left")
    sequence = (F.col("n") == F.col("page_count")) & (F.col("distinct") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("page_count"))
    stale = F.exists("sources", lambda s: s != F.col("sha256"))
    problem = F.when(F.col("page_count") == 0, None).when(~F.coalesce(sequence, F.lit(False)), "pages").when(stale, "stale")
    return out.withColumn("problem", problem).where("problem IS NOT NULL").select("document_id", "problem")
