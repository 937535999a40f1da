"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, staged
from . import embedding_dedup, exact_dedup, hamerly, hard_negatives, minhash, mixing, permutation_index, quality, sentencepiece_sampling, sharding, token_counts, token_output, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_sampling.encode(table(spark, sf_dir, "documents"))
    decoded = sentencepiece_sampling.decode(encoded)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.ShardStore(spark, scratch_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum(grace=0)  # no other writer has this store
    rows = store.read(with_shard=True).select("doc_id", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    shards = rows.groupBy("shard").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("shard_rows"), F.sum("bytes").alias("shard_text_bytes"))
    numbered = shards.withColumn("shard_no", F.row_number().over(Window.orderBy("first_id", "shard")))
    return rows.join(staged(numbered, "numbered"), "shard").select("doc_id", "shard_no", "shard_rows", "shard_text_bytes")


def edits_of(text):
    """Three edits of a document: a cut in its first half, words put in its middle, and a line put at its end."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    edits = [
        (F.floor(n / 4), F.lit(20), F.lit("")),
        (F.floor(n / 2), F.lit(3), F.lit(" some new words ")),
        (n, F.lit(0), F.lit("\nThe last line.")),
    ]
    return F.array(*[F.struct(a.cast("int").alias("start"), b.alias("removed"), c.alias("inserted")) for a, b, c in edits])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits_of(F.col("text")).alias("edits"))
    trees = token_counts.build_trees(docs, keep=("edits",))
    after = token_counts.apply_edits(trees)
    return after.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "reencoded")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def held_out(folds: int, held: int):
    """Whether crc32 of doc_id as text leaves the remainder `held` by `folds`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False)).alias("held_out")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).select("doc_id", held_out(4, 2), "score", "predicted", "flagged")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS full_text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), g AS (
  SELECT doc_id, body,
    first_value(doc_id) OVER (PARTITION BY body ORDER BY length(full_text) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY body) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_output.read_tokens(spark.read.parquet(path))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (
  SELECT sk, sum(size)::BIGINT AS source_size,
    ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY sk)) - 1) % 3 + 1] AS w
  FROM t GROUP BY sk
), c AS (
  SELECT sk, source_size, w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(w) OVER (ORDER BY cap / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM c
), g AS (
  SELECT *, first_value(level) OVER (ORDER BY CASE WHEN w * level <= cap THEN 0 ELSE 1 END, cap / w, sk) AS open_level FROM l
), p AS (
  SELECT sk, source_size, least(cap, w * open_level) AS target FROM g
), q AS (
  SELECT sk, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p
), r AS (
  SELECT *, floor(target - epochs * source_size + 0.5::DOUBLE)::BIGINT AS cut FROM q
), o AS (
  SELECT t.doc_id, t.size, r.source_size, r.target, r.epochs, r.cut,
    coalesce(sum(t.size) OVER (PARTITION BY t.sk ORDER BY t.key, t.doc_id, t.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM t JOIN r USING (sk)
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, cut - start)))::BIGINT AS taken FROM o
"""

def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, trees).select("doc_id", held_out(5, 0), "score", "predicted")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shifted)


OP12_SQL = """
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM t a JOIN t b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(table(spark, sf_dir, "embeddings"))


def clusters_sql(clusters: int = hamerly.CLUSTERS, rounds: int = hamerly.ROUNDS, dim: int = hamerly.DIM) -> str:
    """The same clustering with all distances computed in each round."""
    ctes = [f"""t AS MATERIALIZED (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY key) - 1)::INTEGER AS cluster, v FROM (
    SELECT sha256('2:' || vec_id) AS key, v FROM t ORDER BY key LIMIT {clusters})
)"""]  # fmt: skip
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, t.v, c.cluster,
    (list_inner_product(t.v, t.v) - 2 * list_inner_product(t.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS distance
  FROM t CROSS JOIN c{k} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c.cluster) = 1
)""")
        ctes.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS v FROM (
      SELECT cluster, i, floor(sum(x) / count(*)) AS m
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(list_aggregate([(x::BIGINT)::VARCHAR for x in c.v], 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_output": op7_token_output,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_nearest": op11_nearest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_clusters": op13_clusters,
}
ORACLE: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op9_mixing": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_clusters": clusters_sql()}
