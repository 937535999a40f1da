"""The corpus pipeline: documents to sampled piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next one. All but the last return the columns of documents, with any extra columns that came, whatever their
names. An empty table passes through all stages. Null texts count as empty. Rows that repeat an id are decided by their
texts, as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import exact_dedup, minhash, mixing, quality, sentencepiece_sampling
from paperloom.llm.common import free, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of its input, scores 0.3 or more.
    Empty and null texts are scored like others; of rows that repeat an id each is scored by its own text."""
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, trees)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest id,
    null ids last. All empty, white and null texts are one group; of rows that repeat an id and a text one stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id, null ids last. Documents without words (empty,
    white, null) have no copies and stay; of rows that repeat an id and a set of shingles one stays."""
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row for each time that a document is taken, the last one perhaps cut. Documents
    without words take nothing of a budget and are not in the mix; a null source is a source of its own, the last."""
    return mixing.mix(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text and the ids of a sampled segmentation, for each row of the mix. Repeated rows get the same sample,
    as the draw is seeded by the row's key; a null text has no ids."""
    return sentencepiece_sampling.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("sentencepiece", sample_pieces),
]

#: The classifier and the sampled segmentations are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
