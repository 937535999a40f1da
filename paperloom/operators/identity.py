"""Paragraph identity, source-map indexes and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SCHEME = "composite-anchor-v1"


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: str = "word/document.xml") -> DataFrame:
    """Lines of a text as paragraphs: ordinal from 0, structural path with a 1-based index among paragraphs."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("ordinal", "text"))
    path = T.build_path(F.lit("/w:document/w:body"), F.lit("p"), F.col("ordinal") + 1)
    return lines.select(id_col, F.lit(part).alias("part"), "ordinal", path.alias("path"), F.lit(None).cast("string").alias("para_id"), "text")


def with_ordinals(nodes: DataFrame, parent: list[str], name: str, order: list[str]) -> DataFrame:
    """Index of each node among its parent's children of one name: ordinal from 0, and the 1-based index."""
    n = F.row_number().over(Window.partitionBy(*parent, name).orderBy(*order))
    return nodes.withColumn("ordinal", n - 1).withColumn("sibling", n)


def anchored(nodes: DataFrame, kind: str = "p") -> DataFrame:
    """Add the anchor and identity of nodes (part, path, para_id, text): norm, quote, digest, semantic_id, pointer,
    norm_chars, selectors, weak."""
    return nodes.select(
        "*",
        T.normalize_text("text").alias("norm"),
        T.quote("text").alias("quote"),
        T.node_digest(F.lit(kind), "text").alias("digest"),
        T.semantic_id("part", F.lit(kind), "para_id", "path").alias("semantic_id"),
        T.pointer("part", "path").alias("pointer"),
    ).withColumns(
        {
            "norm_chars": F.char_length("norm"),
            "selectors": T.selector_count("para_id", "path", "quote"),
            "weak": T.is_weak("para_id", "path", "quote"),
        }
    )


def pointers_by_id(entries: DataFrame) -> DataFrame:
    """Semantic id to its distinct pointers, sorted."""
    return entries.groupBy("semantic_id").agg(F.sort_array(F.collect_set("pointer")).alias("pointers"))


def id_by_pointer(entries: DataFrame) -> DataFrame:
    """Pointer to the first of its ids."""
    return entries.groupBy("pointer").agg(F.min("semantic_id").alias("semantic_id"))


def ids_by_digest(entries: DataFrame, within: list[str]) -> DataFrame:
    """Digest to the distinct ids of the nodes of one document that have it, sorted, and how many nodes these are. Lists
    stay within a document: the empty paragraph, say, is in nearly all of them."""
    return entries.groupBy("digest", *within).agg(F.sort_array(F.collect_set("semantic_id")).alias("ids"), F.count(F.lit(1)).alias("n"))


def unique_sorted(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias(out))


def fingerprints(facets: DataFrame, by: list[str], scheme: str = SCHEME) -> DataFrame:
    """SHA-256 of a document: scheme, U+0001, and its rows id NUL digest NUL style NUL level sorted and joined by
    U+0002; absent style and level are empty. Rows of one document gather in one group, as its text did."""
    row = T.joined(F.col("semantic_id"), F.col("digest"), F.coalesce("style_id", F.lit("")), F.coalesce(F.col("level").cast("string"), F.lit("")))
    text = F.array_join(F.sort_array(F.collect_list(row)), "\x02")
    return facets.groupBy(*by).agg(F.sha2(F.concat(F.lit(scheme + "\x01"), text), 256).alias("fingerprint"))


def map_violations(entries: DataFrame, index: DataFrame, nodes: DataFrame) -> DataFrame:
    """Source-map check, as rows (problem, key): pointers that two ids claim, entries of missing nodes, entries that
    the index does not give back."""
    claimed = entries.groupBy("pointer").agg(F.count_distinct("semantic_id").alias("n")).where("n > 1").select(F.lit("claimed-twice").alias("problem"), F.col("pointer").alias("key"))
    missing = entries.join(nodes.select("pointer").distinct(), "pointer", "left_anti").select(F.lit("missing-node"), "pointer")
    lost = entries.join(index, ["semantic_id", "pointer"], "left_anti").select(F.lit("not-in-index"), "pointer")
    return claimed.union(missing).union(lost).distinct()


def identity_violations(nodes: DataFrame, kind: str = "p") -> DataFrame:
    """Nodes whose stored id is not the one recomputed from part, native id and path."""
    again = T.semantic_id("part", F.lit(kind), "para_id", "path")
    return nodes.where(F.col("semantic_id") != again)


def semantic_problems(nodes: DataFrame) -> DataFrame:
    """(problem, key): ids of two nodes, heading levels outside 1..9, tables without rows."""
    twice = nodes.groupBy("semantic_id").count().where("count > 1").select(F.lit("duplicate-id").alias("problem"), F.col("semantic_id").alias("key"))
    levels = nodes.where("level IS NOT NULL AND NOT level BETWEEN 1 AND 9").select(F.lit("level-range"), "semantic_id")
    empty = nodes.where("kind = 'tbl' AND coalesce(n_rows, 0) = 0").select(F.lit("empty-table"), "semantic_id")
    return twice.union(levels).union(empty)
