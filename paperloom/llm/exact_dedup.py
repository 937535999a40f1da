"""Exact de-duplication: 128-bit content hash, then bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, free, hot_of, small, spread_join, staged


def body_of(text):
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts, one row per input row: <id>, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space. Rows meet by the MD5 of that form (128 bits); the bytes
    of every member of a group are then compared with those of the group's first row, and groups in which they differ
    are split by the bytes themselves. The row with the most code points stays, then the one with the smallest id
    (null ids last). Null texts count as empty, so all empty and white texts form one group. Rows that repeat an id and
    a text all carry kept = true; `drop_exact_copies` leaves one of them. An empty table gives no rows; other columns
    are ignored.

    Ids and hashes are shuffled for grouping; a hash that many rows share is dealt over many tasks. Only texts of groups
    of two or more are read again for the comparison, and each task hands on one copy of a text. The rows to read are
    found by a list of their keys, broadcast while it is small; beyond that the join shuffles the texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("rk"))
    hashed = rows.select("id", "rk", F.char_length("text").alias("points"), body_of(F.col("text")).alias("body"))
    keyed = staged(hashed.select("id", "rk", "points", F.unhex(F.md5("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("sha")), "keyed")
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id")))
    groups = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), first.alias("best"))
    groups = staged(groups.select("h", "rows", F.col("best.id").alias("keep_id")), "groups")
    hot = staged(hot_of(groups, "h", keyed.count()), "hot")
    parts = spread_join(keyed, groups.withColumnRenamed("rows", "group_size"), "h", hot)
    parts = staged(parts.select("id", "rk", "points", "h", "sha", "keep_id", "group_size"), "parts")
    free(keyed, groups)
    again = staged(parts.where("group_size > 1").select("rk").distinct(), "again")
    members = rows.join(small(again), "rk", "left_semi").select(body_of(F.col("text")).alias("body"))
    texts = members.groupBy(F.unhex(F.md5("body")).alias("h")).agg(F.collect_set("body").alias("texts"))
    clashes = staged(texts.where(F.size("texts") > 1).select("h"), "clashes")
    free(again)
    if clashes.limit(1).count():
        parts = parts.drop("rk").join(clashes, "h", "left_anti").unionByName(_by_bytes(hashed.drop("rk"), clashes, first))
    return parts.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _by_bytes(rows: DataFrame, clashes: DataFrame, first) -> DataFrame:
    """The same for hashes that different texts share: groups by the bytes."""
    rows = rows.withColumn("h", F.unhex(F.md5("body"))).join(clashes, "h", "left_semi")
    groups = rows.groupBy("h", "body").agg(F.count(F.lit(1)).alias("group_size"), first.alias("best"))
    groups = groups.select("h", "body", "group_size", F.col("best.id").alias("keep_id"))
    return rows.join(groups, ["h", "body"]).select(
        "id", "points", "h", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each group of equal texts."""
    groups = staged(exact_groups(docs, id_col, text_col).select(id_col, "kept", "text_sha256"), "decided")

    def longest(rows: DataFrame) -> DataFrame:
        best = groups.where("kept").select(F.col(id_col).alias("paperloom_best"), F.col("text_sha256").alias("paperloom_key")).distinct()
        rows = rows.withColumn("paperloom_key", F.sha2(body_of(F.col(text_col)), 256)).join(best, "paperloom_key")
        return longest_rows(rows.where(F.col(id_col).eqNullSafe(F.col("paperloom_best"))), "paperloom_key", docs.columns, text_col)

    return keep_rows(docs, groups.select(id_col, "kept"), id_col, longest)


def longest_rows(rows: DataFrame, key: str, columns: list[str], text_col: str) -> DataFrame:
    """Of each key the row with the longest text, of equally long ones that with the largest."""
    size = F.struct(F.char_length(F.coalesce(F.col(text_col), F.lit(""))), F.col(text_col))
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), size).alias("paperloom_row")).select("paperloom_row.*")


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str, pick) -> DataFrame:
    """Rows of docs that stay; decided holds (<id>, kept) for each row of docs.

    The usual case, ids that occur once, is one anti-join with the dropped ids: small lists are broadcast by their
    written size, longer ones shuffled. An id of more rows than one, null being one id, does not tell which of its rows
    stays: those rows go through `pick`, which decides by their texts and gives the ones that stay.
    """
    rid = F.col(id_col).alias("paperloom_rid")
    again = staged(decided.groupBy(rid).count().where("count > 1").select("paperloom_rid"), "again")
    same = F.col(id_col).eqNullSafe(F.col("paperloom_rid"))
    dropped = staged(decided.where("NOT kept").select(rid).distinct(), "dropped")
    rest = docs.join(small(dropped), same, "left_anti")
    if not again.limit(1).count():
        return rest
    once = rest.join(again, same, "left_anti")
    return once.unionByName(pick(docs.join(again, same, "left_semi")))
