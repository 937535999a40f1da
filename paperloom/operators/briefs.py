"""Outlines, targets, histories, lists and reference plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TARGETS, HISTORY, CHANGES = 40, 10, 10
TABLE_MM = 152.0


def outline(blocks: DataFrame, by: list[str], order: str) -> DataFrame:
    """Headings in document order: position, level, text, parent (position of the nearest heading above it in rank)."""
    mine = Window.partitionBy(*by).orderBy(order)
    heads = blocks.where("level IS NOT NULL").withColumn("position", F.row_number().over(mine))
    above = mine.rowsBetween(Window.unboundedPreceding, -1)
    parents = [F.last(F.when(F.col("level") == k, F.col("position")), ignorenulls=True).over(above) for k in range(1, 9)]
    out = heads.select("*", *[p.alias(f"_l{k + 1}") for k, p in enumerate(parents)])
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, 9)])
    return out.withColumn("parent", parent).drop(*[f"_l{k}" for k in range(1, 9)])


def outline_lines(heads: DataFrame, by: list[str]) -> DataFrame:
    """The outline as text: two blanks for each level below the first, and a mark on levels that were inferred."""
    mark = F.when(F.col("level_source") != "outlineLevel", " (inferred)").otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), T.snippet("text"), mark)
    return heads.withColumn("line", line).groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("outline")
    )


def targets(nodes: DataFrame, by: list[str], order: list[str], limit: int = TARGETS) -> DataFrame:
    """The first `limit` nodes of each document with the number of all."""
    mine = Window.partitionBy(*by)
    ranked = nodes.withColumn("rank", F.row_number().over(mine.orderBy(*order))).withColumn("of", F.count(F.lit(1)).over(mine))
    return ranked.where(F.col("rank") <= limit)


def recent(entries: DataFrame, by: list[str], revision: str, limit: int = HISTORY) -> DataFrame:
    """The last entries of each document, oldest first by position."""
    mine = Window.partitionBy(*by)
    last = entries.withColumn("_r", F.row_number().over(mine.orderBy(F.desc(revision)))).where(F.col("_r") <= limit).drop("_r")
    return last.withColumn("position", F.row_number().over(mine.orderBy(revision)))


def brief(documents: DataFrame, by: list[str], empty: str = "-") -> DataFrame:
    """One text a document from its sections title, outline, targets, history and directive (columns), each with its
    heading, absent ones as a dash."""
    part = lambda name: F.concat(F.lit(f"# {name}\n"), F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(empty)))
    return documents.select(*by, F.concat_ws("\n\n", *[part(n) for n in ("title", "outline", "targets", "history", "directive")]).alias("brief"))


def dominant_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """The run of the longest text (the first of equals) and the largest size."""
    return runs.groupBy(*by).agg(F.max_by("run", F.struct(F.char_length("text"), -F.col("pos"))).alias("dominant"), F.max("size").alias("largest_size"))


def plan_blocks(blocks: DataFrame, known_styles: DataFrame) -> DataFrame:
    """Blocks as a creation plan carries them: other kinds are skipped, unknown styles become Normal, all-bold
    paragraphs of the document's largest size Title and other all-bold ones Heading1; list levels are 1 to 3."""
    known = known_styles.select("style_id").distinct().withColumn("known", F.lit(True))
    out = blocks.join(known, "style_id", "left")
    style = (
        F.when(F.coalesce("all_bold", F.lit(False)), F.when(F.col("max_size") == F.col("doc_size"), "Title").otherwise("Heading1"))
        .when(F.col("known"), F.col("style_id"))
        .otherwise("Normal")
    )
    level = F.when(F.col("list_level").isNotNull(), T.clamp(T.half_up("list_level"), 1, 3))
    return out.withColumn("carried", F.col("kind").isin("paragraph", "heading", "table")).withColumn("plan_style", style).withColumn("plan_level", level).drop("known")


def column_widths(total_mm, columns):
    return F.round(total_mm / columns, 1)


def longest_by_key(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """For each cell named by its pointer (table, row, cell) the format of its longest paragraph, the last of equals."""
    key = lambda tag: F.regexp_extract("pointer", rf"/w:{tag}\[(\d+)\]", 1).cast("int")
    cells = paragraphs.withColumns({"tbl": key("tbl"), "tr": key("tr"), "tc": key("tc")}).where("tc IS NOT NULL")
    return cells.groupBy(*by, "tbl", "tr", "tc").agg(F.max_by("format", F.struct(F.char_length("text"), key("p"), F.col("pointer"))).alias("format"))


def note_order(ref):
    """Sort key of note ids: numbers first by value, then texts."""
    number = T.int_or(ref)
    return F.struct(number.isNull().alias("text"), number.alias("number"), F.col(ref).alias("ref"))
