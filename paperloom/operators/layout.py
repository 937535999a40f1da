"""Pages, boxes, sections, breaks and text spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_extents(fragments: DataFrame, by: list[str]) -> DataFrame:
    """Extent of the fragments (page, x, y, width, height) of each page."""
    return fragments.groupBy(*by, "page").agg(
        F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom")
    )


def page_infos(pages: DataFrame, extents: DataFrame, by: list[str]) -> DataFrame:
    """Pages (page, page_width, page_height) with margins inferred from extents, none below 0, and orientation."""
    m = lambda c: F.greatest(F.lit(0.0), c)
    return pages.join(extents, [*by, "page"], "left").select(
        *by, "page", "page_width", "page_height",
        m(F.col("left")).alias("margin_left"), m(F.col("top")).alias("margin_top"),
        m(F.col("page_width") - F.col("right")).alias("margin_right"), m(F.col("page_height") - F.col("bottom")).alias("margin_bottom"),
        F.when(F.col("page_width") >= F.col("page_height"), "landscape").otherwise("portrait").alias("orientation"),
    )


def primary_fragment(fragments: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """The first fragment of each block by page and y."""
    order = F.struct("page", "y", *tie)
    return fragments.groupBy(*by).agg(F.min(order).alias("f")).select(*by, "f.*")


def page_ranges(fragments: DataFrame, by: list[str]) -> DataFrame:
    """First and last page of each table and whether it spans pages."""
    out = fragments.groupBy(*by).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count_distinct("page").alias("pages"))
    return out.withColumn("spans_pages", F.col("pages") > 1)


def affine_box(x0, y0, x1, y1, matrix: list[Column]) -> Column:
    """Envelope (x0, y0, x1, y1) of a box's corners under an affine matrix; null if it is singular or overflows."""
    a, b, c, d, e, f = matrix
    xs = F.array(*[a * x + c * y + e for x in (x0, x1) for y in (y0, y1)])
    ys = F.array(*[b * x + d * y + f for x in (x0, x1) for y in (y0, y1)])
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    finite = F.abs(F.array_max(xs)) < F.lit(float("inf"))
    return F.when((a * d - b * c != 0) & finite & ~F.isnan(F.array_max(xs) + F.array_max(ys)), box)


def top_left(y0: Column, y1: Column, origin: Column, page_height: Column, stated_height: Column, tolerance: float = 0.5) -> Column:
    """Box's (y0, y1) counted from the top: bottom-left coordinates are turned round only if both sources agree on the
    page's height; null otherwise."""
    agree = F.abs(page_height - stated_height) <= tolerance
    turned = F.struct((page_height - y1).alias("y0"), (page_height - y0).alias("y1"))
    same = F.struct(y0.alias("y0"), y1.alias("y1"))
    return F.when(origin == "TOPLEFT", same).when((origin == "BOTTOMLEFT") & agree, turned)


def free_candidates(candidates: DataFrame, reserved: DataFrame, by: list[str]) -> DataFrame:
    """The first candidate zone of each subject (rank) that meets no reserved box. Boxes meet on open inequalities
    within a subject, so the join has its equality and no subject's boxes meet another's."""
    c, r = candidates.alias("c"), reserved.alias("r")
    on = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in by]
    overlap = (F.col("c.x0") < F.col("r.x1")) & (F.col("r.x0") < F.col("c.x1")) & (F.col("c.y0") < F.col("r.y1")) & (F.col("r.y0") < F.col("c.y1"))
    free = c.join(r, [*on, overlap], "left_anti")
    return free.groupBy(*by).agg(F.min("rank").alias("rank"))


def sections(ends: DataFrame, by: list[str]) -> DataFrame:
    """Section ranges: a section starts one after the end of the one before; type nextPage and one column if unstated."""
    mine = Window.partitionBy(*by).orderBy("end_block")
    start = F.coalesce(F.lag("end_block").over(mine) + 1, F.lit(0))
    columns = F.coalesce(F.nullif("n_cols", F.lit(0)), "num_cols", F.lit(1))
    return ends.select(*by, F.row_number().over(mine).alias("section"), start.alias("start_block"), "end_block", F.coalesce("type", F.lit("nextPage")).alias("type"), columns.alias("columns"))


def ordered_breaks(breaks: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Page breaks and those that sections make, in document order: a section's break comes just before its block."""
    own = breaks.select(*by, F.col("block").alias("block"), "source", F.col("block").cast("double").alias("key"))
    made = ranges.where("start_block > 0 AND type IN ('nextPage', 'evenPage', 'oddPage')")
    made = made.select(*by, F.col("start_block").alias("block"), F.lit("section").alias("source"), (F.col("start_block") - 0.5).alias("key"))
    mine = Window.partitionBy(*by).orderBy("key", "source")
    return own.union(made).withColumn("position", F.row_number().over(mine)).drop("key")


def out_of_order(nodes: DataFrame, by: list[str], position: str, order: str) -> DataFrame:
    """Nodes whose order falls below that of the node before them."""
    before = F.lag(order).over(Window.partitionBy(*by).orderBy(position))
    return nodes.withColumn("before", before).where(F.col("before") > F.col(order))


def token_runs(runs: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """Runs that each token overlaps: runs start where the ones before end; tokens are (token, start, stop)."""
    mine = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.withColumn("run_start", F.coalesce(F.sum("chars").over(mine), F.lit(0)))
    spans = spans.withColumn("run_stop", F.col("run_start") + F.col("chars"))
    met = tokens.join(spans, by).where("start < run_stop AND run_start < stop")
    return met.groupBy(*by, "token").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"))


def page_texts(items: DataFrame, by: list[str]) -> DataFrame:
    """Text of a page: its fragments in order, each with a line break if it ends a line."""
    piece = F.concat("text", F.when(F.col("eol"), "\n").otherwise(""))
    kept = items.where(F.trim("text") != "").select(*by, "pos", piece.alias("piece"))
    return kept.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("page_text"))


def islands(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Consecutive rows of equal key as one group: by.., island (from 1), key, n, first, last (by the first order column)."""
    mine = Window.partitionBy(*by).orderBy(*order)
    begins = F.when(F.col(key).eqNullSafe(F.lag(key).over(mine)) & (F.row_number().over(mine) > 1), 0).otherwise(1)
    numbered = rows.withColumn("_b", begins).withColumn("island", F.sum("_b").over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "island").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
