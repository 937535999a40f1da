"""Tables from the regions that a layout model sees on pages: cells with their spans, and the text items in each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of the tiles by which boxes and points meet, and how far edges may differ that count as one, in points.
TILE, SNAP = 64, 2.0


def checked(regions: DataFrame, pages: DataFrame, by: list[str], tolerance: float = 1.0) -> DataFrame:
    """Regions with an issue if their coordinates cannot be those of their page (page_width, page_height): NO_PAGE,
    REVERSED (no extent), OUTSIDE_PAGE; null for the others."""
    met = regions.join(pages.select(*by, "page", "page_width", "page_height"), [*by, "page"], "left")
    outside = (F.least("x0", "y0") < -tolerance) | (F.col("x1") > F.col("page_width") + tolerance) | (F.col("y1") > F.col("page_height") + tolerance)
    reversed_ = F.coalesce((F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1")), F.lit(True))
    issue = F.when(F.col("page_width").isNull(), "NO_PAGE").when(reversed_, "REVERSED").when(outside, "OUTSIDE_PAGE")
    return met.withColumn("region_issue", issue).drop("page_width", "page_height")


def table_cells(cells: DataFrame, by: list[str], snap: float = SNAP) -> DataFrame:
    """Cells (by.., table, cell, x0, y0, x1, y1 from the top left) with row, col, row_span and col_span: the upper edges of
    a table's cells are its rows and their left edges its columns, edges closer than `snap` to the one before being the
    same. A cell spans the rows and columns that begin before its end. The edges of one table are one array."""
    keys = [*by, "table"]
    starts = cells.groupBy(*keys).agg(F.array_sort(F.collect_set("y0")).alias("tops"), F.array_sort(F.collect_set("x0")).alias("lefts"))

    def bands(edges):
        """Edges without those that lie within snap of the one before them."""
        return F.filter(edges, lambda e, i: (i == 0) | (e - F.element_at(edges, F.when(i == 0, 1).otherwise(i)) > snap))

    starts = starts.select(*keys, bands(F.col("tops")).alias("tops"), bands(F.col("lefts")).alias("lefts"))
    met = cells.join(starts, keys)
    before = lambda edges, at: F.size(F.filter(edges, lambda e: e <= F.col(at) + snap)) - 1
    within = lambda edges, end: F.size(F.filter(edges, lambda e: e < F.col(end) - snap))
    placed = met.withColumn("row", before("tops", "y0")).withColumn("col", before("lefts", "x0"))
    spans = {"row_span": F.greatest(F.lit(1), within("tops", "y1") - F.col("row")), "col_span": F.greatest(F.lit(1), within("lefts", "x1") - F.col("col"))}
    return placed.withColumns(spans).drop("tops", "lefts")


def items_in_cells(items: DataFrame, cells: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """Text items (by.., page, item, x0, y0, x1, y1) with the table and cell that hold their middle: the smallest one, then
    the first by table and cell; null if none does. Cells stand on every tile that they cover, an item on the one of its
    middle, so that boxes far from each other never meet. Right and lower edges belong to the next cell."""
    at = lambda c: F.floor(F.col(c) / tile)
    tiles = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    boxes = cells.select(*by, "page", "table", "cell", *(F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1", "y1")))
    boxes = boxes.withColumn("tx", tiles("c_x0", "c_x1")).withColumn("ty", tiles("c_y0", "c_y1"))
    middles = items.withColumn("mx", (F.col("x0") + F.col("x1")) / 2).withColumn("my", (F.col("y0") + F.col("y1")) / 2)
    points = middles.where("mx IS NOT NULL AND my IS NOT NULL").select(*by, "page", "item", "mx", "my", at("mx").alias("tx"), at("my").alias("ty"))
    met = points.join(boxes, [*by, "page", "tx", "ty"]).where("c_x0 <= mx AND mx < c_x1 AND c_y0 <= my AND my < c_y1")
    area = (F.col("c_x1") - F.col("c_x0")) * (F.col("c_y1") - F.col("c_y0"))
    best = met.groupBy(*by, "page", "item").agg(F.min(F.struct(area.alias("area"), "table", "cell")).alias("best"))
    return items.join(best.select(*by, "page", "item", "best.table", "best.cell"), [*by, "page", "item"], "left")


def cell_texts(assigned: DataFrame, by: list[str]) -> DataFrame:
    """The text of each cell: its items from top to bottom and left to right, joined by blanks."""
    inside = assigned.where("cell IS NOT NULL").groupBy(*by, "page", "table", "cell")
    return inside.agg(F.array_join(F.array_sort(F.collect_list(F.struct("y0", "x0", "item", "text"))).getField("text"), " ").alias("text"))
