"""Logical grids of tables: column cursors, merges and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Confidence values, fixed.
CELL_SELF, CELL_MERGED, CELL_ORPHAN = 0.95, 0.9, 0.4
TABLE_NATIVE, TABLE_NO_GRID, TABLE_ISSUE = 0.98, 0.8, 0.6


def placed_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Add start_col to cells (by.., row, idx, grid_before, span, v_merge): what the row skips and earlier spans."""
    earlier = Window.partitionBy(*by, "row").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("start_col", F.col("grid_before") + F.coalesce(F.sum("span").over(earlier), F.lit(0)))


def grid_columns(placed: DataFrame, by: list[str], declared: DataFrame | None = None) -> DataFrame:
    """Rows and columns of each grid: the widest of the declared columns and the rows with what they skip after."""
    after = F.coalesce("grid_after", F.lit(0)) if "grid_after" in placed.columns else F.lit(0)
    sizes = placed.groupBy(*by).agg(F.count_distinct("row").alias("rows"), F.max(F.col("start_col") + F.col("span") + after).alias("widest"))
    if declared is None:
        return sizes.select(*by, "rows", F.col("widest").alias("columns"))
    sizes = sizes.join(declared.select(*by, "declared"), by, "left")
    return sizes.select(*by, "rows", F.greatest(F.coalesce("declared", F.lit(0)), "widest").alias("columns"))


def covered(placed: DataFrame, by: list[str]) -> DataFrame:
    """A row for each column that a cell spans, with the cell that owns it.

    A cell that continues a merge takes the owner above it in its column, carried down; where there is none it is an
    orphan and owns the column itself. The carry runs in windows of one column of one table."""
    spread = placed.withColumn("col", F.explode(F.sequence(F.col("start_col"), F.col("start_col") + F.col("span") - 1)))
    continues = F.col("v_merge").eqNullSafe("continue")
    down = Window.partitionBy(*by, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(~continues, F.struct("row", F.col("start_col").alias("col"))), ignorenulls=True).over(down)
    spread = spread.withColumn("owner", owner).withColumn("orphan", continues & F.col("owner").isNull())
    own = F.coalesce("owner", F.struct("row", F.col("start_col").alias("col")))
    confidence = F.when(F.col("orphan"), CELL_ORPHAN).when(continues, CELL_MERGED).otherwise(CELL_SELF)
    return spread.select(*by, "row", "idx", "col", own["row"].alias("owner_row"), own["col"].alias("owner_col"), "orphan", confidence.alias("confidence"))


def merges(placed: DataFrame, by: list[str]) -> DataFrame:
    """Merged regions: owner's row and column, spans and kind (gridSpan, vMerge, both).

    A run of continuing cells below an owner that start at exactly its column makes its height: runs are islands of a
    column's start cells."""
    continues = F.col("v_merge").eqNullSafe("continue")
    down = Window.partitionBy(*by, "start_col").orderBy("row")
    gap = F.when(continues & (F.col("row") == F.lag("row").over(down) + 1), 0).otherwise(1)
    runs = placed.withColumn("continues", continues).withColumn("first", gap)
    runs = runs.withColumn("run", F.sum("first").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    heads = runs.groupBy(*by, "start_col", "run").agg(
        F.min_by(F.struct("row", "span", "continues"), "row").alias("head"), F.count(F.lit(1)).alias("row_span")
    )
    heads = heads.where("NOT head.continues AND (head.span > 1 OR row_span > 1)")
    kind = F.when((F.col("head.span") > 1) & (F.col("row_span") > 1), "both").when(F.col("head.span") > 1, "gridSpan").otherwise("vMerge")
    return heads.select(*by, F.col("head.row").alias("row"), F.col("start_col").alias("col"), F.col("head.span").alias("col_span"), "row_span", kind.alias("kind"))


def merge_issues(placed: DataFrame, by: list[str], declared: DataFrame) -> DataFrame:
    """(by.., row, issue): rows wider than declared, orphans, and continuations of another width than the cell above."""
    wide = placed.groupBy(*by, "row").agg(F.max(F.col("start_col") + F.col("span")).alias("width")).join(declared, by)
    wide = wide.where("declared > 0 AND width > declared").select(*by, "row", F.lit("row-wider-than-declared").alias("issue"))
    orphans = covered(placed, by).where("orphan").select(*by, "row", F.lit("orphan-continue")).distinct()
    above = placed.select(*by, (F.col("row") + 1).alias("row"), "start_col", F.col("span").alias("above"))
    changed = placed.where("v_merge = 'continue'").join(above, [*by, "row", "start_col"]).where("span <> above").select(*by, "row", F.lit("width-change")).distinct()
    return wide.union(orphans).union(changed)


def shape_digests(placed: DataFrame, by: list[str], columns: DataFrame) -> DataFrame:
    """SHA-256 of table NUL columns NUL cells per row, joined by commas."""
    per_row = placed.groupBy(*by, "row").count()
    shape = per_row.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "count"))), lambda x: x["count"].cast("string")), ",").alias("shape"))
    nul = F.char(F.lit(0))
    return shape.join(columns, by).select(*by, F.sha2(F.concat(F.lit("table"), nul, F.col("columns").cast("string"), nul, "shape"), 256).alias("shape_digest"))


def summaries(cells: DataFrame, by: list[str]) -> DataFrame:
    """Text of a table: cells joined by tabs, rows by line breaks."""
    rows = cells.groupBy(*by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\t").alias("line"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def table_confidence(has_grid, has_issue):
    return F.when(has_issue, TABLE_ISSUE).when(~has_grid, TABLE_NO_GRID).otherwise(TABLE_NATIVE)
