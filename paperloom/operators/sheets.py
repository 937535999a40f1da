"""Workbooks: ranges, upserts, formats and summaries; decks: typography decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def range_bounds(address: str) -> tuple[int, int, int, int]:
    """Bounds of an A1 range (first column, first row, last column, last row); reversed or malformed is an error."""
    import re

    m = re.fullmatch(r"([A-Za-z]{1,3})([1-9]\d{0,6})(?::([A-Za-z]{1,3})([1-9]\d{0,6}))?", address)
    if not m:
        raise ValueError(f"not a range: {address}")

    def number(letters):
        n = 0
        for c in letters.upper():
            n = 26 * n + ord(c) - 64
        return n

    c0, r0 = number(m[1]), int(m[2])
    c1, r1 = (number(m[3]), int(m[4])) if m[3] else (c0, r0)
    if c1 < c0 or r1 < r0:
        raise ValueError(f"reversed range: {address}")
    return c0, r0, c1, r1


def read_range(cells: DataFrame, sheets: DataFrame, by: list[str], address: str) -> DataFrame:
    """All cells of a range of each sheet, row by row, blanks as null values (cells: by.., row, col, value, formula).

    Blanks come from sequences per sheet, not from a cross join of tables; values meet them by an equi-join."""
    c0, r0, c1, r1 = range_bounds(address)
    grid = sheets.select(*by).withColumn("row", F.explode(F.sequence(F.lit(r0), F.lit(r1)))).withColumn("col", F.explode(F.sequence(F.lit(c0), F.lit(c1))))
    inside = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    out = grid.join(inside, [*by, "row", "col"], "left")
    return out.withColumn("address", F.concat(T.column_letters("col"), F.col("row").cast("string")))


def set_cells(cells: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """Literal writes: changed cells replace those at their address, a leading = stays text. Changes must be unique."""
    keys = [*by, "row", "col"]
    new = changes.select(*keys, "value", F.lit(None).cast("string").alias("formula"))
    return cells.select(*keys, "value", "formula").join(new.select(*keys), keys, "left_anti").unionByName(new)


#: Rows of a sheet that share a band: ranges meet cells of their bands only.
BAND = 256


def format_cells(cells: DataFrame, formats: DataFrame, by: list[str]) -> DataFrame:
    """Populated cells with the formats whose ranges hold them (formats: by.. with * as the sheet for all of a workbook's,
    format, r0, c0, r1, c1), and whether a cell is in more ranges than one. The last of `by` is the sheet, those before
    it, if any, name the workbook and are equal on both sides. Formats first meet the sheets that they are for, those of *
    all sheets of their workbook, and then cells by workbook, sheet and band of rows: a format of one workbook reaches no
    other, a range no cells far from it, and the cells of many sheets never share a key."""
    book, sheet = by[:-1], by[-1]
    keyed = cells.where("value IS NOT NULL").select(*by, "row", "col", F.floor(F.col("row") / BAND).alias("band"))
    sheets = keyed.select(*by).distinct()
    ranges = formats.where("r0 <= r1").select(*(F.col(c).alias(f"f_{c}") for c in book), "format", F.col(sheet).cast("string").alias("on_sheet"), "r0", "c0", "r1", "c1")
    same = [F.col(c) == F.col(f"f_{c}") for c in book]
    all_of, one_of = ranges.where("on_sheet = '*'"), ranges.where("on_sheet <> '*'")
    everywhere = sheets.join(all_of, same) if same else sheets.crossJoin(all_of)
    placed = everywhere.unionByName(sheets.join(one_of, [*same, F.col(sheet).cast("string") == F.col("on_sheet")]))
    bands = F.explode(F.sequence(F.floor(F.col("r0") / BAND), F.floor(F.col("r1") / BAND))).alias("band")
    placed = placed.select(*(F.col(c).alias(f"f_{c}") for c in by), "format", "r0", "c0", "r1", "c1", bands).withColumnRenamed("band", "f_band")
    on = [*(F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in by), F.col("band") == F.col("f_band")]
    met = keyed.join(placed, on).where("row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
    return met.groupBy(*by, "row", "col").agg(F.min("format").alias("format"), (F.count(F.lit(1)) > 1).alias("overlaps"))


def workbook_summary(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per sheet: rows and columns in use, populated and formula cells, characters of text."""
    return cells.groupBy(*by).agg(
        F.max("row").alias("rows"), F.max("col").alias("columns"), F.count("value").alias("populated"), F.count("formula").alias("formulas"), F.sum(F.char_length(F.col("value").cast("string"))).alias("chars")
    )


def read_back(expected: DataFrame, observed: DataFrame, keys: list[str], value: str, tolerance: float | None = None) -> DataFrame:
    """Expected values that the saved document does not show (missing, other, or off by more than the tolerance)."""
    met = expected.select(*keys, F.col(value).alias("expected")).join(observed.select(*keys, F.col(value).alias("observed")), keys, "left")
    differs = ~F.col("expected").eqNullSafe(F.col("observed")) if tolerance is None else F.col("observed").isNull() | (F.abs(F.col("expected") - F.col("observed")) > tolerance)
    return met.where(differs)


def title_color(accent: Column, background: Column, least: float = 4.5) -> Column:
    """The accent, or the better of white and black if its contrast on a known background is too low."""
    white, black = T.contrast_ratio(F.lit("#FFFFFF"), background), T.contrast_ratio(F.lit("#000000"), background)
    low = T.contrast_ratio(accent, background) < least
    return F.when(background.isNull(), T.rgb(accent)).when(low, F.when(white >= black, "FFFFFF").otherwise("000000")).otherwise(T.rgb(accent))


def shrunk_size(placeholder: Column, current: Column, wanted: Column, all_sized: Column, fits: Column) -> Column:
    """New size of a run: titles shrink to at most the wanted size if every run has one and the text fits, bodies only
    ever shrink, other placeholders are left alone."""
    lower = F.least(current, wanted)
    return F.when((placeholder == "title") & all_sized & fits, lower).when(placeholder == "body", lower).otherwise(current)


def replace_runs(runs: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Addressed text edits: a run takes the new text if it reads as expected; status ok, stale or missing."""
    out = edits.join(runs.select(*keys, F.col("text").alias("current")), keys, "left")
    status = F.when(F.col("current").isNull(), "missing").when(F.col("current") != F.col("expected"), "stale").otherwise("ok")
    return out.select(*keys, status.alias("status"), F.when(status == "ok", F.col("replacement")).otherwise(F.col("current")).alias("text"))


def style_merge(existing: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """Existing styles but for those named, then the named ones: order is kept, new ones come last."""
    rest = existing.join(named.select(*keys), keys, "left_anti").withColumn("new", F.lit(False))
    return rest.unionByName(named.withColumn("new", F.lit(True)))


def select_pages(pages: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The wanted pages in their new order (wanted: by.., position, page)."""
    return wanted.join(pages, [*by, "page"])


def append_pages(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Pages of the second document after those of the first."""
    count = first.groupBy(*by).agg(F.max("page").alias("last"))
    moved = second.join(count, by, "left").withColumn("page", F.col("page") + F.coalesce("last", F.lit(0))).drop("last")
    return first.unionByName(moved)
