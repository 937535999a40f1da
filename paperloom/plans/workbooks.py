"""Queries that write into existing workbooks: one of each supplier, with sheets of its order lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..scratch import written
from ..sources import packages, workbooks, writers
from .base import query, table

_LINES = """c AS (SELECT l_suppkey AS s, l_suppkey::VARCHAR AS path, 'S' || (l_linenumber % 2) AS sheet,
  row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS k, l_extendedprice, l_tax, l_returnflag, l_linestatus FROM lineitem),
b AS (SELECT s, path, sheet, k, (k // 6 + 1)::INT AS row, (k % 6 + 1)::INT AS col, l_extendedprice AS number, l_tax, l_returnflag, l_linestatus FROM c)"""


def _lines(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    k = F.row_number().over(Window.partitionBy("l_suppkey", F.col("l_linenumber") % 2).orderBy(*order)) - 1
    lines = table(spark, sf, "lineitem").withColumn("k", k).withColumn("sheet", F.concat(F.lit("S"), (F.col("l_linenumber") % 2).cast("string")))
    cell = [(F.floor(F.col("k") / 6) + 1).cast("int").alias("row"), (F.col("k") % 6 + 1).alias("col")]
    return lines.select(F.col("l_suppkey").alias("s"), F.col("l_suppkey").cast("string").alias("path"), "sheet", "k", *cell, F.col("l_extendedprice").alias("number"), "l_tax", "l_returnflag", "l_linestatus")


def _books(lines):
    return writers.build_workbooks(lines.select("path", "sheet", "row", "col", "number", F.lit(None).cast("string").alias("text")))


def _changes(lines):
    """Of every seventh line the cell gets another value, and of the next one a new cell far below is written. Some
    suppliers write to a sheet that is not there, to one cell twice, or outside the limits."""
    of = lambda at: F.when(F.col("k") % 3 == at, F.lit(True))
    value = [
        F.when(of(0), F.col("l_tax")).alias("number"), F.when(of(1), F.concat(F.lit("=<&"), "l_returnflag")).alias("text"), F.when(of(2), F.col("l_linestatus") == "F").alias("boolean"),
    ]
    far = lambda c, by: (F.col(c) + F.when(F.col("k") % 7 == 1, by).otherwise(0)).cast("int").alias(c)
    changes = lines.where("k % 7 < 2").select("s", "path", "sheet", far("row", 1000), far("col", 2), *value, "k")
    first = lines.where("k = 0 AND s % 13 < 3")
    bad = first.select(
        "s", "path", F.when(F.col("s") % 13 == 0, "none").otherwise(F.col("sheet")).alias("sheet"), F.when(F.col("s") % 13 == 2, 100_001).otherwise(F.col("row")).alias("row"), "col",
        F.lit(1.0).alias("number"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("boolean"), F.lit(-1).alias("k"),
    )
    return changes.unionByName(bad).select("path", "sheet", "row", "col", "number", "text", "boolean")


_ISSUE = "CASE s % 13 WHEN 0 THEN 'TARGET_NOT_FOUND' WHEN 1 THEN 'INVALID_INPUT' WHEN 2 THEN 'LIMIT_EXCEEDED' END"


@query(f"""WITH {_LINES}, n AS (SELECT s, path, sheet, (row + CASE WHEN k % 7 = 1 THEN 1000 ELSE 0 END)::INT AS row, (col + CASE WHEN k % 7 = 1 THEN 2 ELSE 0 END)::INT AS col,
  (['number', 'text', 'boolean'])[(k % 3 + 1)::INT] AS kind, CASE k % 3 WHEN 0 THEN l_tax WHEN 2 THEN (l_linestatus = 'F')::INT END::DOUBLE AS number, CASE WHEN k % 3 = 1 THEN '=<&' || l_returnflag END AS text FROM b WHERE k % 7 < 2 AND s % 13 > 2)
SELECT path, sheet, row, col, 'number' AS kind, number, NULL AS text, {_ISSUE} AS issue FROM b ANTI JOIN n USING (path, sheet, row, col)
UNION ALL SELECT path, sheet, row, col, kind, number, text, NULL FROM n""")
def workbook_edits(spark, sf):
    lines = _lines(spark, sf)
    done = written(workbooks.edit_workbooks(_books(lines), _changes(lines), workbooks.set_workbook_cells))
    cells = packages.sheet_cells(done).drop("issue")
    number, text = F.when(F.col("kind") != "text", F.col("value").cast("double")), F.when(F.col("kind") == "text", F.col("value"))
    seen = cells.select("path", "sheet", "row", "col", "kind", number.alias("number"), text.alias("text"))
    return seen.join(done.select("path", "issue"), "path")


def _formats(lines):
    """Two rounds of formats of each supplier; the second goes over a part of the first. Some formats overlap, and some
    ranges hold no content."""
    books = lines.groupBy("s", "path").agg(F.max("sheet").alias("sheet"))
    k = F.col("s")
    rgb = F.concat(F.lit("#"), F.lpad(F.hex((k * 7919 % 16_000_000).cast("long")), 6, "0"))

    def ask(sheet, box, bold=None, italic=None, size=None, name=None, color=None, fill=None, border=None):
        said = {"bold": (bold, "boolean"), "italic": (italic, "boolean"), "size": (size, "double"), "name": (name, "string"), "color": (color, "string"), "fill": (fill, "string"), "border": (border, "string")}
        rows = [(x if not isinstance(x, (int, str)) else F.lit(x)).alias(n) for x, n in zip([sheet, *box], ["sheet", "r0", "c0", "r1", "c1"], strict=True)]
        return F.struct(*rows, *((x if x is not None and not isinstance(x, (bool, str)) else F.lit(x)).cast(kind).alias(n) for n, (x, kind) in said.items()))

    first = [ask(F.col("sheet"), (1, 1, 2, 3), bold=True, size=8 + k % 5, name="Arial"), ask("*", (3, 1, 4, 400), fill=rgb)]
    second = [ask("*", (F.when(k % 11 == 1, 50_000).otherwise(2).cast("int"), 2, F.when(k % 11 == 1, 50_000).otherwise(3).cast("int"), 5), italic=True, color=rgb, border="thin", bold=False)]
    over = ask("*", (4, 6, 5, 6), bold=True)
    rows = lambda formats: books.select("path", F.explode(formats).alias("f")).select("path", "f.*")
    return rows(F.when(k % 11 == 0, F.array(*first, over)).otherwise(F.array(*first))), rows(F.array(*second))


_RGB = "'FF' || upper(lpad(printf('%x', s * 7919 % 16000000), 6, '0'))"


@query(f"""WITH {_LINES}, m AS (SELECT *, sheet = max(sheet) OVER (PARTITION BY path) AND row <= 2 AND col <= 3 AND s % 11 <> 0 AS head, row IN (3, 4) AND s % 11 <> 0 AS band,
  row IN (2, 3) AND col BETWEEN 2 AND 5 AND s % 11 <> 1 AS late, max(CASE WHEN row IN (2, 3) AND col BETWEEN 2 AND 5 THEN 1 ELSE 0 END) OVER (PARTITION BY path) = 1 AS any_late FROM b)
SELECT path, sheet, row, col, head AND NOT late AS bold, late AS italic, (CASE WHEN head THEN 8 + s % 5 ELSE 11 END)::DOUBLE AS size, CASE WHEN head THEN 'Arial' ELSE 'Calibri' END AS name,
  CASE WHEN late THEN {_RGB} END AS color, CASE WHEN band THEN {_RGB} END AS fill, CASE WHEN late THEN 'thin' END AS border,
  CASE WHEN s % 11 = 0 THEN 'INVALID_INPUT' END AS first_issue, CASE WHEN s % 11 = 1 OR NOT any_late THEN 'INVALID_INPUT' END AS second_issue FROM m""")
def workbook_formats(spark, sf):
    lines = _lines(spark, sf)
    first, second = _formats(lines)
    once = written(workbooks.edit_workbooks(_books(lines), first, workbooks.format_workbook_cells))
    twice = written(workbooks.edit_workbooks(once, second, workbooks.format_workbook_cells))
    # where no format was ever written there is no style part, and a cell has what such a workbook shows
    seen = workbooks.cell_styles(twice).drop("issue").fillna({"size": 11.0, "name": "Calibri"})
    issues = once.select("path", F.col("issue").alias("first_issue")).join(twice.select("path", F.col("issue").alias("second_issue")), "path")
    return seen.join(issues, "path")


@query(f"""WITH {_LINES}, p AS (SELECT DISTINCT s, path, sheet FROM b WHERE k = 0 OR k % 7 < 2), o AS (SELECT path, s, sheet, row_number() OVER (PARTITION BY path ORDER BY sheet) AS n FROM p WHERE s % 13 > 2),
f AS (SELECT DISTINCT path FROM b WHERE s % 13 > 2 AND row IN (1, 2) AND col = 1)
SELECT path, 'xl/worksheets/sheet' || n || '.xml' AS part, 'changed' AS change FROM o
UNION ALL SELECT path, unnest(['[Content_Types].xml', 'xl/_rels/workbook.xml.rels', 'xl/styles.xml']), unnest(['changed', 'changed', 'added']) FROM f""")
def workbook_untouched_parts(spark, sf):
    """Values and then formats are written; the parts that differ from the first file are told."""
    lines = _lines(spark, sf)
    books = written(_books(lines))
    done = workbooks.edit_workbooks(books, _changes(lines), workbooks.set_workbook_cells).where("issue IS NULL")
    head = lines.select("path").distinct().select("path", F.lit("*").alias("sheet"), *(F.lit(1).alias(n) for n in ("r0", "c0", "c1")), F.lit(2).alias("r1"), F.lit(True).alias("bold"))
    done = written(workbooks.edit_workbooks(done, head, workbooks.format_workbook_cells))
    return workbooks.part_changes(books.join(done.select("path"), "path", "left_semi"), done)
