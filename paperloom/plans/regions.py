"""Tables that a layout model sees on pages of PDF files: one of each customer, its texts read from the file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, regions
from ..scratch import written
from ..sources import pdf_text
from ..sources import pdf_objects as objects
from .base import query
from .pdfs import _customers, _file, _shown

#: Columns and rows of the grid in points from the top left of a page of 400 by 600.
_LEFT, _TOP, _WIDE, _HIGH = 20, 30, 120, 40


def _grid(k: int, name: str, segment: str) -> bytes:
    """Nine places of a grid of three by three, each with a text in its middle, and one text below the grid."""
    at = lambda r, c: f"{10 + _LEFT + c * _WIDE + 5} {620 - (_TOP + r * _HIGH + 25)} Td"
    body = "\n".join(_shown(f"{segment[:4]}{r}{c}", 8, at(r, c)) for r in range(3) for c in range(3))
    return _file([f"{body}\n{_shown(name, 8, at(5, 1))}"], packed=k % 2 == 0)


def _cells(customers):
    """The boxes that a model gives: those of the grid, with the first two of the first row as one, of every third customer
    the last column as one, edges a little off, counted from the bottom of the page; some heights of pages are wrong."""
    k = F.col("k")
    spots = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(3) for c in range(3)])).alias("at")
    rows = customers.select("path", "k", spots).select("path", "k", "at.*")
    rows = rows.where("NOT (r = 0 AND c = 1)").where(~((k % 3 == 0) & (F.col("c") == 2) & (F.col("r") > 0)))
    wide = F.when((F.col("r") == 0) & (F.col("c") == 0), 2).otherwise(1)
    high = F.when((k % 3 == 0) & (F.col("c") == 2), 3).otherwise(1)
    off = F.when((F.col("r") + F.col("c")) % 2 == 0, 0.5).otherwise(0.0)
    x0, y0 = F.lit(_LEFT) + F.col("c") * _WIDE + off, F.lit(_TOP) + F.col("r") * _HIGH + off
    x1, y1 = F.lit(_LEFT) + (F.col("c") + wide) * _WIDE, F.lit(_TOP) + (F.col("r") + high) * _HIGH
    return rows.select("path", "k", F.lit(1).alias("page"), F.lit(0).alias("table"), (F.col("r") * 3 + F.col("c")).alias("cell"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), (600 - y1).cast("double").alias("y0"), (600 - y0).cast("double").alias("y1"))


@query("""WITH o AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS path, left(c_mktsegment, 4) AS t FROM customer), g AS (SELECT *, r, c FROM o, (SELECT unnest(range(3))::INT AS r), (SELECT unnest(range(3))::INT AS c)),
p AS (SELECT *, CASE WHEN r = 0 AND c = 1 THEN 0 ELSE c END AS col, CASE WHEN k % 3 = 0 AND c = 2 THEN 0 ELSE r END AS row FROM g)
SELECT path, row, col, CASE WHEN k % 3 = 0 AND col = 2 THEN 3 ELSE 1 END AS row_span, CASE WHEN row = 0 AND col = 0 THEN 2 ELSE 1 END AS col_span, string_agg(t || r || c, ' ' ORDER BY r, c) AS text FROM p WHERE k % 5 <> 4 GROUP BY path, k, row, col""")
def region_tables(spark, sf):
    """Where the model's page is not as high as the page of the file, its boxes are not turned round and give no table."""
    rows = _customers(spark, sf)
    files = written(objects.pdf_column(_grid, "k", "name", "segment")(rows).drop("issue"))
    pages = written(objects.pdf_pages(files).select("path", "page", F.col("width").alias("page_width"), F.col("height").alias("page_height")))
    stated = F.when(F.col("k") % 5 == 4, 700.0).otherwise(600.2)
    found = _cells(rows).join(pages, ["path", "page"])
    turned = found.withColumn("box", layout.top_left(F.col("y0"), F.col("y1"), F.lit("BOTTOMLEFT"), F.col("page_height"), stated))
    turned = turned.select("path", "page", "table", "cell", "x0", F.col("box.y0").alias("y0"), "x1", F.col("box.y1").alias("y1"))
    cells = regions.checked(turned, pages, ["path"]).where("region_issue IS NULL").drop("region_issue")
    items = pdf_text.pdf_text_items(files).select("path", "page", "item", "text", "x0", "y0", "x1", "y1")
    texts = regions.cell_texts(regions.items_in_cells(items, cells, ["path"]), ["path"])
    placed = regions.table_cells(cells, ["path", "page"])
    return placed.join(texts, ["path", "page", "table", "cell"]).select("path", "row", "col", "row_span", "col_span", "text")
