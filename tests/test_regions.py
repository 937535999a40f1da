"""Cells and items of regions against plain comparisons of all boxes."""

import random

from pyspark.sql import functions as F

from paperloom.operators import regions as R
from paperloom.operators import sheets


def test_items_meet_the_smallest_cell(spark):
    rng = random.Random(1)
    cells = [(rng.choice("ab"), rng.randrange(1, 3), t, c, *box()) for t in range(4) for c in range(40) for box in [lambda: (lambda x, y: (x, y, x + rng.uniform(1, 150), y + rng.uniform(1, 90)))(rng.uniform(-20, 500), rng.uniform(0, 700))]]
    items = [(rng.choice("abc"), rng.randrange(1, 3), k, x, y, x + 6, y + 4) for k in range(400) for x, y in [(rng.uniform(-30, 620), rng.uniform(-10, 800))]] + [("a", 1, 999, None, None, None, None)]
    boxes = "x0 double, y0 double, x1 double, y1 double"
    got = R.items_in_cells(spark.createDataFrame(items, f"doc string, page int, item int, {boxes}"), spark.createDataFrame(cells, f"doc string, page int, table int, cell int, {boxes}"), ["doc"])
    found = {(r.doc, r.page, r.item): (r.table, r.cell) for r in got.collect()}
    for doc, page, item, x0, y0, x1, y1 in items:
        inside = []
        for d, p, t, c, a0, b0, a1, b1 in cells if x0 is not None else ():
            if (d, p) == (doc, page) and a0 <= (x0 + x1) / 2 < a1 and b0 <= (y0 + y1) / 2 < b1:
                inside.append(((a1 - a0) * (b1 - b0), t, c))
        assert found[doc, page, item] == (min(inside)[1:] if inside else (None, None))
    assert len(found) == len(items) and any(v[0] is not None for v in found.values())


def test_spans_from_bands(spark):
    box = lambda cell, r0, c0, r1, c1, off=0.0: ("d", 1, cell, c0 * 50 + off, r0 * 20 - off, c1 * 50 - 0.5, r1 * 20 + 0.5)
    cells = [box(0, 0, 0, 1, 2), box(1, 0, 2, 3, 3, 0.9), box(2, 1, 0, 2, 1, 1.0), box(3, 1, 1, 2, 2), box(4, 2, 0, 3, 2)]
    frame = spark.createDataFrame(cells, "doc string, table int, cell int, x0 double, y0 double, x1 double, y1 double")
    got = {r.cell: (r.row, r.col, r.row_span, r.col_span) for r in R.table_cells(frame, ["doc"]).collect()}
    assert got == {0: (0, 0, 1, 2), 1: (0, 2, 3, 1), 2: (1, 0, 1, 1), 3: (1, 1, 1, 1), 4: (2, 0, 1, 2)}
    assert R.table_cells(frame.where("cell > 9"), ["doc"]).count() == 0


def test_coordinates_are_checked(spark):
    regions = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 0.0, 0.0, 300.0, 10.0), ("d", 1, -5.0, 0.0, 10.0, 10.0), ("d", 1, 5.0, 0.0, 5.0, 10.0), ("d", 2, 0.0, 0.0, 1.0, 1.0), ("d", 1, None, 0.0, 1.0, 1.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", 1, 200.0, 100.0)], "doc string, page int, page_width double, page_height double")
    got = [r.region_issue for r in R.checked(regions, pages, ["doc"]).orderBy("page", "x1", F.col("x0").asc_nulls_first()).collect()]
    assert sorted(map(str, got)) == ["NO_PAGE", "None", "OUTSIDE_PAGE", "OUTSIDE_PAGE", "REVERSED", "REVERSED"]


def test_formats_stay_in_their_workbook(spark):
    cells = spark.createDataFrame([("x", "S", r, 1, "v") for r in (1, 300, 1000)] + [("y", "S", 1, 1, "v"), ("y", "T", 1, 1, None)], "book string, sheet string, row int, col int, value string")
    formats = spark.createDataFrame([("x", "a", "S", 1, 1, 600, 2), ("x", "b", "*", 1, 1, 1, 1), ("y", "c", "*", 1, 1, 9999, 1), ("y", "d", "S", 9, 1, 3, 1)], "book string, format string, sheet string, r0 int, c0 int, r1 int, c1 int")
    got = sorted(tuple(r) for r in sheets.format_cells(cells, formats, ["book", "sheet"]).collect())
    assert got == [("x", "S", 1, 1, "a", True), ("x", "S", 300, 1, "a", False), ("y", "S", 1, 1, "c", False)]
