"""Work in Python is dealt over tasks whatever files a table comes in, and holds few rows at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.sources import packages, pdf_objects, writers


def _tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_piece_of_input_is_many_tasks(spark):
    rows = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("path"), F.col("id").alias("k"))
    files = pdf_objects.pdf_column(lambda k: b"%PDF-1.4", "k")(rows)
    assert files.count() == 400 and _tasks(files) > 8
    blocks = rows.select("path", F.lit(0).alias("pos"), F.lit("paragraph").alias("kind"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("style"))
    assert _tasks(writers.build_documents(blocks)) > 8
    cells = rows.select("path", F.lit("S").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit(1.5).alias("number"), F.lit(None).cast("string").alias("text"))
    assert _tasks(writers.build_workbooks(cells)) > 8


def test_rows_are_taken_a_few_at_a_time():
    made = []

    class Column:
        def __init__(self, values):
            self.values = values

        def to_pylist(self):
            made.append(len(self.values))
            return list(self.values)

    class Batch:
        def __init__(self, values):
            self.values, self.num_rows = values, len(values)

        def slice(self, start, length):
            return Batch(self.values[start : start + length])

        def column(self, name):
            return Column(self.values)

    assert [x for x, _ in packages.rows_of([Batch(range(100)), Batch(range(0)), Batch(range(7))], "a", "b")] == [*range(100), *range(7)]
    assert max(made) == packages.ROWS_AT_ONCE


def test_batches_are_bounded():
    schema = pa.schema([("n", pa.int64())])
    by_rows = list(packages.batched(((0, (n,)) for n in range(10_000)), schema))
    assert max(b.num_rows for b in by_rows) == packages.BATCH_ROWS and sum(b.num_rows for b in by_rows) == 10_000
    by_size = list(packages.batched(((packages.BATCH_BYTES // 4, (n,)) for n in range(10)), schema))
    assert [b.num_rows for b in by_size] == [4, 4, 2]
    assert list(packages.batched((), schema)) == []


def test_rows_before_a_refusal_stay(spark):
    """A package that is refused in its middle gives the rows before and one with the issue, as without batches."""

    def parse(package):
        yield ("a",)
        raise packages.Refused("SOME")

    content = writers.packed({"a": "x"})
    files = spark.createDataFrame([(str(n), bytearray(content)) for n in range(5)], "path string, content binary")
    got = sorted(packages.extract(files, parse, "v string").collect(), key=lambda r: (r[0], r[1] or ""))
    assert [tuple(r) for r in got] == [x for n in range(5) for x in ((str(n), None, "SOME"), (str(n), "a", None))]


def test_many_comments_go_into_their_part_at_once(monkeypatch):
    """The part of comments is not written anew for each of them."""
    from paperloom.sources import document_edits, markup

    calls = []
    monkeypatch.setattr(document_edits, "into_root", lambda *a: calls.append(1) or markup.into_root(*a))
    content = writers.docx([{"kind": "paragraph", "text": f"line {n}"} for n in range(5)])
    edits = [{"kind": "addComment", "path": f"/w:document/w:body/w:p[{n + 1}]", "text": f"says {n}", "author": "A"} for n in range(5)]
    new = document_edits.edit_document(packages.Package(content), edits)
    assert len(calls) == 1
    done = writers.packed({"[Content_Types].xml": "<Types/>"} | new)
    assert [r[-1] for r in document_edits._anchors(packages.Package(done))] == [f"says {n}" for n in range(5)]


def test_words_of_pdf_objects():
    """Shortcuts of the lexer give what the long way gives."""
    read = lambda data, at=0: pdf_objects.Lexer(data, at).object()
    assert read(b"(plain)") == b"plain" and read(b"(a(b)c)") == b"a(b)c" and read(b"(a\\)\\051\\\nb)") == b"a))b" and read(b"(a\r\nb)") == b"a\nb"
    assert read(b"  % note\n /N#41me") == "NAme" and read(b"/N") == "N" and read(b"null") is None and read(b"true") is True
    assert read(b" 12 0 R", -3) == pdf_objects.Ref(12) and pdf_objects.Lexer(b"x", 9).ended()


def test_formats_of_all_sheets_meet_each_sheet_once(spark):
    """Cells of all sheets do not meet under one key, and a sheet that is called * is one of them."""
    from paperloom.operators import sheets

    cells = spark.createDataFrame([("b", s, 1, 1, 1.0) for s in ("*", "x", None)] + [("c", "x", 1, 1, 1.0)], "book string, sheet string, row int, col int, value double")
    formats = spark.createDataFrame([("b", "all", "*", 1, 1, 2, 2), ("b", "one", "x", 1, 1, 600, 2), ("b", "far", "x", 300, 1, 600, 2)], "book string, format string, sheet string, r0 int, c0 int, r1 int, c1 int")
    got = sheets.format_cells(cells, formats, ["book", "sheet"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("b", "*", 1, 1, "all", False), ("b", "x", 1, 1, "all", True), ("b", None, 1, 1, "all", False)], key=str)


def test_a_style_is_looked_up_once_a_workbook(monkeypatch):
    """Reading the formats of many cells does not walk through their styles for each of them."""
    from paperloom.sources import workbooks

    calls = []
    content = writers.xlsx({"S": [(r, 1, float(r), None) for r in range(1, 301)]})
    new = workbooks.format_workbook_cells(packages.Package(content), [{"sheet": "S", "r0": 2, "c0": 1, "r1": 9, "c1": 1, "bold": True, "size": 9.0}])
    monkeypatch.setattr(workbooks, "child", lambda *a: calls.append(1) or packages.child(*a))
    package = packages.Package(content)
    got = list(workbooks._cell_styles(packages.Package(writers.packed({n: new[n] if n in new else package.read(n) for n in sorted(package.names | set(new))}))))
    assert [r[1] for r in got if r[3]] == list(range(2, 10)) and len(got) == 300 and got[1][5] == 9.0 and got[0][5] == 11.0
    assert len(calls) < 100


def test_document_types_are_refused_however_they_are_written():
    """Parts that begin as plain UTF-8 without a document type are read the short way, all others the long way."""
    import pytest

    bad = '<!DOCTYPE d [<!ENTITY e "x">]><d>&e;</d>'
    for data in (bad, '<?xml version="1.0" encoding="UTF-8"?>' + bad, ('<?xml version="1.0" encoding="UTF-16"?>' + bad).encode("utf-16"), ('<?xml version="1.0" encoding="cp037"?>' + bad).encode("cp037"), "\n" + bad, "﻿" + bad):
        with pytest.raises(packages.Refused, match="XML_FORBIDDEN|XML_MALFORMED"):
            packages.Package(writers.packed({"a.xml": data})).xml("a.xml")
    for data in ("<d><!-- <!DOCTYPE --></d>", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><d/>', '<?xml version="1.0" encoding="UTF-16"?><d/>'.encode("utf-16")):
        assert packages.Package(writers.packed({"a.xml": data})).xml("a.xml").tag == "d"


def test_decks_are_read_once_for_their_covers(spark):
    """Boxes of a deck meet one another; no side of that reads the decks again."""
    from paperloom import plans

    plan = plans.QUERIES["deck_covers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_equal_small_parts_are_made_and_parsed_once(monkeypatch):
    """Packages of one make share parts such as styles; these are neither deflated nor parsed for each of them."""
    parsed = []
    monkeypatch.setattr(packages, "_tree", lambda data, tree=packages._tree: parsed.append(data) or tree(data))
    packages._rows_of_part.cache_clear()
    writers._deflated_once.cache_clear()
    files = [writers.docx([{"kind": "paragraph", "text": f"line {n}"}]) for n in range(20)]
    assert writers._deflated_once.cache_info().misses == 4 + 20
    for read in (packages._styles, packages._relationships, packages._content_types):
        assert len({tuple(read(packages.Package(f))) for f in files}) == 1
    assert len(parsed) == 4


def test_packages_are_what_zipfile_writes_and_reads():
    for parts in ({}, {"a.xml": "x", "b/é.xml": b"\0" * 9999}, {"a.xml": bytes(range(256)) * 40, "b": ""}):
        made = {k: v.encode() if isinstance(v, str) else v for k, v in parts.items()}
        content = writers.packed(parts)
        assert content == writers._zipped(made)
        package = packages.Package(content)
        assert {n: package.read(n) for n in package.names} == made and packages.MAX_TOTAL - package.left == sum(map(len, made.values()))


def test_the_list_of_an_object_stream_is_read_once(monkeypatch):
    """Reading all objects of an object stream takes time by their number, not by its square."""
    calls = []
    data = pdf_objects.assembled({1: {"Type": pdf_objects.Name("Catalog")}} | {n: n for n in range(2, 400)}, {"Root": pdf_objects.Ref(1)}, packed=True)
    monkeypatch.setattr(pdf_objects.Lexer, "object", lambda self, depth=0, old=pdf_objects.Lexer.object: calls.append(1) or old(self, depth))
    doc = pdf_objects.Document(data)
    assert [doc.object(n) for n in range(2, 400)] == list(range(2, 400)) and len(calls) < 400 * 4


def test_only_tables_with_an_edit_become_trees(monkeypatch):
    """What an edit of tables does not touch stays as it is written, returns in texts too."""
    sizes = []
    monkeypatch.setattr(writers.minidom, "parseString", lambda x, old=writers.minidom.parseString: sizes.append(len(x)) or old(x))
    content = writers.docx([{"kind": "paragraph", "text": "x\ry" * 2000}, {"kind": "table", "rows": [["a\rb"]]}, {"kind": "table", "rows": [["c"]]}])
    package = packages.Package(content)
    edit = {"table": 1, "width": 77, "column_widths": [55], "header_row": True}
    new = writers.set_table_geometry(package, [edit])[packages.DOCUMENT]
    old = package.read(packages.DOCUMENT)
    at = old.rindex(b"<w:tbl>")
    assert new[:at] == old[:at] and b"&#13;" in new and sizes and max(sizes) < 2000
    done = writers.packed({packages.DOCUMENT: new})
    assert [r[2] for r in packages._table_geometry(packages.Package(done))] == [None, 77]
