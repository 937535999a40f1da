"""Hand-made packages and what the extractors read from them."""

import zipfile

import pytest

from paperloom.sources import packages as P
from paperloom.sources import writers as W

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body, **more):
    parts = {"[Content_Types].xml": '<Types xmlns="x"><Default Extension="xml" ContentType="application/xml"/></Types>', P.DOCUMENT: f"<w:document {NS}><w:body>{body}</w:body></w:document>"}
    return W.packed(parts | {k.replace("__", "/"): v for k, v in more.items()})


@pytest.fixture(scope="module")
def frame(spark):
    return lambda **files: spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


def test_rich_document(frame):
    table = '<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr><w:trPr><w:gridBefore w:val="1"/><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H1"/><w:outlineLvl w:val="0"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/></w:rPr><w:t>Head</w:t></w:r></w:p>'
        f'<w:sdt><w:sdtContent><w:p><w:r><w:t>in</w:t><w:tab/><w:t>side</w:t><w:br/></w:r><w:commentReference w:id="3"/></w:p></w:sdtContent></w:sdt>{table}'
        '<w:p><w:r><w:br w:type="page"/></w:r></w:p><w:sectPr><w:pgSz w:w="10" w:h="20"/><w:cols w:num="2"/></w:sectPr>'
    )
    notes = f'<w:footnotes {NS}><w:footnote w:id="-1"/><w:footnote w:id="0"/><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    files = frame(a=package(body, word__footnotes=""), b=W.packed({"[Content_Types].xml": "<T/>", P.DOCUMENT: f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/footnotes.xml": notes}))
    rows = [r for r in P.paragraphs(files).collect() if r.path == "b"]
    assert [(r.text, r.table_path is None) for r in rows] == [("Head", True), ("inside", True), ("a", False), ("", False), ("", True)]
    assert (rows[0].style_id, rows[0].outline_level, rows[0].all_bold, rows[0].max_size) == ("H1", 0, True, 14.0)
    assert rows[1].full_text == "in\tside\n" and rows[1].notes == ["comment:3"] and "w:sdtContent" in rows[1].structural_path
    cells = [r for r in P.cells(files).collect() if r.path == "b"]
    assert [(c.grid_before, c.span, c.v_merge, c.header, c.declared) for c in cells] == [(1, 2, "restart", True, 2), (0, 1, "continue", False, 2)]
    assert [(r.kind, r.reference, r.text) for r in P.notes(files).collect() if r.path == "b"] == [("footnote", "2", "note")]
    seen = [(r.obs, r.kind, r.columns) for r in P.layout(files).collect() if r.path == "b"]
    assert seen == [("break", "explicit", None), ("section", "nextPage", 2)]


def test_bad_files_are_rows(frame, monkeypatch):
    good = package("<w:p/>")
    files = frame(
        cut=good[:60], plain=b"hello", entity=good, broken=W.packed({P.DOCUMENT: "<w:document>"}), banned=W.packed({P.DOCUMENT: '<!DOCTYPE x [<!ENTITY a "b">]><x/>'}), none=W.packed({"x.xml": "<x/>"}), ok=good
    )
    got = {r.path: r.issue for r in P.paragraphs(files).collect()}
    assert got == {"cut": "CONTAINER_UNREADABLE", "entity": None, "broken": "XML_MALFORMED", "banned": "XML_FORBIDDEN", "none": "PART_MISSING", "ok": None}


def test_budgets_hold(monkeypatch):
    big = P.Package(package("<w:p/>", word__big="x" * 100_000))
    monkeypatch.setattr(P, "MAX_ENTRY", 1000)
    with pytest.raises(P.Refused, match="LIMIT_ENTRY_BYTES"):
        big.read("word/big")
    monkeypatch.setattr(P, "MAX_ENTRIES", 1)
    with pytest.raises(P.Refused, match="LIMIT_ENTRIES"):
        P.Package(package("<w:p/>"))


def test_workbooks_and_decks(frame):
    book = W.xlsx({"A": [(1, 1, "x", None), (2, 28, 4.5, "SUM(A1)")], "B & C": [(1, 1, "=1+1", None)]})
    deck = W.pptx([[("title", "One", 30.0), ("body", "two", None)], [("title", "Three", None)]])
    files = frame(book=book, deck=deck)
    cells = [tuple(r)[1:6] for r in P.sheet_cells(files.where("path = 'book'")).collect()]
    assert cells == [("A", 1, 1, "text", "x"), ("A", 2, 28, "number", "4.5"), ("B & C", 1, 1, "text", "=1+1")]
    runs = [(r.slide, r.placeholder, r.text, r.size) for r in P.slide_runs(files.where("path = 'deck'")).collect()]
    assert runs == [(1, "title", "One", 30.0), (1, "body", "two", None), (2, "title", "Three", None)]


def test_same_input_gives_same_bytes():
    blocks = [{"kind": "paragraph", "text": "a & b", "style": "Heading1"}, {"kind": "table", "rows": [["x", "y"], ["z"]]}, {"kind": "pageBreak"}, {"kind": "list", "text": "i", "level": 0}]
    assert W.docx(blocks) == W.docx(blocks) and zipfile.is_zipfile(__import__("io").BytesIO(W.docx(blocks)))


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(package("<w:p/>"))
    (tmp_path / "b.txt").write_bytes(b"text")
    rows = {r.path.rsplit("/", 1)[1]: (r.container, r.extension, r.size_bytes) for r in P.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.DOCX"][:2] == ("zip", "docx") and rows["b.txt"] == ("unknown", "txt", 4)


def test_damage_is_an_issue(frame, spark, tmp_path):
    good = package("<w:p><w:r><w:t>some text</w:t></w:r></w:p>")
    name = P.DOCUMENT.encode()
    at = good.index(name) + len(name)
    entity = '<?xml version="1.0" encoding="UTF-16"?><!DOCTYPE d [<!ENTITY e "boom">]><document><body><p>&e;</p></body></document>'.encode("utf-16")
    files = frame(deflate=good[:at] + b"\xff" * 8 + good[at + 8 :], nobody=W.packed({P.DOCUMENT: "<document/>"}), utf16=W.packed({P.DOCUMENT: entity}), ok=good)
    for read in (P.paragraphs, P.cells, P.layout, P.runs):
        got = {r.path: r.issue for r in read(files).collect() if r.issue}
        assert got == {"deflate": "ENTRY_DAMAGED", "nobody": "BODY_MISSING", "utf16": "XML_FORBIDDEN"}
    book = W.xlsx({"A": [(1, 1, 5, None)]})
    p = P.Package(book)
    cell = lambda n: p.read("xl/worksheets/sheet1.xml").replace(b'<c r="A1"><v>5</v></c>', b'<c r="A1" t="s"><v>%s</v></c>' % n)
    strings = '<sst><si><t>zero</t></si><si><t>last</t></si></sst>'
    books = {k: W.packed({i.filename: p.read(i.filename) for i in p.infos} | {"xl/worksheets/sheet1.xml": cell(n), "xl/sharedStrings.xml": strings}) for k, n in {"a": b"1", "b": b"abc", "c": b"-1", "d": b"2"}.items()}
    assert {r.path: r.value for r in P.sheet_cells(frame(**books)).collect()} == {"a": "last", "b": None, "c": None, "d": None}
    (tmp_path / "big.docx").write_bytes(good)
    (tmp_path / "small.txt").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: (r.content is None, r.issue) for r in P.read_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert rows == {"big.docx": (True, "LIMIT_FILE_BYTES"), "small.txt": (False, None)}


def filled(body, values, **more):
    p = P.Package(package(body, **more))
    new = W.fill_template(p, [{"name": k, "value": v} for k, v in values.items()])
    return {k: P.text_of(__import__("xml.etree.ElementTree").etree.ElementTree.fromstring(v)) for k, v in new.items()}


def runs(*texts):
    return "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"


def test_templates():
    head = f"<w:hdr {NS}>{runs('{{', 'b}}')}</w:hdr>"
    assert filled(runs("x {{a", "}} and {{a}}{", "{b}}"), {"a": "1 < 2", "b": ""}, word__header1=None or "", **{"word__header2.xml": head}) == {P.DOCUMENT: "x 1 < 2 and 1 < 2", "word/header2.xml": ""}
    cases = {
        "TEMPLATE_VALUE_MISSING": [(runs("{{a}}{{c}}"), {"a": "x"})],
        "TEMPLATE_VALUE_UNUSED": [(runs("{{a}}"), {"a": "x", "b": "y"})],
        "UNSUPPORTED_TEMPLATE": [
            (runs("{{ a }}"), {"a": "x"}), (runs("{{a}} }}"), {"a": "x"}), (runs("{{a}}"), {"a": "x\ny"}), (runs("none"), {}), (runs("{{a", "}}").replace("</w:r><w:r>", "</w:r><w:hyperlink/><w:r>"), {"a": "x"}),
            (runs("{{a}}").replace("<w:r>", "<w:ins><w:r>").replace("</w:r>", "</w:r></w:ins>"), {"a": "x"}), (runs("{{a}}") + "<w:permStart/>", {"a": "x"}), (runs("{{" + "a" * 65 + "}}"), {"a" * 65: "x"}),
        ],
    }
    for code, given in cases.items():
        for body, values in given:
            with pytest.raises(P.Refused, match=code):
                filled(body, values)
    with pytest.raises(P.Refused, match="UNSUPPORTED_TEMPLATE"):
        filled(runs("{{a}}"), {"a": "x"}, **{"word__comments.xml": f"<w:comments {NS}>{runs('{{a}}')}</w:comments>"})


def test_replacement_in_any_form():
    body = '<w:p><w:r><w:t>first</w:t></w:r><w:r><w:t xml:space="preserve">a &amp; b</w:t></w:r><w:r><w:t/></w:r><w:r><w:tab/></w:r></w:p>'
    p = P.Package(package(body))
    new = W.replace_text(p, [{"expected": "first", "replacement": "<1>"}, {"expected": "a & b", "replacement": " c"}])[P.DOCUMENT].decode()
    assert '<w:t xml:space="preserve">&lt;1&gt;</w:t>' in new and '<w:t xml:space="preserve"> c</w:t>' in new and new.count("xml:space") == 2
    for wanted, code in (("absent", "TEXT_NOT_FOUND"), ("x", "TEXT_AMBIGUOUS")):
        with pytest.raises(P.Refused, match=code):
            W.replace_text(P.Package(package(runs("x", "x"))), [{"expected": wanted, "replacement": ""}])


def test_slides_in_the_order_of_the_deck(frame):
    deck = W.pptx([[("title", "One", None)], [("title", "Two", None)], [("title", "Three", None)]], [3, 1, 2])
    assert [(r.slide, r.text) for r in P.slide_runs(frame(deck=deck)).collect()] == [(1, "One"), (2, "Two"), (3, "Three")]


def test_long_chains_and_cycles(spark):
    """A chain beyond the limit of recursive queries' rows, in doubling rounds; a cycle ends without a value."""
    from pyspark.sql import functions as F

    from paperloom.operators import delivery, integrity

    n = 400_000
    chain = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("style_id"), F.when(F.col("id") % 25 > 0, F.col("id") - 1).alias("based_on"), F.when(F.col("id") % 25 == 0, F.col("id")).alias("v"))
    got = integrity.resolve_chain(chain, ["doc"], "v")
    assert got.where("v = style_id - style_id % 25 AND hops = style_id % 25").count() == n
    loop = spark.createDataFrame([("d", 1, 2, None), ("d", 2, 1, None), ("d", 3, 1, 7), ("d", 4, 9, None)], "doc string, style_id long, based_on long, v long")
    assert {r.style_id: r.v for r in integrity.resolve_chain(loop, ["doc"], "v").collect()} == {1: None, 2: None, 3: 7, 4: None}
    assert {r.style_id: r.v for r in integrity.resolve_chain(loop, ["doc"], "v", default=0).collect()} == {1: 0, 2: 0, 3: 7, 4: 0}
    long = spark.range(1, 700).selectExpr("'m' AS document_id", "id AS revision", "sha2(cast(id AS string), 256) AS sha256", "CASE WHEN id > 1 THEN sha2(cast(id - 1 AS string), 256) END AS parent_sha256")
    assert delivery.walk_chain(long.where("revision <> 600")).agg(F.max("depth")).first()[0] == 500
    assert delivery.walk_chain(long.where("revision <> 30")).agg(F.max("depth")).first()[0] == 29


def test_table_geometry_keeps_the_order_of_the_schema(frame):
    cells = "<w:tc><w:tcPr><w:gridSpan w:val='1'/><w:vAlign w:val='bottom'/></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc>"
    body = f"<w:tbl><w:tblPr><w:tblLook w:val='1'/><w:jc w:val='left'/></w:tblPr><w:tr><w:trPr><w:tblHeader/></w:trPr>{cells}</w:tr><w:tr>{cells}</w:tr></w:tbl>"
    edit = {"table": 0, "style_id": "S", "width": 900, "alignment": "Right", "layout": "fixed", "column_widths": [300, 600], "header_row": False, "vertical_alignment": "Center"}
    new = W.set_table_geometry(P.Package(package(body)), [edit])[P.DOCUMENT]
    root = __import__("xml.etree.ElementTree").etree.ElementTree.fromstring(new)
    table = next(x for x in root.iter() if P.local(x) == "tbl")
    assert [P.local(x) for x in P.child(table, "tblPr")] == ["tblStyle", "tblW", "jc", "tblLayout", "tblLook"]
    assert [P.local(x) for x in table][:2] == ["tblPr", "tblGrid"]
    assert [P.local(x) for x in P.child(table, "tr", "tc", "tcPr")] == ["tcW", "gridSpan", "vAlign"]
    got = P.table_geometry(frame(a=W.packed({"[Content_Types].xml": "<T/>", P.DOCUMENT: new}))).first()
    assert (got.style_id, got.width, got.alignment, got.layout, got.grid, got.n_rows, got.header_row) == ("S", 900, "right", "fixed", [300, 600], 2, False)
    for bad in ({"table": 1}, {"table": -1}):
        with pytest.raises(P.Refused, match="TARGET_NOT_FOUND"):
            W.set_table_geometry(P.Package(package(body)), [bad])
