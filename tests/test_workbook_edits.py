"""Writes into existing workbooks on hand-made sheets."""

import pytest

from paperloom.sources import packages
from paperloom.sources import workbooks as B
from paperloom.sources.packages import Package, Refused
from paperloom.sources.writers import packed, xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
STYLES = (
    f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/><scheme val="minor"/></font><font><b/><sz val="20"/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills>'
    '<borders count="1"><border><left/><right/><top/><bottom/><diagonal/></border></borders><cellXfs count="2"><xf fontId="0" fillId="0" borderId="0"/><xf numFmtId="14" fontId="1" fillId="0" borderId="0"/></cellXfs></styleSheet>'
)


def book(data, head="", tail="", **more):
    parts = {
        "[Content_Types].xml": '<Types xmlns="t"><Override PartName="/xl/calcChain.xml" ContentType="c"/></Types>', "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="u"><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="r"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/><Relationship Id="r3" Target="calcChain.xml"/></Relationships>',
        "xl/worksheets/a.xml": f'<?xml version="1.0"?><worksheet xmlns="{MAIN}">{head}<sheetData>{data}</sheetData>{tail}</worksheet>', "xl/worksheets/b.xml": f'<x:worksheet xmlns:x="{MAIN}"><x:sheetData/></x:worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>zero</t></si><si><t>one</t></si></sst>', "xl/calcChain.xml": "<calcChain/>", "xl/styles.xml": STYLES,
    }
    return Package(packed(parts | more))


def edited(before, *changes, edit=B.set_workbook_cells):
    new = edit(before, list(changes))
    names = [*(i.filename for i in before.infos), *(n for n in new if n not in before.names)]
    after = Package(packed({n: v for n in names if (v := new[n] if n in new else before.read(n)) is not None}))
    assert all(after.read(n) == before.read(n) for n in after.names & before.names if n not in new)
    return after


def refused(before, *changes, edit=B.set_workbook_cells):
    with pytest.raises(Refused) as x:
        edit(before, list(changes))
    return str(x.value)


def put(at, sheet="A", **value):
    row, col = B.address(at)
    return dict(sheet=sheet, row=row, col=col, **value)


def sheet(p, name="a"):
    return p.read(f"xl/worksheets/{name}.xml").decode()


DATA = "<row r=\"2\" spans='1:3' ht=\"9\"><c r=\"A2\" t='s'><v>1</v></c><!-- <c r='B2'/> --><c r=\"C2\" s=\"1\"><f>A2&amp;\"x\"</f><v>7</v></c></row>\n<row r='5'><c r='B5'><v>5</v></c></row>"


def test_changes_are_merged_in_order():
    before = book(DATA, '<dimension ref="A2:C5"/>', "<pageMargins left='1'/>")
    after = edited(before, put("B2", text="=SUM(A1) <&>"), put("C2", number=1.5), put("A1", boolean=True), put("E3", text=""), put("A5", number=-2.0), put("D9", number=1e300))
    assert [r[:5] for r in packages._sheet_cells(after)] == [
        ("A", 1, 1, "boolean", "1"), ("A", 2, 1, "text", "one"), ("A", 2, 2, "text", "=SUM(A1) <&>"), ("A", 2, 3, "number", "1.5"), ("A", 3, 5, "text", ""), ("A", 5, 1, "number", "-2.0"), ("A", 5, 2, "number", "5"), ("A", 9, 4, "number", "1e+300"),
    ]
    text = sheet(after)
    assert "<c r=\"A2\" t='s'><v>1</v></c><!-- <c r='B2'/> -->" in text and '<c r="C2" s="1"><v>1.5</v></c>' in text and "<c r='B5'><v>5</v></c>" in text and "<pageMargins left='1'/>" in text
    assert '<dimension ref="A1:E9"/>' in text and '<row r="2" ht="9">' in text
    # a formula went, and with it the order of calculation
    assert "xl/calcChain.xml" not in after.names and b"calcChain" not in after.read("[Content_Types].xml") + after.read("xl/_rels/workbook.xml.rels")
    assert "xl/calcChain.xml" in edited(before, put("A2", number=1.0)).names


def test_empty_sheets_rows_and_cells():
    after = edited(book("<row r='3'/>"), put("B3", number=1.0), put("A1", sheet="B", text="x"), put("C1", sheet="B", number=2.0))
    assert '<row r="3"><c r="B3"><v>1.0</v></c></row>' in sheet(after)
    assert sheet(after, "b") == f'<x:worksheet xmlns:x="{MAIN}"><x:sheetData><x:row r="1"><x:c r="A1" t="inlineStr"><x:is><x:t xml:space="preserve">x</x:t></x:is></x:c><x:c r="C1"><x:v>2.0</x:v></x:c></x:row></x:sheetData></x:worksheet>'
    emptied = edited(book(DATA), put("C2"), put("A2"), put("Z99"))
    assert [r[:3] for r in packages._sheet_cells(emptied) if r[4] is not None] == [("A", 5, 2)] and '<c r="C2" s="1"/>' in sheet(emptied)


def test_addresses_that_are_counted():
    before = book("<row><c><v>1</v></c><c><v>2</v></c></row><row><c><v>3</v></c></row>")
    after = edited(before, put("B1", number=9.0), put("D2", number=8.0), put("A3", number=7.0))
    assert [r[:3] + (float(r[4]),) for r in packages._sheet_cells(after)] == [("A", 1, 1, 1), ("A", 1, 2, 9), ("A", 2, 1, 3), ("A", 2, 4, 8), ("A", 3, 1, 7)]


def test_merged_ranges_and_shared_formulas():
    before = book("<row r='1'><c r='A1'><f t='shared' ref='A1:A2' si='0'>1</f></c><c r='B1'><f t='shared' si='0'/></c></row>", tail="<mergeCells><mergeCell ref='C3:D4'/></mergeCells>")
    assert [r[1:3] for r in packages._sheet_cells(edited(before, put("D4", number=1.0))) if r[4]] == [(3, 3)]
    assert refused(before, put("D4", number=1.0), put("C3", number=2.0)) == "INVALID_INPUT"
    assert refused(before, put("A1", number=1.0)) == "SHARED_FORMULA" and edited(before, put("B1", number=1.0))


def test_issues():
    before = book(DATA)
    assert refused(before) == refused(before, put("A1", number=1.0), put("A1", number=2.0)) == "INVALID_INPUT"
    assert refused(before, put("A1", sheet="none")) == "TARGET_NOT_FOUND" and refused(before, dict(sheet="A", row=0, col=1)) == refused(before, dict(sheet="A", row=1, col=513)) == "LIMIT_EXCEEDED"
    assert refused(book(DATA, **{"xl/vbaProject.bin": b""}), put("A1")) == "MACROS_REFUSED" and refused(book(DATA, **{"_xmlsignatures/o": b""}), put("A1")) == "SIGNED"
    assert refused(book("<row r='2'/><row r='1'/>"), put("A1", number=1.0)) == "ROW_ORDER" and refused(book("<row r='1'><c r='B1'/><c r='A1'/></row>"), put("A1", number=1.0)) == "CELL_ORDER"


def ask(box, sheet="A", **what):
    return dict(zip(("r0", "c0", "r1", "c1"), B.area(box), strict=True), sheet=sheet, **what)


def test_formats_are_interned():
    before = book(DATA)
    after = edited(before, ask("A1:B9", bold=True, color="#ffffff", fill="#244A67", border="thin"), ask("C1:C9", size=20, italic=False, name="Arial"), edit=B.format_workbook_cells)
    seen = {r[1:3]: r[3:] for r in B._cell_styles(after)}
    assert seen[(2, 1)] == seen[(5, 2)] == (True, False, 11.0, "Calibri", "FFFFFFFF", "FF244A67", "thin") and seen[(2, 3)] == (True, False, 20.0, "Arial", None, None, None)
    root = after.xml("xl/styles.xml")
    counts = {e.tag.rpartition("}")[2]: (e.get("count"), len(e)) for e in root}
    assert counts == {"fonts": ("4", 4), "fills": ("2", 2), "borders": ("2", 2), "cellXfs": ("4", 4)}
    named = edited(before, ask("A2", name="Arial"), edit=B.format_workbook_cells)  # a theme's font would win over the name
    assert named.read("xl/styles.xml").decode().count("scheme") == 1 and next(B._cell_styles(named))[6] == "Arial"
    assert [r[4:] for r in packages._sheet_cells(after)] == [r[4:] for r in packages._sheet_cells(before)] and "numFmtId=\"14\" fontId=\"3\"" in after.read("xl/styles.xml").decode()
    again = edited(after, ask("A1:B9", bold=True), edit=B.format_workbook_cells)
    assert again.read("xl/styles.xml") == after.read("xl/styles.xml") or len(again.xml("xl/styles.xml").find(f"{{{MAIN}}}cellXfs")) == 4


def test_formats_of_a_workbook_without_styles():
    after = edited(Package(xlsx({"S": [(1, 1, "x", None)], "T": [(1, 1, 2.0, None)]})), ask("A1", "*", italic=True, size=8.5), edit=B.format_workbook_cells)
    assert [r[3:6] for r in B._cell_styles(after)] == [(False, True, 8.5)] * 2 and b"styles.xml" in after.read("[Content_Types].xml") and b"rId3" in after.read("xl/_rels/workbook.xml.rels")


def test_issues_of_formats():
    before, to = book(DATA), dict(edit=B.format_workbook_cells)
    assert refused(before, ask("A1:B2"), **to) == refused(before, ask("A1:B2", bold=True), ask("B2:C3", "*", fill="#000000"), **to) == "INVALID_INPUT"
    assert refused(before, ask("X1:Z9", bold=True), **to) == refused(before, ask("B2:A1", bold=True), **to) == "INVALID_INPUT"
    assert refused(before, ask("A1", "none", bold=True), **to) == "TARGET_NOT_FOUND" and refused(before, ask("A1:SZ1", bold=True), **to) == "LIMIT_EXCEEDED"
    assert edited(before, ask("A1:B2", bold=True), ask("C2:C2", bold=True), ask("A3:C9", bold=True), **to)


def test_bad_files_become_issues(spark):
    good = packed({n: book(DATA).read(n) for n in book(DATA).names})
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:200])), ("c", bytearray(b"no zip")), ("d", bytearray(good))], "path string, content binary")
    changes = spark.createDataFrame([("a", "A", 1, 1, 2.0), ("b", "A", 1, 1, 2.0), ("c", "A", 1, 1, 2.0)], "path string, sheet string, row int, col int, number double")
    done = {r.path: (r.issue, bytes(r.content)) for r in B.edit_workbooks(files, changes, B.set_workbook_cells).collect()}
    assert done["b"] == ("CONTAINER_UNREADABLE", good[:200]) and done["c"] == ("CONTAINER_UNREADABLE", b"no zip") and done["a"][0] is None and set(done) == {"a", "b", "c"}
    after = spark.createDataFrame([("a", bytearray(done["a"][1]))], "path string, content binary")
    assert [tuple(r) for r in B.part_changes(files.where("path = 'a'"), after).collect()] == [("a", "xl/worksheets/a.xml", "changed")]
