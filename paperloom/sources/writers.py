"""Packages from tables: documents, workbooks and decks are assembled per file from its rows, and edited part by part."""

from __future__ import annotations

import bisect
import functools
import html
import io
import itertools
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.dom import minidom
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .designs import BULLETS, NUMBERS, numbering_part, styles_part
from .packages import DOCUMENT, PLAIN, SMALL_PART, Package, Refused, local, made_files, rows_of, sheet_parts, spread

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_W = f'xmlns:w="{_WORD}"'
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_DATE = (1980, 1, 1, 0, 0, 0)
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _deflated(data: bytes) -> tuple[int, bytes]:
    engine = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    return zlib.crc32(data), engine.compress(data) + engine.flush()


#: Small parts often are the same in many packages, and are deflated once for some of those that a worker has seen last.
_deflated_once = functools.lru_cache(256)(_deflated)


def packed(parts: dict[str, str | bytes]) -> bytes:
    """A package with fixed dates, so that equal parts give equal bytes."""
    made = {name: data.encode() if isinstance(data, str) else data for name, data in parts.items()}
    if len(made) > 1000 or sum(map(len, made.values())) > 1 << 30 or any(not n.isascii() or "\0" in n or n.endswith("/") for n in made):
        return _zipped(made)
    out, directory, at = [], [], 0
    for name, data in made.items():
        crc, small = (_deflated_once if len(data) <= SMALL_PART else _deflated)(data)
        # of both heads: version, flags, method, time and date, checksum, sizes, lengths of name and of what is behind it
        own = struct.pack("<5H3L2H", 20, 0, zipfile.ZIP_DEFLATED, 0, 33, crc, len(small), len(data), len(name), 0)
        out += [b"PK\3\4", own, name.encode(), small]
        directory += [b"PK\1\2\x14\3", own, struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), name.encode()]
        at += 30 + len(name) + len(small)
    listed = b"".join(directory)
    return b"".join([*out, listed, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(made), len(made), len(listed), at, 0)])


def _zipped(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, _DATE), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _types(defaults: dict[str, str], overrides: dict[str, str]) -> str:
    body = "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in defaults.items())
    body += "".join(f'<Override PartName="/{k}" ContentType="{v}"/>' for k, v in overrides.items())
    return f'{_HEAD}<Types xmlns="{_P}/content-types">{body}</Types>'


def _rels(targets: list[tuple[str, str]]) -> str:
    body = "".join(f'<Relationship Id="rId{k + 1}" Type="{_R}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets))
    return f'{_HEAD}<Relationships xmlns="{_P}/relationships">{body}</Relationships>'


_XML = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"}
_KIND = "application/vnd.openxmlformats-officedocument."


def _safe(text: str | None) -> str:
    return escape(_BAD.sub("", text or ""), {"\r": "&#13;"})


#: Where a paragraph's text goes on in another run; a character that XML does not allow in a text.
RUN_BREAK = "\x1f"


def paragraph_xml(text: str | None, style: str | None = None, para_id: str | None = None, level: int | None = None, ordered: bool = False) -> str:
    props = (f'<w:pStyle w:val="{_safe(style)}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{NUMBERS if ordered else BULLETS}"/></w:numPr>' if level is not None else "")
    native = f' xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" w14:paraId="{para_id}"' if para_id else ""
    runs = "".join(f'<w:r><w:t xml:space="preserve">{_safe(x)}</w:t></w:r>' for x in (text or "").split(RUN_BREAK))
    return f'<w:p{native}>{f"<w:pPr>{props}</w:pPr>" if props else ""}{runs}</w:p>'


@functools.lru_cache(16)
def styles_xml(levels: int = 9) -> str:
    normal = '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
    heads = "".join(
        f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr></w:style>' for k in range(1, levels + 1)
    )
    return f"{_HEAD}<w:styles {_W}>{normal}{heads}</w:styles>"


def docx(blocks: list[dict], preset: str | None = None) -> bytes:
    return packed(docx_parts(blocks, preset))


def docx_parts(blocks: list[dict], preset: str | None = None) -> dict[str, str]:
    """The parts of a document of blocks in order: paragraph (text, style, para_id), list (text, level, ordered), pageBreak,
    table (rows of cell texts), header (text, in the page header). Texts are cut into runs at RUN_BREAK. The styles are
    those of a preset, or nine plain headings; a numbering part is there if a list is."""
    body, header = [], []
    for b in blocks:
        if b["kind"] == "header":
            header.append(paragraph_xml(b.get("text")))
        elif b["kind"] == "table":
            rows = b.get("rows") or []
            width = max([len(r) for r in rows], default=0)
            grid = "".join(f'<w:gridCol w:w="{8600 // max(1, width)}"/>' for _ in range(width))
            cells = "".join("<w:tr>" + "".join(f"<w:tc><w:tcPr/>{paragraph_xml(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
            body.append(f"<w:tbl><w:tblPr/><w:tblGrid>{grid}</w:tblGrid>{cells}</w:tbl>")
        elif b["kind"] == "pageBreak":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        else:
            body.append(paragraph_xml(b.get("text"), b.get("style"), b.get("para_id"), (b.get("level") or 0) if b["kind"] == "list" else None, bool(b.get("ordered"))))
    types = {DOCUMENT: _KIND + "wordprocessingml.document.main+xml", "word/styles.xml": _KIND + "wordprocessingml.styles+xml"}
    rels, more = [("styles", "styles.xml")], {}
    if header:
        rels.append(("header", "header1.xml"))
        more["word/header1.xml"] = f'{_HEAD}<w:hdr {_W}>{"".join(header)}</w:hdr>'
        types["word/header1.xml"] = _KIND + "wordprocessingml.header+xml"
    if any(b["kind"] == "list" for b in blocks):
        rels.append(("numbering", "numbering.xml"))
        more["word/numbering.xml"] = _HEAD + numbering_part()
        types["word/numbering.xml"] = _KIND + "wordprocessingml.numbering+xml"
    shown = f'<w:headerReference xmlns:r="{_R}" w:type="default" r:id="rId2"/>' if header else ""
    return {
        "[Content_Types].xml": _types(_XML, types),
        "_rels/.rels": _rels([("officeDocument", DOCUMENT)]),
        DOCUMENT: f'{_HEAD}<w:document {_W}><w:body>{"".join(body)}<w:sectPr>{shown}<w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>',
        "word/_rels/document.xml.rels": _rels(rels),
        "word/styles.xml": styles_xml() if preset is None else _HEAD + styles_part(preset),
    } | more


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(sheets: dict[str, list[tuple[int, int, object, str | None]]]) -> bytes:
    """A workbook of sheets of cells (row, column, value, formula); numbers are numbers, all else inline text."""
    parts: dict[str, str | bytes] = {}
    for k, (_, cells) in enumerate(sheets.items(), 1):
        rows: dict[int, list[str]] = {}
        for r, c, value, formula in sorted(cells, key=lambda x: x[:2]):
            f = f"<f>{_safe(formula)}</f>" if formula else ""
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                cell = f'<c r="{_letters(c)}{r}">{f}<v>{value!r}</v></c>'
            else:
                cell = f'<c r="{_letters(c)}{r}" t="inlineStr">{f}<is><t xml:space="preserve">{_safe(None if value is None else str(value))}</t></is></c>'
            rows.setdefault(r, []).append(cell)
        data = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in rows.items())
        parts[f"xl/worksheets/sheet{k}.xml"] = f'{_HEAD}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{data}</sheetData></worksheet>'
    names = "".join(f'<sheet name="{_safe(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    book = f'{_HEAD}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_R}"><sheets>{names}</sheets></workbook>'
    overrides = {"xl/workbook.xml": _KIND + "spreadsheetml.sheet.main+xml"} | {n: _KIND + "spreadsheetml.worksheet+xml" for n in parts}
    rels = _rels([("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)])
    return packed({"[Content_Types].xml": _types(_XML, overrides), "_rels/.rels": _rels([("officeDocument", "xl/workbook.xml")]), "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels} | parts)


def pptx(slides: list[list[tuple[str, str, float | None]]], numbers: list[int] | None = None) -> bytes:
    """A deck of slides of shapes (placeholder type, text, size in points). The part of each slide is named by its number,
    which is its place unless numbers are given; the deck lists the slides in their order."""
    a = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{_R}"'
    parts: dict[str, str | bytes] = {}
    numbers = numbers or list(range(1, len(slides) + 1))
    for k, shapes in zip(numbers, slides, strict=True):
        body = ""
        for s, (holder, text, size) in enumerate(shapes, 2):
            sized = f'<a:rPr sz="{round(size * 100)}"/>' if size else ""
            body += f'<p:sp><p:nvSpPr><p:cNvPr id="{s}" name="s{s}"/><p:cNvSpPr/><p:nvPr><p:ph type="{holder}"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{s * 100}"/><a:ext cx="9000" cy="600"/></a:xfrm></p:spPr><p:txBody><a:p><a:r>{sized}<a:t>{_safe(text)}</a:t></a:r></a:p></p:txBody></p:sp>'
        parts[f"ppt/slides/slide{k}.xml"] = f"{_HEAD}<p:sld {a}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    listed = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in range(1, len(slides) + 1))
    deck = f"{_HEAD}<p:presentation {a}><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>"
    rels = _rels([("slide", f"slides/slide{k}.xml") for k in numbers])
    overrides = {"ppt/presentation.xml": _KIND + "presentationml.presentation.main+xml"} | {n: _KIND + "presentationml.slide+xml" for n in parts}
    return packed({"[Content_Types].xml": _types(_XML, overrides), "_rels/.rels": _rels([("officeDocument", "ppt/presentation.xml")]), "ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rels} | parts)


def build_documents(blocks: DataFrame, by: str = "path", preset: str | None = None) -> DataFrame:
    """A document (path, content) of the blocks (by, pos, kind, text, style, and level and ordered if lists are among
    them) of each path: one group is one file. preset names a column with the preset of each path."""
    fields = ["pos", "kind", "text", "style", *(c for c in ("level", "ordered") if c in blocks.columns)]
    preset_of = F.lit(None).cast("string") if preset is None else F.col(preset)
    dealt = spread(blocks.select(F.col(by).cast("string").alias("path"), F.struct(*fields).alias("block"), preset_of.alias("preset")), "path")
    grouped = dealt.groupBy("path").agg(F.array_sort(F.collect_list("block")).alias("blocks"), F.min("preset").alias("preset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_files((path, docx(b, p)) for path, b, p in rows_of(batches, "path", "blocks", "preset"))

    return grouped.mapInArrow(run, "path string, content binary")


def build_workbooks(cells: DataFrame, by: str = "path") -> DataFrame:
    """A workbook (path, content) of the cells (by, sheet, row, col, number, text) of each path."""
    dealt = spread(cells.select(F.col(by).cast("string").alias("path"), F.struct("sheet", "row", "col", "number", "text").alias("cell")), "path")
    grouped = dealt.groupBy("path").agg(F.array_sort(F.collect_list("cell")).alias("cells"))

    def book(cells_of: list[dict]) -> bytes:
        sheets: dict[str, list] = {}
        for c in cells_of:
            sheets.setdefault(c["sheet"], []).append((c["row"], c["col"], c["text"] if c["number"] is None else c["number"], None))
        return xlsx(sheets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_files((path, book(c)) for path, c in rows_of(batches, "path", "cells"))

    return grouped.mapInArrow(run, "path string, content binary")


def changed(package: Package, edit, what, order: list[str]) -> dict[str, bytes]:
    """The parts of a package after an edit: those that it had in their order, then new ones."""
    new = edit(package, what)
    return {k: v for k in (*order, *(n for n in new if n not in package.names)) if (v := new[k] if k in new else package.read(k)) is not None}


def rewritten(content: bytes, edit, what) -> tuple[bytes, str | None]:
    """The bytes of one file after an edit, as rewrite makes them, and the issue."""
    try:
        package = Package(content)
        return packed(changed(package, edit, what, [i.filename for i in package.infos])), None
    except Refused as refused:
        return content, str(refused)
    except Exception:  # no package fails the job, whatever it holds
        return content, "EDIT_FAILED"


def rewrite(files: DataFrame, edit, extra: str) -> DataFrame:
    """Files whose parts are changed by edit(package, row) -> {part: new bytes, None to take it out}; other parts stay
    byte for byte. A file that edit refuses keeps its content and has the issue. `extra` names the column with what to
    do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_files((path, *rewritten(content, edit, what)) for path, content, what in rows_of(batches, "path", "content", "what"))

    return files.select("path", "content", F.col(extra).alias("what")).mapInArrow(run, "path string, content binary, issue string")


def _text_spans(xml: str) -> Iterator[tuple[int, int, str]]:
    """Start, stop and text of the content of each text element of WordprocessingML in a part."""
    found = re.search(rf'xmlns:(\w+)=["\']{re.escape(_WORD)}["\']', xml)
    prefix = re.escape(found[1]) + ":" if found else ""
    for m in re.finditer(rf"<{prefix}t(?:\s[^<>]*)?(?:/>|>([^<]*)</{prefix}t\s*>)", xml):
        if m[1] is not None:
            yield m.start(1), m.end(1), html.unescape(m[1])


def replace_text(package: Package, edits: list[dict] | None) -> dict[str, bytes]:
    """Replace text in single runs of the body: edits of (expected, replacement), each of which must be the whole text of
    one text element, in whatever form it is written. All else of the part stays byte for byte."""
    package.xml(DOCUMENT)
    body = package.read(DOCUMENT).decode()
    for e in edits or ():
        spans = [(s, t) for s, t, text in _text_spans(body) if text == e["expected"]]
        if len(spans) != 1:
            raise Refused("TEXT_AMBIGUOUS" if spans else "TEXT_NOT_FOUND")
        (start, stop), new = spans[0], _safe(e["replacement"])
        tag = body.rfind("<", 0, start)
        space = "" if "xml:space" in body[tag:start] else ' xml:space="preserve"'
        body = f"{body[: start - 1]}{space}>{new}{body[stop:]}"
    return {DOCUMENT: body.encode()}


#: A token of a template: the name of a value between two pairs of braces, a fixed form.
TOKEN = re.compile(r"\{\{([A-Za-z][A-Za-z0-9_]{0,63})\}\}")
_FILLED = re.compile(r"word/(document|header\d*|footer\d*)\.xml")
_LOCKED = ("documentProtection", "trackRevisions", "permStart")


def fill_template(package: Package, values: list[dict] | None) -> dict[str, bytes]:
    """Put values in the place of {{name}} tokens of body, tables, headers and footers. A token may be spread over runs
    of a paragraph that hold text only; its value goes to the first of them and keeps that run's format. A token without
    a value, a value without a token, a value of several lines, braces that are no token, tokens elsewhere and protected
    or revision-tracked documents are issues."""
    given = {v["name"]: v["value"] or "" for v in values or ()}
    if any(re.search(r"[\r\n\t]", v) for v in given.values()):
        raise Refused("UNSUPPORTED_TEMPLATE")
    changed: dict[str, bytes] = {}
    used: set[str] = set()
    for name in sorted(n for n in package.names if n.startswith("word/") and n.endswith(".xml")):
        root = package.xml(name)
        if any(local(x) in _LOCKED for x in root.iter()):
            raise Refused("UNSUPPORTED_TEMPLATE")
        everything = "".join(root.itertext())
        if "{{" not in everything and "}}" not in everything:
            continue
        if not _FILLED.fullmatch(name):
            if "{{" in everything:
                raise Refused("UNSUPPORTED_TEMPLATE")
            continue
        part = minidom.parseString(package.read(name))
        filled = set().union(*(_fill_paragraph(x, given) for x in part.getElementsByTagNameNS(_WORD, "p")))
        if filled:
            changed[name] = part.toxml("utf-8")
            used |= filled
        elif TOKEN.search(everything):  # not in the text of a paragraph
            raise Refused("UNSUPPORTED_TEMPLATE")
    if set(given) - used:
        raise Refused("TEMPLATE_VALUE_UNUSED")
    if not used:
        raise Refused("UNSUPPORTED_TEMPLATE")
    return changed


def _fill_paragraph(paragraph, given: dict[str, str]) -> set[str]:
    """Fill the tokens of one paragraph and give their names."""
    texts = paragraph.getElementsByTagNameNS(_WORD, "t")
    contents = ["".join(n.data for n in t.childNodes if n.nodeType in (n.TEXT_NODE, n.CDATA_SECTION_NODE)) for t in texts]
    whole_text = "".join(contents)
    tokens = list(TOKEN.finditer(whole_text))
    left = TOKEN.sub("", whole_text)
    if "{{" in left or "}}" in left:
        raise Refused("UNSUPPORTED_TEMPLATE")
    if not tokens:
        return set()
    if any(m[1] not in given for m in tokens):
        raise Refused("TEMPLATE_VALUE_MISSING")
    ends = list(itertools.accumulate(map(len, contents)))
    for m in tokens:
        hit = [t for t, text, end in zip(texts, contents, ends, strict=True) if end - len(text) < m.end() and end > m.start()]
        _check_runs(paragraph, hit)
    for t, text, end in zip(texts, contents, ends, strict=True):
        start, out, at = end - len(text), [], end - len(text)
        for m in tokens:
            if m.end() <= start or m.start() >= end:
                continue
            out.append(whole_text[at : max(at, m.start())])
            if m.start() >= start:
                out.append(given[m[1]])
            at = min(end, m.end())
        if not out:
            continue
        out.append(whole_text[at:end])
        for n in list(t.childNodes):
            t.removeChild(n)
        t.appendChild(t.ownerDocument.createTextNode(_BAD.sub("", "".join(out))))
        t.setAttribute("xml:space", "preserve")
    return {m[1] for m in tokens}


def _check_runs(paragraph, texts) -> None:
    """A token may only go over runs that stand side by side in the paragraph and hold nothing but text and format."""
    runs = [t.parentNode for t in texts]
    if any(r.parentNode is not paragraph for r in runs):
        raise Refused("UNSUPPORTED_TEMPLATE")
    between = itertools.dropwhile(lambda n: n is not runs[0], paragraph.childNodes)
    for n in between:
        if n.nodeType == n.ELEMENT_NODE:
            inner = [c for c in n.childNodes if c.nodeType == c.ELEMENT_NODE]
            plain = n.localName == "r" and all(c.namespaceURI == _WORD and c.localName in ("t", "rPr") for c in inner)
            if n.namespaceURI != _WORD or not plain:
                raise Refused("UNSUPPORTED_TEMPLATE")
        if n is runs[-1]:
            return


#: Order of the properties of tables and cells in the schema, fixed values.
TABLE_PROPERTIES = (
    "tblStyle tblpPr tblOverlap bidiVisual tblStyleRowBandSize tblStyleColBandSize tblW jc tblCellSpacing tblInd tblBorders shd tblLayout tblCellMar tblLook tblCaption tblDescription"
).split()
CELL_PROPERTIES = "cnfStyle tcW gridSpan hMerge vMerge tcBorders shd noWrap tcMar textDirection tcFitText vAlign hideMark".split()


def _kids(element, name: str) -> list:
    return [c for c in element.childNodes if c.nodeType == c.ELEMENT_NODE and c.namespaceURI == _WORD and c.localName == name]


def _made(element, name: str, **attributes):
    """A new element in the prefix of the one that it is for."""
    prefix = f"{element.prefix}:" if element.prefix else ""
    new = element.ownerDocument.createElementNS(_WORD, prefix + name)
    for key, value in attributes.items():
        new.setAttributeNS(_WORD, prefix + key, str(value))
    return new


def _first(element, name: str):
    """The properties that lead an element, made if they are not there."""
    if not (found := _kids(element, name)):
        element.insertBefore(_made(element, name), element.firstChild)
        found = _kids(element, name)
    return found[0]


def _put(properties, order: list[str], name: str, **attributes) -> None:
    """Set one property in the place that the schema gives it."""
    for old in _kids(properties, name):
        properties.removeChild(old)
    later = set(order[order.index(name) + 1 :])
    place = next((c for c in properties.childNodes if c.nodeType == c.ELEMENT_NODE and c.localName in later), None)
    properties.insertBefore(_made(properties, name, **attributes), place)


def set_table_geometry(package: Package, edits: list[dict] | None) -> dict[str, bytes]:
    """Set the geometry of tables of the body, by their place in it: style_id, width, alignment, layout (fixed or autofit),
    column_widths, header_row, vertical_alignment; lengths in twips, null leaves a thing as it is. Column widths go to
    the grid and to the cells, and there must be one for each cell of the first row. In parts that are plain UTF-8 only
    the tables with an edit become trees, and all else stays as it is."""
    root = package.xml(DOCUMENT)
    if not any(c.tag == f"{{{_WORD}}}body" for c in root):
        raise Refused("BODY_MISSING")
    data = package.read(DOCUMENT)
    pieces = _outer_tables(data, root)
    if pieces is None:  # tables are found in the tree of the whole part
        part = minidom.parseString(data)
        _shape_all(part.getElementsByTagNameNS(_WORD, "tbl"), edits)
        return {DOCUMENT: part.toxml("utf-8")}
    spaces, outer = pieces
    first, trees = list(itertools.accumulate((n for *_, n in outer), initial=0)), {}
    for e in edits or ():
        if not 0 <= e["table"] < first[-1]:
            raise Refused("TARGET_NOT_FOUND")
        k = bisect.bisect_right(first, e["table"]) - 1
        if k not in trees:
            start, stop, _ = outer[k]
            trees[k] = minidom.parseString(b"<fragment " + spaces + b">" + data[start:stop] + b"</fragment>")
        _shape(trees[k].getElementsByTagNameNS(_WORD, "tbl")[e["table"] - first[k]], e)
    out, at = [], 0
    for k, tree in sorted(trees.items()):
        start, stop, _ = outer[k]
        out += [data[at:start], "".join(n.toxml() for n in tree.documentElement.childNodes).replace("\r", "&#13;").encode()]
        at = stop
    return {DOCUMENT: b"".join([*out, data[at:]])}


_ROOT = re.compile(rb"""<(\w+):document((?:\s+[\w:.-]+=(?:"[^"]*"|'[^']*'))*)\s*>""")
_SPACES = re.compile(rb"""\sxmlns(?::[\w.-]+)?=(?:"[^"]*"|'[^']*')""")


def _outer_tables(data: bytes, root) -> tuple[bytes, list[tuple[int, int, int]]] | None:
    """The namespaces of a part, and (start, stop, tables in it) of its tables that stand in no other one; null if a part is
    not plain enough to find them: in UTF-8, without comments and the like, with all namespaces declared at its root."""
    body = data.find(b"<", data.find(b"?>") + 2) if data.startswith(b"<?xml") else 0
    head = _ROOT.match(data, body)
    if head is None or b"<!" in data or b"<?" in data[body:] or re.search(rb"\sxmlns", data[head.end() :]) or not PLAIN.match(data):
        return None
    if f'xmlns:{head[1].decode()}="{_WORD}"'.encode() not in head[2] or data.count(_WORD.encode()) != 1:
        return None
    outer, depth, start, count = [], 0, 0, 0
    for m in re.finditer(rb"""<(/?)%s:tbl(?:\s(?:[^<>"']|"[^"]*"|'[^']*')*?)?(/?)>""" % re.escape(head[1]), data):
        if m[1]:
            depth -= 1
        else:
            start, count = (start, count + 1) if depth else (m.start(), 1)
            depth += not m[2]
        if not depth:
            outer.append((start, m.end(), count))
    if depth or sum(n for *_, n in outer) != sum(1 for _ in root.iter(f"{{{_WORD}}}tbl")):
        return None
    return b"".join(_SPACES.findall(head[2])), outer


def _shape_all(tables: list, edits: list[dict] | None) -> None:
    for e in edits or ():
        if not 0 <= e["table"] < len(tables):
            raise Refused("TARGET_NOT_FOUND")
        _shape(tables[e["table"]], e)


def _shape(table, wanted: dict) -> None:
    props, rows = _first(table, "tblPr"), _kids(table, "tr")
    simple = {"style_id": ("tblStyle", "val"), "alignment": ("jc", "val"), "layout": ("tblLayout", "type")}
    for key, (name, attribute) in simple.items():
        if (value := wanted.get(key)) is not None:
            _put(props, TABLE_PROPERTIES, name, **{attribute: value.lower() if key != "style_id" else value})
    if wanted.get("width") is not None:
        _put(props, TABLE_PROPERTIES, "tblW", w=wanted["width"], type="dxa")
    widths, vertical = wanted.get("column_widths"), wanted.get("vertical_alignment")
    if widths is not None:
        if not rows or len(_kids(rows[0], "tc")) != len(widths):
            raise Refused("INVALID_INPUT")
        for old in _kids(table, "tblGrid"):
            table.removeChild(old)
        grid = _made(table, "tblGrid")
        for w in widths:
            grid.appendChild(_made(table, "gridCol", w=w))
        table.insertBefore(grid, props.nextSibling)
    for row in rows:
        for k, cell in enumerate(_kids(row, "tc")):
            if widths is not None and k < len(widths):
                _put(_first(cell, "tcPr"), CELL_PROPERTIES, "tcW", w=widths[k], type="dxa")
            if vertical is not None:
                _put(_first(cell, "tcPr"), CELL_PROPERTIES, "vAlign", val=vertical.lower())
    if wanted.get("header_row") is not None and rows:
        marks = _first(rows[0], "trPr")
        for old in _kids(marks, "tblHeader"):
            marks.removeChild(old)
        if wanted["header_row"]:
            marks.appendChild(_made(marks, "tblHeader"))


#: Elements of a worksheet that come after its page setup in the schema, fixed values.
AFTER_PAGE_SETUP = (
    "headerFooter rowBreaks colBreaks customProperties cellWatches ignoredErrors smartTags drawing drawingHF picture oleObjects controls webPublishItems tableParts extLst"
).split()


def set_print_layout(package: Package, edits: list[dict] | None) -> dict[str, bytes]:
    """Set orientation, fit_to_width, fit_to_height and scale of sheets by name; null leaves a thing as it is. Fitting to
    pages turns the sheet's mark for it on. Sheets that are not named, and all other parts, stay byte for byte."""
    known = dict(sheet_parts(package))
    if any(e["sheet"] not in known for e in edits or ()):
        raise Refused("TARGET_NOT_FOUND")
    if len({e["sheet"] for e in edits or ()}) < len(edits or ()):
        raise Refused("INVALID_INPUT")
    changed = {}
    for e in edits or ():
        name = known[e["sheet"]]
        package.xml(name)
        part = minidom.parseString(package.read(name))
        sheet = part.documentElement
        prefix = f"{sheet.prefix}:" if sheet.prefix else ""
        kids = [c for c in sheet.childNodes if c.nodeType == c.ELEMENT_NODE]
        made = lambda tag: part.createElementNS(sheet.namespaceURI, prefix + tag)  # noqa: B023, E731
        setup = next((c for c in kids if c.localName == "pageSetup"), None)
        if setup is None:
            setup = made("pageSetup")
            sheet.insertBefore(setup, next((c for c in kids if c.localName in AFTER_PAGE_SETUP), None))
        for key, attribute in {"orientation": "orientation", "fit_to_width": "fitToWidth", "fit_to_height": "fitToHeight", "scale": "scale"}.items():
            if e.get(key) is not None:
                setup.setAttribute(attribute, str(e[key]))
        if e.get("fit_to_width") is not None or e.get("fit_to_height") is not None:
            props = next((c for c in kids if c.localName == "sheetPr"), None)
            if props is None:
                props = sheet.insertBefore(made("sheetPr"), sheet.firstChild)
            mark = next((c for c in props.childNodes if c.nodeType == c.ELEMENT_NODE and c.localName == "pageSetUpPr"), None)
            if mark is None:
                mark = props.appendChild(made("pageSetUpPr"))
            mark.setAttribute("fitToPage", "1")
        changed[name] = part.toxml("utf-8")
    return changed
