"""New documents with pictures and a table of contents, and readers of both.

A picture keeps its bytes in a part of its own; type and size in pixels are told by these bytes. A table of contents is a
field whose entries lead to bookmarks of the headings; readers may renew it, which the settings ask for.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .designs import styles_part
from .packages import DOCUMENT, Package, Refused, Rows, _body, attr, child, extract, local, made_files, rows_of, spread, text_of
from .writers import _HEAD, _KIND, _R, _W, _rels, _safe, _types, _XML, packed, paragraph_xml, styles_xml

#: EMU of a millimetre and of a pixel where a picture's size is not given, fixed values; levels of contents at most.
MILLIMETRE, PIXEL, LEVELS = 36_000, 9_525, 9
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"


def picture(data: bytes | None) -> tuple[str, int, int]:
    """(png or jpeg, width, height in pixels) of a picture by its own bytes; others are refused."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame
                high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", wide, high
            at += 2 + size
    raise Refused("FORMAT_MISMATCH")


def _level(block: dict) -> int | None:
    found = re.fullmatch(r"Heading([1-9])", block.get("style") or "") if block["kind"] == "paragraph" else None
    return int(found[1]) if found else None


def _drawing(number: int, rel: str, wide: int, high: int, alt: str | None) -> str:
    name = f'id="{number}" name="Picture {number}"'
    return (
        f'<w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:drawing><wp:inline xmlns:wp="{_DRAWING}/wordprocessingDrawing" distT="0" distB="0" distL="0" distR="0"><wp:extent cx="{wide}" cy="{high}"/>'
        f'<wp:docPr {name} descr="{_safe(alt).replace(chr(34), "&quot;")}"/><a:graphic xmlns:a="{_DRAWING}/main"><a:graphicData uri="{_DRAWING}/picture"><pic:pic xmlns:pic="{_DRAWING}/picture">'
        f'<pic:nvPicPr><pic:cNvPr {name}/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip xmlns:r="{_R}" r:embed="{rel}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{wide}" cy="{high}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
    )


def _field(kind: str, more: str = "") -> str:
    return f'<w:r><w:fldChar w:fldCharType="{kind}"{more}/></w:r>'


def _contents(headings: list[tuple[int, int, str]], levels: int) -> str:
    """The field of contents: an entry a heading (number, level, text) that leads to the heading's bookmark."""
    shown = [h for h in headings if h[1] <= levels]
    start = _field("begin", ' w:dirty="true"') + f'<w:r><w:instrText xml:space="preserve"> TOC \\o "1-{levels}" \\h \\z \\u </w:instrText></w:r>' + _field("separate")
    if not shown:
        return f"<w:p>{start}{_field('end')}</w:p>"
    out = []
    for k, (number, level, text) in enumerate(shown):
        link = f'<w:hyperlink w:anchor="_Toc{number}" w:history="1"><w:r><w:t xml:space="preserve">{_safe(text)}</w:t></w:r></w:hyperlink>'
        out.append(f'<w:p><w:pPr><w:pStyle w:val="TOC{level}"/></w:pPr>{start if k == 0 else ""}{link}{_field("end") if k == len(shown) - 1 else ""}</w:p>')
    return "".join(out)


def illustrated_docx(blocks: list[dict], preset: str | None = None) -> bytes:
    """A document of blocks in order: paragraph (text, style), pageBreak, image (data, width_mm and height_mm or null for
    96 pixels an inch, text as what it shows, caption), contents (text as its title, levels). Every heading gets a bookmark
    if there are contents. Refused are pictures that are neither PNG nor JPEG, or without extent, and other kinds."""
    numbered = [(n, _level(b), b.get("text") or "") for n, b in enumerate(blocks) if _level(b)]
    listed = any(b["kind"] == "contents" for b in blocks)
    rels, parts, body = [("styles", "styles.xml"), ("settings", "settings.xml")], {}, []
    defaults = dict(_XML)
    for n, b in enumerate(blocks):
        if b["kind"] == "paragraph":
            xml = paragraph_xml(b.get("text"), b.get("style"))
            if listed and _level(b):
                head, tail = xml.index("<w:r>"), xml.rindex("</w:p>")
                xml = f'{xml[:head]}<w:bookmarkStart w:id="{n}" w:name="_Toc{n}"/>{xml[head:tail]}<w:bookmarkEnd w:id="{n}"/></w:p>'
            body.append(xml)
        elif b["kind"] == "pageBreak":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        elif b["kind"] == "contents":
            if b.get("text"):
                body.append(paragraph_xml(b["text"], "Title"))
            body.append(_contents(numbered, min(LEVELS, b.get("levels") or 3)))
        elif b["kind"] == "image":
            kind, wide, high = picture(b.get("data"))
            size = [round(b[k] * MILLIMETRE) if b.get(k) is not None else v * PIXEL for k, v in (("width_mm", wide), ("height_mm", high))]
            if min(size) <= 0:
                raise Refused("INVALID_INPUT")
            number = len(parts) + 1
            name = f"media/image{number}.{kind}"
            parts[f"word/{name}"] = b["data"]
            defaults[kind] = f"image/{kind}"
            rels.append(("image", name))
            body.append(_drawing(number, f"rId{len(rels)}", *size, b.get("text")))
            if b.get("caption"):
                body.append(paragraph_xml(b["caption"], "Caption"))
        else:
            raise Refused("INVALID_INPUT")
    settings = '<w:updateFields w:val="true"/>' if listed else ""
    types = {DOCUMENT: f"{_KIND}wordprocessingml.document.main+xml", "word/styles.xml": f"{_KIND}wordprocessingml.styles+xml", "word/settings.xml": f"{_KIND}wordprocessingml.settings+xml"}
    return packed(
        {
            "[Content_Types].xml": _types(defaults, types), "_rels/.rels": _rels([("officeDocument", DOCUMENT)]),
            DOCUMENT: f'{_HEAD}<w:document {_W}><w:body>{"".join(body)}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>',
            "word/_rels/document.xml.rels": _rels(rels), "word/styles.xml": styles_xml() if preset is None else _HEAD + styles_part(preset), "word/settings.xml": f"{_HEAD}<w:settings {_W}>{settings}</w:settings>",
        }
        | parts
    )


def build_illustrated(blocks: DataFrame, by: str = "path") -> DataFrame:
    """A document (path, content, issue) of the blocks (by, pos, kind, text, style, data, width_mm, height_mm, caption,
    levels) of each path; what is refused has no content but an issue."""
    fields = F.struct("pos", "kind", "text", "style", "data", "width_mm", "height_mm", "caption", "levels")
    grouped = spread(blocks.select(F.col(by).cast("string").alias("path"), fields.alias("block")), "path").groupBy("path").agg(F.array_sort(F.collect_list("block")).alias("blocks"))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, own in rows_of(batches, "path", "blocks"):
            try:
                yield path, illustrated_docx(own), None
            except Refused as refused:
                yield path, None, str(refused)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_files(tried(batches))

    return grouped.mapInArrow(run, "path string, content binary, issue string")


# --- readers ----------------------------------------------------------------------------------------------------------


def _pictures(p: Package) -> Rows:
    rels = p.optional("word/_rels/document.xml.rels")
    targets = {attr(e, "Id"): f"word/{attr(e, 'Target', '')}" for e in rels} if rels is not None else {}
    for k, e in enumerate(x for x in p.xml(DOCUMENT).iter() if local(x) in ("inline", "anchor")):
        blip = next((x for x in e.iter() if local(x) == "blip"), None)
        about, size = child(e, "docPr"), child(e, "extent")
        part = targets.get(attr(blip, "embed")) if blip is not None else None
        kind = wide = high = digest = issue = None
        if part in p.names:
            data = p.read(part)
            digest = hashlib.sha256(data).hexdigest()
            try:
                kind, wide, high = picture(data)
            except Refused as refused:
                issue = str(refused)
        else:
            issue = "PART_MISSING"
        extent = (None, None) if size is None else (int(size.get("cx")), int(size.get("cy")))
        yield (k, part, kind, wide, high, *extent, None if about is None else about.get("descr"), digest, issue)


def pictures(files: DataFrame) -> DataFrame:
    """The pictures of the body in order: part, kind, size in pixels and in EMU, what it shows, digest of its bytes, and
    why one could not be told."""
    return extract(files, _pictures, "picture int, part string, kind string, pixel_width int, pixel_height int, width bigint, height bigint, alt string, sha256 string, picture_issue string")


def _entries(p: Package) -> Rows:
    marks: dict[str, str] = {}
    entries, depth, inside = [], 0, False
    for e in _body(p).iter():
        if local(e) != "p":
            continue
        for x in e.iter():
            if local(x) == "bookmarkStart":
                marks[attr(x, "name")] = text_of(e)
            elif local(x) == "fldChar":
                depth += {"begin": 1, "end": -1}.get(attr(x, "fldCharType"), 0)
                inside = inside and depth > 0
            elif local(x) == "instrText" and re.match(r"\s*TOC\b", x.text or ""):
                inside = True
            elif local(x) == "hyperlink" and inside:
                style = child(e, "pPr", "pStyle")
                level = re.fullmatch(r"TOC(\d)", attr(style, "val", "")) if style is not None else None
                entries.append((len(entries), int(level[1]) if level else None, attr(x, "anchor"), text_of(x)))
    for entry in entries:
        yield (*entry, marks.get(entry[2]))


def contents_entries(files: DataFrame) -> DataFrame:
    """Entries of tables of contents in order: level, the bookmark that each leads to, its text, and the text of the
    paragraph that has the bookmark (null if none has)."""
    return extract(files, _entries, "entry int, level int, anchor string, text string, heading string")
