"""New PDF files: headings, paragraphs, tables and page breaks flow over pages with repeated table heads and page numbers.

Text is set in Helvetica, which every reader has, so it must be ASCII: no font is embedded, and other text is refused.
Streams are not compressed, so that files can be profiled by their bytes (see packages.pdf_profile).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packages import Refused, made_files, rows_of, spread

#: Widths of the characters from space to tilde in Helvetica, in thousandths of the size: fixed values of the font.
WIDTHS = [int(x) for x in (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 "
    "1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 "
    "333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
).split()]
#: Page sizes in points, margins, sizes and colours, fixed values.
PAGES = {"A4": (595.28, 841.89), "LETTER": (612.0, 792.0)}
MARGIN, HEADINGS, CELL_SIZE, NUMBER_SIZE = 48, {1: 24, 2: 17, 3: 13}, 10, 9
INK, CELL_INK, NUMBER_INK, HEAD_FILL, CELL_FILL, EDGE = "#193B57", "#243447", "#627888", "#EAF1F6", "#FFFFFF", "#C8D5DF"
LEADING = 1.156
MAX_PAGES = 500


def width_of(text: str, size: float) -> float:
    return sum(WIDTHS[ord(c) - 32] for c in text) * size / 1000


def wrapped(text: str, size: float, room: float) -> list[str]:
    """Lines of a text that fit into room; a word that does not is cut."""
    lines = []
    for paragraph in re.split("\r\n|\r|\n", text.replace("\t", " ")):
        line = ""
        for word in paragraph.split(" "):
            longer = f"{line} {word}" if line else word
            if width_of(longer, size) <= room:
                line = longer
                continue
            if line:
                lines.append(line)
            line = ""
            for c in word:
                if line and width_of(line + c, size) > room:
                    lines.append(line)
                    line = ""
                line += c
        lines.append(line)
    return lines


def _color(value: str | None, default: str = "#000000") -> str:
    value = value or default
    if not re.fullmatch("#[0-9A-Fa-f]{6}", value):
        raise Refused("INVALID_INPUT")
    return " ".join(f"{int(value[k : k + 2], 16) / 255:.3f}" for k in (1, 3, 5))


class _Flow:
    """Pages of drawing operators; y goes down from the top edge."""

    def __init__(self, size: tuple[float, float], max_pages: int):
        self.wide, self.high = size
        self.room, self.max_pages = self.wide - 2 * MARGIN, max_pages
        self.pages: list[list[str]] = []
        self.turn()

    def turn(self):
        if len(self.pages) >= self.max_pages:
            raise Refused("LIMIT_EXCEEDED")
        self.pages.append([])
        self.y = float(MARGIN)

    def line(self, text: str, x: float, y: float, size: float, color: str, page: int = -1):
        shown = re.sub(r"([\\()])", r"\\\1", text)
        self.pages[page].append(f"BT {color} rg /F1 {size:g} Tf {x:.2f} {self.high - y - size:.2f} Td ({shown}) Tj ET")

    def text(self, text: str, size: float, color: str, line_gap: float = 0, after: float = 0):
        step = size * LEADING + line_gap
        for line in wrapped(text, size, self.room):
            if self.y + step > self.high - MARGIN:
                self.turn()
            self.line(line, MARGIN, self.y, size, color)
            self.y += step
        self.y += after

    def row(self, cells: list[str], head: bool):
        each, tall = self.room / len(cells), self.row_height(cells)
        for k, cell in enumerate(cells):
            x = MARGIN + k * each
            self.pages[-1].append(f"{_color(HEAD_FILL if head else CELL_FILL)} rg {_color(EDGE)} RG {x:.2f} {self.high - self.y - tall:.2f} {each:.2f} {tall:.2f} re B")
            for n, line in enumerate(wrapped(cell, CELL_SIZE, each - 14)):
                self.line(line, x + 7, self.y + 8 + n * CELL_SIZE * LEADING, CELL_SIZE, _color(CELL_INK))
        self.y += tall

    def row_height(self, cells: list[str]) -> float:
        return max(len(wrapped(c, CELL_SIZE, self.room / len(cells) - 14)) for c in cells) * CELL_SIZE * LEADING + 16

    def table(self, head: list[str], rows: list[list[str]]):
        if not head or any(len(r) != len(head) for r in rows):
            raise Refused("INVALID_INPUT")
        low, top = self.high - MARGIN, self.row_height(head)
        heights = [self.row_height(r) for r in rows]
        if any(h > self.high - 120 or MARGIN + top + h > low for h in [0, *heights]):
            raise Refused("INVALID_INPUT")  # a row that no page can hold under the head
        if self.y + top + (heights[0] if rows else 0) > low:
            self.turn()
        self.row(head, True)
        for row, tall in zip(rows, heights, strict=True):
            if self.y + tall > low:
                self.turn()
                self.row(head, True)
            self.row(row, False)
        self.y += 12


def pdf(title: str, blocks: list[dict], page_size: str = "A4", max_pages: int = MAX_PAGES) -> bytes:
    """A file of blocks: heading (level, text), paragraph (text, size, color), table (headers, rows), pageBreak. Refused
    are text beyond ASCII (FONT_REQUIRED), rows higher than a page or of other widths than the head, and blocks of other
    kinds (INVALID_INPUT), and more pages than max_pages (LIMIT_EXCEEDED). A null text counts as empty."""
    texts = [title, *(b.get("text") or "" for b in blocks), *(c for b in blocks for r in [b.get("headers") or [], *(b.get("rows") or [])] for c in r)]
    if any(re.search(r"[^\t\n\r\x20-\x7e]", x or "") for x in texts):
        raise Refused("FONT_REQUIRED")
    flow = _Flow(PAGES[page_size], max_pages)
    for b in blocks:
        if b["kind"] == "pageBreak":
            flow.turn()
        elif b["kind"] == "heading":
            if flow.y > flow.high - 130:
                flow.turn()
            flow.text(b.get("text") or "", HEADINGS.get(b.get("level") or 1, HEADINGS[3]), _color(INK), after=12)
        elif b["kind"] == "paragraph":
            flow.text(b.get("text") or "", b.get("size") or 11, _color(b.get("color")), line_gap=3, after=9)
        elif b["kind"] == "table":
            flow.table([c or "" for c in b.get("headers") or []], [[c or "" for c in r] for r in b.get("rows") or []])
        else:
            raise Refused("INVALID_INPUT")
    for k in range(len(flow.pages)):
        number = f"{k + 1} / {len(flow.pages)}"
        flow.line(number, flow.wide - MARGIN - width_of(number, NUMBER_SIZE), flow.high - 28, NUMBER_SIZE, _color(NUMBER_INK), k)
    return _file(title, flow)


def _file(title: str, flow: _Flow) -> bytes:
    """Objects 1 catalog, 2 page tree, 3 font, 4 information, then a page and its content in turn."""
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(len(flow.pages)))
    shown = re.sub(r"([\\()])", r"\\\1", title or "")
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Count {len(flow.pages)} /Kids [{kids}] >>",
        "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        f"<< /Title ({shown}) >>",
    ]
    for k, page in enumerate(flow.pages):
        stream = "\n".join(page)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {flow.wide:g} {flow.high:g}] /Resources << /Font << /F1 3 0 R >> >> /Contents {6 + 2 * k} 0 R >>")
        objects.append(f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream")
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n{body}\nendobj\n".encode("ascii")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R /Info 4 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("ascii")


def build_pdfs(blocks: DataFrame, by: str = "path") -> DataFrame:
    """A file (path, content, issue) of the blocks (by, pos, kind, text, level, headers, rows) of each path, titled by its
    path; what is refused has no content but an issue."""
    fields = F.struct("pos", "kind", "text", "level", "headers", "rows")
    grouped = spread(blocks.select(F.col(by).cast("string").alias("path"), fields.alias("block")), "path").groupBy("path").agg(F.array_sort(F.collect_list("block")).alias("blocks"))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, own in rows_of(batches, "path", "blocks"):
            try:
                yield path, pdf(path or "", own), None
            except Refused as refused:
                yield path, None, str(refused)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made_files(tried(batches))

    return grouped.mapInArrow(run, "path string, content binary, issue string")
