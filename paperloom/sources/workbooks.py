"""Writes into existing workbooks: literal values and formats of cells go into the XML of their sheets, all else stays.

A sheet is scanned once for the places of its rows and cells; changed rows are merged into the text in order, and every
other character of the part, like every other part, stays as it is. Formats are interned in the style part: fonts, fills,
borders and cell formats are looked up by their XML and added only if they are new.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.dom import minidom

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import TOKEN, elements, named, related, spliced, tag, text_of_part
from .packages import Package, Refused, Rows, attr, child, children, extract, local, sheet_parts
from .writers import _HEAD, _KIND, _letters, _safe, rewrite

#: Limits of a workbook, fixed values: last row and column that may be written, changes of one file.
MAX_ROW, MAX_COLUMN, MAX_CHANGES = 100_000, 512, 20_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_ADDRESS = re.compile(r"([A-Za-z]{1,3})([1-9]\d{0,6})")


def address(text: str | None) -> tuple[int, int]:
    """(row, column) of an address such as B7."""
    found = _ADDRESS.fullmatch((text or "").replace("$", ""))
    if not found:
        raise Refused("CELL_ADDRESS")
    return int(found[2]), _column(found[1])


@functools.lru_cache(4096)
def _column(letters: str) -> int:
    column = 0
    for letter in letters.upper():
        column = 26 * column + ord(letter) - 64
    return column


def area(text: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) of a range such as A1:C3, or of one cell."""
    first, _, last = text.partition(":")
    return (*address(first), *address(last or first))


@dataclass
class Spot:
    """Where an element stands in the text: its start, the end of its opening tag and its end."""

    start: int
    opened: int
    stop: int = 0
    number: int = 0
    attributes: dict[str, str] = field(default_factory=dict)
    formula: dict[str, str] | None = None
    filled: bool = False
    cells: list["Spot"] = field(default_factory=list)


#: Elements of a cell that are looked at, those that tell of content.
_OF_CELL = ("v", "is", "f")


class SheetText:
    """The text of a sheet part with the places of its data, rows and cells."""

    def __init__(self, package: Package, part: str):
        self.text = text_of_part(package, part)
        self.rows: list[Spot] = []
        self.data: Spot | None = None
        self.dimension: Spot | None = None
        self.merged: list[tuple[int, int, int, int]] = []
        self.prefix = ""
        self._scan()
        if self.data is None:
            raise Refused("SHEET_DATA_MISSING")

    def _scan(self) -> None:
        stack: list[str] = []
        row = cell = None
        for m in TOKEN.finditer(self.text):
            if m[2] is None:
                continue
            name, closing, alone = m[3], bool(m[1]), bool(m[5])
            if closing:
                stack.pop()
                if name == "c" and stack[-1:] == ["row"]:
                    cell.stop = m.end()
                elif name == "row" and stack[-1:] == ["sheetData"]:
                    row.stop = m.end()
                elif name == "sheetData" and len(stack) == 1:
                    self.data.stop = m.end()
                continue
            depth = len(stack)
            if depth > 3 and stack[3] == "c" and name not in _OF_CELL:
                if not alone:
                    stack.append(name)
                continue
            spot = Spot(m.start(), m.end(), m.end() if alone else 0)
            if depth == 1 and name == "sheetData":
                self.data, self.prefix = spot, m[2][: -len(name)]
            elif depth == 1 and name == "dimension":
                spot.attributes, self.dimension = named(m[4]), spot
            elif name == "mergeCell" and stack[-1:] == ["mergeCells"]:
                self.merged.append(area(named(m[4]).get("ref", "")))
            elif name == "row" and stack[1:] == ["sheetData"]:
                row = spot
                row.attributes = named(m[4])
                row.number = int(row.attributes.get("r") or (self.rows[-1].number + 1 if self.rows else 1))
                if self.rows and row.number <= self.rows[-1].number:
                    raise Refused("ROW_ORDER")
                self.rows.append(row)
            elif name == "c" and stack[2:] == ["row"]:
                cell = spot
                cell.attributes = named(m[4])
                cell.number = address(cell.attributes["r"])[1] if "r" in cell.attributes else row.cells[-1].number + 1 if row.cells else 1
                if row.cells and cell.number <= row.cells[-1].number:
                    raise Refused("CELL_ORDER")
                row.cells.append(cell)
            elif len(stack) == 4 and stack[3] == "c":
                if name == "f":
                    cell.formula = named(m[4])
                cell.filled |= name in ("v", "is", "f") and not (alone and name != "f")
            if not alone:
                stack.append(name)

    def master(self, row: int, column: int) -> tuple[int, int]:
        """The cell that shows what is written to a cell of a merged range."""
        for r0, c0, r1, c1 in self.merged:
            if r0 <= row <= r1 and c0 <= column <= c1:
                return r0, c0
        return row, column


def _cell(prefix: str, row: int, column: int, style: str | None, change: dict) -> str:
    """A cell with a literal: a number, a truth value, or a text that stays a text whatever it begins with."""
    own = {"r": f"{_letters(column)}{row}"} | ({"s": style} if style else {})
    name = f"{prefix}c"
    if change.get("number") is not None:
        return f"{tag(name, own, False)}<{prefix}v>{change['number']!r}</{prefix}v></{name}>"
    if change.get("boolean") is not None:
        return f"{tag(name, own | {'t': 'b'}, False)}<{prefix}v>{int(change['boolean'])}</{prefix}v></{name}>"
    if change.get("text") is not None:
        inner = f'<{prefix}is><{prefix}t xml:space="preserve">{_safe(change["text"])}</{prefix}t></{prefix}is>'
        return f"{tag(name, own | {'t': 'inlineStr'}, False)}{inner}</{name}>"
    return tag(name, own, True) if style else ""  # emptied: only its format is left


def _writable(package: Package) -> dict[str, str]:
    if any(n.lower().endswith("vbaproject.bin") for n in package.names):
        raise Refused("MACROS_REFUSED")
    if any(n.startswith("_xmlsignatures/") for n in package.names):
        raise Refused("SIGNED")
    return dict(sheet_parts(package))


def _overwritten(cell: Spot) -> bool:
    """Whether a formula goes with the cell. One that other cells take their formula from is not given up."""
    if cell.formula is None:
        return False
    if cell.formula.get("t") in ("array", "dataTable") or cell.formula.get("t") == "shared" and "ref" in cell.formula:
        r0, c0, r1, c1 = area(cell.formula.get("ref") or cell.attributes.get("r") or "A1")
        if (r0, c0) != (r1, c1):
            raise Refused("SHARED_FORMULA")
    return True


def set_workbook_cells(package: Package, changes: list[dict] | None) -> dict[str, bytes | None]:
    """Write literals into cells: changes of (sheet, row, col, number, boolean, text), of which the first that is there
    counts; none of them empties a cell. A cell keeps its format, and loses its formula; what is written to a merged
    range goes to its first cell. Issues: TARGET_NOT_FOUND (no such sheet), INVALID_INPUT (a cell is written twice, or
    nothing is), LIMIT_EXCEEDED (outside the limits), SHARED_FORMULA (other cells depend on the formula),
    MACROS_REFUSED and SIGNED."""
    known = _writable(package)
    if not changes:
        raise Refused("INVALID_INPUT")
    if len(changes) > MAX_CHANGES or any(not 1 <= c["row"] <= MAX_ROW or not 1 <= c["col"] <= MAX_COLUMN for c in changes):
        raise Refused("LIMIT_EXCEEDED")
    by_sheet: dict[str, list[dict]] = {}
    for c in changes:
        by_sheet.setdefault(c["sheet"], []).append(c)
    if not by_sheet.keys() <= known.keys():
        raise Refused("TARGET_NOT_FOUND")
    out: dict[str, bytes | None] = {}
    lost = False
    for name, wanted in by_sheet.items():
        sheet = SheetText(package, known[name])
        cells: dict[int, dict[int, dict]] = {}
        for c in wanted:
            row, column = sheet.master(c["row"], c["col"])
            if column in cells.setdefault(row, {}):
                raise Refused("INVALID_INPUT")
            cells[row][column] = c
        text, gone = _merged(sheet, cells)
        out[known[name]] = text.encode()
        lost |= gone
    return out | (_without_chain(package) if lost else {})


def _merged(sheet: SheetText, cells: dict[int, dict[int, dict]]) -> tuple[str, bool]:
    """The sheet's text with changes merged into its rows in order, and whether a formula was given up."""
    p, numbers, lost = sheet.prefix, [r.number for r in sheet.rows], False
    pieces: list[tuple[int, int, str]] = []
    empty = sheet.data.opened == sheet.data.stop  # <sheetData/>
    fresh: dict[int, list[str]] = {}
    for row, changes in sorted(cells.items()):
        at = bisect_left(numbers, row)
        if at == len(numbers) or numbers[at] != row:
            made = "".join(_cell(p, row, c, None, changes[c]) for c in sorted(changes))
            if made:
                fresh.setdefault(at, []).append(f"{tag(f'{p}row', {'r': str(row)}, False)}{made}</{p}row>")
            continue
        spot = sheet.rows[at]
        columns = [c.number for c in spot.cells]
        # rows without a number of their own keep their place, as they are counted from the row before
        head = {k: v for k, v in spot.attributes.items() if k != "spans"} | {"r": str(row)}
        if spot.opened == spot.stop:
            made = "".join(_cell(p, row, c, None, changes[c]) for c in sorted(changes))
            pieces.append((spot.start, spot.stop, f"{tag(f'{p}row', head, False)}{made}</{p}row>"))
            continue
        pieces.append((spot.start, spot.opened, tag(f"{p}row", head, False)))
        end = sheet.text.rindex("<", spot.opened, spot.stop)
        added: dict[int, str] = {}
        for column in sorted(changes):
            k = bisect_left(columns, column)
            if k < len(columns) and columns[k] == column:
                old = spot.cells[k]
                lost |= _overwritten(old)
                pieces.append((old.start, old.stop, _cell(p, row, column, old.attributes.get("s"), changes[column])))
            else:
                place = spot.cells[k].start if k < len(columns) else end
                added[place] = added.get(place, "") + _cell(p, row, column, None, changes[column])
        pieces += [(place, place, new) for place, new in added.items()]
        for old in spot.cells:  # a cell that was counted from the one before gets its address
            if "r" not in old.attributes and old.number not in changes:
                pieces.append((old.start, old.opened, tag(f"{p}c", {"r": f"{_letters(old.number)}{row}"} | old.attributes, old.opened == old.stop)))
    for at, rows in fresh.items():
        place = sheet.rows[at].start if at < len(sheet.rows) else sheet.data.stop if empty else sheet.text.rindex("<", sheet.data.opened, sheet.data.stop)
        if at < len(sheet.rows) and "r" not in sheet.rows[at].attributes:
            raise Refused("ROW_NUMBERS_MISSING")
        if not empty:
            pieces.append((place, place, "".join(rows)))
    if empty and fresh:
        pieces.append((sheet.data.start, sheet.data.stop, f"<{p}sheetData>{''.join(sum(fresh.values(), []))}</{p}sheetData>"))
    if sheet.dimension is not None:
        pieces += _grown(sheet, cells)
    return spliced(sheet.text, pieces), lost


def _grown(sheet: SheetText, cells: dict[int, dict[int, dict]]) -> list[tuple[int, int, str]]:
    """The dimension of a sheet, if the written cells lie outside of it."""
    spots = [(r, c) for r, row in cells.items() for c, change in row.items() if any(change.get(k) is not None for k in ("number", "boolean", "text"))]
    if not spots:
        return []
    old = area(sheet.dimension.attributes.get("ref", "A1"))
    new = (min(old[0], *(r for r, _ in spots)), min(old[1], *(c for _, c in spots)), max(old[2], *(r for r, _ in spots)), max(old[3], *(c for _, c in spots)))
    if new == old:
        return []
    ref = f"{_letters(new[1])}{new[0]}:{_letters(new[3])}{new[2]}"
    return [(sheet.dimension.start, sheet.dimension.stop, tag(f"{sheet.prefix}dimension", sheet.dimension.attributes | {"ref": ref}, True))] if sheet.dimension.opened == sheet.dimension.stop else []


def _without_chain(package: Package) -> dict[str, bytes | None]:
    """Without the order of calculation, which names cells that have no formula any more; it is made anew on opening."""
    chain = "xl/calcChain.xml"
    if chain not in package.names:
        return {}
    cut = lambda name, pattern: {name: re.sub(pattern, "", package.read(name).decode()).encode()}
    return {chain: None} | cut("[Content_Types].xml", r'<(?:\w+:)?Override\b[^<>]*calcChain\.xml"[^<>]*/>') | cut("xl/_rels/workbook.xml.rels", r'<(?:\w+:)?Relationship\b[^<>]*calcChain\.xml"[^<>]*/>')


# --- formats ---------------------------------------------------------------------------------------------------------

#: Order of the properties of a font in the schema, fixed values.
FONT_ORDER = "b i strike condense extend outline shadow u vertAlign sz color name family charset scheme".split()
EDGES = ("left", "right", "top", "bottom")
_STYLES = "xl/styles.xml"
_PLAIN_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border><left/><right/><top/><bottom/><diagonal/></border></borders>'
    '<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
    '<cellXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/></cellXfs></styleSheet>'
)


class Styles:
    """The style part of a workbook, with its formats interned by their XML."""

    def __init__(self, package: Package):
        self.made = _STYLES not in package.names
        if not self.made:
            package.xml(_STYLES)
        self.part = minidom.parseString(_PLAIN_STYLES if self.made else package.read(_STYLES))
        self.lists = {c.localName: c for c in elements(self.part.documentElement)}
        if not {"fonts", "fills", "borders", "cellXfs"} <= self.lists.keys():
            raise Refused("STYLES_INCOMPLETE")
        self.places = {n: {x.toxml(): k for k, x in reversed(list(enumerate(elements(self.lists[n]))))} for n in ("fonts", "fills", "borders", "cellXfs")}
        self.known: dict[tuple, int] = {}

    def _new(self, name: str, **attributes):
        root = self.part.documentElement
        made = self.part.createElementNS(root.namespaceURI, f"{root.prefix}:{name}" if root.prefix else name)
        for k, v in attributes.items():
            made.setAttribute(k, str(v))
        return made

    def _at(self, kind: str, place: int):
        found = list(elements(self.lists[kind]))
        if not 0 <= place < len(found):
            raise Refused("STYLE_INDEX")
        return found[place]

    def _interned(self, kind: str, element) -> int:
        places, text = self.places[kind], element.toxml()
        if text not in places:
            places[text] = len(list(elements(self.lists[kind])))
            self.lists[kind].appendChild(element)
            self.lists[kind].setAttribute("count", str(places[text] + 1))
        return places[text]

    def _font(self, base: int, wanted: dict) -> int:
        font = self._at("fonts", base).cloneNode(True)
        new = {}
        for key, name in (("bold", "b"), ("italic", "i")):
            if wanted.get(key) is not None:
                new[name] = self._new(name) if wanted[key] else None
        if wanted.get("size") is not None:
            new["sz"] = self._new("sz", val=f"{wanted['size']:g}")
        if wanted.get("color") is not None:
            new["color"] = self._new("color", rgb=_argb(wanted["color"]))
        if wanted.get("name") is not None:
            new |= {"name": self._new("name", val=wanted["name"]), "scheme": None}  # a theme's font would win over the name
        for name, element in new.items():
            for old in [c for c in elements(font) if c.localName == name]:
                font.removeChild(old)
            if element is not None:
                later = FONT_ORDER[FONT_ORDER.index(name) + 1 :]
                font.insertBefore(element, next((c for c in elements(font) if c.localName in later), None))
        return self._interned("fonts", font)

    def _fill(self, color: str) -> int:
        fill, pattern = self._new("fill"), self._new("patternFill", patternType="solid")
        pattern.appendChild(self._new("fgColor", rgb=_argb(color)))
        fill.appendChild(pattern)
        return self._interned("fills", fill)

    def _border(self, base: int, kind: str) -> int:
        border = self._at("borders", base).cloneNode(True)
        for old in [c for c in elements(border) if c.localName in (*EDGES, "start", "end")]:
            border.removeChild(old)
        first = border.firstChild
        for edge in EDGES:
            border.insertBefore(self._new(edge, style=kind), first)
        return self._interned("borders", border)

    def with_format(self, base: int, wanted: dict) -> int:
        """The place of the cell format `base` with what is wanted put over it."""
        key = (base, *(wanted.get(k) for k in FORMAT))
        if key not in self.known:
            xf = self._at("cellXfs", base).cloneNode(True)
            number = lambda name: int(xf.getAttribute(name) or 0)
            if any(wanted.get(k) is not None for k in FORMAT[:5]):
                xf.setAttribute("fontId", str(self._font(number("fontId"), wanted)))
                xf.setAttribute("applyFont", "1")
            if wanted.get("fill") is not None:
                xf.setAttribute("fillId", str(self._fill(wanted["fill"])))
                xf.setAttribute("applyFill", "1")
            if wanted.get("border") is not None:
                xf.setAttribute("borderId", str(self._border(number("borderId"), wanted["border"])))
                xf.setAttribute("applyBorder", "1")
            self.known[key] = self._interned("cellXfs", xf)
        return self.known[key]

    def parts(self, package: Package) -> dict[str, bytes | None]:
        out: dict[str, bytes | None] = {_STYLES: self.part.toxml("utf-8")}
        if self.made:
            out |= related(package, "xl/_rels/workbook.xml.rels", "styles", "styles.xml", _STYLES, f"{_KIND}spreadsheetml.styles+xml")
        return out


def _argb(color: str) -> str:
    return f"FF{color.lstrip('#').upper()}"


#: What a format may ask for; the first five are of the font.
FORMAT = ("bold", "italic", "size", "name", "color", "fill", "border")


def format_workbook_cells(package: Package, formats: list[dict] | None) -> dict[str, bytes | None]:
    """Format the cells with content in ranges: formats of (sheet, * for all of them, r0, c0, r1, c1, and any of bold,
    italic, size, name, color, fill, border). A cell keeps what is not asked for, its value and its formula. Issues:
    TARGET_NOT_FOUND (no such sheet), INVALID_INPUT (nothing asked for, ranges that overlap or are reversed, no cell
    with content), LIMIT_EXCEEDED, MACROS_REFUSED and SIGNED."""
    known = _writable(package)
    if not formats or any(all(f.get(k) is None for k in FORMAT) or f["r1"] < f["r0"] or f["c1"] < f["c0"] for f in formats):
        raise Refused("INVALID_INPUT")
    if len(formats) > MAX_CHANGES or any(f["r0"] < 1 or f["c0"] < 1 or f["r1"] > MAX_ROW or f["c1"] > MAX_COLUMN for f in formats):
        raise Refused("LIMIT_EXCEEDED")
    if any(f["sheet"] != "*" and f["sheet"] not in known for f in formats):
        raise Refused("TARGET_NOT_FOUND")
    styles, out, done = Styles(package), {}, 0
    for name, part in known.items():
        ranges = sorted((f for f in formats if f["sheet"] in ("*", name)), key=lambda f: (f["r0"], f["c0"]))
        if not ranges:
            continue
        _apart(ranges)
        sheet, pieces = SheetText(package, part), []
        for row in sheet.rows:
            own = [f for f in ranges if f["r0"] <= row.number <= f["r1"]]
            for cell in row.cells if own else ():
                wanted = next((f for f in own if f["c0"] <= cell.number <= f["c1"]), None)
                if wanted is None or not cell.filled:
                    continue
                style = styles.with_format(int(cell.attributes.get("s") or 0), wanted)
                done += 1
                pieces.append((cell.start, cell.opened, tag(f"{sheet.prefix}c", cell.attributes | {"s": str(style)}, cell.opened == cell.stop)))
        if pieces:
            out[part] = spliced(sheet.text, pieces).encode()
    if not done:
        raise Refused("INVALID_INPUT")
    return out | styles.parts(package)


def _apart(ranges: list[dict]) -> None:
    """Ranges, sorted by first row, of which no two overlap: each is compared with those that are still open."""
    still: list[dict] = []
    for f in ranges:
        still = [x for x in still if x["r1"] >= f["r0"]]
        if any(x["c0"] <= f["c1"] and f["c0"] <= x["c1"] for x in still):
            raise Refused("INVALID_INPUT")
        still.append(f)


def edit_workbooks(files: DataFrame, changes: DataFrame, edit, by: str = "path") -> DataFrame:
    """Files (path, content, issue) with the changes of each path made by one of the edits above; files without a change
    are left out. Changes of one file meet in one row, MAX_CHANGES and one of them at most are carried on."""
    own = F.struct(*(c for c in changes.columns if c != by))
    grouped = changes.groupBy(F.col(by).cast("string").alias("path")).agg(F.slice(F.array_sort(F.collect_list(own)), 1, MAX_CHANGES + 1).alias("changes"))
    return rewrite(files.select("path", "content").join(grouped, "path"), edit, "changes")


def _cell_styles(p: Package) -> Rows:
    root = p.optional(_STYLES)
    lists = {local(e): list(e) for e in root} if root is not None else {}
    at = lambda kind, k: lists[kind][int(k or 0)] if kind in lists else None

    @functools.cache
    def seen(style: str | None) -> tuple:
        xf = at("cellXfs", style)
        font, fill, border = (None if xf is None else at(kind, xf.get(key)) for kind, key in (("fonts", "fontId"), ("fills", "fillId"), ("borders", "borderId")))
        flag = lambda n: font is not None and (x := child(font, n)) is not None and attr(x, "val", "1") not in ("0", "false")
        value = lambda n, a="val": None if font is None or child(font, n) is None else attr(child(font, n), a)
        solid = None if fill is None else child(fill, "patternFill", "fgColor")
        edges = {None if child(border, n) is None else attr(child(border, n), "style") for n in EDGES} if border is not None else {None}
        size = value("sz")
        return flag("b"), flag("i"), None if size is None else float(size), value("name"), value("color", "rgb"), None if solid is None else attr(solid, "rgb"), edges.pop() if len(edges) == 1 else None

    for sheet, part in sheet_parts(p):
        for row in children(child(p.xml(part), "sheetData"), "row"):
            for e in children(row, "c"):
                if len(e):
                    yield (sheet, *address(attr(e, "r")), *seen(e.get("s")))


def cell_styles(files: DataFrame) -> DataFrame:
    """The format of each cell with content: bold, italic, size, name, color, fill (both ARGB) and border, this only if
    it is the same on all four edges."""
    return extract(files, _cell_styles, "sheet string, row int, col int, bold boolean, italic boolean, size double, name string, color string, fill string, border string")


def part_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, part, change) of parts that two sets of files do not have in common byte for byte: added, removed or
    changed. Damaged files give no row; see the readers' issues for those."""
    digest = lambda files, name: extract(files, _digests, f"part string, {name} string").where("issue IS NULL").drop("issue")
    both = digest(before, "old").join(digest(after, "new"), ["path", "part"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", "part", change.alias("change"))


def _digests(p: Package) -> Iterator[tuple[str, str]]:
    import hashlib

    for i in p.infos:
        if not i.is_dir():
            yield i.filename, hashlib.sha256(p.read(i.filename)).hexdigest()
