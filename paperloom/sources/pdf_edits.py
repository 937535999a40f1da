"""Edits of existing PDF files: pages turned, chosen, put in order and appended, stamps, notes and values of form fields.

What is reachable from the pages and the form is copied into a new file with new numbers; inherited attributes go to each
page, so that a page can leave its tree. Source bytes are never changed.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packages import Refused, Rows
from .pdf import width_of
from .pdf_objects import MAX_DEPTH, MAX_OBJECTS, MAX_PAGES, Document, Lexer, Name, Operator, Page, Ref, Stream, assembled, box_of, extract_pdf, features, pdf_column, skip_image, text_string

#: Edits of one file at most, size of a note's icon in points; fixed values.
MAX_EDITS, ICON = 1000, 20
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
#: Flags of a field: a radio button, a push button.
RADIO, PUSH = 1 << 15, 1 << 16


class Builder:
    """The objects of a new file."""

    def __init__(self):
        self.objects: dict[int, object] = {}

    def add(self, value) -> Ref:
        if len(self.objects) >= MAX_OBJECTS:
            raise Refused("LIMIT_OBJECTS")
        number = len(self.objects) + 1
        self.objects[number] = value
        return Ref(number)

    def get(self, value):
        for _ in range(MAX_DEPTH):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None


class Copier:
    """Copies of objects of a file: each indirect object once, whatever leads to it. Page tree nodes are not gone into, so
    that a page does not bring along all others."""

    def __init__(self, doc: Document, to: Builder):
        self.doc, self.to = doc, to
        self.numbers: dict[int, Ref] = {}
        self.pages: dict[int, Ref] = {}
        self.todo: list[tuple[Ref, object]] = []  # what has been led to and is to be copied

    def copy(self, value, depth: int = 0):
        if depth > MAX_DEPTH:
            raise Refused("LIMIT_DEPTH")
        if isinstance(value, Ref):
            return self._indirect(value)
        if isinstance(value, Stream):
            return Stream({k: self.copy(v, depth + 1) for k, v in value.dict.items() if k != "Length"}, value.raw)
        if isinstance(value, dict):
            return {k: self.copy(v, depth + 1) for k, v in value.items()}
        return [self.copy(v, depth + 1) for v in value] if isinstance(value, list) else value

    def _indirect(self, ref: Ref) -> Ref | None:
        if ref.number in self.pages:
            return self.pages[ref.number]
        if ref.number in self.numbers:
            return self.numbers[ref.number]
        value = self.doc.object(ref.number)
        plain = value.dict if isinstance(value, Stream) else value
        if value is None or isinstance(plain, dict) and plain.get("Type") in ("Pages", "Page"):
            return None  # a page that is not taken over, or nothing
        self.numbers[ref.number] = own = self.to.add(None)
        self.todo.append((own, value))
        return own

    def finish(self) -> None:
        """Copy what has been led to; a list instead of recursion, as chains of objects may be long."""
        while self.todo:
            own, value = self.todo.pop()
            self.to.objects[own.number] = self.copy(value)

    def page(self, page: Page) -> Ref:
        """A page with what it inherits; its tree's node is set when the file is put together."""
        own = self.to.add(None)
        if isinstance(page.ref, Ref):
            self.pages[page.ref.number] = own
        kept = {k: page.get(k) for k in INHERITED if page.get(k) is not None}
        self.todo.append((own, {k: v for k, v in page.dict.items() if k != "Parent"} | kept))
        return own


@dataclass
class Field:
    """A field of a form, or a node of its tree that has no fields below."""

    name: str
    ref: Ref | None
    dict: dict
    kind: str | None
    value: object
    flags: int
    widgets: list = field(default_factory=list)


def fields(get, form) -> list[Field]:
    """The fields of a form with the type, value and flags that they inherit, and the widgets that their nodes name."""
    form = get(form)
    out: list[Field] = []
    seen: set[int] = set()
    stack = [(r, "", None, None, 0, 0) for r in reversed(get(form.get("Fields")) or [])] if isinstance(form, dict) else []
    while stack:
        ref, above, kind, value, flags, depth = stack.pop()
        node = get(ref)
        if not isinstance(node, dict) or isinstance(ref, Ref) and ref.number in seen:
            continue
        if depth > MAX_DEPTH:
            raise Refused("LIMIT_DEPTH")
        if isinstance(ref, Ref):
            seen.add(ref.number)
        part = text_string(get(node.get("T")))
        name = above if part is None else f"{above}.{part}" if above else part
        kind, value = get(node.get("FT")) or kind, get(node["V"]) if "V" in node else value
        flags = get(node.get("Ff")) if isinstance(get(node.get("Ff")), int) else flags
        kids = get(node.get("Kids"))
        kids = kids if isinstance(kids, list) else []
        named = [k for k in kids if isinstance(get(k), dict) and get(k).get("T") is not None]
        if named:
            stack += [(k, name, kind, value, flags, depth + 1) for k in reversed(kids)]
        else:
            own = [k for k in kids if isinstance(get(k), dict)] if kids else [ref] if node.get("Subtype") == "Widget" else []
            out.append(Field(name, ref if isinstance(ref, Ref) else None, node, kind, value, flags, own))
    return out


def field_kind(f: Field) -> str:
    if f.kind == "Btn":
        return "radio" if f.flags & RADIO else "push" if f.flags & PUSH else "checkbox"
    return {"Tx": "text", "Ch": "choice", "Sig": "signature"}.get(f.kind, "other")


class Editor:
    def __init__(self, content: bytes):
        self.doc = Document(content)
        if features(self.doc) & {"signatures", "xfa"}:
            raise Refused("UNSUPPORTED_OPERATION")
        self.new = Builder()
        self.root = self.new.add({})
        self.tree = self.new.add({})
        copier = Copier(self.doc, self.new)
        self.order = [copier.page(p) for p in self.doc.pages()]
        self.catalog = copier.copy({k: v for k, v in self.doc.root.items() if k != "Pages"})
        self.info = copier.copy(self.doc.trailer.get("Info"))
        copier.finish()
        self.font: Ref | None = None

    def page(self, number: int) -> dict:
        if not 1 <= number <= len(self.order):
            raise Refused("INVALID_INPUT")
        return self.new.get(self.order[number - 1])

    def has_fields(self) -> bool:
        return bool(fields(self.new.get, self.catalog.get("AcroForm")))

    # operations ---------------------------------------------------------------------------------------------------

    def rotate(self, op: dict) -> None:
        page = self.page(op["page"])
        now = self.new.get(page.get("Rotate"))
        if op.get("degrees") is None or op["degrees"] % 90:
            raise Refused("INVALID_INPUT")
        page["Rotate"] = ((now if isinstance(now, int) else 0) + op["degrees"]) % 360

    def select_pages(self, op: dict) -> None:
        wanted = op.get("pages") or []
        if self.has_fields():
            raise Refused("UNSUPPORTED_OPERATION")
        if not wanted or len(set(wanted)) < len(wanted) or any(not 1 <= n <= len(self.order) for n in wanted):
            raise Refused("INVALID_INPUT")
        self.order = [self.order[n - 1] for n in wanted]

    def append_pages(self, op: dict) -> None:
        wanted, other = op.get("pages") or [], Document(op["source"] or b"")
        if fields(other.get, other.root.get("AcroForm")):
            raise Refused("UNSUPPORTED_OPERATION")
        pages = list(other.pages())
        if not wanted or any(not 1 <= n <= len(pages) for n in wanted):
            raise Refused("INVALID_INPUT")
        if len(self.order) + len(wanted) > MAX_PAGES:
            raise Refused("LIMIT_PAGES")
        copier = Copier(other, self.new)
        self.order += [copier.page(pages[n - 1]) for n in wanted]
        copier.finish()

    def _point(self, op: dict) -> tuple[dict, float, float, float, float]:
        """The page and the place of a point from its top left; pages that are turned or scaled are refused."""
        page = self.page(op["page"])
        unit = self.new.get(page.get("UserUnit"))
        if self.new.get(page.get("Rotate")) not in (None, 0) or unit not in (None, 1):
            raise Refused("UNSUPPORTED_OPERATION")
        x0, y0, x1, y1 = box_of(self.new.get, page.get)
        if not (0 <= op["x"] < x1 - x0 and 0 <= op["y"] < y1 - y0):
            raise Refused("INVALID_INPUT")
        return page, x0 + op["x"], y1 - op["y"], x1 - x0, y1 - y0

    def stamp(self, op: dict) -> None:
        page, x, y, wide, high = self._point(op)
        text, size, color = _ascii(op.get("text")), op.get("size") or 12.0, op.get("color") or "#000000"
        if "\n" in text or not re.fullmatch("#[0-9A-Fa-f]{6}", color) or width_of(text, size) + op["x"] > wide or op["y"] + size > high:
            raise Refused("INVALID_INPUT")
        resources = dict(self.new.get(page.get("Resources")) or {})
        fonts = dict(self.new.get(resources.get("Font")) or {})
        name = next(f"Stamp{k}" for k in range(len(fonts) + 1) if f"Stamp{k}" not in fonts)
        fonts[name] = self._helvetica()
        page["Resources"] = resources | {"Font": fonts}
        ink = " ".join(f"{int(color[k : k + 2], 16) / 255:.3f}" for k in (1, 3, 5))
        old = self.new.get(page.get("Contents"))
        streams = old if isinstance(old, list) else [page["Contents"]] if page.get("Contents") is not None else []
        before, after = self._saves(streams)
        drawn = f"\n{'Q ' * after}\nq BT {ink} rg /{name} {size:g} Tf 1 0 0 1 {x:.3f} {y - size:.3f} Tm ({_escaped(text)}) Tj ET Q\n"
        page["Contents"] = [self.new.add(Stream({}, b"q " * before + b"\n")), *streams, self.new.add(Stream({}, drawn.encode()))]

    def _saves(self, streams: list) -> tuple[int, int]:
        """How many states to save before the content of a page and to restore after it, so that whatever it does to its
        state is undone: content may save or restore more often than it should."""
        lexer = Lexer(b"\n".join(self.doc.decoded(s) for x in streams if isinstance(s := self.new.get(x), Stream)))
        depth = least = 0
        while not lexer.ended():
            try:
                value = lexer.object()
            except Refused:
                lexer.at += 1
                continue
            if isinstance(value, Operator):
                if value.word == "BI":
                    skip_image(lexer)
                depth += (value.word == "q") - (value.word == "Q")
                least = min(least, depth)
        return 1 - least, 1 - least + depth

    def _helvetica(self) -> Ref:
        self.font = self.font or self.new.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
        return self.font

    def add_note(self, op: dict) -> None:
        page, x, y, wide, high = self._point(op)
        if op["x"] + ICON > wide or op["y"] + ICON > high or not op.get("text"):
            raise Refused("INVALID_INPUT")
        text = op["text"]
        own = self.new.add(
            {"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [x, y - ICON, x + ICON, y], "Contents": _text_bytes(text), "Name": Name("Comment"), "F": 4, "P": self.order[op["page"] - 1]}
            | {"NM": f"note-{hashlib.sha256(text.encode()).hexdigest()[:16]}".encode()}
        )
        known = self.new.get(page.get("Annots"))
        page["Annots"] = [*(known if isinstance(known, list) else []), own]

    def _field(self, op: dict, kind: str) -> Field:
        found = [f for f in fields(self.new.get, self.catalog.get("AcroForm")) if f.name == op["name"]]
        if len(found) != 1 or field_kind(found[0]) != kind:
            raise Refused("INVALID_INPUT")
        # fields whose widgets are not those of the pages are not repaired
        own = {w.number for w in found[0].widgets if isinstance(w, Ref)}
        rows = [r for r in widget_rows(self.new.get, [(n, self.new.get(p)) for n, p in enumerate(self.order, 1)], self.catalog.get("AcroForm")) if r["name"] == op["name"] or r["object"] in own]
        if not own or sorted(r["object"] for r in rows) != sorted(own) or any(r["name"] != op["name"] or not r["linked"] for r in rows):
            raise Refused("UNSUPPORTED_OPERATION")
        return found[0]

    def set_text_field(self, op: dict) -> None:
        f, text = self._field(op, "text"), _ascii(op.get("value"))
        f.dict["V"] = _text_bytes(text)
        for ref in f.widgets:
            widget = self.new.get(ref)
            if widget is not f.dict:
                widget.pop("V", None)
            rect = [float(self.new.get(v)) for v in self.new.get(widget.get("Rect")) or [0, 0, 0, 0]]
            wide, high = abs(rect[2] - rect[0]), abs(rect[3] - rect[1])
            size = min(12.0, max(4.0, high * 0.7))
            drawn = f"/Tx BMC q BT 0 g /Helv {size:g} Tf 2 {max(1.0, (high - size) / 2 + 0.2 * size):.2f} Td ({_escaped(text)}) Tj ET Q EMC"
            look = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, wide, high], "Resources": {"Font": {"Helv": self._helvetica()}}}, drawn.encode())
            widget["AP"] = {"N": self.new.add(look)}

    def set_checkbox(self, op: dict) -> None:
        f = self._field(op, "checkbox")
        for ref in f.widgets:
            widget = self.new.get(ref)
            looks = self.new.get((self.new.get(widget.get("AP")) or {}).get("N"))
            on = next((k for k in looks if k != "Off"), None) if isinstance(looks, dict) else None
            if on is None:
                raise Refused("UNSUPPORTED_OPERATION")
            state = Name(on if op.get("checked") else "Off")
            widget["AS"] = state
            f.dict["V"] = state
            if widget is not f.dict:
                widget.pop("V", None)

    def bytes(self, packed: bool = False) -> bytes:
        if not self.order:
            raise Refused("INVALID_INPUT")
        for ref in self.order:
            self.new.objects[ref.number]["Parent"] = self.tree
        self.new.objects[self.tree.number] = {"Type": Name("Pages"), "Kids": list(self.order), "Count": len(self.order)}
        self.new.objects[self.root.number] = self.catalog | {"Type": Name("Catalog"), "Pages": self.tree}
        live = self._live()
        return assembled({n: v for n, v in self.new.objects.items() if n in live}, {"Root": self.root} | ({"Info": self.info} if self.info else {}), packed=packed)

    def _live(self) -> set[int]:
        """The objects that the root leads to; a page that was not chosen is let go, also where a link still names it."""
        chosen, seen = {r.number for r in self.order}, set()
        stack = [self.root, self.info]
        while stack:
            value = stack.pop()
            if isinstance(value, Ref):
                if value.number in seen:
                    continue
                found = self.new.objects.get(value.number)
                if isinstance(found, dict) and found.get("Type") == "Page" and value.number not in chosen:
                    continue
                seen.add(value.number)
                value = found
            value = value.dict if isinstance(value, Stream) else value
            stack += list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
        return seen


def _ascii(text: str | None) -> str:
    if re.search(r"[^\t\n\r\x20-\x7e]", text or ""):
        raise Refused("FONT_REQUIRED")
    return text or ""


def _escaped(text: str) -> str:
    return re.sub(r"([\\()])", r"\\\1", text.replace("\r", " ").replace("\n", " ").replace("\t", " "))


def _text_bytes(text: str) -> bytes:
    return text.encode("ascii") if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be")


OPERATIONS = {
    "rotate": Editor.rotate, "selectPages": Editor.select_pages, "appendPages": Editor.append_pages, "stamp": Editor.stamp, "addNote": Editor.add_note, "setTextField": Editor.set_text_field,
    "setCheckbox": Editor.set_checkbox,
}


def edit_pdf(content: bytes, edits: list[dict] | None) -> bytes:
    """The file after edits in order: rotate (page, degrees), selectPages (pages), appendPages (source, pages), stamp
    (page, x, y, text, size, color), addNote (page, x, y, text), setTextField (name, value), setCheckbox (name, checked);
    places are points from the top left. Issues: those of reading, INVALID_INPUT, UNSUPPORTED_OPERATION (signed or XFA
    files, pages chosen from a form, points on turned pages, fields whose widgets disagree), FONT_REQUIRED (text beyond
    ASCII), LIMIT_PAGES, LIMIT_OBJECTS."""
    if not edits or len(edits) > MAX_EDITS or any(e["kind"] not in OPERATIONS for e in edits):
        raise Refused("INVALID_INPUT")
    editor = Editor(content)
    for e in edits:
        OPERATIONS[e["kind"]](editor, e)
    return editor.bytes()


def edit_pdfs(files: DataFrame, edits: DataFrame, by: str = "path", order: str = "seq") -> DataFrame:
    """Files (path, content) with the edits of each path made in their order: path, content, issue. What is refused has
    no new content; files without an edit are left out."""
    own = F.struct(order, *(c for c in edits.columns if c not in (by, order)))
    grouped = edits.groupBy(F.col(by).cast("string").alias("path")).agg(F.slice(F.array_sort(F.collect_list(own)), 1, MAX_EDITS + 1).alias("edits"))
    return pdf_column(edit_pdf, "content", "edits")(files.select("path", "content").join(grouped, "path"))


# --- forms as tables --------------------------------------------------------------------------------------------------


def shown_value(value) -> str | None:
    """A value as text: of a text its characters, of a button the name of its state."""
    return str(value) if isinstance(value, Name) else text_string(value)


def widget_rows(get, pages, form) -> list[dict]:
    """The widgets of pages with what their own chain of parents says."""
    named = {w.number for f in fields(get, form) for w in f.widgets if isinstance(w, Ref)}
    nodes = {f.ref.number for f in fields(get, form) if f.ref is not None}
    out = []
    for number, page in pages:
        annots = get(page.get("Annots"))
        for ref in annots if isinstance(annots, list) else ():
            widget = get(ref)
            if not isinstance(widget, dict) or widget.get("Subtype") != "Widget":
                continue
            chain, refs, node = [], [], ref
            while isinstance(get(node), dict) and len(chain) <= MAX_DEPTH and not any(get(node) is c for c in chain):
                chain.append(get(node))
                refs.append(node)
                node = chain[-1].get("Parent")
            endless = isinstance(get(node), dict)
            parts = [t for c in reversed(chain) if (t := text_string(get(c.get("T")))) is not None]
            value = next((get(c["V"]) for c in chain if "V" in c), None)
            looks = get(widget.get("AP"))
            looks = get(looks.get("N")) if isinstance(looks, dict) else None
            state = get(widget.get("AS"))
            look = get(looks.get(state)) if isinstance(looks, dict) and isinstance(state, Name) else looks
            own = ref.number if isinstance(ref, Ref) else None
            out.append({
                "page": number, "object": own, "name": None if endless else ".".join(parts), "canonical": own in named, "linked": any(isinstance(r, Ref) and r.number in nodes for r in refs),
                "value": shown_value(value), "state": str(state) if isinstance(state, Name) else None, "appearance_bytes": len(look.raw) if isinstance(look, Stream) else None,
            })
    return out


def _fields(doc: Document) -> Rows:
    for f in fields(doc.get, doc.root.get("AcroForm")):
        yield (f.name, field_kind(f), shown_value(f.value), sorted(w.number for w in f.widgets if isinstance(w, Ref)))


def pdf_fields(files: DataFrame) -> DataFrame:
    """The fields of forms: name, kind, value and the object numbers of the widgets that their nodes name."""
    return extract_pdf(files, _fields, "name string, kind string, value string, widgets array<int>")


def _widgets(doc: Document) -> Rows:
    for w in widget_rows(doc.get, [(p.number, p.dict) for p in doc.pages()], doc.root.get("AcroForm")):
        yield tuple(w[k] for k in ("page", "object", "name", "canonical", "linked", "value", "state", "appearance_bytes"))


def pdf_widgets(files: DataFrame) -> DataFrame:
    """The widgets that pages name: the qualified name by their own parents (null if these have no end), canonical (a field
    names them), linked (their parents lead to a field), value, state and bytes of the look that is shown."""
    return extract_pdf(files, _widgets, "page int, object int, name string, canonical boolean, linked boolean, value string, state string, appearance_bytes int")
