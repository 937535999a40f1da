"""Text items of PDF pages with their boxes: content streams are run with a stack of graphics states, fonts give widths and
characters. Boxes are in points from the top left of the page as it is shown, after rotation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .packages import Refused, Rows
from .pdf import WIDTHS
from .pdf_objects import Document, Lexer, Name, Operator, Page, Ref, Stream, extract_pdf, skip_image

#: Limits, fixed values: items and operators of a file, forms inside of forms.
MAX_ITEMS, MAX_OPERATORS, MAX_FORMS = 200_000, 5_000_000, 20
#: A move inside of a shown array by more than this share of the size parts words.
WORD_GAP = 0.2
Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


# --- fonts ------------------------------------------------------------------------------------------------------------

#: Names of glyphs that are not letters, fixed values.
GLYPHS = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at "
    "bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde bullet endash emdash quoteleft quoteright quotedblleft quotedblright ellipsis germandbls "
    "zero one two three four five six seven eight nine section degree copyright registered Euro sterling yen fi fl minus".split(),
    " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~•–—‘’“”…ß0123456789§°©®€£¥ﬁﬂ−", strict=True,
))
_ACCENT = re.compile(r"([A-Za-z])(acute|grave|circumflex|dieresis|tilde|cedilla|ring|caron|macron|breve|ogonek)")
_ACCENTS = {"dieresis": "DIAERESIS", "ring": "RING ABOVE"}


def glyph_text(name: str) -> str | None:
    """The character of a glyph's name: a letter, a name of the list, a letter with an accent, or a code."""
    name = name.partition(".")[0]
    if len(name) == 1 or name in GLYPHS:
        return GLYPHS.get(name, name)
    if code := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(code[1] or code[2], 16)) if int(code[1] or code[2], 16) < 0x110000 else None
    if found := _ACCENT.fullmatch(name):
        size = "CAPITAL" if found[1].isupper() else "SMALL"
        try:
            return unicodedata.lookup(f"LATIN {size} LETTER {found[1].upper()} WITH {_ACCENTS.get(found[2], found[2].upper())}")
        except KeyError:
            return None
    return None


def unicode_map(data: bytes) -> tuple[dict[bytes, str], set[int]]:
    """The characters that a ToUnicode map gives to codes, and the lengths of its codes."""
    lexer, found, lengths, stack = Lexer(data), {}, set(), []
    text = lambda b: b.decode("utf-16-be", "replace") if isinstance(b, bytes) else ""
    while not lexer.ended():
        value = lexer.object()
        if not isinstance(value, Operator):
            stack.append(value)
            continue
        if value.word == "endcodespacerange":
            lengths |= {len(x) for x in stack if isinstance(x, bytes)}
        elif value.word == "endbfchar":
            found |= {a: text(b) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes)}
        elif value.word == "endbfrange":
            for low, high, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for k in range(min(last - first + 1, 1 << 16)):
                    code = (first + k).to_bytes(len(low), "big")
                    if isinstance(to, list):
                        found[code] = text(to[k]) if k < len(to) else ""
                    elif to:
                        found[code] = text(to[:-2] + ((int.from_bytes(to[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big"))
        stack = [] if value.word.startswith(("begin", "end")) else stack
        if len(found) > MAX_ITEMS:
            raise Refused("LIMIT_OBJECTS")
    return found, lengths


#: The character of each code, in the pages of codes that simple fonts begin with.
_CODES = {page: {k: bytes([k]).decode(page, "replace") for k in range(256)} for page in ("mac_roman", "cp1252")}


class Font:
    """Codes, widths (in thousandths) and characters of a font."""

    def __init__(self, doc: Document, spec: dict):
        get = doc.get
        self.composite = spec.get("Subtype") == "Type0"
        self.name = str(get(spec.get("BaseFont")) or "")
        self.vertical, self.widths, self.default = False, {}, 500.0
        self.space_width, self.texts, lengths = 1.0, {}, set()
        below = spec
        if self.composite:
            kids = get(spec.get("DescendantFonts"))
            below = get(kids[0]) if isinstance(kids, list) and kids else {}
            below = below if isinstance(below, dict) else {}
            self.vertical = str(get(spec.get("Encoding")) or "").endswith("-V")
            self.default = float(get(below.get("DW")) or 1000)
            self._of_ranges([get(x) for x in get(below.get("W")) or []], get)
        else:
            first, widths = get(spec.get("FirstChar")) or 0, get(spec.get("Widths"))
            if isinstance(widths, list):
                self.widths = {first + k: float(get(w) or 0) for k, w in enumerate(widths)}
            elif "Courier" in self.name:
                self.default = 600.0
            else:  # one of the fonts that every reader has
                self.widths = {32 + k: float(w) for k, w in enumerate(WIDTHS)}
            self._encoding(get(spec.get("Encoding")), get)
        about = get(below.get("FontDescriptor"))
        about = about if isinstance(about, dict) else {}
        if not self.composite and isinstance(get(about.get("MissingWidth")), (int, float)):
            self.default = float(get(about["MissingWidth"]))
        up, down = get(about.get("Ascent")), get(about.get("Descent"))
        self.ascent, self.descent = (up / 1000 if isinstance(up, (int, float)) and up else 0.8), (down / 1000 if isinstance(down, (int, float)) and down else -0.2)
        scale = get(spec.get("FontMatrix")) if spec.get("Subtype") == "Type3" else None
        self.scale = float(get(scale[0])) if isinstance(scale, list) and len(scale) == 6 else 0.001
        stream = get(spec.get("ToUnicode"))
        self.known: dict[bytes, str] = {}
        if isinstance(stream, Stream):
            self.known, lengths = unicode_map(doc.decoded(stream))
        self.width = 2 if self.composite and lengths != {1} else 1

    def _of_ranges(self, values: list, get) -> None:
        k = 0
        while k + 1 < len(values):
            if isinstance(values[k + 1], list):
                self.widths |= {values[k] + n: float(get(w) or 0) for n, w in enumerate(values[k + 1])}
                k += 2
            elif k + 2 < len(values):
                self.widths |= dict.fromkeys(range(values[k], min(values[k + 1], values[k] + 65535) + 1), float(values[k + 2]))
                k += 3
            else:
                return

    def _encoding(self, spec, get) -> None:
        base = spec if isinstance(spec, Name) else get(spec.get("BaseEncoding")) if isinstance(spec, dict) else None
        page = {"MacRomanEncoding": "mac_roman"}.get(base, "cp1252")
        self.texts = dict(_CODES[page])
        code = 0
        for x in (get(spec.get("Differences")) or []) if isinstance(spec, dict) else ():
            x = get(x)
            if isinstance(x, int):
                code = x
            else:
                self.texts[code] = glyph_text(str(x)) or "�"
                code += 1

    def glyphs(self, shown: bytes) -> Iterator[tuple[str, float, bool]]:
        """Text, width in units of the size, and whether it is a blank for word spacing, of each code."""
        for k in range(0, len(shown), self.width):
            code = shown[k : k + self.width]
            number = int.from_bytes(code, "big")
            text = self.known.get(code)
            if text is None:
                text = "�" if self.composite else self.texts.get(number, "�")
            yield text, self.widths.get(number, self.default) * self.scale, self.width == 1 and number == 32


# --- content ----------------------------------------------------------------------------------------------------------


@dataclass
class State:
    ctm: Matrix
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


@dataclass
class Item:
    text: str
    font: str
    size: float
    box: tuple[float, float, float, float] | None


class Interpreter:
    """Runs the content of a page and gathers its text items."""

    def __init__(self, doc: Document, view: Matrix, budget: list[int]):
        self.doc, self.view, self.budget = doc, view, budget
        self.items: list[Item] = []
        self.fonts: dict[int, Font] = {}

    def run(self, data: bytes, resources: dict, ctm: Matrix, depth: int = 0) -> None:
        if depth > MAX_FORMS:
            raise Refused("LIMIT_DEPTH")
        lexer, state, saved, args = Lexer(data), State(ctm), [], []
        line = at = UNIT
        while not lexer.ended():
            try:
                value = lexer.object()
            except Refused as x:
                if str(x) != "SYNTAX":
                    raise
                lexer.at += 1  # a damaged place is passed over
                continue
            if not isinstance(value, Operator):
                args.append(value)
                continue
            self.budget[0] -= 1
            if self.budget[0] < 0:
                raise Refused("LIMIT_OPERATORS")
            op, n = value.word, [float(x) for x in args if isinstance(x, (int, float)) and not isinstance(x, bool)]
            if op == "q":
                saved.append(replace(state))
            elif op == "Q":
                state = saved.pop() if saved else state
            elif op == "cm" and len(n) == 6:
                state.ctm = times(tuple(n), state.ctm)
            elif op == "BT":
                line = at = UNIT
            elif op == "Tf" and n and args and isinstance(args[0], Name):
                state.font, state.size = self._font(resources, args[0]), n[-1]
            elif op in ("Tc", "Tw", "TL", "Ts", "Tz") and n:
                setattr(state, {"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise", "Tz": "stretch"}[op], n[-1] / 100 if op == "Tz" else n[-1])
            elif op in ("Td", "TD") and len(n) == 2:
                if op == "TD":
                    state.leading = -n[1]
                line = at = times((1, 0, 0, 1, *n), line)
            elif op == "Tm" and len(n) == 6:
                line = at = tuple(n)
            elif op == "T*":
                line = at = times((1, 0, 0, 1, 0, -state.leading), line)
            elif op in ("Tj", "TJ", "'", '"') and args:
                if op == '"' and len(n) >= 2:
                    state.word, state.char = n[0], n[1]
                if op in "'\"":
                    line = at = times((1, 0, 0, 1, 0, -state.leading), line)
                at = self._show(state, at, args[-1] if isinstance(args[-1], list) else [args[-1]])
            elif op == "Do" and args and isinstance(args[0], Name):
                self._form(resources, args[0], state, depth)
            elif op == "BI":
                skip_image(lexer)
            args = []

    def _resource(self, resources: dict, kind: str, name: str):
        group = self.doc.get(resources.get(kind))
        return group.get(name) if isinstance(group, dict) else None

    def _font(self, resources: dict, name: str) -> Font | None:
        ref = self._resource(resources, "Font", name)
        spec = self.doc.get(ref)
        if not isinstance(spec, dict):
            return None
        key = ref.number if isinstance(ref, Ref) else -id(spec)
        if key not in self.fonts:
            self.fonts[key] = Font(self.doc, spec)
        return self.fonts[key]

    def _form(self, resources: dict, name: str, state: State, depth: int) -> None:
        form = self.doc.get(self._resource(resources, "XObject", name))
        if not isinstance(form, Stream) or form.dict.get("Subtype") != "Form":
            return
        matrix = self.doc.get(form.dict.get("Matrix"))
        matrix = tuple(float(self.doc.get(x)) for x in matrix) if isinstance(matrix, list) and len(matrix) == 6 else UNIT
        own = self.doc.get(form.dict.get("Resources"))
        self.run(self.doc.decoded(form), own if isinstance(own, dict) else resources, times(matrix, state.ctm), depth + 1)

    def _show(self, state: State, at: Matrix, shown: list) -> Matrix:
        """Show strings with the moves between them as one item; gives the text matrix after it."""
        font, size = state.font, state.size
        if font is None:
            return at
        words, across = [], 0.0
        for x in shown:
            if isinstance(x, (int, float)) and not isinstance(x, bool):
                if -x / 1000 > WORD_GAP and words and not words[-1].endswith(" "):
                    words.append(" ")
                across -= x / 1000 * size * state.stretch
            elif isinstance(x, bytes):
                for text, wide, blank in font.glyphs(x):
                    words.append(text)
                    across += (wide * size + state.char + (state.word if blank else 0.0)) * state.stretch
        text = "".join(words)
        if text.strip():
            if len(self.items) >= self.budget[1]:
                raise Refused("LIMIT_ITEMS")
            whole = times(times(at, state.ctm), self.view)
            corners = [moved(whole, x, y * size + state.rise) for x in (0.0, across) for y in (font.descent, font.ascent)]
            box = (min(x for x, _ in corners), min(y for _, y in corners), max(x for x, _ in corners), max(y for _, y in corners))
            scale = abs(whole[0] * whole[3] - whole[1] * whole[2]) ** 0.5
            self.items.append(Item(text, font.name, abs(size) * scale, None if font.vertical else box))
        step = (0.0, -across) if font.vertical else (across, 0.0)
        return times((1, 0, 0, 1, *step), at)


def view_of(doc: Document, page: Page) -> Matrix:
    """From the page's own coordinates to points from the top left of what is shown."""
    x0, y0, x1, y1 = doc.box(page)
    u = doc.get(page.dict.get("UserUnit"))
    u = float(u) if isinstance(u, (int, float)) and not isinstance(u, bool) and u > 0 else 1.0
    return {0: (u, 0.0, 0.0, -u, -x0 * u, y1 * u), 90: (0.0, u, u, 0.0, -y0 * u, -x0 * u), 180: (-u, 0.0, 0.0, u, x1 * u, -y0 * u), 270: (0.0, -u, -u, 0.0, y1 * u, x1 * u)}[doc.rotation(page)]


def page_content(doc: Document, page: Page) -> bytes:
    """The content of a page; its streams are parts of one, parted by blanks."""
    found = doc.get(page.dict.get("Contents"))
    streams = [doc.get(x) for x in found] if isinstance(found, list) else [found]
    return b"\n".join(doc.decoded(s) for s in streams if isinstance(s, Stream))


def page_items(doc: Document, page: Page, budget: list[int]) -> list[Item]:
    runner = Interpreter(doc, view_of(doc, page), budget)
    resources = doc.get(page.get("Resources"))
    runner.run(page_content(doc, page), resources if isinstance(resources, dict) else {}, UNIT)
    return runner.items


def _items(doc: Document) -> Rows:
    budget = [MAX_OPERATORS, MAX_ITEMS]
    for page in doc.pages():
        items = page_items(doc, page, budget)
        budget[1] -= len(items)
        for k, item in enumerate(items):
            yield (page.number, k, f"page/{page.number}/text/{k}", item.text, item.font, item.size, *(item.box or (None,) * 4))


def pdf_text_items(files: DataFrame) -> DataFrame:
    """The text items of all pages in the order of their content: page, item, pointer, text, font, size and box (x0, y0,
    x1, y1, from the top left of the page as shown; null for vertical writing). Blank items are left out."""
    return extract_pdf(files, _items, "page int, item int, pointer string, text string, font string, size double, x0 double, y0 double, x1 double, y1 double")
