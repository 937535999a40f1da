"""Decks with their layouts, masters and themes: which part a slide leans on, colours of themes and maps of their names,
placeholders and backgrounds as tables; and covers written into a deck where its text leaves room."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame

from .markup import TOKEN, Fragment, declarations, elements, spliced, text_of_part
from .packages import Package, Refused, Rows, _slides, attr, child, children, extract, local, text_of, whole
from .writers import _HEAD, _KIND, _R, _rels, _safe, _types, _XML, packed

_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_PML = "http://schemas.openxmlformats.org/presentationml/2006/main"
#: Size of a slide where the deck gives none, in EMU; a fixed value.
DEFAULT_SIZE = (9_144_000, 6_858_000)


def linked(p: Package, part: str, kind: str) -> str | None:
    """The part that a part's relationship of a kind leads to, if it is there."""
    folder, name = posixpath.split(part)
    rels = p.optional(f"{folder}/_rels/{name}.rels")
    for e in rels if rels is not None else ():
        if (attr(e, "Type") or "").endswith(f"/{kind}") and attr(e, "TargetMode") != "External":
            target = attr(e, "Target", "")
            found = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            return found if found in p.names else None
    return None


def _chain(p: Package, slide: str) -> list[str | None]:
    """Slide, layout, master and theme; what comes after a broken link is null."""
    out: list[str | None] = [slide]
    for kind in ("slideLayout", "slideMaster", "theme"):
        out.append(linked(p, out[-1], kind) if out[-1] else None)
    return out


def _links(p: Package) -> Rows:
    for number, slide in enumerate(_slides(p), 1):
        yield (number, *_chain(p, slide))


def deck_links(files: DataFrame) -> DataFrame:
    """The layout, master and theme of each slide, null from the first link on that leads nowhere."""
    return extract(files, _links, "slide int, slide_part string, layout_part string, master_part string, theme_part string")


def _themes(p: Package) -> Rows:
    for name in sorted(n for n in p.names if re.fullmatch(r"ppt/theme/[^/]+\.xml", n)):
        scheme = child(p.xml(name), "themeElements", "clrScheme")
        for e in scheme if scheme is not None else ():
            color = next(iter(e), None)
            value = None if color is None else attr(color, "val") if local(color) == "srgbClr" else attr(color, "lastClr")
            yield (name, local(e), value.upper() if value and re.fullmatch("[0-9A-Fa-f]{6}", value) else None)


def theme_colors(files: DataFrame) -> DataFrame:
    """The colours of each theme by their name (dk1, accent2 and so on); null if a colour is none that can be told."""
    return extract(files, _themes, "theme_part string, name string, rgb string")


def _maps(p: Package) -> Rows:
    for name in sorted(n for n in p.names if re.fullmatch(r"ppt/(slides|slideLayouts|slideMasters)/[^/]+\.xml", n)):
        root = p.xml(name)
        own = child(root, "clrMap") if "Masters" in name else child(root, "clrMapOvr", "overrideClrMapping")
        for alias, to in (own.attrib if own is not None else {}).items():
            yield (name, local(alias), to)


def color_maps(files: DataFrame) -> DataFrame:
    """What a master calls the colours of its theme (bg1, tx2 and so on), and where slides and layouts override that."""
    return extract(files, _maps, "map_part string, alias string, name string")


def _backgrounds(p: Package) -> Rows:
    for number, slide in enumerate(_slides(p), 1):
        fill = child(p.xml(slide), "cSld", "bg", "bgPr", "solidFill")
        color = next(iter(fill), None) if fill is not None else None
        if color is not None and local(color) in ("srgbClr", "schemeClr"):
            yield (number, "rgb" if local(color) == "srgbClr" else "scheme", attr(color, "val"))


def slide_backgrounds(files: DataFrame) -> DataFrame:
    """The own solid backgrounds of slides: a colour, or the name of one of the theme's."""
    return extract(files, _backgrounds, "slide int, fill string, value string")


def _box(shape) -> tuple | None:
    frame = child(shape, "spPr", "xfrm")
    off, ext = (None, None) if frame is None else (child(frame, "off"), child(frame, "ext"))
    if off is None or ext is None:
        return None
    box = tuple(whole(e.get(k)) for e, k in ((off, "x"), (off, "y"), (ext, "cx"), (ext, "cy")))
    return None if None in box else box


def _shapes(p: Package, part: str):
    tree = child(p.xml(part), "cSld", "spTree")
    for k, e in enumerate(children(tree, "sp") if tree is not None else ()):
        holder = child(e, "nvSpPr", "nvPr", "ph")
        names = child(e, "nvSpPr", "cNvPr")
        kind, index = (None, None) if holder is None else (holder.get("type", "obj"), holder.get("idx", "0"))
        yield k, e, None if names is None else names.get("name"), kind, index, _box(e)


def _placeholders(p: Package) -> Rows:
    for name in sorted(n for n in p.names if re.fullmatch(r"ppt/(slides|slideLayouts|slideMasters)/[^/]+\.xml", n)):
        for k, e, own, kind, index, box in _shapes(p, name):
            body = child(e, "txBody")
            yield (name, k, own, kind, index, "\n".join(text_of(x) for x in children(body, "p")) if body is not None else None, *(box or (None,) * 4))


def deck_shapes(files: DataFrame) -> DataFrame:
    """Shapes of slides, layouts and masters with their placeholder's type and index, text and own box in EMU."""
    return extract(files, _placeholders, "shape_part string, shape int, name string, holder string, idx string, text string, x bigint, y bigint, width bigint, height bigint")


def _sizes(p: Package) -> Rows:
    size = child(p.xml("ppt/presentation.xml"), "sldSz")
    yield tuple(DEFAULT_SIZE if size is None else (whole(size.get("cx")), whole(size.get("cy"))))


def deck_sizes(files: DataFrame) -> DataFrame:
    return extract(files, _sizes, "slide_width bigint, slide_height bigint")


# --- covers -----------------------------------------------------------------------------------------------------------

#: Zones of a cover as shares of the slide (left, top, width, height), in the order in which they are tried, and colours
#: and font of its shapes: fixed values.
FIELD_ZONES = ((0.73, 0.04, 0.23, 0.18), (0.73, 0.78, 0.23, 0.18), (0.04, 0.04, 0.23, 0.18))
WORD_ZONES = ((0.055, 0.055, 0.34, 0.12), (0.055, 0.84, 0.34, 0.10), (0.55, 0.055, 0.16, 0.12))
PAPER, NAVY, GOLD, SUBTITLE, FACE = "F8F9FA", "1E3A5F", "D4AF37", "425466", "Aptos Display"
TITLES = ("title", "ctrTitle")


def meets(one, other) -> bool:
    """Whether two boxes (left, top, width, height) have a place in common; edges may touch."""
    return one[0] < other[0] + other[2] and other[0] < one[0] + one[2] and one[1] < other[1] + other[3] and other[1] < one[1] + one[3]


def effective_boxes(p: Package, slide: str):
    """(shape, placeholder type, text, box) of a slide's shapes; a placeholder without a box has that of its layout, by
    index, or of its master, by type."""
    _, layout, master, _ = _chain(p, slide)
    by_index = {i: b for _, _, _, h, i, b in _shapes(p, layout) if h} if layout else {}
    kinds = {i: h for _, _, _, h, i, _ in _shapes(p, layout) if h} if layout else {}
    by_kind = {h: b for _, _, _, h, _, b in _shapes(p, master) if h} if master else {}
    for _, e, _, kind, index, box in _shapes(p, slide):
        if box is None and kind:
            box = by_index.get(index)
        if box is None and kind:
            wanted = kinds.get(index, kind)
            box = by_kind.get(wanted) or by_kind.get({"ctrTitle": "title", "subTitle": "body", "obj": "body"}.get(wanted))
        yield e, kind, text_of(e), box


def _shape_xml(number: int, name: str, box, color: str, form: str, text: str | None = None, size: int = 0) -> str:
    fill = f'<a:solidFill><a:srgbClr val="{color}"/></a:solidFill>'
    frame = f'<a:xfrm><a:off x="{box[0]}" y="{box[1]}"/><a:ext cx="{box[2]}" cy="{box[3]}"/></a:xfrm><a:prstGeom prst="{form}"><a:avLst/></a:prstGeom>'
    run = "" if text is None else f'<a:r><a:rPr sz="{size * 100}" b="1">{fill}<a:latin typeface="{FACE}"/></a:rPr><a:t>{_safe(text)}</a:t></a:r>'
    shown = f"{frame}<a:noFill/>" if text is not None else f"{frame}{fill}<a:ln><a:noFill/></a:ln>"
    kind = ' txBox="1"' if text is not None else ""
    return (
        f'<p:sp xmlns:p="{_PML}" xmlns:a="{_A}"><p:nvSpPr><p:cNvPr id="{number}" name="{name}"/><p:cNvSpPr{kind}/><p:nvPr/></p:nvSpPr><p:spPr>{shown}</p:spPr>'
        f"<p:txBody><a:bodyPr/><a:lstStyle/><a:p>{run}</a:p></p:txBody></p:sp>"
    )


def add_cover(package: Package, wanted: list[dict] | None) -> dict[str, bytes | None]:
    """A cover of native shapes on the first slide: a light ground, a dark field with a dot, and a word; titles and
    subtitles take its colours and keep their places. Field and word go to the first zones that meet no text, and no
    text means no obstacle. Issues: NO_SLIDES, NO_FREE_ZONE, INVALID_INPUT (no word), MACROS_REFUSED."""
    if any(n.lower().endswith("vbaproject.bin") for n in package.names):
        raise Refused("MACROS_REFUSED")
    word = (wanted or [{}])[0].get("word")
    if not word or not word.strip():
        raise Refused("INVALID_INPUT")
    slides = _slides(package)
    if not slides:
        raise Refused("NO_SLIDES")
    (wide, high), part = next(iter(_sizes(package))), slides[0]
    taken = [(b[0] / wide, b[1] / high, b[2] / wide, b[3] / high) for _, _, text, b in effective_boxes(package, part) if b is not None and text.strip()]

    def free(zones, more=()):
        for z in zones:
            if not any(meets(z, t) for t in (*taken, *more)):
                return z
        raise Refused("NO_FREE_ZONE")

    field = free(FIELD_ZONES)
    at = free(WORD_ZONES, [field])
    scaled = lambda z: (int(wide * z[0]), int(high * z[1]), int(wide * z[2]), int(high * z[3]))
    dot = int(min(wide, high) * 0.045)
    text = text_of_part(package, part)
    number = max([int(n) for n in re.findall(r'<(?:\w+:)?cNvPr\b[^<>]*\bid="(\d{1,9})"', text)], default=1) + 1
    place = (int(wide * (field[0] + field[2] * 0.56)), int(high * (field[1] + field[3] * 0.28)), dot, dot)
    size = max(34, min(60, int(high / 12700 * 0.095)))
    below = _shape_xml(number, "Cover ground", (0, 0, wide, high), PAPER, "rect") + _shape_xml(number + 1, "Cover field", scaled(field), NAVY, "rect") + _shape_xml(number + 2, "Cover dot", place, GOLD, "ellipse")
    return {part: _covered(text, below, _shape_xml(number + 3, "Cover word", scaled(at), NAVY, "rect", word, size)).encode()}


def _covered(text: str, below: str, above: str) -> str:
    """The slide with shapes under all others and above them, and its titles in the cover's colours."""
    pieces, stack, end, spaces = [], [], 0, declarations(text)
    for m in TOKEN.finditer(text):
        if m[2] is None:
            continue
        name = m[3]
        if m[1]:
            start = stack.pop()
            if name == "sp" and [n for n, _ in stack] == ["sld", "cSld", "spTree"]:
                pieces.append((start[1], m.end(), _styled(spaces, text[start[1] : m.end()])))
            elif name == "spTree" and len(stack) == 2:
                end = m.start()
        elif not m[5]:
            stack.append((name, m.start()))
    # what belongs to the tree itself stands before its shapes
    head = re.compile(r"(?:\s*<(\w+:)?(nvGrpSpPr|grpSpPr)\b(?:[^<>]*/>|.*?</(?:\w+:)?\2\s*>))*", re.S)
    opened = re.search(r"<(?:\w+:)?spTree\b[^<>]*>", text)
    if opened is None or opened[0].endswith("/>"):
        raise Refused("SLIDE_UNEXPECTED")
    at = head.match(text, opened.end()).end()
    return spliced(text, [(at, at, below), *pieces, (end, end, above)])


def _styled(spaces: str, shape: str) -> str:
    """A shape with its runs in the cover's colours if it is a title or subtitle, else as it was."""
    tree = Fragment(spaces, shape)
    holder = next((e for e in tree.root.getElementsByTagNameNS(_PML, "ph")), None)
    kind = holder.getAttribute("type") if holder is not None else ""
    if kind not in (*TITLES, "subTitle"):
        return shape
    for run in tree.root.getElementsByTagNameNS(_A, "r"):
        prefix = f"{run.prefix}:" if run.prefix else ""
        make = lambda name, prefix=prefix, **own: _with(tree.document.createElementNS(_A, prefix + name), own)
        props = next((c for c in elements(run) if c.localName == "rPr"), None)
        if props is None:
            props = run.insertBefore(make("rPr"), run.firstChild)
        for old in [c for c in elements(props) if c.localName in ("solidFill", "gradFill", "noFill", "latin")]:
            if old.localName != "latin" or kind in TITLES:
                props.removeChild(old)
        fill = make("solidFill")
        fill.appendChild(make("srgbClr", val=NAVY if kind in TITLES else SUBTITLE))
        line = next((c for c in elements(props) if c.localName == "ln"), None)
        props.insertBefore(fill, line.nextSibling if line is not None else props.firstChild)
        if kind in TITLES:
            props.setAttribute("b", "1")
            later = ("ea", "cs", "sym", "hlinkClick", "hlinkMouseOver", "rtl", "extLst")
            props.insertBefore(make("latin", typeface=FACE), next((c for c in elements(props) if c.localName in later), None))
    return tree.text()


def _with(element, own: dict[str, str]):
    for k, v in own.items():
        element.setAttribute(k, v)
    return element


# --- new decks --------------------------------------------------------------------------------------------------------


def deck(slides: list[dict], colors: dict[str, str], names: dict[str, str], size: tuple[int, int] = DEFAULT_SIZE, boxes: dict[str, tuple] | None = None, broken: str | None = None) -> bytes:
    """A deck with one layout, master and theme. slides: shapes (type, index, text, box or None) and background (kind,
    value); colors: of the theme; names: the master's map; boxes: of placeholder types, on the master, and "layout" for
    those on the layout; broken: a kind of link that leads nowhere."""
    spaces = f'xmlns:a="{_A}" xmlns:p="{_PML}" xmlns:r="{_R}"'

    def shape(k, kind, index, text, box):
        frame = "" if box is None else f'<a:xfrm><a:off x="{box[0]}" y="{box[1]}"/><a:ext cx="{box[2]}" cy="{box[3]}"/></a:xfrm>'
        holder = f'<p:ph type="{kind}" idx="{index}"/>' if kind else ""
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{k + 2}" name="s{k}"/><p:cNvSpPr/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:spPr>{frame}</p:spPr><p:txBody><a:bodyPr/><a:p><a:r><a:t>{_safe(text)}</a:t></a:r></a:p></p:txBody></p:sp>'

    def tree(shapes, ground=""):
        head = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
        return f"<p:cSld>{ground}<p:spTree>{head}{''.join(shape(k, *s) for k, s in enumerate(shapes))}</p:spTree></p:cSld>"

    parts: dict[str, str | bytes] = {}
    for n, s in enumerate(slides, 1):
        color = "" if not s.get("background") else f'<p:bg><p:bgPr><a:solidFill><a:{"srgbClr" if s["background"][0] == "rgb" else "schemeClr"} val="{s["background"][1]}"/></a:solidFill></p:bgPr></p:bg>'
        over = "".join(f' {k}="{v}"' for k, v in (s.get("names") or {}).items())
        over = f"<p:clrMapOvr><a:overrideClrMapping{over}/></p:clrMapOvr>" if over else ""
        parts[f"ppt/slides/slide{n}.xml"] = f"{_HEAD}<p:sld {spaces}>{tree(s['shapes'], color)}{over}</p:sld>"
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = _rels([("slideLayout", "../slideLayouts/slideLayout1.xml" if broken != "slideLayout" else "../gone.xml")])
    boxes = boxes or {}
    holders = [(kind, str(n), "", box) for n, (kind, box) in enumerate(boxes.items()) if kind != "layout"]
    own = [(kind, index, "", box) for kind, index, box in boxes.get("layout", ())]
    parts["ppt/slideLayouts/slideLayout1.xml"] = f"{_HEAD}<p:sldLayout {spaces}>{tree(own)}</p:sldLayout>"
    parts["ppt/slideLayouts/_rels/slideLayout1.xml.rels"] = _rels([("slideMaster", "../slideMasters/slideMaster1.xml")] if broken != "slideMaster" else [])
    mapped = "".join(f' {k}="{v}"' for k, v in names.items())
    parts["ppt/slideMasters/slideMaster1.xml"] = f"{_HEAD}<p:sldMaster {spaces}>{tree(holders)}<p:clrMap{mapped}/></p:sldMaster>"
    parts["ppt/slideMasters/_rels/slideMaster1.xml.rels"] = _rels([("theme", "../theme/theme1.xml" if broken != "theme" else "../theme/gone.xml")])
    scheme = "".join(f'<a:{n}><a:sysClr val="window" lastClr="{v[1:]}"/></a:{n}>' if v.startswith("~") else f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in colors.items())
    parts["ppt/theme/theme1.xml"] = f'{_HEAD}<a:theme xmlns:a="{_A}"><a:themeElements><a:clrScheme name="c">{scheme}</a:clrScheme></a:themeElements></a:theme>'
    listed = "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in range(1, len(slides) + 1))
    parts["ppt/presentation.xml"] = f'{_HEAD}<p:presentation {spaces}><p:sldIdLst>{listed}</p:sldIdLst><p:sldSz cx="{size[0]}" cy="{size[1]}"/></p:presentation>'
    parts["ppt/_rels/presentation.xml.rels"] = _rels([("slide", f"slides/slide{n}.xml") for n in range(1, len(slides) + 1)])
    kinds = {"ppt/presentation.xml": "presentation.main", "ppt/slideLayouts/slideLayout1.xml": "slideLayout", "ppt/slideMasters/slideMaster1.xml": "slideMaster"} | {f"ppt/slides/slide{n}.xml": "slide" for n in range(1, len(slides) + 1)}
    types = {k: f"{_KIND}presentationml.{v}+xml" for k, v in kinds.items()} | {"ppt/theme/theme1.xml": f"{_KIND}theme+xml"}
    return packed({"[Content_Types].xml": _types(_XML, types), "_rels/.rels": _rels([("officeDocument", "ppt/presentation.xml")])} | parts)
