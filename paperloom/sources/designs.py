"""Designs of new documents: the styles part of a preset and the numbering part of lists, and readers of both."""

from __future__ import annotations

from dataclasses import dataclass, replace
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame

from .packages import Package, Rows, _run_format, attr, child, children, extract, whole

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
BULLETS, NUMBERS = 1, 2  # the lists that paragraphs refer to


@dataclass(frozen=True)
class Preset:
    """Type of a kind of document. Sizes are half points, line is in 240ths, spaces are points, indent is characters."""

    latin: str
    east_asia: str
    accent: str
    size: int
    line: int
    indent: int
    after: float
    title_size: int
    title_color: str
    title_centred: bool
    heading_sizes: tuple[int, int, int]
    heading_bold: tuple[bool, bool, bool]
    heading_faces: tuple[str, str, str]
    heading_color: str
    heading_before: tuple[float, float, float]
    heading_after: float


# Fixed values of the presets, of the styles that they share, and of lists.
_REPORT = Preset(
    "Calibri", "Microsoft YaHei", "24476B", 22, 300, 0, 6, 40, "24476B", False,
    (30, 26, 22), (True, True, True), ("Microsoft YaHei",) * 3, "24476B", (12.5, 11, 9.5), 6,
)
_FORMAL = Preset(
    "Times New Roman", "SimSun", "20334D", 24, 360, 2, 6, 44, "000000", True,
    (32, 28, 24), (False, False, True), ("SimHei", "SimHei", "SimSun"), "000000", (12.5, 11, 9.5), 6,
)
PRESETS = {
    "report": _REPORT,
    "technical": replace(_REPORT, accent="176B6B", size=21, line=290, title_color="176B6B", heading_color="176B6B"),
    "chinese-long": _FORMAL,
    "chinese-contract": replace(_FORMAL, accent="000000", after=2, heading_sizes=(24, 24, 24), heading_bold=(True, True, True), heading_before=(10, 10, 10), heading_after=4),
}
SUBTITLE_SIZE, CAPTION_SIZE, CODE_SIZE, MUTED, CODE_FACE, CODE_FILL, CODE_LINE = 24, 18, 19, "667085", "Consolas", "F2F4F7", 260
TITLE_BEFORE, TITLE_AFTER = 320, 240
LIST_LEFT, LIST_HANGING, BULLET = 720, 360, "•"


def _el(name: str, *inside: str, **attributes) -> str:
    """An element in the document's namespace; null attributes are left out."""
    named = "".join(f" w:{k}={quoteattr(str(v))}" for k, v in attributes.items() if v is not None)
    return f"<w:{name}{named}>{''.join(inside)}</w:{name}>" if inside else f"<w:{name}{named}/>"


def _twips(points: float) -> int:
    return int(points * 20 + 0.5)


def _style(style_id: str, name: str, paragraph: list[str], run: list[str], follows: bool = True) -> str:
    head = [_el("name", val=name)] + [_el("basedOn", val="Normal")] * (style_id != "Normal") + [_el("next", val="Normal"), _el("qFormat")] * follows
    body = [_el("pPr", *paragraph)] * bool(paragraph) + [_el("rPr", *run)]
    return _el("style", *head, *body, type="paragraph", styleId=style_id, default="1" if style_id == "Normal" else None)


def styles_part(preset: str, heading_rule: tuple[float, float, str] | None = None, centred_headings: bool = False) -> str:
    """The styles of a preset: Normal, Title, Subtitle, three headings, Caption and Code, each property in the order of
    the schema. heading_rule (points of width, points of distance, colour) draws a line under headings. The first-line
    indent of a preset's body is taken back where it does not belong."""
    p = PRESETS[preset]
    faces = lambda east, latin=p.latin: _el("rFonts", ascii=latin, hAnsi=latin, eastAsia=east)
    sized = lambda n: [_el("sz", val=n), _el("szCs", val=n)]
    indent = [_el("ind", firstLineChars=p.indent * 100, firstLine=p.indent * p.size * 10)] * bool(p.indent)
    flush = [_el("ind", firstLineChars=0, firstLine=0)] * bool(p.indent)
    centre = [_el("jc", val="center")]
    rule = []
    if heading_rule:
        width, space, color = heading_rule
        rule = [_el("pBdr", _el("bottom", val="single", sz=round(width * 8), space=round(space), color=color))]
    made = [
        _style("Normal", "Normal", indent, [faces(p.east_asia), *sized(p.size)]),
        _style(
            "Title", "Title", [_el("keepNext"), _el("spacing", before=TITLE_BEFORE, after=TITLE_AFTER), *flush, *centre * p.title_centred],
            [faces(p.heading_faces[0]), _el("b"), _el("color", val=p.title_color), *sized(p.title_size)],
        ),
        _style("Subtitle", "Subtitle", [_el("keepNext"), *flush], [faces(p.east_asia), _el("color", val=MUTED), *sized(SUBTITLE_SIZE)]),
    ]
    for k in range(3):
        spacing = _el("spacing", before=_twips(p.heading_before[k]), after=_twips(p.heading_after))
        paragraph = [_el("keepNext"), _el("keepLines"), *rule, spacing, *flush, *centre * centred_headings, _el("outlineLvl", val=k)]
        run = [faces(p.heading_faces[k]), *[_el("b")] * p.heading_bold[k], _el("color", val=p.heading_color), *sized(p.heading_sizes[k])]
        made.append(_style(f"Heading{k + 1}", f"heading {k + 1}", paragraph, run))
    made.append(_style("Caption", "Caption", [_el("keepLines")], [faces(p.east_asia), _el("color", val=MUTED), *sized(CAPTION_SIZE)]))
    code = [_el("shd", fill=CODE_FILL), _el("spacing", line=CODE_LINE, lineRule="auto")]
    made.append(_style("Code", "Code", code, [faces(p.east_asia, CODE_FACE), _el("sz", val=CODE_SIZE)], follows=False))
    run = _el("rPrDefault", _el("rPr", faces(p.east_asia), _el("sz", val=p.size), _el("lang", val="en-US", eastAsia="zh-CN")))
    spacing = _el("spacing", after=_twips(p.after), line=p.line, lineRule="auto")
    return f'<w:styles xmlns:w="{WORD}">{_el("docDefaults", run, _el("pPrDefault", _el("pPr", _el("widowControl"), spacing, *indent)))}{"".join(made)}</w:styles>'


def numbering_part(left: int = LIST_LEFT, hanging: int = LIST_HANGING) -> str:
    """Two lists of one level, BULLETS and NUMBERS, with a hanging indent in twips."""
    kinds = ((BULLETS, "bullet", BULLET), (NUMBERS, "decimal", "%1."))
    shapes, lists = [], []
    for number, kind, text in kinds:
        level = [_el("start", val=1), _el("numFmt", val=kind), _el("lvlText", val=text), _el("lvlJc", val="left"), _el("pPr", _el("ind", left=left, hanging=hanging))]
        shapes.append(_el("abstractNum", _el("multiLevelType", val="hybridMultilevel"), _el("lvl", *level, ilvl=0), abstractNumId=number - 1))
        lists.append(_el("num", _el("abstractNumId", val=number - 1), numId=number))
    return f'<w:numbering xmlns:w="{WORD}">{"".join(shapes + lists)}</w:numbering>'


def _formats(p: Package) -> Rows:
    root = p.optional("word/styles.xml")
    for e in children(root, "style") if root is not None else ():
        bold, size, color, east = _run_format(e)
        space, jc, fonts, rule = child(e, "pPr", "spacing"), child(e, "pPr", "jc"), child(e, "rPr", "rFonts"), child(e, "pPr", "pBdr", "bottom")
        yield (
            attr(e, "styleId"), size, bold, color, None if fonts is None else attr(fonts, "ascii"), east, None if space is None else whole(attr(space, "before")),
            None if space is None else whole(attr(space, "after")), None if jc is None else attr(jc, "val"), rule is not None,
        )


def style_formats(files: DataFrame) -> DataFrame:
    """The own format of each style: points of size, twips of space; what a style does not say is null."""
    return extract(files, _formats, "style_id string, size double, bold boolean, color string, latin string, east_asia string, before int, after int, alignment string, ruled boolean")


def _numberings(p: Package) -> Rows:
    root = p.optional("word/numbering.xml")
    shapes = {attr(e, "abstractNumId"): e for e in children(root, "abstractNum")} if root is not None else {}
    for e in children(root, "num") if root is not None else ():
        target = child(e, "abstractNumId")
        shape = shapes.get(None if target is None else attr(target, "val"))
        for level in children(shape, "lvl") if shape is not None else ():
            kind, text, indent = child(level, "numFmt"), child(level, "lvlText"), child(level, "pPr", "ind")
            yield (
                attr(e, "numId"), whole(attr(level, "ilvl")), None if kind is None else attr(kind, "val"), None if text is None else attr(text, "val"),
                None if indent is None else whole(attr(indent, "left")), None if indent is None else whole(attr(indent, "hanging")),
            )


def numberings(files: DataFrame) -> DataFrame:
    """The levels of each list that paragraphs can refer to; a document without lists gives no row."""
    return extract(files, _numberings, "num_id string, num_level int, format string, text string, left int, hanging int")
