"""Colours, inherited boxes and covers of decks made by hand."""

import pytest

from paperloom.operators import decks as by_rows
from paperloom.sources import decks as D
from paperloom.sources.packages import Package, Refused
from paperloom.sources.writers import packed

COLORS, NAMES = {"dk1": "000000", "lt1": "~ffffff", "accent1": "12abEF", "bad": "xyz"}, {"bg1": "lt1", "tx1": "dk1"}
TITLE = ("title", "0", "Head", None)


def files(spark, **decks):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in decks.items()], "path string, content binary")


def covered(content, word="Word"):
    p = Package(content)
    new = D.add_cover(p, [dict(word=word)])
    return Package(packed({i.filename: new.get(i.filename) or p.read(i.filename) for i in p.infos}))


def names(p, part="ppt/slides/slide1.xml"):
    return [n for _, _, n, *_ in D._shapes(p, part)]


def test_colours_through_the_chain(spark):
    ground = lambda value, names=None: dict(shapes=[], background=("scheme", value), names=names)
    slides = [ground("bg1"), ground("bg1", {"bg1": "accent1"}), ground("accent1"), ground("none"), ground("bad"), dict(shapes=[], background=("rgb", "00ff00")), dict(shapes=[])]
    tables = files(spark, whole=D.deck(slides, COLORS, NAMES), **{k: D.deck(slides[:3], COLORS, NAMES, broken=k) for k in ("theme", "slideMaster", "slideLayout")}, bad=b"PK\x03\x04")
    got = {}
    for r in by_rows.background_colors(D.slide_backgrounds(tables), D.deck_links(tables), D.color_maps(tables), D.theme_colors(tables)).collect():
        got.setdefault(r.path, {})[r.slide] = r.rgb
    assert got["whole"] == {1: "FFFFFF", 2: "12ABEF", 3: "12ABEF", 4: None, 5: None, 6: "00FF00"}
    assert all(got[k] == {1: None, 2: None, 3: None} for k in ("theme", "slideMaster", "slideLayout")) and "bad" not in got


def test_rows_and_writer_agree_on_boxes(spark):
    boxes = {"title": (1, 2, 3, 4), "body": (5, 6, 7, 8), "layout": [("ctrTitle", "0", None), ("body", "7", (9, 9, 9, 9)), ("pic", "3", None)]}
    shapes = [TITLE, ("subTitle", "7", "s", None), ("obj", "5", "o", None), ("pic", "3", "p", None), ("title", "0", "own", (0, 0, 1, 1)), (None, None, "free", None), ("dt", "9", "d", None)]
    content = D.deck([dict(shapes=shapes)], COLORS, NAMES, boxes=boxes)
    table = files(spark, d=content)
    rows = by_rows.inherited_boxes(D.deck_shapes(table), D.deck_links(table)).orderBy("shape").collect()
    got = [(r.x, r.y, r.width, r.height) if r.box_from else None for r in rows]
    assert got == [b for *_, b in D.effective_boxes(Package(content), "ppt/slides/slide1.xml")] == [(1, 2, 3, 4), (9, 9, 9, 9), (5, 6, 7, 8), None, (0, 0, 1, 1), None, None]
    assert [r.box_from for r in rows] == ["master", "layout", "master", None, "own", None, None]


def test_covers_lie_under_and_beside_what_is_there():
    low = (900_000, 2_500_000, 7_000_000, 1_000_000)
    content = D.deck([dict(shapes=[("title", "0", "Head", low), ("subTitle", "1", "sub", low), (None, None, "free", low)]), dict(shapes=[TITLE])], COLORS, NAMES)
    after = covered(content, "A & <B>")
    assert names(after) == ["Cover ground", "Cover field", "Cover dot", "s0", "s1", "s2", "Cover word"]
    text = after.read("ppt/slides/slide1.xml").decode()
    assert text.index("<p:grpSpPr/>") < text.index("Cover ground") and "A &amp; &lt;B&gt;" in text and len({n for n in text.split('<p:cNvPr id="')[1:] for n in [n.split('"')[0]]}) == 8
    before = Package(content)
    assert all(after.read(n) == before.read(n) for n in before.names if n != "ppt/slides/slide1.xml")
    head, sub, free = (text[text.index(f'name="s{k}"') :] for k in range(3))
    assert f'b="1"><a:solidFill><a:srgbClr val="{D.NAVY}"/></a:solidFill><a:latin typeface="{D.FACE}"/></a:rPr><a:t>Head' in head and f'<a:srgbClr val="{D.SUBTITLE}"/></a:solidFill></a:rPr><a:t>sub' in sub and "<a:r><a:t>free" in free


@pytest.mark.parametrize("taken, field, word", [
    ([], 0, 0), ([(0.7, 0.0, 0.1, 0.1)], 1, 0), ([(0.7, 0.0, 0.1, 0.1), (0.7, 0.9, 0.1, 0.1)], 2, 1), ([(0.7, 0.0, 0.03, 0.5)], 0, 0), ([(0.0, 0.0, 0.3, 0.2)], 0, 1), ([(0.0, 0.0, 0.3, 0.2), (0.0, 0.8, 0.3, 0.2)], 0, 2),
])
def test_zones_are_tried_in_order(taken, field, word):
    wide, high = 1_000_000, 500_000
    shapes = [(None, None, "x", tuple(int(v * n) for v, n in zip(t, (wide, high, wide, high), strict=True))) for t in taken] + [(None, None, " ", (0, 0, wide, high))]
    after = covered(D.deck([dict(shapes=shapes)], COLORS, NAMES, size=(wide, high)))
    boxes = {n: b for _, _, n, _, _, b in D._shapes(after, "ppt/slides/slide1.xml")}
    assert boxes["Cover field"][:2] == (int(wide * D.FIELD_ZONES[field][0]), int(high * D.FIELD_ZONES[field][1]))
    assert boxes["Cover word"][:2] == (int(wide * D.WORD_ZONES[word][0]), int(high * D.WORD_ZONES[word][1]))


def test_refusals():
    full = D.deck([dict(shapes=[(None, None, "x", (0, 0, 9_144_000, 6_858_000))])], COLORS, NAMES)
    for content, word, issue in ((full, "w", "NO_FREE_ZONE"), (full, " ", "INVALID_INPUT"), (D.deck([], COLORS, NAMES), "w", "NO_SLIDES")):
        with pytest.raises(Refused, match=issue):
            covered(content, word)
