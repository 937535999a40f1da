"""Designs of new documents and new PDF files."""

import re

import pytest

from paperloom.sources import designs as D
from paperloom.sources import pdf as P
from paperloom.sources import writers as W
from paperloom.sources.packages import Package, Refused, attr, children


def test_presets_keep_the_order_of_the_schema():
    order = "keepNext keepLines widowControl pBdr shd spacing ind jc outlineLvl".split()
    for preset in D.PRESETS:
        for rule in (None, (0.75, 3, "D0D5DD")):
            part = Package(W.packed({"s": D.styles_part(preset, rule, True)})).xml("s")
            for style in children(part, "style"):
                names = [e.tag.rpartition("}")[2] for p in children(style, "pPr") for e in p]
                assert names == sorted(names, key=order.index), (preset, attr(style, "styleId"))
            assert D.styles_part(preset, rule).count("<w:pBdr>") == (3 if rule else 0)


def test_numbering_only_with_lists():
    assert "word/numbering.xml" not in Package(W.docx([{"kind": "paragraph", "text": "x"}], "report")).names
    listed = Package(W.docx([{"kind": "header", "text": "h"}, {"kind": "list", "text": "x", "ordered": True}]))
    assert [attr(e, "Target") for e in listed.xml("word/_rels/document.xml.rels")] == ["styles.xml", "header1.xml", "numbering.xml"]
    assert '<w:numId w:val="2"/>' in listed.read("word/document.xml").decode()


def pages_of(data):
    return re.findall(rb"stream\n(.*?)\nendstream", data, re.S)


def test_table_heads_repeat_and_places_are_right():
    data = P.pdf("a (b)", [{"kind": "table", "headers": ["head", "x"], "rows": [[f"r{k}", "word " * 30] for k in range(60)]}])
    pages = pages_of(data)
    assert len(pages) > 1 and all(b"(head)" in p and f"({k} / {len(pages)})".encode() in p for k, p in enumerate(pages, 1))
    assert [int(x) for x in re.findall(rb"\(r(\d+)\)", data)] == list(range(60))
    for n, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(f"{n} 0 obj".encode())
    assert data[int(re.search(rb"startxref\n(\d+)", data)[1]) :].startswith(b"xref") and b"/Title (a \\(b\\))" in data
    heights = [float(y) for y in re.findall(rb"Tf [\d.]+ ([\d.]+) Td", data)]
    assert min(heights) > 0 and max(heights) < P.PAGES["A4"][1]


def test_long_words_and_texts_are_kept():
    text = "x" * 500 + " " + "several words " * 2000
    data = P.pdf("t", [{"kind": "paragraph", "text": text}])
    shown = b"".join(re.findall(rb"\((.*?)\) Tj", b"".join(p.rpartition(b"\nBT")[0] for p in pages_of(data))))
    assert shown.replace(b" ", b"").decode() == text.replace(" ", "")
    assert all(P.width_of(line, 11) <= 499.3 for line in P.wrapped(text, 11, 499.28))


@pytest.mark.parametrize("issue, blocks", {
    "FONT_REQUIRED": [{"kind": "paragraph", "text": "é"}],
    "LIMIT_EXCEEDED": [{"kind": "pageBreak"}] * P.MAX_PAGES,
    "INVALID_INPUT": [{"kind": "table", "headers": ["a"], "rows": [["y\n" * 100]]}],
}.items())
def test_refusals(issue, blocks):
    with pytest.raises(Refused, match=issue):
        P.pdf("t", blocks)


def test_empty():
    assert len(pages_of(P.pdf("", []))) == 1 and len(pages_of(P.pdf("", [{"kind": "paragraph", "text": None}]))) == 1
