"""Pictures and contents of new documents."""

import struct

import pytest

from paperloom.plans.illustrated import _made
from paperloom.sources import illustrated as I
from paperloom.sources.packages import Package, Refused
from paperloom.sources.writers import packed


def made(*blocks, **how):
    return Package(I.illustrated_docx([dict(b) for b in blocks], **how))


def heading(level, text):
    return dict(kind="paragraph", style=f"Heading{level}", text=text)


def test_pictures_tell_their_size():
    assert I.picture(_made(0)) == ("png", 1, 1) and I.picture(_made(13)) == ("jpeg", 14, 7)
    tables = b"\xff\xd8\xff\xdb" + struct.pack(">H", 4) + b"xx" + b"\xff\xc4" + struct.pack(">H", 3) + b"y" + b"\xff\xc2" + struct.pack(">HBHH", 8, 8, 3, 5) + b"\0"
    assert I.picture(tables) == ("jpeg", 5, 3)
    for bad in (None, b"", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"\xff\xd8\xff\xe0\x00\x04xx"):
        with pytest.raises(Refused, match="FORMAT_MISMATCH"):
            I.picture(bad)


def test_pictures_keep_their_bytes():
    p = made(dict(kind="image", data=_made(2), text='a "b" <c>', width_mm=20.0, height_mm=10.0, caption="fig"), dict(kind="image", data=_made(3)))
    assert p.read("word/media/image1.png") == _made(2) and p.read("word/media/image2.jpeg") == _made(3)
    rows = list(I._pictures(p))
    assert [r[1:7] for r in rows] == [("word/media/image1.png", "png", 3, 3, 720_000, 360_000), ("word/media/image2.jpeg", "jpeg", 4, 4, 38_100, 38_100)] and [r[7] for r in rows] == ['a "b" <c>', ""]
    assert b'Extension="png" ContentType="image/png"' in p.read("[Content_Types].xml") and b"updateFields" not in p.read("word/settings.xml")
    lost = Package(packed({n: p.read(n) for n in p.names if "image1" not in n} | {"word/media/image2.jpeg": b"no"}))
    assert [r[-1] for r in I._pictures(lost)] == ["PART_MISSING", "FORMAT_MISMATCH"]
    for bad in (dict(kind="image", data=_made(2), width_mm=0.0), dict(kind="chart")):
        with pytest.raises(Refused, match="INVALID_INPUT"):
            made(bad)


def test_contents_lead_to_headings():
    p = made(heading(1, "A & b"), dict(kind="contents", text="In it", levels=2), heading(2, "B"), heading(3, "C"), heading(2, ""), dict(kind="paragraph", text="x"))
    assert list(I._entries(p)) == [(0, 1, "_Toc0", "A & b", "A & b"), (1, 2, "_Toc2", "B", "B"), (2, 2, "_Toc4", "", "")]
    text = p.read("word/document.xml").decode()
    assert text.count('fldCharType="begin" w:dirty="true"') == text.count('fldCharType="end"') == 1 and "updateFields" in p.read("word/settings.xml").decode()
    none = made(dict(kind="contents"), dict(kind="paragraph", text="x"))
    assert list(I._entries(none)) == [] and none.read("word/document.xml").decode().count("fldChar ") == 3
    assert "bookmark" not in made(heading(1, "A")).read("word/document.xml").decode()
