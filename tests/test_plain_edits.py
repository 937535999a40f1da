"""Plain paragraphs are edited and resolved as text, with the same results as by trees."""

import random
from unittest import mock
from xml.etree.ElementTree import canonicalize

import pytest
from test_document_edits import HEAD, ODD, P, TAIL, W, edited, para, said

from paperloom.plans import QUERIES
from paperloom.sources import document_edits as E
from paperloom.sources import markup
from paperloom.sources.packages import DOCUMENT, Package, Refused, _objects
from paperloom.sources.writers import docx, packed

LINES = ["first line", "", "a & <b>\t\"q\"", "four", "five", "six six", "last"]


def plain():
    return Package(docx([{"kind": "paragraph", "text": t, "style": "Heading1" if k == 0 else None} for k, t in enumerate(LINES)]))


def track(n, find, new, **more):
    return dict(kind="replaceText", path=P(n), expected=LINES[n - 1], find=find, text=new, occurrence=0, revision="track", author='R "&', **more)


def add(n, new, position="After"):
    return dict(kind="insertParagraph", path=P(n), text=new, position=position, revision="track", author="R", date="2024-01-02T03:04:05Z")


def test_revisions_of_plain_paragraphs_need_no_tree(monkeypatch):
    def tree(*_):
        raise AssertionError("a tree was made")

    monkeypatch.setattr(E, "Fragment", tree)
    after = edited(plain(), track(1, "fir", "<new> & "), track(3, "a &", "x"), add(2, "added 1"), add(7, "added 2"), add(7, "before", "Before"))
    assert [(r[1], r[5]) for r in E._revisions(after)] == [
        ("del", "fir"), ("ins", "<new> & "), ("ins", ""), ("ins", "added 1"), ("del", "a &"), ("ins", "x"), ("ins", ""), ("ins", "before"), ("ins", ""), ("ins", "added 2")
    ]
    assert said(edited(after, dict(decision="reject"), edit=E.resolve_all)) == LINES
    accepted = edited(after, dict(decision="accept"), edit=E.resolve_all)
    assert said(accepted) == ["<new> & st line", "", "added 1", "x <b>\t\"q\"", "four", "five", "six six", "before", "last", "added 2"]
    assert [r[-1] for r in E._marked_paragraphs(after)] == [10] * 10 and {r[-1] for r in E._marked_paragraphs(accepted)} == {0}


def test_formats_of_plain_paragraphs_need_no_tree(monkeypatch):
    def tree(*_):
        raise AssertionError("a tree was made")

    monkeypatch.setattr(E, "Fragment", tree)
    wanted = dict(kind="formatParagraph", alignment="Justified", space_before=6.5, space_after=3.0, bold=True, size=9.5)
    after = edited(plain(), wanted | {"path": P(1)}, dict(kind="formatParagraph", path=P(1), outline_level=2, bold=False), wanted | {"path": P(2)}, dict(kind="formatParagraph", path=P(3), name="Arial", style_id="Q"))
    assert [row[1:] for row in E._direct(after)][:4] == [
        ("first line", "Heading1", 2, "both", 6.5, 3.0, None), ("", None, None, "both", 6.5, 3.0, None), (LINES[2], "Q", None, None, None, None, None), ("four", None, None, None, None, None, None)
    ]
    body = after.read(DOCUMENT).decode()
    assert '<w:rPr><w:b w:val="0"/><w:bCs w:val="0"/><w:sz w:val="19"/><w:szCs w:val="19"/></w:rPr>' in body and body.count("<w:rFonts") == 1


def test_accepting_needs_trees_of_odd_paragraphs_only(monkeypatch):
    """A deleted end merges plain paragraphs as text; a paragraph of another form is resolved as a tree beside them."""
    made = []
    fragment = E.Fragment
    monkeypatch.setattr(E, "Fragment", lambda *x: made.append(x) or fragment(*x))
    mark = lambda kind, words: f'<w:p><w:pPr><w:jc w:val="{kind}"/><w:rPr><w:b/><w:{kind} w:id="1" w:author="a"/></w:rPr></w:pPr><w:r><w:t>{words}</w:t></w:r></w:p>'
    odd = '<w:p w:x="1"><w:ins w:id="3"><w:r><w:t>odd</w:t></w:r></w:ins></w:p>'
    body = mark("del", "a") + mark("del", "b") + para("c") + mark("ins", "d") + para("e") + odd + mark("del", "f")
    before = Package(packed({DOCUMENT: HEAD.replace("<!-- kept -->", "").replace(f"'{W}'", f'"{W}"') + body + TAIL}))
    accepted = edited(before, dict(decision="accept"), edit=E.resolve_all)
    assert said(accepted) == ["abc", "d", "e", "odd", "f"] and len(made) == 1 and "odd" in made[0][1]
    assert '<w:jc w:val="ins"/><w:rPr><w:b/></w:rPr>' in accepted.read(DOCUMENT).decode()
    assert said(edited(before, dict(decision="reject"), edit=E.resolve_all)) == ["a", "b", "c", "de", "", "f"]


RUNS = ["", "<w:rPr><w:b/></w:rPr>", '<w:rPr><w:sz w:val="4"/><w:rFonts w:asciiTheme="t"/><w:b w:val="0"/><w:b/></w:rPr>', "<w:rPr/>"]
PROPS = ["", "<w:pPr/>", '<w:pPr><w:pStyle w:val="A&amp;b"/><w:jc w:val="left"/></w:pPr>', '<w:pPr><w:keepNext/><w:spacing w:line="300"/><w:spacing w:line="1"/></w:pPr>', "<w:pPr><w:rPr><w:b/></w:rPr></w:pPr>"]
TEXTS = ["", "abc", "aXa &amp; &lt;b&gt;", " lead", "x &#38; y", "q&#13;z", "a>b", "é abc abc", "line\nfeed"]
OTHERS = [ODD, "<w:p/>", f"<w:tbl><w:tr><w:tc>{para('c')}</w:tc></w:tr></w:tbl>", f"<w:p><w:r><w:txbxContent>{para('in')}</w:txbxContent><w:t>abc</w:t></w:r></w:p>", '<w:p><w:r><w:t>abc</w:t></w:r></w:p ><w:bookmarkEnd w:id="3"/>']


def a_paragraph(rng):
    run = lambda: f"<w:r>{rng.choice(RUNS)}<w:t{rng.choice(['', ' xml:space=\"preserve\"'])}>{rng.choice(TEXTS)}</w:t></w:r>"
    return rng.choice(OTHERS) if rng.random() < 0.15 else f"<w:p>{rng.choice(PROPS)}{''.join(run() for _ in range(rng.choice([1, 1, 1, 2])))}</w:p>"


def an_edit(rng, n):
    pick = lambda **fields: {k: rng.choice(v) for k, v in fields.items()}
    fields = {
        "replaceText": dict(find=["a", "abc", "b", "\r"], occurrence=[0, 0, None], text=["<new> & ", "", "n\r\x01m", None], revision=["track", "track", "untracked"], match_case=[None, None, False]),
        "insertParagraph": dict(text=["added", "x & y"], position=["Before", "After"], style_id=[None, "S&"], revision=["track", "track", None]),
        "formatParagraph": dict(alignment=[None, "Justified"], style_id=['Q"t', None], outline_level=[None, 3], space_after=[None, 2.0], line_spacing=[None, 15], bold=[True, False], size=[None, 9.5], name=[None, "Arial"]),
        "addComment": dict(text=["say"], quote=[None, "a"], occurrence=[0]),
        "resolveRevisions": dict(decision=["accept", "reject"]),
    }
    kind = rng.choice([*["replaceText", "insertParagraph", "formatParagraph"] * 3, *fields])
    return dict(kind=kind, path=P(rng.randrange(1, n + 1)), **pick(author=["R", 'a"<&\n'], date=[None, "2024"], **fields[kind]))


def outcome(edit, content, edits):
    try:
        return {k: canonicalize(v.decode()) for k, v in edit(Package(content), edits).items()}
    except Refused as refused:
        return str(refused)


def test_text_and_trees_agree():
    rng, compared = random.Random(11), 0
    for _ in range(1500):
        n = rng.randrange(1, 6)
        head = HEAD.replace("<!-- kept -->", rng.choice(["", "", "<!-- kept -->"])).replace(f"'{W}'", f'"{W}"')
        parts = {DOCUMENT: head + "".join(a_paragraph(rng) for _ in range(n)) + TAIL, "[Content_Types].xml": "<Types/>"}
        steps = [(E.edit_document, [an_edit(rng, n) for _ in range(rng.randrange(1, 4))])]
        steps += [(E.resolve_all, [dict(decision=d)]) for d in ("accept", "reject")]
        content = packed(parts)
        for edit, what in steps:
            got = outcome(edit, content, what)
            with mock.patch.object(E, "is_plain", lambda *_: False):
                assert outcome(edit, content, what) == got, (parts, what)
            if edit is E.edit_document:
                if isinstance(got, str):
                    break
                content = packed(parts | edit(Package(content), what))
            compared += 1
    assert compared > 900


@pytest.mark.parametrize("leaves", [1, 2])
def test_passed_over_paragraphs_have_the_same_places(leaves):
    rng = random.Random(leaves)
    for _ in range(300):
        text = HEAD.replace("<!-- kept -->", rng.choice(["", "<!-- kept -->"])) + "".join(a_paragraph(rng) for _ in range(5)) + TAIL
        wanted = (lambda name, depth: name == "p") if leaves == 1 else (lambda name, depth: name in ("p", "tbl", "sdt") or depth < 2)
        assert markup.places(text, wanted, leaves) == markup.places(text, wanted)


def test_objects_of_lists():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.struct([("c", pa.string())])))]))
    values = [[], [{"a": 1, "b": None}, {"a": None, "b": [{"c": "x"}, None]}], [{"a": 3, "b": []}], [{"a": 4, "b": [{"c": None}]}]]
    for some in (values, [*values, None], [*values, [None]]):
        whole = pa.array(some, kind)
        assert _objects(whole) == some and _objects(whole.slice(1, 2)) == some[1:3] and _objects(whole.slice(3)) == some[3:]


def test_documents_share_a_package_when_edited(spark, tmp_path):
    """Rows without an id, or with the same one, are one file; texts that are null are one empty line."""
    rows = [(None, "one\ntwo"), (None, "one\nmore"), (1, None), (2, "abc\n\ndef"), (2, "abc"), (3, "ab")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted((str(r.path), r.text) for r in QUERIES[name](spark, str(tmp_path)).select("path", "text").collect())
    assert [t for p, t in run("paragraph_formats") if p == "2"] == ["", "abc", "abc", "def"] and {p for p, _ in run("paragraph_formats")} == {"None", "1", "2", "3"}
    assert {p for p, _ in run("revision_reject")} == {p for p, _ in run("revision_accept")} <= {"None", "2"}
