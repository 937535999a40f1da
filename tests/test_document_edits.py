"""Edits of existing documents on hand-made files, and revisions against a plain model of paragraphs."""

import random
import re

import pytest

from paperloom.sources import document_edits as E
from paperloom.sources import packages
from paperloom.sources.packages import DOCUMENT, Package, Refused
from paperloom.sources.writers import packed

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
P = "/w:document/w:body/w:p[{}]".format
HEAD = f"<?xml version='1.0' encoding='UTF-8'?><!-- kept --><w:document xmlns:w='{W}' xmlns:x=\"urn:x\"><w:body>"
TAIL = "<w:sectPr/></w:body></w:document>"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"


def package(body, **more):
    parts = {"[Content_Types].xml": f'<Types xmlns="{TYPES}"/>', DOCUMENT: HEAD + body + TAIL, "word/_rels/document.xml.rels": f'<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="t" Target="u"/></Relationships>'}
    return Package(packed(parts | {k.replace("__", "/") + ".xml": v for k, v in more.items()}))


def edited(before, *edits, edit=E.edit_document):
    new = edit(before, list(edits))
    names = [*(i.filename for i in before.infos), *(n for n in new if n not in before.names)]
    return Package(packed({n: v for n in names if (v := new[n] if n in new else before.read(n)) is not None}))


def text(p):
    return p.read(DOCUMENT).decode()


def said(p):
    return [row[7] for row in packages._paragraphs(p)]


def refused(before, *edits, edit=E.edit_document):
    with pytest.raises(Refused) as x:
        edit(before, list(edits))
    return str(x.value)


def para(*runs, props=""):
    return f"<w:p>{props}{''.join(f'<w:r>{r}</w:r>' if r.startswith('<') else f'<w:r><w:t>{r}</w:t></w:r>' for r in runs)}</w:p>"


ODD = "<w:p  x:a = 'b'><w:r><w:t xml:space='preserve'>odd &#38; old </w:t></w:r></w:p>"


def test_replacing_keeps_all_else():
    before = package(ODD + para("<w:rPr><w:b/></w:rPr><w:t>one tw</w:t>", "o thr<!-- c -->ee".replace("<!-- c -->", "")) + ODD)
    after = edited(before, dict(kind="replaceText", path=P(2), expected="one two three", find="two", text="2 & <2>"))
    assert said(after) == ["odd & old ", "one 2 & <2> three", "odd & old "]
    assert text(after).startswith(HEAD + ODD) and text(after).endswith(ODD + TAIL)
    assert "<w:rPr><w:b/></w:rPr><w:t xml:space=\"preserve\">2 &amp; &lt;2&gt;</w:t>" in text(after)
    gone = edited(before, dict(kind="replaceText", path=P(2), find="one two three", text=None))
    assert said(gone)[1] == "" and "<w:b/>" not in text(gone)


def test_issues_of_texts():
    before = package(para("aXaxa"))
    find = lambda find, **more: dict(kind="replaceText", path=P(1), find=find, text="n", **more)
    assert refused(before, find("q")) == "TEXT_NOT_FOUND" and refused(before, find("a")) == "TEXT_AMBIGUOUS"
    assert refused(before, find("a", occurrence=3)) == refused(before, find("")) == refused(before, find("a", occurrence=0, revision="x")) == "INVALID_INPUT"
    assert refused(before, find("a", expected="other")) == "STALE_TARGET" and refused(before, dict(kind="replaceText", path=P(2), find="a", text="")) == "TARGET_NOT_FOUND"
    assert refused(before, dict(kind="setMargins", path=P(1))) == "UNSUPPORTED_OPERATION" and refused(before) == "INVALID_INPUT"
    assert said(edited(before, find("x", match_case=False, occurrence=1))) == ["aXana"] and said(edited(before, find("A", match_case=False, occurrence=2))) == ["aXaxn"]


def test_tracked_edits_follow_the_document():
    settings = f'<w:settings xmlns:w="{W}"><w:trackRevisions{{}}/></w:settings>'
    for off, tracked in (("", True), (' w:val="0"', False)):
        before = package(para("old text"), word__settings=settings.format(off))
        after = edited(before, dict(kind="replaceText", path=P(1), find="old", text="new", author="A"), dict(kind="insertParagraph", path=P(1), text="more", position="Before", style_id="S"))
        assert [(r[1], r[5]) for r in E._revisions(after)] == ([("ins", ""), ("ins", "more"), ("del", "old"), ("ins", "new")] if tracked else [])
        assert said(after) == ["more", "new text"]
        ids = [r[2] for r in E._revisions(after)]
        assert len(ids) == len(set(ids))
        if tracked:
            assert said(edited(after, dict(decision="reject"), edit=E.resolve_all)) == ["old text"]
            assert said(edited(after, dict(decision="accept"), edit=E.resolve_all)) == ["more", "new text"]


def test_comments():
    hyper = '<w:hyperlink x:id="r"><w:r><w:t>in link</w:t></w:r></w:hyperlink>'
    before = package(f"<w:p><w:pPr/><w:r><w:t>be</w:t><w:tab/><w:t>fore</w:t></w:r>{hyper}<w:r><w:t>after</w:t></w:r></w:p>" + ODD)
    say = lambda text, **more: dict(kind="addComment", path=P(1), text=text, author='A "b"', **more)
    after = edited(before, say("first\nline", quote="efore in".replace(" ", "")), say("all"), say("end", quote="after", initials="I"))
    assert sorted(E._anchors(after)) == [("0", "eforein", 'A "b"', None, "first\nline"), ("1", "beforein linkafter", 'A "b"', None, "all"), ("2", "after", 'A "b"', "I", "end")]
    assert said(after) == said(before) and ODD in text(after)
    rels = after.xml("word/_rels/document.xml.rels")
    assert [(e.get("Id"), e.get("Target")) for e in rels] == [("rId1", "u"), ("rId2", "comments.xml")] and b"/word/comments.xml" in after.read("[Content_Types].xml")
    again = edited(after, say("later"))
    assert [r[0] for r in E._anchors(again)] == ["1", "0", "2", "3"] or sorted(r[0] for r in E._anchors(again)) == ["0", "1", "2", "3"]
    assert len(again.xml("word/_rels/document.xml.rels")) == 2 and refused(before, say(" ")) == "INVALID_INPUT"
    taken = package('<w:p><w:commentRangeStart w:id="7"/></w:p>' + para("x"), word__comments=f"<c:comments xmlns:c='{W}'><c:comment c:id='4'/></c:comments>")
    assert {r[0] for r in E._anchors(edited(taken, dict(kind="addComment", path=P(2), text="t")))} == {"8"}


def test_formats_go_to_their_places():
    before = package(f'<w:p><w:pPr><w:keepNext/><w:spacing w:line="300"/><w:rPr><w:b/></w:rPr></w:pPr><w:r><w:rPr><w:rStyle w:val="s"/><w:rFonts w:asciiTheme="t"/><w:lang w:val="x"/></w:rPr><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p>{ODD}')
    wanted = dict(kind="formatParagraph", path=P(1), style_id="H", outline_level=10, alignment="Justified", space_after=6.5, bold=False, italic=True, size=10.5, color="#a1b2c3", name="Font")
    after = text(edited(before, wanted))
    assert '<w:pPr><w:pStyle w:val="H"/><w:keepNext/><w:spacing w:line="300" w:after="130"/><w:jc w:val="both"/><w:outlineLvl w:val="9"/><w:rPr><w:b/></w:rPr></w:pPr>' in after
    assert '<w:rStyle w:val="s"/><w:rFonts w:ascii="Font" w:hAnsi="Font" w:eastAsia="Font" w:cs="Font"/><w:b w:val="0"/><w:bCs w:val="0"/><w:i/><w:iCs/><w:color w:val="A1B2C3"/><w:sz w:val="21"/><w:szCs w:val="21"/><w:lang w:val="x"/>' in after
    assert after.count('<w:sz w:val="21"/>') == 2 and ODD in after
    for bad in (dict(), dict(style_id=" "), dict(outline_level=0), dict(outline_level=11), dict(space_after=-1), dict(color="FF0000"), dict(size=0), dict(alignment="middle"), dict(name="")):
        assert refused(before, dict(kind="formatParagraph", path=P(1), **bad)) == "INVALID_INPUT"


def test_paragraphs_of_cells_and_of_boxes():
    cell = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    box = f"<w:p><w:r><w:txbxContent>{para('inner')}</w:txbxContent><w:t>outer</w:t></w:r></w:p>"
    before = package(cell + box)
    at = "/w:document/w:body/w:tbl[1]/w:tr[1]/w:tc[1]/w:p[1]"
    assert "changed" in text(edited(before, dict(kind="replaceText", path=at, expected="c", find="c", text="changed")))
    assert refused(before, dict(kind="replaceText", path=f"{P(1)}/w:r[1]/w:txbxContent[1]/w:p[1]", find="inner", text="")) == "TARGET_NOT_FOUND"
    assert "inner" in text(edited(before, dict(kind="replaceText", path=P(1), expected="outer", find="outer", text="new")))


# --- revisions against a model ----------------------------------------------------------------------------------------


def piece(kind, words):
    run = f"<w:r><w:{'delText' if kind in E.TAKEN else 't'}>{words}</w:{'delText' if kind in E.TAKEN else 't'}></w:r>"
    if kind == "moveFrom":
        run = f"<w:r><w:t>{words}</w:t></w:r>"
    return run if kind is None else f'<w:moveFromRangeStart w:id="9"/><w:{kind} w:id="1" w:author="a">{run}</w:{kind}>' if kind == "moveFrom" else f'<w:{kind} w:id="1" w:author="a">{run}</w:{kind}>'


def modelled(paragraphs, accept):
    """Texts after resolving: paragraphs of (pieces, end) are merged from the last to the first."""
    goes = lambda kind: kind in (E.TAKEN if accept else E.ADDED)
    texts = [["".join(w for k, w in pieces if not goes(k)), goes(end)] for pieces, end in paragraphs]
    for i in reversed(range(len(texts))):
        if texts[i][1] and i + 1 < len(texts):
            texts[i + 1][0] = texts[i][0] + texts[i + 1][0]
            del texts[i]
        elif texts[i][1] and not texts[i][0]:  # a table comes next
            del texts[i]
    return [t for t, _ in texts]


@pytest.mark.parametrize("decision", ["accept", "reject"])
def test_revisions_against_a_model(decision):
    rng = random.Random(7)
    kinds = [None, None, *E.ADDED, *E.TAKEN]
    for _ in range(300):
        paragraphs = [([(rng.choice(kinds), f"w{rng.randrange(999)} ") for _ in range(rng.randrange(4))], rng.choice([None, None, None, "ins", "del"])) for _ in range(rng.randrange(1, 7))]
        body = ""
        for pieces, end in paragraphs:
            change = '<w:pPrChange w:id="3" w:author="a"><w:pPr><w:jc w:val="former"/></w:pPr></w:pPrChange>' if rng.random() < 0.3 else ""
            mark = f'<w:rPr><w:{end} w:id="2" w:author="a"/><w:b/></w:rPr>' if end else ""
            body += f"<w:p><w:pPr><w:jc w:val=\"new\"/>{mark}{change}</w:pPr>{''.join(piece(*x) for x in pieces)}</w:p>"
        before = package(ODD + "<w:tbl/>" + body + "<w:tbl/>" + ODD)
        marks = len(list(E._revisions(before)))
        if not marks:
            assert refused(before, dict(decision=decision), edit=E.resolve_all) == "TARGET_NOT_FOUND"
            continue
        after = edited(before, dict(decision=decision), edit=E.resolve_all)
        want = modelled(paragraphs, decision == "accept")
        assert said(after)[1:-1] == want
        assert not list(E._revisions(after)) and "RangeStart" not in text(after) and "delText" not in text(after)
        assert text(after).startswith(HEAD + ODD) and text(after).endswith(ODD + TAIL)
        assert decision == "reject" or "former" not in text(after)


def test_rows_sections_and_nested_marks():
    row = lambda words, mark="": f"<w:tr>{f'<w:trPr><w:{mark} w:id=\"1\"/></w:trPr>' if mark else ''}<w:tc>{para(words)}</w:tc></w:tr>"
    nested = '<w:p><w:ins w:id="1"><w:r><w:t>a</w:t></w:r><w:del w:id="2"><w:r><w:delText>b</w:delText></w:r></w:del></w:ins></w:p>'
    section = '<w:p><w:pPr><w:sectPr><w:headerReference x:id="h"/><w:pgSz w:w="2"/><w:sectPrChange w:id="5"><w:sectPr><w:pgSz w:w="1"/></w:sectPr></w:sectPrChange></w:sectPr></w:pPr></w:p>'
    run = '<w:p><w:r><w:rPr><w:b/><w:rPrChange w:id="6"><w:rPr><w:i/></w:rPr></w:rPrChange></w:rPr><w:t>f</w:t></w:r></w:p>'
    before = package(f"<w:tbl>{row('1')}{row('2', 'ins')}{row('3', 'del')}</w:tbl>" + nested + section + run)
    accepted, rejected = (edited(before, dict(decision=d), edit=E.resolve_all) for d in ("accept", "reject"))
    assert said(accepted) == ["1", "2", "a", "", "f"] and said(rejected) == ["1", "3", "", "", "f"]
    assert '<w:headerReference x:id="h"/><w:pgSz w:w="2"/>' in text(accepted) and re.search(r'<w:headerReference x:id="h"/><w:pgSz w:w="1"/>', text(rejected))
    assert "<w:rPr><w:b/></w:rPr>" in text(accepted) and "<w:rPr><w:i/></w:rPr>" in text(rejected)
    assert refused(package("<w:tbl><w:tr><w:tc><w:tcPr><w:cellIns/><w:tcPrChange/></w:tcPr></w:tc></w:tr></w:tbl>"), dict(decision="accept"), edit=E.resolve_all) == "REVISION_UNSUPPORTED"
    assert refused(before, dict(decision="maybe"), edit=E.resolve_all) == refused(before, edit=E.resolve_all) == "INVALID_INPUT"


def test_one_paragraph_is_resolved_alone():
    mark = lambda end, *pieces: f'<w:p><w:pPr><w:rPr><w:{end} w:id="1"/></w:rPr></w:pPr>{"".join(piece(*x) for x in pieces)}</w:p>'
    body = mark("del", (None, "a"), ("ins", "b")) + mark("ins", ("del", "c"), (None, "d")) + ODD
    resolve = lambda n, how: dict(kind="resolveRevisions", path=P(n), decision=how)
    one = edited(package(body), resolve(1, "accept"))
    assert said(one) == ["abd", "odd & old "] and [r[1] for r in E._revisions(one)] == ["ins", "del"]
    both = edited(package(body), resolve(1, "accept"), resolve(2, "accept"))
    assert said(both) == ["abd", "odd & old "] and not list(E._revisions(both))
    assert said(edited(package(body), resolve(2, "reject"))) == ["ab", "cdodd & old "]
    assert refused(package(body), resolve(3, "accept")) == refused(package(body), resolve(1, "accept"), resolve(1, "accept")) == "TARGET_NOT_FOUND"


def test_stories_beside_the_body():
    note = lambda kind: f'<w:{kind} xmlns:w="{W}">{para("x")}<w:p><w:ins w:id="1"><w:r><w:t>new</w:t></w:r></w:ins></w:p></w:{kind}>'
    after = edited(package(ODD, word__header1=note("hdr"), word__footnotes=f'<w:footnotes xmlns:w="{W}">{note("footnote")}</w:footnotes>'), dict(decision="reject"), edit=E.resolve_all)
    assert not list(E._revisions(after)) and b"new" not in after.read("word/header1.xml") + after.read("word/footnotes.xml") and ODD in text(after)
