"""Queries over PDF files: one of each customer, written by the library from the row and read back, edited or damaged."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..operators import forms
from ..scratch import written
from ..sources import pdf_edits, pdf_text
from ..sources import pdf_objects as objects
from ..sources.pdf_objects import Name, Ref, Stream
from .base import query, table

_FONT = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")}


def _shown(text: str, size: float, place: str) -> str:
    return f"BT /F1 {size:g} Tf {place} ({pdf_edits._escaped(text)}) Tj ET"


def _file(contents: list[str], catalog: dict | None = None, page: dict | None = None, more: dict | None = None, **how) -> bytes:
    """A file with a page of each content. Objects: 1 catalog, 2 and 3 page tree, 4 font, then pages, contents and more
    (objects under names, to be led to by Ref of their name)."""
    n = len(contents)
    names = {name: Ref(5 + 2 * n + k) for k, name in enumerate(more or {})}

    def linked(value):
        if isinstance(value, dict):
            return {k: linked(v) for k, v in value.items()}
        if isinstance(value, list):
            return [linked(v) for v in value]
        if isinstance(value, Stream):
            return Stream(linked(value.dict), value.raw)
        return names.get(value, value) if isinstance(value, str) and not isinstance(value, Name) else value

    out = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)} | linked(catalog or {}), 2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": n},
        # what pages have in common stands in the tree
        3: {"Type": Name("Pages"), "Parent": Ref(2), "Kids": [Ref(5 + 2 * k) for k in range(n)], "Count": n, "MediaBox": [10, 20, 410, 620], "Resources": {"Font": {"F1": Ref(4)}}}, 4: _FONT,
    }
    for k, content in enumerate(contents):
        out[5 + 2 * k] = {"Type": Name("Page"), "Parent": Ref(3), "Contents": Ref(6 + 2 * k)} | linked(page or {})
        out[6 + 2 * k] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(content.encode("latin-1", "replace")))
    out |= {names[k].number: linked(v) for k, v in (more or {}).items()}
    return objects.assembled(out, {"Root": Ref(1)}, **how)


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


#: A catalog or page entry for each kind of feature, with the objects that it leads to.
_PLANTED = {
    0: ({}, {}), 1: ({"OpenAction": "act"}, {"act": {"S": Name("JavaScript"), "JS": b"x"}}), 2: ({"Names": {"EmbeddedFiles": "files"}}, {"files": {"Names": []}}),
    3: ({"OpenAction": "act"}, {"act": {"S": Name("Launch")}}), 4: ({"AcroForm": "form"}, {"form": {"Fields": ["sig"]}, "sig": {"FT": Name("Sig"), "T": b"s", "Parent": "sig"}}),
    5: ({"AcroForm": "form"}, {"form": {"Fields": [], "XFA": "xfa"}, "xfa": Stream({}, b"<x/>")}), 6: ({"MarkInfo": {"Marked": True}}, {}),
}


def _profiled(k: int, name: str) -> bytes:
    catalog, more = _PLANTED[k % 7]
    data = _file([_shown(f"{name} {n}", 10, "20 30 Td") for n in range(1 + k % 3)], catalog, more=more, packed=k % 2 == 0, version=f"1.{4 + k % 4}")
    if k % 13 == 5:
        return data.replace(b"/Root", b"/Encrypt 3 0 R /Root")
    if k % 13 == 6:
        return data[: data.rindex(b"startxref")]
    return data[:9] if k % 13 == 7 else data


@query("""WITH o AS (SELECT c_custkey AS k, c_custkey % 13 IN (5, 7) AS bad FROM customer)
SELECT k::VARCHAR AS path, CASE WHEN NOT bad THEN '1.' || (4 + k % 4) END AS version, CASE WHEN NOT bad THEN (1 + k % 3)::INT END AS pages, CASE WHEN NOT bad THEN k % 13 = 6 END AS rebuilt,
  CASE WHEN NOT bad THEN k % 7 = 1 END AS javascript, CASE WHEN NOT bad THEN k % 7 = 2 END AS embedded_files, CASE WHEN NOT bad THEN k % 7 = 3 END AS external_links, CASE WHEN NOT bad THEN k % 7 = 4 END AS signatures,
  CASE WHEN NOT bad THEN k % 7 IN (4, 5) END AS acro_form, CASE WHEN NOT bad THEN k % 7 = 5 END AS xfa, CASE WHEN NOT bad THEN k % 7 = 6 END AS tagged, CASE k % 13 WHEN 5 THEN 'ENCRYPTED' WHEN 7 THEN 'ROOT_MISSING' END AS issue FROM o""")
def pdf_object_features(spark, sf):
    """Features in files of which every second has its objects in compressed streams; some files are encrypted, without
    cross-references, or cut after their head."""
    files = objects.pdf_column(_profiled, "k", "name")(_customers(spark, sf))
    return objects.pdf_features(files.drop("issue")).drop("objects")


@query("""WITH o AS (SELECT c_custkey AS k, (1 + c_custkey % 3)::INT AS pages, (CASE c_custkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END)::INT AS more, c_custkey % 2 = 0 AS packed FROM customer WHERE c_custkey % 13 NOT IN (5, 6, 7))
SELECT k::VARCHAR AS path, CASE WHEN packed THEN 4 + pages + more - (k % 7 = 5)::INT ELSE 0 END AS held, pages + (k % 7 = 5)::INT + CASE WHEN packed THEN 2 ELSE 0 END AS streams, pages AS page_objects FROM o""")
def pdf_object_counts(spark, sf):
    files = objects.pdf_column(_profiled, "k", "name")(_customers(spark, sf).where("k % 13 NOT IN (5, 6, 7)"))
    found = objects.pdf_objects(files.drop("issue"))
    return found.groupBy("path").agg(F.count("holder").alias("held"), F.count_if(F.col("kind") == "stream").alias("streams"), F.count_if(F.col("type") == "Page").alias("page_objects"))


def _turned(k: int, name: str, segment: str) -> bytes:
    """Text under nested matrices: scaled and moved by cm, placed by Tm or Td and T*, in a form on the second page."""
    direct = f"q 2 0 0 2 10 20 cm {_shown(name, 6, '1 0 0 1 5 100 Tm')} Q q 1 0 0 1 {k % 50} 0 cm BT /F1 10 Tf 14 TL 50 300 Td ({segment}) Tj T* [({name}) -500 (x)] TJ ET Q"
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 100, 100], "BBox": [0, 0, 100, 100], "Resources": {"Font": {"F1": Ref(4)}}}, _shown(segment, 10, "3 4 Td").encode())
    page = {"Rotate": 90 * (k % 4), "Resources": {"Font": {"F1": Ref(4)}, "XObject": {"X1": "form"}}}
    return _file([direct, "q 1 0 0 1 0 50 cm /X1 Do Q"], page=page, more={"form": form}, packed=k % 2 == 0)


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer),
i AS (SELECT k, 1 AS page, 0 AS item, name AS text, 12.0 AS size, 20 AS x, 220 AS y FROM o UNION ALL SELECT k, 1, 1, segment, 10.0, 50 + k % 50, 300 FROM o
  UNION ALL SELECT k, 1, 2, name || ' x', 10.0, 50 + k % 50, 286 FROM o UNION ALL SELECT k, 2, 0, segment, 10.0, 103, 154 FROM o),
b AS (SELECT *, x AS l, y - 0.2 * size AS b, x + 0.6 * size * length(text) - CASE WHEN item = 2 THEN 0.1 * size ELSE 0 END AS r, y + 0.8 * size AS t FROM i),
v AS (SELECT *, k % 4 AS turn FROM b)
SELECT k::VARCHAR AS path, page, item, text, size::DOUBLE AS size, round(CASE turn WHEN 0 THEN l - 10 WHEN 1 THEN b - 20 WHEN 2 THEN 410 - r ELSE 620 - t END, 3)::DOUBLE AS x0, round(CASE turn WHEN 0 THEN 620 - t WHEN 1 THEN l - 10 WHEN 2 THEN b - 20 ELSE 410 - r END, 3)::DOUBLE AS y0,
  round(CASE turn WHEN 0 THEN r - 10 WHEN 1 THEN t - 20 WHEN 2 THEN 410 - l ELSE 620 - b END, 3)::DOUBLE AS x1, round(CASE turn WHEN 0 THEN 620 - b WHEN 1 THEN r - 10 WHEN 2 THEN t - 20 ELSE 410 - l END, 3)::DOUBLE AS y1 FROM v""")
def pdf_text_boxes(spark, sf):
    files = objects.pdf_column(_turned, "k", "name", "segment")(_customers(spark, sf))
    items = pdf_text.pdf_text_items(files.drop("issue"))
    return items.select("path", "page", "item", "text", F.round("size", 3).alias("size"), *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _three(k: int, name: str, segment: str) -> bytes:
    return _file([_shown(f"{name} p{n}", 10, "20 30 Td") for n in (1, 2, 3)], packed=k % 2 == 0)


def _page_edits(customers):
    """Pages are turned, chosen and appended, stamped and noted; some edits ask for pages that are not there."""
    op = lambda kind, page=None, degrees=None, pages=None, source=None, x=None, y=None, text=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(page).cast("int").alias("page"), F.lit(degrees).cast("int").alias("degrees"), F.lit(pages).cast("array<int>").alias("pages"), (F.lit(None) if source is None else source).cast("binary").alias("source"),
        F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"), (F.lit(None) if text is None else text).cast("string").alias("text"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("string").alias("color"),
    )
    k = F.col("k")
    first = [op("stamp", 2, x=30, y=40, text=F.concat(F.lit("seen ("), "segment", F.lit(")"))), op("addNote", 3, x=5, y=5, text=F.concat(F.lit("note "), "name"))]
    then = [op("selectPages", pages=[3, 2]), op("rotate", 1, 90), op("appendPages", pages=[2], source=F.col("other"))]
    edits = F.when(k % 10 == 9, F.array(op("rotate", 4, 90))).when(k % 10 == 8, F.array(op("selectPages", pages=[1, 1]))).when(k % 10 == 7, F.array(op("rotate", 1, 90), op("stamp", 1, x=1, y=1, text=F.lit("x")))).otherwise(F.array(*first, *then))
    return customers.withColumn("edits", edits)


@query("""WITH o AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS path, c_name AS name, c_mktsegment AS segment FROM customer), g AS (SELECT * FROM o WHERE k % 10 < 7)
SELECT path, 1 AS page, 90 AS rotation, 600.0::DOUBLE AS width, name || ' p3' AS text, 'note ' || name AS notes, NULL AS issue FROM g UNION ALL SELECT path, 2, 0, 400.0, name || ' p2|seen (' || segment || ')', '', NULL FROM g
UNION ALL SELECT path, 3, 0, 400.0, segment || ' p2', '', NULL FROM g
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, CASE WHEN k % 10 = 7 THEN 'UNSUPPORTED_OPERATION' ELSE 'INVALID_INPUT' END FROM o WHERE k % 10 >= 7""")
def pdf_page_edits(spark, sf):
    rows = _customers(spark, sf)
    files = objects.pdf_column(_three, "k", "name", "segment")(rows).select("path", "content")
    # the file to take pages from has the segment in the place of the name
    other = objects.pdf_column(_three, "k", "name", "segment")(rows.withColumn("name", F.col("segment"))).select("path", F.col("content").alias("other"))
    asked = _page_edits(rows.join(other, "path")).select("path", "edits").join(files, "path")
    done = written(objects.pdf_column(pdf_edits.edit_pdf, "content", "edits")(asked))
    items = pdf_text.pdf_text_items(done).where("issue IS NULL").groupBy("path", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("item", "text"))).getField("text"), "|").alias("text"))
    pages = objects.pdf_pages(done).drop("issue").join(items, ["path", "page"], "left")
    seen = done.select("path", "issue").join(pages, "path", "left")
    return seen.select("path", "page", "rotation", "width", "text", F.array_join("notes", "|").alias("notes"), "issue")


#: Ways in which a form can disagree with its pages, by k % 12; the last ones are as they should be.
_FLAWS = "missing repeated value no_widget unplaced other_name unlinked widget_value no_look state foreign".split()


def _form(k: int, name: str, segment: str) -> bytes:
    """A text field of two widgets under a parent, and a box; one thing is wrong with it."""
    flaw = _FLAWS[k % 12] if k % 12 < len(_FLAWS) else ""
    look = lambda text: Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 50, 20]}, text)
    widget = lambda parent, **own: {"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [50, 50, 150, 70], "Parent": parent, "AP": {"N": "look"}} | own
    value = segment.encode()
    more = {
        "look": look(b"q Q"), "bare": look(b""),
        "form": {"Fields": ["group", "box", *(["twin"] if flaw == "repeated" else [])]},
        "group": {"T": b"person", "Kids": ["text"]}, "text": {"T": b"segment", "FT": Name("Tx"), "Parent": "group", "V": b"wrong" if flaw == "value" else value, "Kids": [] if flaw == "no_widget" else ["w1", "w2"]},
        "w1": widget("text"), "w2": widget("text"), "box": {"T": b"ok", "FT": Name("Btn"), "V": Name("Yes"), "Kids": ["w3"]},
        "w3": widget("box", AS=Name("Off" if flaw == "state" else "Yes"), AP={"N": {"Yes": "look", "Off": "look"}}),
        "twin": {"T": b"person.segment", "FT": Name("Tx"), "V": value, "Kids": []}, "stray": widget("group", T=b"other"),
    }
    shown = ["w1", "w2", "w3"]
    if flaw == "missing":
        more["text"]["T"] = b"other"
    elif flaw == "no_widget":
        shown = ["w3"]
    elif flaw == "unplaced":
        shown = ["w1", "w3"]
    elif flaw == "other_name":
        more["w2"]["Parent"] = "group"
    elif flaw == "unlinked":
        more["w2"] |= {"Parent": "lost"}
        more["lost"] = {"T": b"segment", "Parent": "above", "V": value}
        more["above"] = {"T": b"person"}
    elif flaw == "widget_value":
        more["w2"]["V"] = b"stale"
    elif flaw == "no_look":
        more["w1"]["AP"] = {"N": "bare"}
    elif flaw == "foreign":
        more["w4"] = widget("text")
        shown.append("w4")
    return _file([""], {"AcroForm": "form"}, {"Annots": shown}, more, packed=k % 2 == 0)


def _forms(spark, sf):
    return objects.pdf_column(_form, "k", "name", "segment")(_customers(spark, sf)).drop("issue")


def _expected(rows, text, checked):
    box = rows.select("path", F.lit("ok").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(checked).alias("checked"))
    return rows.select("path", F.lit("person.segment").alias("name"), text.alias("value"), F.lit(None).cast("boolean").alias("checked")).unionByName(box)


@query("""WITH o AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS path FROM customer)
SELECT path, CASE WHEN k % 12 = 9 THEN 'ok' ELSE 'person.segment' END AS name, unnest(CASE k % 12 WHEN 0 THEN ['MISSING'] WHEN 1 THEN ['REPEATED', 'NO_WIDGET'] WHEN 2 THEN ['VALUE', 'WIDGET_VALUE'] WHEN 3 THEN ['NO_WIDGET'] WHEN 4 THEN ['UNPLACED'] WHEN 5 THEN ['OTHER_NAME', 'UNLINKED', 'WIDGET_VALUE']
  WHEN 6 THEN ['UNLINKED'] WHEN 7 THEN ['WIDGET_VALUE'] WHEN 8 THEN ['NO_APPEARANCE'] WHEN 9 THEN ['STATE'] WHEN 10 THEN ['FOREIGN'] ELSE [] END) AS problem FROM o""")
def pdf_form_problems(spark, sf):
    files = written(_forms(spark, sf))
    expected = _expected(_customers(spark, sf), F.col("segment"), True)
    return forms.field_problems(pdf_edits.pdf_fields(files), pdf_edits.pdf_widgets(files), expected)


@query("""WITH o AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS path, c_name AS name FROM customer), g AS (SELECT *, k % 12 IN (0, 1) AS unknown, k % 12 IN (3, 4, 5, 6, 10) AS unfit FROM o)
SELECT path, CASE WHEN unknown THEN 'INVALID_INPUT' WHEN unfit THEN 'UNSUPPORTED_OPERATION' END AS issue, CASE WHEN NOT unknown AND NOT unfit THEN 'ok=Off,person.segment=' || name END AS fields, 0 AS problems FROM g""")
def pdf_form_fill(spark, sf):
    """A text and a box are set; forms that do not agree with their pages are left alone."""
    op = lambda kind, name, value, checked: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(checked).cast("boolean").alias("checked"))
    edits = F.array(op("setTextField", "person.segment", F.col("name"), None), op("setCheckbox", "ok", F.lit(None), False))
    rows = _customers(spark, sf)
    done = written(objects.pdf_column(pdf_edits.edit_pdf, "content", "edits")(_forms(spark, sf).join(rows.select("path", edits.alias("edits")), "path")))
    fields = written(pdf_edits.pdf_fields(done))
    said = fields.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))), ",").alias("fields"))
    good = rows.join(done.where("issue IS NULL").select("path"), "path", "left_semi")
    bad = forms.field_problems(fields, pdf_edits.pdf_widgets(done), _expected(good, F.col("name"), False)).groupBy("path").agg(F.count(F.lit(1)).alias("problems"))
    out = done.select("path", "issue").join(said, "path", "left").join(bad, "path", "left")
    return out.select("path", "issue", "fields", F.coalesce("problems", F.lit(0)).alias("problems"))
