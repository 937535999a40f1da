"""Queries over packages: they are built from the driver's tables, written by the library and read back by it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import delivery, identity, integrity, rules, views
from ..scratch import written
from ..sources import designs, packages, writers
from ..sources import pdf as writers_pdf
from .base import norm, query, table

_DOC = "SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS text FROM documents"
_LINES = f"""d AS ({_DOC}), l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal, unnest(string_split(text, chr(10))) AS text FROM d)"""


def _lines(spark, sf):
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.split(clean, "\n").alias("lines"))


def _blocks(spark, sf):
    lines = _lines(spark, sf).select("path", F.posexplode("lines").alias("pos", "text"))
    style = F.when(F.col("pos") == 0, "Heading1").when(F.col("pos") % 4 == 1, "Heading3")
    return lines.select("path", "pos", F.lit("paragraph").alias("kind"), "text", style.alias("style"))


def _documents(spark, sf):
    return writers.build_documents(_blocks(spark, sf))


def _join(left, right, how="inner", also=()):
    """Join on path, which is null for documents without an id, and on the columns also."""
    right = right.withColumnsRenamed({k: f"{k}_right" for k in ("path", *also)})
    on = F.col("path").eqNullSafe(F.col("path_right"))
    for k in also:
        on = on & (F.col(k) == F.col(f"{k}_right"))
    return left.join(right, on, how).drop("path_right", *(f"{k}_right" for k in also))


@query(f"""WITH {_LINES} SELECT doc_id::VARCHAR AS path, ordinal, '/w:document/w:body/w:p[' || (ordinal + 1) || ']' AS structural_path, {norm('text')} AS text,
  CASE WHEN ordinal = 0 THEN 1 WHEN ordinal % 4 = 1 THEN 3 END AS level FROM l""")
def package_paragraphs(spark, sf):
    files = written(_documents(spark, sf))
    paras, styles = packages.paragraphs(files), packages.styles(files)
    chain = styles.select("path", "style_id", F.col("outline_level").alias("chain"), "name")
    out = _join(paras, chain, "left", ["style_id"])
    level = T.heading_level("outline_level", "chain", "style_id", "name")
    return out.select("path", "ordinal", "structural_path", T.normalize_text("text").alias("text"), level.alias("level"))


@query(f"""WITH d AS ({_DOC}), p AS (SELECT doc_id::VARCHAR AS path, unnest(['[Content_Types].xml', '_rels/.rels', 'word/_rels/document.xml.rels', 'word/document.xml', 'word/styles.xml']) AS part,
  unnest(['application/xml', 'application/vnd.openxmlformats-package.relationships+xml', 'application/vnd.openxmlformats-package.relationships+xml',
  'application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml', 'application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml']) AS content_type FROM d) SELECT * FROM p""")
def package_scan(spark, sf):
    return packages.typed_parts(written(_documents(spark, sf))).select("path", "part", "content_type")


@query(f"""WITH d AS ({_DOC}), r AS (SELECT doc_id::VARCHAR AS path, unnest(['', 'word/document.xml']) AS source_part, unnest(['word/document.xml', 'word/styles.xml']) AS resolved FROM d) SELECT *, true AS found FROM r""")
def package_relationships(spark, sf):
    files = written(_documents(spark, sf))
    rels, parts = packages.relationships(files), packages.parts(files)
    known = parts.select("path", F.col("part").alias("resolved"), F.lit(True).alias("found"))
    return _join(rels, known, "left", ["resolved"]).select("path", "source_part", "resolved", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"""WITH d AS ({_DOC}) SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 20 = 0 THEN 'CONTAINER_UNREADABLE' ELSE 'OK' END AS outcome, doc_id % 20 <> 0 AS parsed FROM d WHERE doc_id % 20 <> 5
UNION ALL SELECT doc_id::VARCHAR, 'NOT_ZIP', false FROM d WHERE doc_id % 20 = 5""")
def package_gate(spark, sf):
    files = _documents(spark, sf)
    k = F.col("path").cast("bigint") % 20
    broken = F.when(k == 0, F.substring("content", 1, 40)).when(k == 5, F.concat(F.lit(b"{\\rtf1"), F.col("content"))).otherwise(F.col("content"))
    files = written(files.select("path", broken.alias("content")))
    seen = packages.parts(files).groupBy("path").agg(F.min("issue").alias("issue"), F.count("part").alias("n"))
    out = _join(files.select("path", packages.container(F.col("content")).alias("container")), seen, "left")
    code = rules.gate(("NOT_ZIP", F.col("container") != "zip"), ("CONTAINER_UNREADABLE", F.col("issue").isNotNull()))
    return out.select("path", F.coalesce(code, F.lit("OK")).alias("outcome"), (F.coalesce("n", F.lit(0)) > 0).alias("parsed"))


_SHEET = """c AS (SELECT l_suppkey::VARCHAR AS path, 'S' || (l_linenumber % 2) AS sheet, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS k, l_extendedprice AS number, l_returnflag AS flag FROM lineitem)"""


@query(f"""WITH {_SHEET} SELECT path, sheet, max(k // 6 + 1)::INT AS rows, max(k % 6 + 1)::INT AS columns, count(*) AS populated, count(*) FILTER (k % 5 = 0) AS texts, round(sum(CASE WHEN k % 5 <> 0 THEN number END), 2) AS total FROM c GROUP BY path, sheet""")
def workbook_cells(spark, sf):
    w = Window.partitionBy("l_suppkey", F.col("l_linenumber") % 2).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    c = table(spark, sf, "lineitem").withColumn("k", F.row_number().over(w) - 1)
    c = c.select(
        F.col("l_suppkey").alias("path"), F.concat(F.lit("S"), (F.col("l_linenumber") % 2).cast("string")).alias("sheet"), (F.floor(F.col("k") / 6) + 1).cast("int").alias("row"), (F.col("k") % 6 + 1).alias("col"),
        F.when(F.col("k") % 5 != 0, F.col("l_extendedprice")).alias("number"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("="), "l_returnflag")).alias("text"),
    )
    cells = packages.sheet_cells(writers.build_workbooks(c))
    number = F.when(F.col("kind") == "number", F.col("value").cast("double"))
    return cells.groupBy("path", "sheet").agg(
        F.max("row").alias("rows"), F.max("col").alias("columns"), F.count("value").alias("populated"), F.count_if(F.col("kind") == "text").alias("texts"), F.round(F.sum(number), 2).alias("total")
    )


@query(f"""WITH d AS ({_DOC}), x AS (SELECT doc_id, doc_id % 6 IN (1, 5) AS fine, CASE WHEN doc_id % 6 = 4 THEN 'dear {{{{ name }}}}, {{{{name}}}}' ELSE 'dear {{{{name}}}}, {{{{name}}}}' END AS t FROM d)
SELECT doc_id::VARCHAR AS path, CASE WHEN fine THEN replace(t, '{{{{name}}}}', 'reader & ' || doc_id) ELSE t END AS text, CASE WHEN fine THEN 'T' || doc_id || ' page' ELSE '{{{{title}}}} page' END AS header,
  CASE doc_id % 6 WHEN 0 THEN 'TEMPLATE_VALUE_MISSING' WHEN 2 THEN 'TEMPLATE_VALUE_UNUSED' WHEN 3 THEN 'UNSUPPORTED_TEMPLATE' WHEN 4 THEN 'UNSUPPORTED_TEMPLATE' END AS issue FROM x""")
def template_fill(spark, sf):
    d, cut = table(spark, sf, "documents").select(F.col("doc_id").alias("path")), writers.RUN_BREAK
    kind = F.coalesce(F.col("path").cast("bigint") % 6, F.lit(1))
    body = F.when(kind == 4, "dear {{ name }}, {{name}}").otherwise(f"dear {{{{na{cut}me}}{cut}}}, {{{cut}{{name}}}}")
    block = lambda pos, name, text: d.select("path", F.lit(pos).alias("pos"), F.lit(name).alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("style"))
    files = writers.build_documents(block(0, "paragraph", body).unionByName(block(1, "header", F.lit(f"{{{{ti{cut}tle}}}} page"))))
    value = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("value"))
    reader = F.concat(F.lit("reader & "), "path", F.when(kind == 3, "\n").otherwise(""))
    given = F.array(value("title", F.concat(F.lit("T"), "path")), F.when(kind != 0, value("name", reader)), F.when(kind == 2, value("more", F.lit("x"))))
    done = written(writers.rewrite(files.withColumn("values", F.array_compact(given)), writers.fill_template, "values"))
    text, header = packages.paragraphs(done).select("path", "text"), packages.header_texts(done).select("path", F.col("text").alias("header"))
    return _join(_join(done.select("path", "issue"), text), header).select("path", "text", "header", "issue")


@query(f"""WITH d AS ({_DOC}) SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 4 = 0 THEN 'TEXT_NOT_FOUND' END AS issue, CASE WHEN doc_id % 4 = 0 THEN 'first' ELSE 'second & last' END AS text, doc_id % 4 <> 0 AS changed FROM d""")
def text_replacement(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"))
    files = written(writers.build_documents(d.select("path", F.lit(0).alias("pos"), F.lit("paragraph").alias("kind"), F.lit("first").alias("text"), F.lit(None).cast("string").alias("style"))))
    expected = F.when(F.col("path").cast("bigint") % 4 == 0, "absent").otherwise("first")
    files = files.withColumn("edits", F.array(F.struct(expected.alias("expected"), F.lit("second & last").alias("replacement"))))
    done = written(writers.rewrite(files, writers.replace_text, "edits")).withColumn("new_sha", F.sha2("content", 256))
    both = _join(done, files.select("path", F.sha2("content", 256).alias("old_sha")))
    return _join(both, packages.paragraphs(done).select("path", "text")).select("path", "issue", "text", (F.col("new_sha") != F.col("old_sha")).alias("changed"))


@query(f"""WITH d AS ({_DOC}) SELECT count(*) AS files, count(DISTINCT text) AS artifacts FROM d""")
def artifact_store(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), "UTF-8").alias("content"))
    refs = delivery.artifact_refs(d)
    return d.agg(F.count(F.lit(1)).alias("files")).crossJoin(refs.agg(F.count(F.lit(1)).alias("artifacts")))


@query("""WITH p AS (SELECT p_partkey, (['word/vbaProject.bin', 'word/document.xml', 'xl/macrosheets/m.xml', 'word/embeddings/o.bin', 'word/embeddings/f.swf', 'word/embeddings/b.xlsx', 'word/activeX/a.xml', 'word/afchunk.dat', 'word/media/i.png'])[(p_partkey % 9 + 1)::INT] AS part,
  (['application/x', 'application/vnd.ms-word.document.macroEnabled.main+xml', 'application/xml'])[(p_partkey % 3 + 1)::INT] AS ct FROM part)
SELECT p_partkey, (['name', CASE WHEN ct LIKE '%macroEnabled%' THEN 'content-type' END, CASE WHEN ct LIKE '%macroEnabled%' THEN 'content-type' ELSE 'folder' END, CASE WHEN ct LIKE '%macroEnabled%' THEN 'content-type' END,
  CASE WHEN ct LIKE '%macroEnabled%' THEN 'content-type' END, CASE WHEN ct LIKE '%macroEnabled%' THEN 'content-type' END, CASE WHEN ct LIKE '%macroEnabled%' THEN 'content-type' END, CASE WHEN ct LIKE '%macroEnabled%' THEN 'content-type' END, CASE WHEN ct LIKE '%macroEnabled%' THEN 'content-type' END])[(p_partkey % 9 + 1)::INT] AS macro,
  ([NULL, NULL, NULL, 'oleEmbedding', 'flash', 'package', 'activeX', 'altChunk', NULL])[(p_partkey % 9 + 1)::INT] AS embedded FROM p""")
def package_indicators(spark, sf):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    names = ["word/vbaProject.bin", "word/document.xml", "xl/macrosheets/m.xml", "word/embeddings/o.bin", "word/embeddings/f.swf", "word/embeddings/b.xlsx", "word/activeX/a.xml", "word/afchunk.dat", "word/media/i.png"]
    kinds = ["application/x", "application/vnd.ms-word.document.macroEnabled.main+xml", "application/xml"]
    p = table(spark, sf, "part").select("p_partkey", pick(names).alias("part"), pick(kinds).alias("content_type"))
    macros = integrity.macro_indicators(p, ["p_partkey"]).select("p_partkey", F.col("how").alias("macro"))
    return p.join(macros, "p_partkey", "left").select("p_partkey", "macro", integrity.embedded_kind(F.col("part"), F.col("content_type")).alias("embedded"))


@query(f"""WITH {_LINES}, n AS (SELECT doc_id::VARCHAR AS path, ordinal, CASE WHEN ordinal = 0 THEN 1 WHEN ordinal % 4 = 1 THEN 3 END AS level FROM l)
SELECT path, count(*) AS paragraphs, count(level) AS headings, 10 AS styles, 2 AS relationships, 5 AS parts FROM n GROUP BY path""")
def package_counts(spark, sf):
    files = written(_documents(spark, sf))
    paras = packages.paragraphs(files).groupBy("path").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(F.col("style_id").startswith("Heading")).alias("headings"))
    one = lambda df, name: df.groupBy("path").agg(F.count(F.lit(1)).alias(name))
    for counted, name in ((packages.styles, "styles"), (packages.relationships, "relationships"), (packages.parts, "parts")):
        paras = _join(paras, one(counted(files), name))
    return paras


def _nodes(spark, sf):
    return identity.anchored(identity.paragraphs(table(spark, sf, "documents"))).withColumns({"level": F.lit(1), "kind": F.lit("p"), "n_rows": F.lit(1)})


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, ordinal, coalesce(doc_id, 0) * 31 + ordinal AS m FROM l), p AS (
  SELECT 'identity' AS problem FROM m WHERE m % 17 = 0 UNION ALL SELECT 'claimed-twice' FROM m WHERE m % 7 = 0 UNION ALL SELECT 'missing-node' FROM m WHERE m % 13 = 0 UNION ALL SELECT 'not-in-index' FROM m WHERE m % 11 = 0 OR m % 7 = 0
  UNION ALL SELECT 'duplicate-id' FROM m GROUP BY ordinal, m % 17 = 0 HAVING count(*) > 1 UNION ALL SELECT 'level-range' FROM m WHERE m % 19 < 2 UNION ALL SELECT 'empty-table' FROM m WHERE m % 23 = 0)
SELECT problem, count(*) AS n FROM p GROUP BY problem""")
def identity_checks(spark, sf):
    """Nodes of all documents, some of them made bad by a number of their own: ids that are not what they should be,
    pointers that a second id claims, entries whose node or place in the index is gone, levels and tables out of order."""
    m = F.coalesce(F.col("doc_id"), F.lit(0)) * 31 + F.col("ordinal")
    nodes = _nodes(spark, sf).withColumn("pointer", F.concat_ws("#", "doc_id", "pointer"))
    entries = nodes.select("semantic_id", "pointer", m.alias("m"))
    claimed = entries.where("m % 7 = 0").select(F.concat("semantic_id", F.lit("-b")).alias("semantic_id"), "pointer")
    found = identity.map_violations(entries.drop("m").unionByName(claimed), entries.where("m % 11 <> 0").drop("m"), nodes.where(m % 13 != 0))
    bad = nodes.withColumns({
        "semantic_id": F.when(m % 17 == 0, F.concat("semantic_id", F.lit("-x"))).otherwise(F.col("semantic_id")),
        "level": F.when(m % 19 == 0, 0).when(m % 19 == 1, 10).otherwise(F.col("level")), "kind": F.when(m % 23 < 2, "tbl").otherwise(F.col("kind")), "n_rows": F.when(m % 23 == 0, 0).otherwise(F.col("n_rows")),
    })
    wrong = identity.identity_violations(bad).select(F.lit("identity").alias("problem"))
    return wrong.union(found.select("problem")).union(identity.semantic_problems(bad).select("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _damaged(content: bytes, kind: int) -> bytes:
    """A package made bad in one of seven ways; 0 leaves it as it is."""
    if kind == 1:
        return content[: len(content) // 2]
    name = packages.DOCUMENT.encode()
    if kind == 2:  # the deflate stream
        at = content.index(name) + len(name)
        return content[:at] + b"\xff" * 8 + content[at + 8 :]
    if kind == 7:  # the flag of an encrypted entry, in the directory
        at = content.rindex(name) - 46
        return content[: at + 8] + bytes([content[at + 8] | 1]) + content[at + 9 :]
    new = {
        3: b"<document/>", 4: b"<document><body></document>", 6: None,
        5: '<?xml version="1.0" encoding="UTF-16"?><!DOCTYPE d [<!ENTITY e "boom">]><document><body>&e;</body></document>'.encode("utf-16"),
    }
    if kind not in new:
        return content
    package = packages.Package(content)
    parts = {i.filename: new[kind] if i.filename == packages.DOCUMENT else package.read(i.filename) for i in package.infos}
    return writers.packed({k: v for k, v in parts.items() if v is not None})


@query(f"""WITH d AS ({_DOC}) SELECT doc_id::VARCHAR AS path, issue AS paragraphs, issue AS cells, issue AS layout FROM
  (SELECT doc_id, (['', 'CONTAINER_UNREADABLE', 'ENTRY_DAMAGED', 'BODY_MISSING', 'XML_MALFORMED', 'XML_FORBIDDEN', 'PART_MISSING', 'ENTRY_ENCRYPTED'])[(doc_id % 8 + 1)::INT] AS issue FROM d)""")
def package_damage(spark, sf):
    def run(batches):
        return packages.made_files((p, _damaged(c, int(p or 0) % 8)) for p, c in packages.rows_of(batches, "path", "content"))

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("pos"), F.lit("paragraph").alias("kind"), F.lit("some text").alias("text"), F.lit(None).cast("string").alias("style"))
    files = written(writers.build_documents(d).mapInArrow(run, "path string, content binary"))
    out = files.select("path")
    for name, read in (("paragraphs", packages.paragraphs), ("cells", packages.cells), ("layout", packages.layout)):
        out = _join(out, read(files).groupBy("path").agg(F.max("issue").alias(name)), "left")
    return out.select("path", *(F.coalesce(n, F.lit("")).alias(n) for n in ("paragraphs", "cells", "layout")))


def _rich_parts(k: int) -> dict[str, str]:
    """A document with a table, drawings, notes, properties and fields whose values follow k."""
    ns = " ".join(
        f'xmlns:{p}="{u}"' for p, u in {
            "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
            "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
            "mc": "http://schemas.openxmlformats.org/markup-compatibility/2006",
        }.items()
    )
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    head = (
        f'<w:p><w:pPr><w:jc w:val="center"/><w:ind w:firstLine="{k % 500}"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="{2 * (k % 30)}"/><w:color w:val="auto"/></w:rPr>'
        f'<w:t>run {k}</w:t><w:tab/></w:r><w:r><w:rPr><w:b w:val="0"/><w:rFonts w:eastAsia="SimSun"/><w:color w:val="FF0000"/></w:rPr><w:t>tail</w:t><w:br/></w:r></w:p>'
    )
    row = f'<w:tr><w:trPr><w:gridBefore w:val="1"/><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr>{para(f"cell {k}")}{para("two")}</w:tc></w:tr>'
    table_xml = f"<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid>{row}<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{para('x')}</w:tc></w:tr></w:tbl>"
    placed = f'<wp:positionH relativeFrom="page"><wp:posOffset>{k}</wp:posOffset></wp:positionH><wp:positionV relativeFrom="page"><wp:align>top</wp:align></wp:positionV>'
    drawing = f'<w:drawing><wp:anchor behindDoc="{k % 2}">{placed}<wp:extent cx="100" cy="200"/><wp:wrapNone/><a:blip r:embed="rId{k % 9}"/></wp:anchor></w:drawing>'
    other = '<w:pict><wp:inline><wp:extent cx="1" cy="2"/></wp:inline></w:pict>'
    choice = f'<w:p><w:r><mc:AlternateContent><mc:Choice Requires="wps">{drawing}</mc:Choice><mc:Fallback>{other}</mc:Fallback></mc:AlternateContent></w:r></w:p>'
    section = f'<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="{k % 100}" w:right="20" w:bottom="30" w:left="40"/><w:cols w:num="2"/></w:sectPr>'
    note = lambda kind, n, t, more="": f'<w:{kind} w:id="{n}"{more}>{para(t)}</w:{kind}>'
    field = f'<w:p><w:r><w:instrText> DDEAUTO x{k} </w:instrText></w:r><w:fldSimple w:instr="PAGE"/></w:p>'
    return {
        "[Content_Types].xml": "<Types/>",
        packages.DOCUMENT: f"<w:document {ns}><w:body>{head}{table_xml}{choice}<w:altChunk/>{section}</w:body></w:document>",
        "word/comments.xml": f"<w:comments {ns}>{note('comment', 1, f'says {k}', f' w:author=\'A{k % 3}\'')}</w:comments>",
        "word/footnotes.xml": f"<w:footnotes {ns}>{note('footnote', -1, '')}{note('footnote', 0, '')}{note('footnote', 2, 'foot')}</w:footnotes>",
        "word/header1.xml": f"<w:hdr {ns}>{field}{field}</w:hdr>",
        "docProps/core.xml": f"<c><title>T{k}</title><creator/></c>",
    }


def _rich(spark, sf):
    def run(batches):
        return packages.made_files((p, writers.packed(_rich_parts(int(p or 0)))) for (p,) in packages.rows_of(batches, "path"))

    return packages.spread(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path")), "path").mapInArrow(run, "path string, content binary")


@query("""SELECT doc_id::VARCHAR AS path, r AS row, 0 AS idx, 3 AS declared, CASE WHEN r = 0 THEN 1 ELSE 0 END AS grid_before, CASE WHEN r = 0 THEN 2 ELSE 1 END AS span, CASE WHEN r = 0 THEN 'restart' ELSE 'continue' END AS v_merge, r = 0 AS header,
  CASE WHEN r = 0 THEN 'cell ' || doc_id || chr(10) || 'two' ELSE 'x' END AS text FROM documents, (SELECT unnest([0, 1]) AS r)""")
def package_cells(spark, sf):
    return packages.cells(_rich(spark, sf)).select("path", "row", "idx", "declared", "grid_before", "span", "v_merge", "header", "text")


@query("""SELECT doc_id::VARCHAR AS path, 'comment' AS kind, '1' AS reference, 'A' || (doc_id % 3) AS author, 'says ' || doc_id AS text FROM documents UNION ALL SELECT doc_id::VARCHAR, 'footnote', '2', NULL, 'foot' FROM documents""")
def package_notes(spark, sf):
    return packages.notes(_rich(spark, sf)).select("path", "kind", "reference", "author", "text")


@query("""SELECT doc_id::VARCHAR AS path, 'T' || doc_id AS title, 'word/header1.xml' AS part, 'DDEAUTO x' || doc_id AS instruction FROM documents""")
def package_properties(spark, sf):
    files = written(_rich(spark, sf))
    fields = packages.dde_fields(files).select("path", "part", "instruction")
    return _join(packages.metadata(files).select("path", "title"), fields).select("path", "title", "part", "instruction")


@query("""SELECT doc_id::VARCHAR AS path, 'float' AS obs, 2 AS block, 'anchor' AS kind, NULL AS columns, 100 AS width, 200 AS height, doc_id AS offset_x, NULL AS offset_y, CASE WHEN doc_id % 2 = 1 THEN 'behindText' ELSE 'inFrontOfText' END AS wrap, 'rId' || (doc_id % 9) AS rel_id, NULL AS margin_top FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'unknown', 3, 'altChunk', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'section', 2, 'nextPage', 2, 11906, 16838, NULL, NULL, NULL, NULL, doc_id % 100 FROM documents""")
def package_layout(spark, sf):
    return packages.layout(_rich(spark, sf)).select("path", "obs", "block", "kind", "columns", "width", "height", "offset_x", "offset_y", "wrap", "rel_id", "margin_top")


@query("""WITH r AS (SELECT doc_id, unnest(range(5)) AS k FROM documents) SELECT doc_id::VARCHAR AS path, (['run ' || doc_id, 'tail', 'cell ' || doc_id, 'two', 'x'])[k + 1] AS text, CASE k WHEN 0 THEN true WHEN 1 THEN false END AS bold, CASE WHEN k = 0 AND doc_id % 30 > 0 THEN (doc_id % 30)::DOUBLE END AS size,
  CASE WHEN k = 1 THEN 'FF0000' END AS color, CASE WHEN k = 1 THEN 'SimSun' END AS east_asia, CASE WHEN k < 2 THEN 'center' END AS alignment, CASE WHEN k < 2 THEN doc_id % 500 END AS first_line FROM r
UNION ALL SELECT doc_id::VARCHAR, '', NULL, NULL, NULL, NULL, NULL, NULL FROM documents""")
def package_runs(spark, sf):
    return packages.runs(_rich(spark, sf)).select("path", "text", "bold", "size", "color", "east_asia", "alignment", "first_line")


@query("""SELECT doc_id::VARCHAR AS path, CASE doc_id % 4 WHEN 2 THEN 'TARGET_NOT_FOUND' WHEN 3 THEN 'INVALID_INPUT' END AS issue, CASE WHEN doc_id % 4 < 2 THEN 'Grid' || (doc_id % 5) END AS style_id, CASE WHEN doc_id % 4 < 2 THEN 5000 + doc_id % 100 END AS width,
  CASE WHEN doc_id % 4 < 2 THEN 'center' END AS alignment, CASE WHEN doc_id % 4 = 1 THEN 'fixed' END AS layout, CASE WHEN doc_id % 4 < 2 THEN (1000 + doc_id % 7)::VARCHAR ELSE '' END AS grid, doc_id % 4 <> 0 AS header_row FROM documents""")
def table_geometry(spark, sf):
    k = F.coalesce(F.col("path").cast("bigint"), F.lit(0))
    widths = F.when(k % 4 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array((1000 + k % 7).cast("int")))
    wanted = F.struct(
        F.when(k % 4 == 2, 9).otherwise(0).alias("table"), F.concat(F.lit("Grid"), (k % 5).cast("string")).alias("style_id"), (5000 + k % 100).cast("int").alias("width"), F.lit("Center").alias("alignment"),
        F.when(k % 4 == 1, "fixed").alias("layout"), widths.alias("column_widths"), (k % 4 == 1).alias("header_row"), F.lit("top").alias("vertical_alignment"),
    )
    done = written(writers.rewrite(_rich(spark, sf).withColumn("edits", F.array(wanted)), writers.set_table_geometry, "edits"))
    seen = packages.table_geometry(done).select("path", "style_id", "width", "alignment", "layout", F.array_join(F.array_compact("grid"), ",").alias("grid"), "header_row")
    return _join(done.select("path", "issue"), seen)


@query("""SELECT s_suppkey::VARCHAR AS path, CASE s_suppkey % 5 WHEN 3 THEN 'TARGET_NOT_FOUND' WHEN 4 THEN 'INVALID_INPUT' END AS issue, sheet, CASE WHEN sheet = 'A' AND s_suppkey % 5 < 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'landscape' ELSE 'portrait' END END AS orientation,
  CASE WHEN sheet = 'A' AND s_suppkey % 5 IN (1, 2) THEN s_suppkey % 5 END AS fit_to_width, CASE WHEN sheet = 'A' AND s_suppkey % 5 = 0 THEN 80 END AS scale, sheet = 'A' AND s_suppkey % 5 IN (1, 2) AS fit_to_page FROM supplier, (SELECT unnest(['A', 'B']) AS sheet)""")
def print_layout(spark, sf):
    cells = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.col("s_acctbal").alias("number"), F.lit(None).cast("string").alias("text"))
    k = F.col("path").cast("bigint") % 5
    wanted = F.struct(
        F.when(k == 3, "C").otherwise("A").alias("sheet"), F.when(F.col("path").cast("bigint") % 2 == 0, "landscape").otherwise("portrait").alias("orientation"),
        F.when(k.isin(1, 2), k.cast("int")).alias("fit_to_width"), F.when(k == 0, 80).alias("scale"),
    )
    done = written(writers.rewrite(writers.build_workbooks(cells).withColumn("edits", F.when(k == 4, F.array(wanted, wanted)).otherwise(F.array(wanted))), writers.set_print_layout, "edits"))
    seen = packages.print_layouts(done).select("path", "sheet", "orientation", "fit_to_width", "scale", "fit_to_page")
    return _join(done.select("path", "issue"), seen)


@query("""WITH d AS (SELECT doc_id, (['', '/JS (x)', '/S /JavaScript', '/Type /EmbeddedFile', '/URI (u)', '/S/Launch', '/FT /Sig', '/AcroForm 1', '/XFA 2', '/JSON', '/Encrypt 9 /JS', '/S /GoTo'])[(doc_id % 12 + 1)::INT] AS mark, doc_id % 12 = 10 AS encrypted FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id::VARCHAR AS path, '1.' || (doc_id % 8) AS version, (doc_id % 4)::INT AS pages, encrypted, CASE WHEN NOT encrypted THEN doc_id % 12 IN (1, 2) END AS javascript, CASE WHEN NOT encrypted THEN doc_id % 12 = 3 END AS embedded_files,
  CASE WHEN NOT encrypted THEN doc_id % 12 IN (4, 5) END AS external_links, CASE WHEN NOT encrypted THEN doc_id % 12 = 6 END AS signatures, CASE WHEN NOT encrypted THEN doc_id % 12 = 7 END AS acro_form, CASE WHEN NOT encrypted THEN doc_id % 12 = 8 END AS xfa FROM d""")
def pdf_profiles(spark, sf):
    marks = ["", "/JS (x)", "/S /JavaScript", "/Type /EmbeddedFile", "/URI (u)", "/S/Launch", "/FT /Sig", "/AcroForm 1", "/XFA 2", "/JSON", "/Encrypt 9 /JS", "/S /GoTo"]
    k = F.col("doc_id")
    head = F.when(k % 7 == 0, "%!PS-").otherwise("%PDF-")  # some files are of another kind
    mark = F.element_at(F.array(*[F.lit(m) for m in marks]), (k % 12 + 1).cast("int"))
    text = F.concat(head, F.lit("1."), (k % 8).cast("string"), F.lit("\n/Type /Pages "), F.repeat(F.lit("/Type /Page "), (k % 4).cast("int")), mark, F.lit(" %%EOF"))
    return packages.pdf_profile(table(spark, sf, "documents").select(k.cast("string").alias("path"), F.encode(text, "UTF-8").alias("content")))


@query("""SELECT doc_id::VARCHAR AS path, concat_ws('|', 'run ' || doc_id || 'tail', 'cell ' || doc_id, 'two', 'x', '') AS paragraphs, '/w:document/w:body/w:tbl[1]' AS tables, 'comment:1,footnote:2' AS notes, 'run ' || doc_id AS formatting,
  '[Content_Types].xml,docProps/core.xml,word/comments.xml,word/document.xml,word/footnotes.xml,word/header1.xml' AS parts FROM documents""")
def document_views(spark, sf):
    view = views.content_view(written(_rich(spark, sf)))
    return view.select("path", F.array_join("paragraphs", "|").alias("paragraphs"), *(F.array_join(n, ",").alias(n) for n in views.FLAGS))


@query("""SELECT doc_id::VARCHAR AS path, 4 + 1 AS paragraphs, 2 AS notes, 'notes,paragraphs,path' AS columns FROM documents""")
def pruned_views(spark, sf):
    view = views.content_view(written(_rich(spark, sf)), ("notes",))
    return view.select("path", F.size("paragraphs").alias("paragraphs"), F.size("notes").alias("notes"), F.lit(",".join(sorted(view.columns))).alias("columns"))


@query("""SELECT p_partkey, regexp_replace(tag, '^\\{[^}]*\\}', '') AS name FROM (SELECT p_partkey, (['{http://x/y}' || p_type, p_type, '{}' || p_type, '{a}{b}' || p_type])[(p_partkey % 4 + 1)::INT] AS tag FROM part)""")
def tag_names(spark, sf):
    forms = F.array(F.concat(F.lit("{http://x/y}"), "p_type"), F.col("p_type"), F.concat(F.lit("{}"), "p_type"), F.concat(F.lit("{a}{b}"), "p_type"))
    return table(spark, sf, "part").select("p_partkey", T.local_name(F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("name"))


_PRESETS = ["report", "technical", "chinese-long", "chinese-contract"]


def _designed(spark, sf):
    """A document of each supplier in one of the presets, with a heading and, but for every seventh, a list."""
    k = F.col("s_suppkey")
    block = lambda pos, kind, style, ordered=None: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), F.lit(style).cast("string").alias("style"), F.lit(ordered).cast("boolean").alias("ordered"))
    plain, listed = [block(0, "paragraph", "Heading1"), block(1, "paragraph", None)], [block(2, "list", None, False), block(3, "list", None, True)]
    blocks = F.explode(F.when(k % 7 == 0, F.array(*plain)).otherwise(F.array(*plain, *listed))).alias("b")
    preset = F.element_at(F.array(*[F.lit(p) for p in _PRESETS]), (k % 4 + 1).cast("int")).alias("preset")
    rows = table(spark, sf, "supplier").select(k.alias("path"), preset, F.col("s_name").alias("text"), blocks).select("path", "preset", "text", "b.*")
    return writers.build_documents(rows.withColumn("level", F.lit(0)), preset="preset")


@query("""WITH p AS (SELECT * FROM (VALUES (0, 'Calibri', 'Microsoft YaHei', 11.0, '24476B', NULL, 15.0, 13.0, 11.0, true, true, true, 'Microsoft YaHei', 'Microsoft YaHei', 250, 220, 190, 120, 20.0),
  (1, 'Calibri', 'Microsoft YaHei', 10.5, '176B6B', NULL, 15.0, 13.0, 11.0, true, true, true, 'Microsoft YaHei', 'Microsoft YaHei', 250, 220, 190, 120, 20.0),
  (2, 'Times New Roman', 'SimSun', 12.0, '000000', 'center', 16.0, 14.0, 12.0, NULL, NULL, true, 'SimHei', 'SimSun', 250, 220, 190, 120, 22.0),
  (3, 'Times New Roman', 'SimSun', 12.0, '000000', 'center', 12.0, 12.0, 12.0, true, true, true, 'SimHei', 'SimSun', 200, 200, 200, 80, 22.0)) t(k, latin, east, body, color, title, h1, h2, h3, b1, b2, b3, face, face3, s1, s2, s3, after, tsize)),
f AS (SELECT k, unnest([{'style_id': 'Normal', 'size': body, 'bold': NULL, 'color': NULL, 'latin': latin, 'east_asia': east, 'before': NULL, 'after': NULL, 'alignment': NULL},
  {'style_id': 'Title', 'size': tsize, 'bold': true, 'color': color, 'latin': latin, 'east_asia': face, 'before': 320, 'after': 240, 'alignment': title},
  {'style_id': 'Subtitle', 'size': 12.0, 'bold': NULL, 'color': '667085', 'latin': latin, 'east_asia': east, 'before': NULL, 'after': NULL, 'alignment': NULL},
  {'style_id': 'Heading1', 'size': h1, 'bold': b1, 'color': color, 'latin': latin, 'east_asia': face, 'before': s1, 'after': after, 'alignment': NULL},
  {'style_id': 'Heading2', 'size': h2, 'bold': b2, 'color': color, 'latin': latin, 'east_asia': face, 'before': s2, 'after': after, 'alignment': NULL},
  {'style_id': 'Heading3', 'size': h3, 'bold': b3, 'color': color, 'latin': latin, 'east_asia': face3, 'before': s3, 'after': after, 'alignment': NULL},
  {'style_id': 'Caption', 'size': 9.0, 'bold': NULL, 'color': '667085', 'latin': latin, 'east_asia': east, 'before': NULL, 'after': NULL, 'alignment': NULL},
  {'style_id': 'Code', 'size': 9.5, 'bold': NULL, 'color': NULL, 'latin': 'Consolas', 'east_asia': east, 'before': NULL, 'after': NULL, 'alignment': NULL}], recursive := true) FROM p)
SELECT s_suppkey::VARCHAR AS path, style_id, size::DOUBLE AS size, bold, color, latin, east_asia, before::INT AS before, after::INT AS after, alignment FROM supplier JOIN f ON s_suppkey % 4 = k""")
def preset_styles(spark, sf):
    return designs.style_formats(_designed(spark, sf)).drop("ruled", "issue")


@query("""SELECT s_suppkey::VARCHAR AS path, l.* FROM supplier, (VALUES (2, '1', 'bullet', '•', 720, 360), (3, '2', 'decimal', '%1.', 720, 360)) l(ordinal, num_id, format, text, "left", hanging) WHERE s_suppkey % 7 <> 0""")
def list_numbering(spark, sf):
    files = written(_designed(spark, sf))
    items, lists = packages.paragraphs(files).where("num_id IS NOT NULL").select("path", "ordinal", "num_id"), designs.numberings(files)
    return _join(items, lists.select("path", "num_id", "format", "text", "left", "hanging"), "left", ["num_id"])


@query("""WITH o AS (SELECT c_custkey FROM customer)
SELECT c_custkey::VARCHAR AS path, CASE WHEN c_custkey % 11 = 0 THEN 'FONT_REQUIRED' END AS issue, CASE WHEN c_custkey % 11 <> 0 THEN '1.4' END AS version, CASE WHEN c_custkey % 11 <> 0 THEN (1 + c_custkey % 3)::INT END AS pages FROM o""")
def pdf_creation(spark, sf):
    """A file of each customer: a heading, a short table, and page breaks with a paragraph after each."""
    k, nulls = F.col("c_custkey"), F.lit(None)
    heading = F.when(k % 11 == 0, "café").otherwise(F.col("c_name"))
    block = lambda pos, kind, text, headers=nulls, rows=nulls: F.struct(
        F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), text.cast("string").alias("text"), F.lit(1).alias("level"), headers.cast("array<string>").alias("headers"), rows.cast("array<array<string>>").alias("rows")
    )
    cells = F.array(F.lit("(segment)"), F.col("c_mktsegment"))
    start = [block(0, "heading", heading), block(1, "table", nulls, F.array(F.lit("key"), F.lit("value")), F.array(cells, cells))]
    more = [[block(2 + 2 * n, "pageBreak", nulls), block(3 + 2 * n, "paragraph", F.col("c_name"))] for n in range(2)]
    blocks = F.when(k % 3 == 0, F.array(*start)).when(k % 3 == 1, F.array(*start, *more[0])).otherwise(F.array(*start, *more[0], *more[1]))
    files = written(writers_pdf.build_pdfs(table(spark, sf, "customer").select(k.alias("path"), F.explode(blocks).alias("b")).select("path", "b.*")))
    return _join(files.select("path", "issue"), packages.pdf_profile(files).select("path", "version", "pages"), "left")
