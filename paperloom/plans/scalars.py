"""Queries over the scalar functions of names, markup, units and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import briefs, integrity, rules, sheets
from ..sources import packages
from .base import norm, query, table


@query(f"""SELECT doc_id, (CASE WHEN length(s) > 60 THEN left(s, 60) || '…' ELSE s END) AS snippet, (CASE WHEN length(n) > 80 THEN left(n, 80) || '…' ELSE n END) AS summary,
  lower(s) AS match_key, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
  left(regexp_replace(regexp_replace(text || '.docx', '\\.[^.]+$', ''), '[^a-zA-Z0-9_.\\-]+', '_', 'g'), 80) AS stem_chars, regexp_matches(text, '[^\\x09\\x0a\\x0d\\x20-\\x7e]') AS needs_font
  FROM (SELECT doc_id, text, {norm('text')} AS n, {norm('text')} AS s FROM documents)""")
def text_functions(spark, sf):
    d = table(spark, sf, "documents")
    stem = T.stem(F.concat("text", F.lit(".docx")))
    return d.select("doc_id", T.snippet("text").alias("snippet"), T.truncate("text").alias("summary"), T.match_key("text").alias("match_key"), T.xml_escape("text").alias("escaped"), stem.alias("stem_chars"), T.needs_font("text").alias("needs_font"))


_P = "(['heading 1', 'Heading3', ' heading ', '标题 2', 'Heading2 Char', 'Body Text', 'Title', 'heading 12', 'Heading 10', 'Heading Part 7 '])[(p_partkey % 10 + 1)::INT]"


@query(f"""WITH p AS (SELECT p_partkey, {_P} AS name, 'word/_rels/part' || p_partkey || '.xml.rels' AS rels,
  (['media/a.png', '../b.xml', '/c/./d.xml', '../../e.xml', './f/../g.xml'])[(p_partkey % 5 + 1)::INT] AS target,
  (['C:/x/File.DOCX', 'noext', 'a.b/c', 'https://h/x.docx', 'file:///t/x.PDF', 's3://b/k.xlsx', 'ftp://q/z.txt'])[(p_partkey % 7 + 1)::INT] AS uri,
  CASE WHEN p_partkey % 9 = 0 THEN 3 END AS outline FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(lower(name), '^\\s*(heading|标题)\\s*[1-9]?\\s*$') THEN coalesce(nullif(regexp_extract(lower(name), '([1-9]?)\\s*$', 1), '')::INT, 1)
    WHEN regexp_matches(lower(name), '^\\s*(heading|标题).*[0-9]\\s*$') THEN regexp_extract(lower(name), '([0-9]+)\\s*$', 1)::INT END AS level,
  outline IS NOT NULL OR regexp_matches(lower(name), '^\\s*(heading|标题)\\s*[1-9]?\\s*$') AS is_heading,
  'word/part' || p_partkey || '.xml' AS source_part,
  (['word/media/a.png', 'b.xml', 'c/d.xml', 'e.xml', 'word/g.xml'])[(p_partkey % 5 + 1)::INT] AS resolved,
  (['docx', NULL, NULL, 'docx', 'pdf', 'xlsx', 'txt'])[(p_partkey % 7 + 1)::INT] AS ext,
  (['unknown', 'local', 'local', 'refused', 'local', 'refused', 'unknown'])[(p_partkey % 7 + 1)::INT] AS place FROM p""")
def name_functions(spark, sf):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    p = table(spark, sf, "part").select(
        "p_partkey",
        pick(["heading 1", "Heading3", " heading ", "标题 2", "Heading2 Char", "Body Text", "Title", "heading 12", "Heading 10", "Heading Part 7 "]).alias("name"),
        F.concat(F.lit("word/_rels/part"), F.col("p_partkey").cast("string"), F.lit(".xml.rels")).alias("rels"),
        pick(["media/a.png", "../b.xml", "/c/./d.xml", "../../e.xml", "./f/../g.xml"]).alias("target"),
        pick(["CC:/x/File.DOCX", "noext", "a.b/c", "https://h/x.docx", "file:///t/x.PDF", "s3://b/k.xlsx", "ftp://q/z.txt"]).alias("uri"),
        F.when(F.col("p_partkey") % 9 == 0, 3).alias("outline"),
    )
    source = T.relationship_source("rels")
    nothing = F.lit(None).cast("string")
    return p.select(
        "p_partkey", T.name_level(nothing, "name").alias("level"), T.is_heading_style("outline", nothing, "name").alias("is_heading"), source.alias("source_part"),
        T.resolve_target(source, "target").alias("resolved"), T.extension("uri").alias("ext"), T.uri_scheme("uri").alias("place"),
    )


@query("""WITH p AS (SELECT p_partkey, p_size, p_retailprice AS x FROM part)
SELECT p_partkey, floor(x * 20 + 0.5)::BIGINT AS twips, floor(p_size * 2 + 0.5)::BIGINT AS half_points, floor(x * 8 + 0.5)::BIGINT AS eighths, floor(x * 36000 + 0.5)::BIGINT AS emu,
  floor(x * 1440 / 25.4 + 0.5)::BIGINT AS mm_twips, round(x * 12700 / 914400 * 72, 6) AS points, abs(x - round(x)) <= 0.25 AS near, ((p_size * 7 - 200) % 360 + 360) % 360 AS turn,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS number, CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_size END AS number_or, greatest(1, least(9, p_size - 3)) AS level,
  p_size % 5 NOT IN (0, 1, 2) AS is_on, round(CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE / 100 * 10.5 ELSE p_size::DOUBLE / 20 END, 2) AS indent FROM p""")
def unit_functions(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("x"))
    text = F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    switch = F.element_at(F.array(*[F.lit(v) for v in ("0", "false", "OFF", "1", "on")]), F.col("p_size") % 5 + 1)
    chars, twips = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")), F.when(F.col("p_size") % 2 == 1, F.col("p_size").cast("double"))
    return p.select(
        "p_partkey", T.twips("x").alias("twips"), T.half_points("p_size").alias("half_points"), T.eighths("x").alias("eighths"), T.emu_from_mm("x").alias("emu"), T.twips_from_mm("x").alias("mm_twips"),
        F.round(T.points_from_emu(F.col("x") * 12700), 6).alias("points"), T.close_to("x", F.round("x"), 0.25).alias("near"), T.rotation(F.col("p_size") * 7 - 200).alias("turn"), T.int_or(text).alias("number"),
        T.int_or(text, -1).alias("number_or"), T.clamp(F.col("p_size") - 3, 1, 9).alias("level"), T.is_on(switch).alias("is_on"), T.first_line_points(chars, twips, F.lit(10.5)).alias("indent"),
    )


def _channel(k: str) -> str:
    return f"CASE WHEN {k}/255.0::DOUBLE <= 0.04045::DOUBLE THEN {k}/255.0::DOUBLE/12.92::DOUBLE ELSE pow(({k}/255.0::DOUBLE + 0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END"


@query(f"""WITH p AS (SELECT p_partkey, p_size, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 53) % 256 AS b FROM part),
l AS (SELECT *, 0.2126::DOUBLE * ({_channel('r')}) + 0.7152::DOUBLE * ({_channel('g')}) + 0.0722::DOUBLE * ({_channel('b')}) AS y FROM p)
SELECT p_partkey, round(1.05::DOUBLE / (y + 0.05::DOUBLE), 6) AS on_white, CASE WHEN 1.05::DOUBLE / (y + 0.05::DOUBLE) < 4.5 THEN '000000' ELSE printf('%02X%02X%02X', r, g, b) END AS title_color,
  greatest(1, ceil((p_size + 10) * 0.55::DOUBLE * 28.0::DOUBLE / 200.0::DOUBLE)) * 28.0::DOUBLE * 1.2::DOUBLE + 8 <= 80 AS fits,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 AND greatest(1, ceil((p_size + 10) * 0.55::DOUBLE * 28.0::DOUBLE / 200.0::DOUBLE)) * 28.0::DOUBLE * 1.2::DOUBLE + 8 <= 80 THEN least(p_size, 24) ELSE p_size END
    WHEN p_partkey % 3 = 1 THEN least(p_size, 24) ELSE p_size END AS size FROM l""")
def contrast_fit(spark, sf):
    k = F.col("p_partkey")
    hexed = lambda m: F.lpad(F.hex(k * m % 256), 2, "0")
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("#"), hexed(37), hexed(91), hexed(53)).alias("color"))
    white, fits = F.lit("#FFFFFF"), T.lines_fit(F.col("p_size") + 10, F.lit(28.0), F.lit(200.0), F.lit(80.0))
    holder = F.element_at(F.array(F.lit("title"), F.lit("body"), F.lit("footer")), (k % 3 + 1).cast("int"))
    return p.select(
        "p_partkey", F.round(T.contrast_ratio("color", white), 6).alias("on_white"), sheets.title_color(F.col("color"), white).alias("title_color"), fits.alias("fits"),
        sheets.shrunk_size(holder, F.col("p_size"), F.lit(24), F.col("p_size") % 2 == 0, fits).alias("size"),
    )


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
k AS (SELECT page_id, target, (['/hyperlink', '/image', '/oleObject', '/attachedTemplate', '/mailMergeSource', '/frameFile', '/other'])[(length(target) % 7 + 1)::INT] AS kind FROM l)
SELECT page_id, category, count(*) AS n FROM (SELECT page_id, CASE WHEN kind = '/attachedTemplate' THEN 'attachedTemplate' WHEN kind = '/hyperlink' THEN 'hyperlink' WHEN kind = '/image' THEN 'externalImage'
  WHEN kind IN ('/oleObject', '/frameFile') THEN 'externalObject' WHEN kind = '/mailMergeSource' THEN 'dataSource' WHEN starts_with(lower(target), 'dde') THEN 'dde' ELSE 'other' END AS category FROM k) GROUP BY ALL
UNION ALL SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'dde' WHEN page_id % 3 = 1 THEN 'other' ELSE 'hyperlink' END, 1 FROM pages""")
def external_links(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))
    kinds = ["/hyperlink", "/image", "/oleObject", "/attachedTemplate", "/mailMergeSource", "/frameFile", "/other"]
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.char_length("target") % 7 + 1).cast("int"))
    found = links.groupBy("page_id", integrity.external_category(kind, F.col("target")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    odd = F.col("page_id") % 3
    rel, target = F.when(odd == 2, "/hyperlink").otherwise("/other"), F.when(odd == 0, " \t\nDDEAUTO excel").when(odd == 1, "x dde").otherwise("dde")
    return found.unionByName(table(spark, sf, "pages").select("page_id", integrity.external_category(rel, target).alias("category"), F.lit(1).cast("bigint").alias("n")))


@query("""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS plain,
  sha256(regexp_replace(html, '\\s(?:href|class)="[^"]*"', '', 'g')) AS bare_sha FROM pages""")
def markup_functions(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.decode_entities(T.plain_text("html")).alias("plain"), F.sha2(T.without_attributes("html", "href", "class"), 256).alias("bare_sha"))


@query("""WITH p AS (SELECT p_partkey, 'Dear {{name}}, part {{part_' || (p_partkey % 3) || '}} and {{name}}' || ([' {{broken', ' {{ blank }}', ' {{_x}}', ' {{a.b}}', ' }}', ''])[(p_partkey % 6 + 1)::INT] AS t FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\{\\{([A-Za-z][A-Za-z0-9_]{0,63})\\}\\}', 1))), ',') AS names,
  regexp_matches(regexp_replace(t, '\\{\\{[A-Za-z][A-Za-z0-9_]{0,63}\\}\\}', '', 'g'), '\\{\\{|\\}\\}') AS broken FROM p""")
def template_tokens(spark, sf):
    k = F.col("p_partkey")
    ends = F.array(*[F.lit(x) for x in (" {{broken", " {{ blank }}", " {{_x}}", " {{a.b}}", " }}", "")])
    t = F.concat(F.lit("Dear {{name}}, part {{part_"), (k % 3).cast("string"), F.lit("}} and {{name}}"), F.element_at(ends, (k % 6 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.template_names(t), ",").alias("names"), T.has_broken_token(t).alias("broken"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 18278 + 1)::INT AS n FROM part), l AS (SELECT p_partkey, n,
  CASE WHEN n > 702 THEN chr(((n - 703) // 676 + 65)::INT) ELSE '' END || CASE WHEN n > 26 THEN chr(((((n - 27) // 26) % 26) + 65)::INT) ELSE '' END || chr(((n - 1) % 26 + 65)::INT) AS letters FROM p)
SELECT p_partkey, letters, n AS number, n AS col, (p_partkey % 1000 + 1)::INT AS row FROM l""")
def a1_addresses(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", T.column_letters((F.col("p_partkey") % 18278 + 1).cast("int")).alias("letters"))
    col, row = T.address_parts(F.concat("letters", (F.col("p_partkey") % 1000 + 1).cast("string")))
    return p.select("p_partkey", "letters", T.column_number("letters").alias("number"), col.alias("col"), row.alias("row"))


@query("""SELECT s_suppkey, lpad(upper(to_hex(greatest(1, ('0x' || left(sha256(s_name), 8))::BIGINT & 2147483647))), 8, '0') AS para_id,
  (['zip', 'ole', 'rtf', 'pdf', 'unknown'])[(s_suppkey % 5 + 1)::INT] AS container FROM supplier""")
def file_signatures(spark, sf):
    heads = ["504B030414000600", "D0CF11E0A1B11AE1", "7B5C727466310000", "255044462D312E37", "0011223344556677"]
    content = F.unhex(F.element_at(F.array(*[F.lit(x) for x in heads]), (F.col("s_suppkey") % 5 + 1).cast("int")))
    return table(spark, sf, "supplier").select("s_suppkey", T.paragraph_key("s_name").alias("para_id"), packages.container(content).alias("container"))


@query("""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'x' || s_suppkey ELSE (s_suppkey * 7 % 50)::VARCHAR END AS ref, s_nationkey FROM supplier)
SELECT s_suppkey, ref, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 = 0, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 7 % 50 END, ref, s_suppkey) AS position FROM n""")
def note_sort(spark, sf):
    from pyspark.sql import Window

    k = F.col("s_suppkey")
    n = table(spark, sf, "supplier").select("s_suppkey", F.when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise((k * 7 % 50).cast("string")).alias("ref"), "s_nationkey")
    order = Window.partitionBy("s_nationkey").orderBy(briefs.note_order("ref"), "s_suppkey")
    return n.select("s_suppkey", "ref", F.row_number().over(order).alias("position"))


@query("""WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'doc' ELSE 'docx' END AS ext, CASE WHEN c_custkey % 5 = 0 THEN 'text/plain' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'application/word' END AS mime FROM customer)
SELECT c_custkey, CASE WHEN ext <> 'docx' THEN 'hard:extension' WHEN mime <> 'application/word' THEN 'soft:mime' END AS first_conflict, (ext <> 'docx')::INT + coalesce(mime <> 'application/word', false)::INT AS conflicts FROM h""")
def hint_conflicts(spark, sf):
    k = F.col("c_custkey")
    ext, mime = F.when(k % 3 == 0, "doc").otherwise("docx"), F.when(k % 5 == 0, "text/plain").when(k % 7 == 0, None).otherwise("application/word")
    c = table(spark, sf, "customer").select("c_custkey", rules.hint_conflicts(ext, F.lit("docx"), mime, F.lit("application/word")).alias("found"))
    first = F.array_min("found")
    return c.select("c_custkey", F.when(F.size("found") > 0, F.concat_ws(":", first["level"], first["hint"])).alias("first_conflict"), F.size("found").alias("conflicts"))
