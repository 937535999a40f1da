"""Queries over profiles, reference rules, plans and other decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import briefs, integrity, layout, profiles, rules, sheets
from ..sources import packages, writers
from .base import query, table


def _pick(column, values):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(column) % len(values) + 1).cast("int"))


_PARTS = ["xl/charts/chart1.xml", "xl/workbook.xml", "xl/comments2.xml", "xl/tables/t.xml", "customXml/item.xml", "xl/media/i.png", "docProps/core.xml"]


@query("""SELECT p_brand AS path, (['charts', NULL, 'comments', 'tables', 'customXml', 'media', NULL])[(p_partkey % 7 + 1)::INT] AS feature, count(*) AS parts FROM part WHERE p_partkey % 7 NOT IN (1, 6) GROUP BY ALL""")
def sheet_features(spark, sf):
    return profiles.refused_features(table(spark, sf, "part").select(F.col("p_brand").alias("path"), _pick("p_partkey", _PARTS).alias("part")), ["path"])


@query("""SELECT o_custkey AS path, count(*) AS entries, sum(o_orderkey) AS total_bytes, max(o_orderkey) AS largest, bool_or(o_orderkey % 50 = 0) AS encrypted, bool_or(o_orderkey % 3 = 0) AS macros, bool_or(o_orderkey % 3 = 1) AS embedded,
  count(*) FILTER (o_orderkey % 4 = 0) AS external, count(*) AS relationships FROM orders GROUP BY o_custkey""")
def format_profile(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    parts = o.select(F.col("o_custkey").alias("path"), _pick("o_orderkey", ["word/vbaProject.bin", "word/embeddings/e.bin", "word/document.xml"]).alias("part"), k.alias("size_bytes"), (k % 50 == 0).alias("encrypted"))
    rels = o.select(F.col("o_custkey").alias("path"), F.when(k % 4 == 0, "External").otherwise("Internal").alias("target_mode"))
    return profiles.format_profile(parts, rels, ["path"])


@query("""WITH p AS (SELECT DISTINCT o_custkey AS path, (['word/document.xml', '../evil.xml', 'word/vbaProject.bin', '[Content_Types].xml'])[(o_orderkey % 4 + 1)::INT] AS part FROM orders),
w AS (SELECT DISTINCT path, unnest(['word/document.xml', '[Content_Types].xml']) AS part FROM p)
SELECT path, 'unsafe-name' AS violation, part AS item FROM p WHERE part = '../evil.xml' UNION ALL SELECT path, 'active-content', part FROM p WHERE part LIKE '%vba%'
UNION ALL SELECT path, 'missing-part', part FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.path = w.path AND p.part = w.part)
UNION ALL SELECT path, 'dangling-target', 'word/styles.xml' FROM (SELECT DISTINCT path FROM p)""")
def package_violations(spark, sf):
    o = table(spark, sf, "orders")
    parts = o.select(F.col("o_custkey").alias("path"), _pick("o_orderkey", ["word/document.xml", "../evil.xml", "word/vbaProject.bin", "[Content_Types].xml"]).alias("part")).distinct()
    rels = parts.select("path").distinct().select("path", F.lit("Internal").alias("target_mode"), F.lit("word/styles.xml").alias("resolved"))
    return profiles.package_violations(parts, rels, ["path"], ["word/document.xml", "[Content_Types].xml"])


@query("""SELECT l_orderkey, 'part' AS rule, l_partkey::VARCHAR AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL
SELECT l_orderkey, 'supplier', l_suppkey::VARCHAR FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3)""")
def reference_rules(spark, sf):
    l = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("ref"))
    supplier = table(spark, sf, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").alias("ref"))
    return _lost_lines(l, part, supplier)


def _lost_lines(l, part, supplier):
    def lost(name, column, known):
        return l.join(known.select(F.col("ref").alias(column)), column, "left_anti").select("l_orderkey", F.lit(name).alias("rule"), F.col(column).cast("string").alias("ref"))

    return lost("part", "l_partkey", part).union(lost("supplier", "l_suppkey", supplier))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'found') AS label, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, CASE WHEN c_custkey % 5 = 0 THEN 99 END) AS size FROM customer""")
def refined_refs(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    known = c.select("c_custkey", F.when(k % 2 == 0, F.col("c_name")).alias("label"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("size"))
    found = c.select("c_custkey", F.lit("found").alias("label"), F.when(k % 5 == 0, 99).alias("size"))
    return profiles.refined(known, found, ["c_custkey"], ["label", "size"])


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, r_name AS color FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) l LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 6 <> 0) ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def theme_chain(spark, sf):
    start = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_suppkey").alias("key")).distinct()
    hops = [(table(spark, sf, "supplier").where("s_suppkey % 6 <> 0"), "s_suppkey", "s_nationkey"), (table(spark, sf, "nation"), "n_nationkey", "n_regionkey"), (table(spark, sf, "region"), "r_regionkey", "r_name")]
    return profiles.follow(start, hops, "key").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("key").alias("color"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'explicit' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'scenario' ELSE 'legacy' END AS why,
  CASE WHEN c_custkey % 4 = 0 THEN 'formal' WHEN c_mktsegment = 'BUILDING' THEN 'plain' WHEN c_mktsegment = 'MACHINERY' THEN 'technical' ELSE 'legacy' END AS chosen FROM customer""")
def design_choice(spark, sf):
    scenarios = spark.createDataFrame([("BUILDING", "plain"), ("MACHINERY", "technical")], "scenario string, register string")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("scenario"), F.when(F.col("c_custkey") % 4 == 0, "formal").alias("register"))
    return profiles.design(c, scenarios).select("c_custkey", "why", "chosen")


@query("""WITH c AS (SELECT s_nationkey AS component, s_suppkey AS rank, s_name AS path, s_acctbal > 5000 AS found FROM supplier) SELECT component, arg_min(path, rank) FILTER (found) AS path, min(rank) FILTER (found) AS rank FROM c GROUP BY component""")
def runtime_choice(spark, sf):
    c = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("component"), F.col("s_suppkey").alias("rank"), F.col("s_name").alias("path"), (F.col("s_acctbal") > 5000).alias("found"))
    return profiles.first_existing(c, ["component"])


@query("""SELECT doc_id::VARCHAR AS source_id, sha256(coalesce(text, '')) AS source_sha256, '{"kind":"dual","sourceId":"' || doc_id || '","sourceSha256":"' || sha256(coalesce(text, '')) || '","payload":"{\\"lang\\":\\"' || lang || '\\",\\"source\\":\\"' || source || '\\"}"}' AS envelope FROM documents""")
def evidence_envelopes(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("source_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"), "source", "lang")
    return profiles.evidence("dual", rows, ["source", "lang"])


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE '{"a":[' || event_id || ',{"y":null,"z":"é"}],"k":' || (props->>'$.k') || '}' END AS canonical FROM events""")
def canonical_json(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{ "k" : '), k, F.lit(', "a": ['), F.col("event_id").cast("string"), F.lit(', {"z":"é", "y":null}]}'))
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(text).alias("raw"))
    return profiles.canonical_json(e, "raw").select("event_id", "canonical")


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN true END AS inside,
  strlen(text) >= 117 OR strlen(text) - 57 - length(regexp_extract(substr(hex(text), 115), '^(?:[89AB].){0,3}')) // 2 BETWEEN 54 AND 60 AS near_size FROM documents""")
def byte_ranges(spark, sf):
    piece = profiles.byte_range(F.encode("text", "UTF-8"), 57, 60)
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("text").contains(piece).alias("inside"), F.octet_length(piece).between(54, 60).alias("near_size"))


@query("""WITH i AS (SELECT l_orderkey AS doc, l_partkey % 20 || '' AS pointer, l_linenumber AS page FROM lineitem), p AS (SELECT l_orderkey AS doc, max(l_linenumber) - 1 AS pages FROM lineitem GROUP BY 1)
SELECT i.doc, 'page-range' AS rule, pointer FROM i JOIN p USING (doc) WHERE NOT page BETWEEN 1 AND pages UNION ALL SELECT doc, 'pointer-twice', pointer FROM i GROUP BY doc, pointer HAVING count(*) > 1""")
def page_violations(spark, sf):
    l = table(spark, sf, "lineitem")
    ir = l.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 20).cast("string").alias("pointer"), F.col("l_linenumber").alias("page"))
    pages = ir.groupBy("doc").agg((F.max("page") - 1).alias("page"))
    return profiles.page_violations(ir, pages)


@query("""SELECT doc_id, wanted, CASE WHEN contains(coalesce(text, ''), wanted) THEN 'pass' ELSE 'fail' END AS status FROM documents, (SELECT unnest(['the', 'License', 'zzz']) AS wanted)""")
def text_includes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    wanted = d.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("License"), F.lit("zzz"))).alias("wanted"))
    return profiles.text_includes(d, wanted, ["doc_id"])


@query("""WITH r AS (SELECT o_custkey AS doc, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) * (CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END) AS page FROM orders), e AS (SELECT doc, count(*) AS pages FROM r GROUP BY doc)
SELECT doc, CASE WHEN doc % 3 = 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN doc % 3 = 0 THEN 1 END AS missing FROM e""")
def render_pages(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.row_number().over(w) * F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(1)).alias("page"))
    return profiles.complete_pages(r, r.groupBy("doc").agg(F.count(F.lit(1)).alias("pages")), ["doc"])


@query("""SELECT p_partkey AS op, 'size' AS field, p_size::DOUBLE AS value FROM part WHERE p_size NOT BETWEEN 4 AND 40 UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice NOT BETWEEN 900 AND 1500""")
def plan_violations(spark, sf):
    plan = table(spark, sf, "part").select(F.col("p_partkey").alias("op"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return profiles.plan_violations(plan, {"size": (4, 40), "price": (900, 1500)})


@query("""WITH e AS (SELECT l_orderkey AS doc, l_linenumber AS pos, max(l_partkey % 9) AS rank FROM lineitem GROUP BY ALL), t AS (SELECT *, max(rank) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT doc, pos, rank FROM t WHERE top > rank""")
def schema_order(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos")).agg(F.max(F.col("l_partkey") % 9).alias("rank"))
    return profiles.out_of_schema_order(e, ["doc"], "rank", "pos")


@query("""WITH c AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS name, p_size AS base, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size + p_partkey % 5 - 2 END AS asked FROM part),
r AS (SELECT *, asked IS NOT NULL AND (asked > base OR asked < 0) AS refused FROM c) SELECT name, CASE WHEN refused OR asked IS NULL THEN base ELSE asked END AS value, refused FROM r""")
def tightened_limits(spark, sf):
    """Each part has a limit of its size; three of four ask for another one, some for more than it or for less than none."""
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select(k.cast("string").alias("name"), k.alias("k"), F.col("p_size").alias("value"))
    n = F.col("k")
    asked = part.where(n % 4 != 0).select("name", F.when(n % 7 == 0, -1).otherwise(F.col("value") + n % 5 - 2).cast("int").alias("value"))
    return rules.tightened(part, asked)


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'UNSUPPORTED' WHEN 'AUTOMOBILE' THEN 'LIMIT' ELSE 'PARTIALLY_PARSED' END AS code, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'error' ELSE 'warning' END AS severity FROM customer""")
def issue_warnings(spark, sf):
    lookup = spark.createDataFrame([("BUILDING", "UNSUPPORTED", "warning"), ("AUTOMOBILE", "LIMIT", "error")], "issue string, code string, severity string")
    return rules.warnings_of(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("issue")), lookup).select("c_custkey", "code", "severity")


@query("""WITH c AS (SELECT conv_id, turn, sha256(conv_id::VARCHAR) AS sha FROM conversations), s AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'old' ELSE sha END AS sha, 'n' || turn AS semantic_id FROM c WHERE turn % 3 <> 1)
SELECT c.conv_id, count(*) FILTER (s.sha = c.sha) AS matched, count(*) FILTER (s.sha IS DISTINCT FROM c.sha) AS unmatched FROM c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn GROUP BY c.conv_id""")
def bridge_coverage(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pointer"), F.sha2(F.col("conv_id").cast("string"), 256).alias("source_sha"))
    s = c.where("pointer % 3 <> 1").withColumn("source_sha", F.when(F.col("conv_id") % 4 == 0, "old").otherwise(F.col("source_sha"))).withColumn("semantic_id", F.concat(F.lit("n"), "pointer"))
    out = integrity.bridge(c, s, ["conv_id"])
    return out.groupBy("conv_id").agg(F.count("semantic_id").alias("matched"), F.count_if(F.col("semantic_id").isNull()).alias("unmatched"))


@query("""WITH p AS (SELECT conv_id, turn, (turn // 2 + 1) AS tr, length(text) AS n, role FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, tr ORDER BY n DESC, turn DESC) AS k FROM p) SELECT conv_id, 1 AS tbl, tr, 1 AS tc, role AS format FROM r WHERE k = 1""")
def cell_paragraph_formats(spark, sf):
    c = table(spark, sf, "conversations")
    place = F.concat(F.lit("d!/w:tbl[1]/w:tr["), (F.floor(F.col("turn") / 2) + 1).cast("string"), F.lit("]/w:tc[1]/w:p["), (F.col("turn") + 1).cast("string"), F.lit("]"))
    return briefs.longest_by_key(c.select("conv_id", place.alias("pointer"), "text", F.col("role").alias("format")), ["conv_id"])


@query("""WITH e AS (SELECT p_partkey, p_brand AS kind, p_size % 10 AS part FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY kind, part ORDER BY p_partkey) AS k FROM e) SELECT p_partkey, kind, part FROM r WHERE k = 1""")
def embedded_dedupe(spark, sf):
    e = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("kind"), (F.col("p_size") % 10).alias("part"))
    return integrity.first_of(e, ["kind", "part"], ["p_partkey"])


@query("""WITH p AS (SELECT conv_id AS doc, turn + 1 AS page, text FROM conversations)
SELECT doc, max(page) OVER (PARTITION BY doc) + 1 - page AS position, page, sha256(text) AS sha FROM p UNION ALL
SELECT doc, 0, page + max(page) OVER (PARTITION BY doc), sha256(text) FROM p""")
def page_selection(spark, sf):
    p = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), F.sha2("text", 256).alias("sha"))
    last = F.max("page").over(Window.partitionBy("doc"))
    wanted = p.select("doc", (last + 1 - F.col("page")).alias("position"), "page")
    picked = sheets.select_pages(p, wanted, ["doc"]).select("doc", "position", "page", "sha")
    doubled = sheets.append_pages(p, p, ["doc"])
    added = doubled.join(p.groupBy("doc").agg(F.max("page").alias("n")), "doc").where("page > n")
    return picked.union(added.select("doc", F.lit(0).cast("bigint"), "page", "sha"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 100.0 WHEN p_size % 5 = 0 THEN NULL ELSE 660.0 END::DOUBLE AS y0, CASE WHEN p_size % 3 = 0 THEN 140.0 WHEN p_size % 5 = 0 THEN NULL ELSE 700.0 END::DOUBLE AS y1 FROM part""")
def region_flip(spark, sf):
    s = F.col("p_size")
    origin, stated = F.when(s % 3 == 0, "TOPLEFT").otherwise("BOTTOMLEFT"), F.when(s % 5 == 0, 790.0).otherwise(800.4)
    box = layout.top_left(F.lit(100.0), F.lit(140.0), origin, F.lit(800.0), stated)
    return table(spark, sf, "part").select("p_partkey", F.round(box["y0"], 3).alias("y0"), F.round(box["y1"], 3).alias("y1"))


@query("""WITH b AS (SELECT conv_id, turn, (['paragraph', 'heading', 'table', 'image'])[(turn % 4 + 1)::INT] AS kind, CASE WHEN turn % 3 = 0 THEN 'Known' ELSE 'Odd' END AS style, turn % 5 = 0 AS bold, turn % 2 * 4 + 12 AS size FROM conversations)
SELECT conv_id, turn, kind <> 'image' AS carried, CASE WHEN bold THEN CASE WHEN size = 16 THEN 'Title' ELSE 'Heading1' END WHEN style = 'Known' THEN 'Known' ELSE 'Normal' END AS plan_style, greatest(1, least(3, turn)) AS plan_level, round(152.0 / (turn + 1), 1) AS width FROM b""")
def reference_plan(spark, sf):
    t = F.col("turn")
    b = table(spark, sf, "conversations").select(
        "conv_id", "turn", _pick("turn", ["paragraph", "heading", "table", "image"]).alias("kind"), F.when(t % 3 == 0, "Known").otherwise("Odd").alias("style_id"), (t % 5 == 0).alias("all_bold"),
        (t % 2 * 4 + 12).alias("max_size"), F.lit(16).alias("doc_size"), t.cast("double").alias("list_level"),
    )
    plan = briefs.plan_blocks(b, spark.createDataFrame([("Known",)], "style_id string"))
    return plan.select("conv_id", "turn", "carried", "plan_style", "plan_level", briefs.column_widths(F.lit(briefs.TABLE_MM), t + 1).alias("width"))


@query("""SELECT conv_id::VARCHAR AS path, turn + 1 AS slide, 'body' AS placeholder, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS text FROM conversations""")
def deck_runs(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), "turn", F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "").alias("text"))
    decks = packages.spread(c, "path").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))

    def made(path, texts):
        numbers = list(range(1, len(texts) + 1))  # of the parts; half of the decks do not number slides as they show them
        return writers.pptx([[("body", t, None)] for t in texts], numbers[::-1] if path and int(path) % 2 else numbers)

    def run(batches):
        return packages.made_files((path, made(path, texts)) for path, texts in packages.rows_of(batches, "path", "texts"))

    runs = packages.slide_runs(decks.mapInArrow(run, "path string, content binary"))
    return runs.select("path", F.col("slide").cast("bigint").alias("slide"), "placeholder", "text")
