"""Queries over grids, references, styles, layout, sheets and manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import briefs, delivery, grid, identity, integrity, layout, revision, rules, sheets
from .base import query, table

_CELLS = """q AS (SELECT l_orderkey AS tbl, l_linenumber AS row, l_quantity, l_extendedprice, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS idx FROM lineitem),
cells AS (SELECT tbl, row, idx, l_linenumber_skip AS grid_before, span, v_merge, text FROM (SELECT tbl, row, idx, (l_partkey % 5 = 0)::INT AS l_linenumber_skip0, 0 AS l_linenumber_skip,
  (l_quantity::BIGINT % 3 + 1)::INT AS span, CASE WHEN l_partkey % 4 = 0 THEN 'continue' WHEN l_partkey % 4 = 1 THEN 'restart' END AS v_merge, l_partkey::VARCHAR AS text FROM q)),
placed AS (SELECT *, grid_before + coalesce(sum(span) OVER (PARTITION BY tbl, row ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_col FROM cells)"""


def _cells(spark, sf):
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    q = table(spark, sf, "lineitem").withColumn("idx", F.row_number().over(one) - 1)
    merge = F.when(F.col("l_partkey") % 4 == 0, "continue").when(F.col("l_partkey") % 4 == 1, "restart")
    return q.select(
        F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("row"), "idx", F.lit(0).alias("grid_before"), (F.col("l_quantity").cast("bigint") % 3 + 1).cast("int").alias("span"),
        merge.alias("v_merge"), F.col("l_partkey").cast("string").alias("text"),
    )


def _placed(spark, sf):
    return grid.placed_cells(_cells(spark, sf), ["tbl"])


@query(f"WITH {_CELLS} SELECT tbl, count(DISTINCT row) AS rows, greatest(4, max(start_col + span)) AS columns FROM placed GROUP BY tbl")
def grid_columns(spark, sf):
    placed = _placed(spark, sf)
    declared = placed.select("tbl").distinct().withColumn("declared", F.lit(4))
    return grid.grid_columns(placed, ["tbl"], declared)


@query(f"""WITH {_CELLS}, e AS (SELECT tbl, row, idx, start_col, v_merge, unnest(range(start_col, start_col + span)) AS col FROM placed),
o AS (SELECT *, last_value(CASE WHEN v_merge IS DISTINCT FROM 'continue' THEN row END IGNORE NULLS) OVER w AS orow, last_value(CASE WHEN v_merge IS DISTINCT FROM 'continue' THEN start_col END IGNORE NULLS) OVER w AS ocol
  FROM e WINDOW w AS (PARTITION BY tbl, col ORDER BY row ROWS UNBOUNDED PRECEDING))
SELECT tbl, row, idx, col, coalesce(orow, row) AS owner_row, coalesce(ocol, start_col) AS owner_col, v_merge = 'continue' AND orow IS NULL AND v_merge IS NOT NULL AS orphan,
  CASE WHEN v_merge = 'continue' AND orow IS NULL THEN 0.4::DOUBLE WHEN v_merge = 'continue' THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM (SELECT tbl, row, idx, col, start_col, coalesce(v_merge, '') AS v_merge, orow, ocol FROM o)""")
def grid_owners(spark, sf):
    return grid.covered(_placed(spark, sf), ["tbl"])


@query(f"""WITH {_CELLS}, g AS (SELECT *, CASE WHEN coalesce(v_merge, '') = 'continue' AND row = lag(row) OVER w + 1 THEN 0 ELSE 1 END AS f FROM placed WINDOW w AS (PARTITION BY tbl, start_col ORDER BY row)),
r AS (SELECT *, sum(f) OVER (PARTITION BY tbl, start_col ORDER BY row ROWS UNBOUNDED PRECEDING) AS run FROM g),
h AS (SELECT tbl, start_col, run, min(row) AS row, arg_min(span, row) AS span, arg_min(coalesce(v_merge, ''), row) AS m, count(*) AS row_span FROM r GROUP BY tbl, start_col, run)
SELECT tbl, row, start_col AS col, span AS col_span, row_span, CASE WHEN span > 1 AND row_span > 1 THEN 'both' WHEN span > 1 THEN 'gridSpan' ELSE 'vMerge' END AS kind FROM h WHERE m <> 'continue' AND (span > 1 OR row_span > 1)""")
def grid_merges(spark, sf):
    return grid.merges(_placed(spark, sf), ["tbl"])


@query(f"""WITH {_CELLS}, d AS (SELECT tbl, string_agg(n::VARCHAR, ',' ORDER BY row) AS shape FROM (SELECT tbl, row, count(*) AS n FROM placed GROUP BY tbl, row) GROUP BY tbl),
c AS (SELECT tbl, max(start_col + span) AS columns FROM placed GROUP BY tbl), s AS (SELECT tbl, string_agg(line, chr(10) ORDER BY row) AS summary FROM (SELECT tbl, row, string_agg(text, chr(9) ORDER BY idx) AS line FROM cells GROUP BY tbl, row) GROUP BY tbl)
SELECT tbl, sha256('table' || chr(0) || columns || chr(0) || shape) AS shape_digest, summary FROM d JOIN c USING (tbl) JOIN s USING (tbl)""")
def grid_digests(spark, sf):
    placed = _placed(spark, sf)
    sizes = grid.grid_columns(placed, ["tbl"]).select("tbl", "columns")
    return grid.shape_digests(placed, ["tbl"], sizes).join(grid.summaries(placed, ["tbl"]), "tbl")


@query(f"""WITH {_CELLS}, w AS (SELECT tbl, row FROM placed GROUP BY tbl, row HAVING max(start_col + span) > 4), u AS (SELECT p.tbl, p.row FROM placed p JOIN placed a ON a.tbl = p.tbl AND a.row = p.row - 1 AND a.start_col = p.start_col WHERE p.v_merge = 'continue' AND p.span <> a.span GROUP BY ALL),
o AS (SELECT tbl, row, v_merge, last_value(CASE WHEN v_merge IS DISTINCT FROM 'continue' THEN row END IGNORE NULLS) OVER (PARTITION BY tbl, col ORDER BY row) AS owner FROM (SELECT *, unnest(range(start_col, start_col + span)) AS col FROM placed))
SELECT DISTINCT tbl, row, 'orphan-continue' AS issue FROM o WHERE v_merge = 'continue' AND owner IS NULL UNION ALL SELECT tbl, row, 'row-wider-than-declared' FROM w UNION ALL SELECT tbl, row, 'width-change' FROM u""")
def grid_issues(spark, sf):
    placed = _placed(spark, sf)
    declared = placed.select("tbl").distinct().withColumn("declared", F.lit(4))
    return grid.merge_issues(placed, ["tbl"], declared)


@query("""WITH lost AS (SELECT DISTINCT o_orderpriority AS kind, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o_custkey) AS k FROM lost)
SELECT kind, o_custkey AS target, 1 AS n FROM r WHERE k <= 20 UNION ALL SELECT kind, NULL, count(*) FROM lost GROUP BY kind""")
def dangling_refs(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("key"))
    customers = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("key"))
    return integrity.dangling(orders, customers, "key", ["kind"])


@query("""SELECT DISTINCT l_suppkey AS doc, p_type AS style_id, CASE WHEN p_size % 2 = 0 THEN 'defined' WHEN p_type LIKE '%BRASS%' THEN 'builtin-undefined' ELSE 'unknown' END AS status FROM
  (SELECT l_suppkey, p_type || (p_size % 10) AS p_type, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def style_inventory(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_type", (F.col("p_size") % 10).cast("string")).alias("style_id"), "p_size", "p_type")
    used = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("doc"), "style_id", "p_size")
    defined = used.where("p_size % 2 = 0").select("doc", "style_id")
    builtin = p.where("p_type LIKE '%BRASS%'").select("style_id")
    return integrity.style_inventory(used, defined, builtin, ["doc"])


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS style_id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS based_on, CASE WHEN p_size > 40 THEN p_size END AS own FROM part),
walk AS (SELECT style_id, based_on AS up, own AS found, 0 AS hops FROM s UNION ALL SELECT w.style_id, s.based_on, s.own, w.hops + 1 FROM walk w JOIN s ON w.up = s.style_id WHERE w.found IS NULL AND w.hops < 24),
f AS (SELECT style_id, arg_min(found, hops) AS outline, min(hops) AS hops FROM walk WHERE found IS NOT NULL GROUP BY style_id)
SELECT s.style_id, f.outline, f.hops FROM s LEFT JOIN f USING (style_id)""")
def style_chain(spark, sf):
    k = F.col("p_partkey")
    s = table(spark, sf, "part").select(k.alias("style_id"), F.when(k > 1, F.floor(k / 2)).alias("based_on"), F.when(F.col("p_size") > 40, F.col("p_size")).alias("outline"))
    return integrity.resolve_chain(s, [], "outline")


@query("""WITH b AS (SELECT s_nationkey, s_suppkey, s_name AS target FROM supplier WHERE s_suppkey % 4 <> 0), a AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' ELSE s_name END AS target FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT coalesce(b.s_nationkey, a.s_nationkey) AS s_nationkey, coalesce(b.s_suppkey, a.s_suppkey) AS s_suppkey, CASE WHEN a.target IS NULL THEN 'dropped' WHEN b.target IS NULL THEN 'added' ELSE 'retargeted' END AS drift, b.target AS old, a.target AS new
FROM b FULL OUTER JOIN a ON a.s_nationkey = b.s_nationkey AND a.s_suppkey = b.s_suppkey WHERE a.target IS DISTINCT FROM b.target""")
def relationship_drift(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.col("s_name").alias("target"))
    changed = F.when(F.col("s_suppkey") % 3 == 0, F.concat("target", F.lit("!"))).otherwise(F.col("target"))
    return integrity.relationship_drift(s.where("s_suppkey % 4 <> 0"), s.where("s_suppkey % 5 <> 0").withColumn("target", changed), ["s_nationkey", "s_suppkey"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_targets(spark, sf):
    return integrity.repeated_targets(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH n AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS node, l_linenumber AS para, l_partkey % 50 AS digest FROM lineitem),
e AS (SELECT o_orderkey AS doc, 1 AS edit, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 END AS para, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 6 + 1 END AS path, o_custkey AS k, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey % 50 END AS digest FROM orders),
a AS (SELECT e.doc, count(*) AS c, min(node) AS node, bool_or(n.digest = e.digest) AS same FROM e JOIN n ON n.doc = e.doc AND n.para = e.para GROUP BY e.doc),
b AS (SELECT e.doc, bool_or(n.digest = e.digest) AS same, min(node) AS node FROM e JOIN n ON n.doc = e.doc AND n.node = e.path GROUP BY e.doc),
s AS (SELECT doc, arg_min(c, level) AS c, arg_min(node, level) AS node FROM (SELECT e.doc, level, count(*) AS c, min(node) AS node FROM e JOIN n ON n.doc = e.doc AND n.digest = e.digest CROSS JOIN (SELECT unnest([0, 1, 2]) AS level)
  WHERE e.path IS NOT NULL AND CASE level WHEN 0 THEN n.para % 3 = e.k % 3 WHEN 1 THEN n.para % 2 = e.k % 2 ELSE true END GROUP BY ALL) GROUP BY doc),
w AS (SELECT e.doc, count(*) AS c, min(node) AS node FROM e JOIN n ON n.doc = e.doc AND n.digest = e.digest WHERE e.path IS NULL GROUP BY e.doc),
r AS (SELECT e.doc, CASE WHEN a.c > 1 THEN 'ambiguous' WHEN a.c = 1 AND NOT coalesce(a.same, false) THEN 'stale' WHEN a.c = 1 THEN 'ok' WHEN b.same THEN 'ok' WHEN e.path IS NOT NULL THEN CASE WHEN s.c = 1 THEN 'ok' WHEN s.c > 1 THEN 'ambiguous' ELSE 'stale' END
    WHEN w.c = 1 THEN 'ok' WHEN w.c > 1 THEN 'ambiguous' ELSE 'not-found' END AS status, CASE WHEN a.c = 1 THEN a.node WHEN b.same THEN b.node WHEN e.path IS NOT NULL THEN s.node ELSE w.node END AS node
  FROM e LEFT JOIN a USING (doc) LEFT JOIN b USING (doc) LEFT JOIN s USING (doc) LEFT JOIN w USING (doc))
SELECT doc, status, CASE WHEN status = 'ok' THEN node END AS node FROM r""")
def edit_targets(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    scopes = lambda k: F.array(F.concat(F.lit("cell "), text(k % 3)), F.concat(F.lit("row "), text(k % 2)), F.lit("table"))
    nodes = table(spark, sf, "lineitem").withColumn("node", F.row_number().over(w))
    nodes = nodes.select(F.col("l_orderkey").alias("doc"), "node", text("l_linenumber").alias("para_id"), text("node").alias("path"), scopes(F.col("l_linenumber")).alias("scopes"), text(F.col("l_partkey") % 50).alias("digest"))
    c = F.col("o_custkey")
    edits = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc"), F.lit(1).alias("edit"), F.when(c % 3 == 0, text(c % 7)).alias("para_id"), F.when(c % 2 == 0, text(c % 6 + 1)).alias("path"), scopes(c).alias("scopes"), F.when(c % 11 != 0, text(c % 50)).alias("digest")
    )
    return integrity.resolve_targets(edits, nodes, ["doc"]).select("doc", "status", "node")


@query("""WITH m AS (SELECT l_orderkey AS doc, l_partkey, l_extendedprice, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_orderkey % 4 END AS wanted FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY l_partkey, l_extendedprice) - 1 AS n, count(*) OVER (PARTITION BY doc) AS c FROM m),
g AS (SELECT doc, max(c) AS of, max(wanted) AS wanted, max(l_partkey) FILTER (n = wanted OR (wanted IS NULL AND n = 0)) AS p, max(l_extendedprice) FILTER (n = wanted OR (wanted IS NULL AND n = 0)) AS x FROM r GROUP BY doc),
s AS (SELECT *, CASE WHEN wanted IS NULL AND of > 1 THEN 'ambiguous' WHEN p IS NULL THEN 'not-found' ELSE 'ok' END AS status FROM g)
SELECT doc, of, status, CASE WHEN status = 'ok' THEN p END AS l_partkey, CASE WHEN status = 'ok' THEN x END AS l_extendedprice FROM s""")
def match_occurrence(spark, sf):
    k = F.col("l_orderkey")
    m = table(spark, sf, "lineitem").select(k.alias("doc"), "l_partkey", "l_extendedprice", F.when(k % 4 != 0, (k % 4).cast("int")).alias("wanted"))
    return integrity.occurrence(m, ["doc"], ["l_partkey", "l_extendedprice"], "wanted")


_BOX = """f AS (SELECT l_orderkey AS doc, l_linenumber AS block, l_suppkey % 4 AS page, l_quantity AS x, l_partkey % 700 AS y, l_discount * 100 AS width, l_tax * 100 AS height, l_partkey, l_extendedprice FROM lineitem)"""


def _fragments(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("doc"), c("l_linenumber").alias("block"), (c("l_suppkey") % 4).alias("page"), c("l_quantity").alias("x"), (c("l_partkey") % 700).alias("y"),
        (c("l_discount") * 100).alias("width"), (c("l_tax") * 100).alias("height"), "l_partkey", "l_extendedprice",
    )


@query(f"""WITH {_BOX}, e AS (SELECT doc, page, min(x) AS l, min(y) AS t, max(x + width) AS r, max(y + height) AS b FROM f GROUP BY doc, page)
SELECT doc, page, round(greatest(0, l), 6) AS margin_left, round(greatest(0, t), 6) AS margin_top, round(greatest(0, 60.0 - r), 6) AS margin_right, round(greatest(0, 800.0 - b), 6) AS margin_bottom, 'portrait' AS orientation FROM e""")
def page_extent(spark, sf):
    f = _fragments(spark, sf)
    extents = layout.page_extents(f, ["doc"])
    pages = extents.select("doc", "page", F.lit(60.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    out = layout.page_infos(pages, extents, ["doc"])
    return out.select("doc", "page", *[F.round(c, 6).alias(c) for c in ("margin_left", "margin_top", "margin_right", "margin_bottom")], "orientation")


@query(f"""WITH {_BOX}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, block ORDER BY page, y, l_partkey, l_extendedprice) AS k FROM f) SELECT doc, block, page, y, l_partkey, l_extendedprice FROM r WHERE k = 1""")
def primary_fragment(spark, sf):
    return layout.primary_fragment(_fragments(spark, sf), ["doc", "block"], ["l_partkey", "l_extendedprice"])


@query(f"""WITH {_BOX} SELECT doc, min(page) AS first_page, max(page) AS last_page, count(DISTINCT page) AS pages, count(DISTINCT page) > 1 AS spans_pages FROM f GROUP BY doc""")
def page_range(spark, sf):
    return layout.page_ranges(_fragments(spark, sf), ["doc"])


@query("""WITH b AS (SELECT p_brand AS slide, p_partkey AS rank, (p_partkey % 90)::DOUBLE AS x0, (p_size * 2)::DOUBLE AS y0, (p_partkey % 90 + p_size % 5 + 1)::DOUBLE AS x1, (p_size * 2 + 4)::DOUBLE AS y1 FROM part)
SELECT c.slide, min(c.rank) AS rank FROM b c WHERE c.rank % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b r WHERE r.rank % 2 = 1 AND r.slide = c.slide AND c.x0 < r.x1 AND r.x0 < c.x1 AND c.y0 < r.y1 AND r.y0 < c.y1) GROUP BY c.slide""")
def box_overlap(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    b = table(spark, sf, "part").select(
        F.col("p_brand").alias("slide"), k.alias("rank"), (k % 90).cast("double").alias("x0"), (s * 2).cast("double").alias("y0"), (k % 90 + s % 5 + 1).cast("double").alias("x1"), (s * 2 + 4).cast("double").alias("y1")
    )
    return layout.free_candidates(b.where("rank % 2 = 0"), b.where("rank % 2 = 1"), ["slide"])


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:10], lambda e: e::DOUBLE) AS m FROM embeddings), c AS (SELECT vec_id, m[1]*m[4]-m[2]*m[3] AS det,
  [m[1]*m[7]+m[3]*m[8]+m[5], m[1]*m[7]+m[3]*m[10]+m[5], m[1]*m[9]+m[3]*m[8]+m[5], m[1]*m[9]+m[3]*m[10]+m[5]] AS xs, [m[2]*m[7]+m[4]*m[8]+m[6], m[2]*m[7]+m[4]*m[10]+m[6], m[2]*m[9]+m[4]*m[8]+m[6], m[2]*m[9]+m[4]*m[10]+m[6]] AS ys FROM v)
SELECT vec_id, round(list_min(xs), 6) AS x0, round(list_min(ys), 6) AS y0, round(list_max(xs), 6) AS x1, round(list_max(ys), 6) AS y1 FROM c WHERE det <> 0""")
def affine_envelope(spark, sf):
    m = [F.element_at("embedding", k).cast("double") for k in range(1, 11)]
    box = layout.affine_box(m[6], m[7], m[8], m[9], m[:6])
    out = table(spark, sf, "embeddings").select("vec_id", box.alias("b")).where("b IS NOT NULL")
    return out.select("vec_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""WITH e AS (SELECT DISTINCT o_custkey AS doc, (o_orderkey % 97)::INT AS end_block, NULL AS x FROM orders), t AS (SELECT doc, end_block, CASE WHEN end_block % 3 = 0 THEN 'continuous' END AS type, CASE WHEN end_block % 4 = 0 THEN 2 END AS num_cols, end_block % 5 AS n_cols FROM e)
SELECT doc, row_number() OVER w AS section, coalesce(lag(end_block) OVER w + 1, 0) AS start_block, end_block, coalesce(type, 'nextPage') AS type, coalesce(nullif(n_cols, 0), num_cols, 1) AS columns FROM t WINDOW w AS (PARTITION BY doc ORDER BY end_block)""")
def section_ranges(spark, sf):
    return layout.sections(_section_ends(spark, sf), ["doc"])


def _section_ends(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 97).cast("int").alias("end_block")).distinct()
    b = F.col("end_block")
    return e.select("doc", "end_block", F.when(b % 3 == 0, "continuous").alias("type"), F.when(b % 4 == 0, 2).alias("num_cols"), (b % 5).alias("n_cols"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS doc, (o_orderkey % 97)::INT AS end_block FROM orders),
s AS (SELECT doc, coalesce(lag(end_block) OVER (PARTITION BY doc ORDER BY end_block) + 1, 0) AS start_block, CASE WHEN end_block % 3 = 0 THEN 'continuous' ELSE 'nextPage' END AS type FROM e),
u AS (SELECT doc, end_block AS block, 'explicit' AS source, end_block::DOUBLE AS key FROM e WHERE end_block % 2 = 0 UNION ALL SELECT doc, start_block, 'section', start_block - 0.5 FROM s WHERE start_block > 0 AND type = 'nextPage')
SELECT doc, block, source, row_number() OVER (PARTITION BY doc ORDER BY key, source) AS position FROM u""")
def break_order(spark, sf):
    ends = _section_ends(spark, sf)
    breaks = ends.where("end_block % 2 = 0").select("doc", F.col("end_block").alias("block"), F.lit("explicit").alias("source"))
    return layout.ordered_breaks(breaks, layout.sections(ends, ["doc"]), ["doc"])


@query("""WITH n AS (SELECT user_id, event_id, floor(value)::BIGINT AS ord FROM events), l AS (SELECT *, lag(ord) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM n) SELECT * FROM l WHERE before > ord""")
def page_order(spark, sf):
    n = table(spark, sf, "events").select("user_id", "event_id", F.floor("value").alias("ord"))
    return layout.out_of_order(n, ["user_id"], "event_id", "ord")


@query("""WITH r AS (SELECT conv_id, turn AS run, length(text) AS chars FROM conversations), s AS (SELECT conv_id, run, coalesce(sum(chars) OVER w, 0) AS a, coalesce(sum(chars) OVER w, 0) + chars AS b FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT DISTINCT conv_id, unnest([1, 2]) AS token FROM conversations), u AS (SELECT conv_id, token, token * 150 AS start, token * 150 + 200 AS stop FROM t)
SELECT u.conv_id, token, min(run) AS first_run, max(run) AS last_run FROM u JOIN s ON u.conv_id = s.conv_id AND start < b AND a < stop GROUP BY u.conv_id, token""")
def text_spans(spark, sf):
    c = table(spark, sf, "conversations")
    runs = c.select("conv_id", F.col("turn").alias("run"), F.char_length("text").alias("chars"))
    tokens = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("token"))
    tokens = tokens.select("conv_id", "token", (F.col("token") * 150).alias("start"), (F.col("token") * 150 + 200).alias("stop"))
    return layout.token_runs(runs, tokens, ["conv_id"])


_SHEET = """c AS (SELECT l_suppkey AS sheet, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1)::INT AS k, l_extendedprice AS value FROM lineitem),
cells AS (SELECT sheet, k // 8 + 1 AS row, k % 8 + 1 AS col, value FROM c WHERE k % 7 <> 3)"""


def _sheet(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    c = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sheet"), (F.row_number().over(w) - 1).alias("k"), F.col("l_extendedprice").alias("value"))
    return c.where("k % 7 <> 3").select("sheet", (F.floor(F.col("k") / 8) + 1).cast("int").alias("row"), (F.col("k") % 8 + 1).alias("col"), "value", F.lit(None).cast("string").alias("formula"))


@query(f"""WITH {_SHEET}, s AS (SELECT DISTINCT sheet FROM cells), g AS (SELECT sheet, r AS row, k AS col FROM s, unnest(range(2, 7)) a(r), unnest(range(2, 6)) b(k))
SELECT g.sheet, g.row, g.col, value, chr((64 + g.col)::INT) || g.row AS address FROM g LEFT JOIN cells USING (sheet, row, col)""")
def range_read(spark, sf):
    cells = _sheet(spark, sf)
    return sheets.read_range(cells, cells.select("sheet").distinct(), ["sheet"], "B2:E6").select("sheet", "row", "col", "value", "address")


@query(f"""WITH {_SHEET}, x AS (SELECT DISTINCT sheet, 1 AS row, 1 AS col, -1.0::DOUBLE AS value FROM cells UNION ALL SELECT DISTINCT sheet, 500, 2, 7.5 FROM cells)
SELECT sheet, row, col, value FROM cells c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.sheet = c.sheet AND x.row = c.row AND x.col = c.col) UNION ALL SELECT * FROM x""")
def cell_upsert(spark, sf):
    cells = _sheet(spark, sf)
    s = cells.select("sheet").distinct()
    changes = s.select("sheet", F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit(-1.0).alias("value")).union(s.select("sheet", F.lit(500), F.lit(2), F.lit(7.5)))
    return sheets.set_cells(cells, changes, ["sheet"]).select("sheet", "row", "col", "value")


@query(f"""WITH {_SHEET} SELECT sheet, max(row) AS rows, max(col) AS columns, count(value) AS populated FROM cells GROUP BY sheet""")
def workbook_summary(spark, sf):
    return sheets.workbook_summary(_sheet(spark, sf), ["sheet"]).select("sheet", "rows", "columns", "populated")


@query(f"""WITH {_SHEET}, f AS (SELECT 'a' AS format, '*' AS s, 1 AS r0, 1 AS c0, 3 AS r1, 3 AS c1 UNION ALL SELECT 'b', '5', 2, 2, 9, 9)
SELECT sheet, row, col, min(format) AS format, count(*) > 1 AS overlaps FROM cells JOIN f ON (s = '*' OR s = sheet::VARCHAR) AND row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY sheet, row, col""")
def cell_formats(spark, sf):
    formats = spark.createDataFrame([("a", "*", 1, 1, 3, 3), ("b", "5", 2, 2, 9, 9)], "format string, sheet string, r0 int, c0 int, r1 int, c1 int")
    return sheets.format_cells(_sheet(spark, sf), formats, ["sheet"])


@query("""WITH m AS (SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, sha256(o_orderkey::VARCHAR) AS sha256 FROM orders),
p AS (SELECT *, CASE WHEN revision % 7 = 5 THEN 'x' ELSE lag(sha256) OVER (PARTITION BY document_id ORDER BY revision) END AS parent FROM m), q AS (SELECT * FROM p WHERE NOT (document_id % 5 = 0 AND revision = 2))
SELECT document_id, revision, CASE WHEN revision = 1 THEN 'ok' WHEN parent IS NULL THEN 'no-parent' WHEN lag(revision) OVER w IS NULL OR lag(revision) OVER w <> revision - 1 THEN 'gap' WHEN lag(sha256) OVER w <> parent THEN 'digest' ELSE 'ok' END AS status FROM q WINDOW w AS (PARTITION BY document_id ORDER BY revision)""")
def manifest_chain(spark, sf):
    return delivery.chain_status(_manifests(spark, sf), ["document_id"]).select("document_id", "revision", "status")


def _manifests(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.row_number().over(w).alias("revision"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    lag = F.lag("sha256").over(Window.partitionBy("document_id").orderBy("revision"))
    m = m.withColumn("parent_sha256", F.when(F.col("revision") % 7 == 5, "x").otherwise(lag))
    return m.where("NOT (document_id % 5 = 0 AND revision = 2)")


@query("""WITH RECURSIVE m AS (SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, sha256(o_orderkey::VARCHAR) AS sha FROM orders),
p AS (SELECT *, CASE WHEN revision % 7 = 5 THEN 'x' ELSE lag(sha) OVER (PARTITION BY document_id ORDER BY revision) END AS parent FROM m), q AS (SELECT * FROM p WHERE NOT (document_id % 5 = 0 AND revision = 2)),
c AS (SELECT document_id, revision, sha, 1 AS depth FROM q WHERE revision = 1 AND parent IS NULL UNION ALL SELECT q.document_id, q.revision, q.sha, c.depth + 1 FROM c JOIN q ON q.parent = c.sha AND q.document_id = c.document_id AND q.revision = c.revision + 1)
SELECT document_id, max(depth) AS depth FROM c GROUP BY document_id""")
def manifest_walk(spark, sf):
    return delivery.walk_chain(_manifests(spark, sf)).groupBy("document_id").agg(F.max("depth").alias("depth"))


@query("""WITH m AS (SELECT c_custkey AS document_id, c_custkey % 4 AS page_count FROM customer), f AS (SELECT o_custkey AS d FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), v AS (SELECT o_custkey AS d, count(DISTINCT o_orderkey % 3) AS seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT document_id, page_count, CASE WHEN f.d IS NOT NULL THEN 'failed' WHEN coalesce(seen, 0) >= page_count THEN 'reviewed' ELSE 'pending' END AS review FROM m LEFT JOIN f ON f.d = document_id LEFT JOIN v ON v.d = document_id""")
def review_state(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "document_id")
    findings = o.where("o_orderpriority = '1-URGENT'").select("document_id", F.lit("error").alias("severity"))
    reviews = o.where("o_orderstatus = 'F'").select("document_id", (F.col("o_orderkey") % 3).alias("page"))
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 4).alias("page_count"))
    return delivery.review_state(findings, reviews, m, every_page=True)


@query("""WITH s AS (SELECT p_partkey AS style_id, p_name AS def FROM part), n AS (SELECT p_partkey * 3 AS style_id, 'new' AS def FROM part)
SELECT style_id, def, false AS new FROM s WHERE style_id NOT IN (SELECT style_id FROM n) UNION ALL SELECT style_id, def, true FROM n""")
def style_merge(spark, sf):
    p = table(spark, sf, "part")
    named = p.select((F.col("p_partkey") * 3).alias("style_id"), F.lit("new").alias("def"))
    return sheets.style_merge(p.select(F.col("p_partkey").alias("style_id"), F.col("p_name").alias("def")), named, ["style_id"])


@query("""WITH b AS (SELECT page_id, generate_subscripts(h, 1) AS pos, unnest(h) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<(h[1-6])[ >]', 1) AS h FROM pages)), l AS (SELECT page_id, pos, right(tag, 1)::INT AS level FROM b)
SELECT a.page_id, a.pos AS position, a.level, max(u.pos) AS parent FROM l a LEFT JOIN (SELECT * FROM l) u ON u.page_id = a.page_id AND u.pos < a.pos AND u.level < a.level GROUP BY ALL""")
def outline_targets(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h[1-6])[ >]"), 1)).alias("pos", "tag"))
    blocks = p.select("page_id", "pos", F.right("tag", F.lit(1)).cast("int").alias("level"))
    return briefs.outline(blocks, ["page_id"], "pos").select("page_id", "position", "level", "parent")


@query("""SELECT page_id, len(regexp_extract_all(html, '<h[1-6][ >]')) AS headings, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, '<a ')) AS links FROM pages""")
def document_counts(spark, sf):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return table(spark, sf, "pages").select("page_id", n("<h[1-6][ >]").alias("headings"), n("<p[ >]").alias("paragraphs"), n("<li[ >]").alias("items"), n("<a ").alias("links"))


@query("""WITH r AS (SELECT conv_id, turn AS pos, role, length(text) AS size, text FROM conversations) SELECT conv_id, first(role ORDER BY length(text) DESC, pos) AS dominant, max(size) AS largest_size FROM r GROUP BY conv_id""")
def dominant_run(spark, sf):
    r = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("run"), "text", F.char_length("text").alias("size"))
    return briefs.dominant_run(r, ["conv_id"])


@query("""WITH k AS (SELECT conv_id, turn, lower(trim(text)) AS key, CASE WHEN turn % 2 = 0 THEN NULL ELSE turn END AS level FROM conversations), m AS (SELECT conv_id, key, arg_min(turn + 100, turn) AS v FROM k WHERE turn % 4 = 0 GROUP BY conv_id, key)
SELECT k.conv_id, k.turn, coalesce(k.level, m.v) AS level, k.level IS NULL AND m.v IS NOT NULL AS filled FROM k LEFT JOIN m USING (conv_id, key)""")
def model_fill(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.lower(F.trim("text")).alias("key"))
    base = c.withColumn("level", F.when(F.col("turn") % 2 != 0, F.col("turn")))
    model = c.where("turn % 4 = 0").select("conv_id", "key", (F.col("turn") + 100).alias("level"), F.col("turn").alias("pos"))
    return integrity.fill_missing(base, model, ["conv_id"], "key", "level").select("conv_id", "turn", "level", "filled")


@query("""SELECT conv_id, string_agg(text || CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END, '' ORDER BY turn) AS page_text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def page_texts(spark, sf):
    items = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), "text", (F.col("turn") % 2 == 0).alias("eol"))
    return layout.page_texts(items, ["conv_id"])


@query("""SELECT o_orderkey, (['new', 'same', 'conflict'])[CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_custkey % 2 = 0 THEN 2 ELSE 3 END] AS outcome FROM orders""")
def publish_outcome(spark, sf):
    o = table(spark, sf, "orders")
    incoming = o.select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    stored = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.sha2(F.col("o_orderkey").cast("string"), 256)).otherwise("other").alias("sha256"))
    return delivery.publish_conflicts(incoming, stored, ["o_orderkey"]).select("o_orderkey", "outcome")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS x FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, x AS expected, CASE WHEN l_linenumber < 5 THEN x + (l_orderkey % 3) * 0.04 END AS observed FROM b
WHERE l_linenumber >= 5 OR abs((l_orderkey % 3) * 0.04) > 0.05""")
def read_back(spark, sf):
    b = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("size"))
    seen = b.where("l_linenumber < 5").withColumn("size", F.col("size") + (F.col("l_orderkey") % 3) * 0.04)
    return sheets.read_back(b, seen, ["l_orderkey", "l_linenumber"], "size", 0.05)


@query("""SELECT l_orderkey, l_linenumber, status, text FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 5 THEN 'missing' WHEN l_orderkey % 2 = 0 THEN 'stale' ELSE 'ok' END AS status,
  CASE WHEN l_linenumber >= 5 THEN NULL WHEN l_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS text FROM lineitem GROUP BY ALL)""")
def run_edits(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    k = table(spark, sf, "lineitem").select(*keys).distinct()
    edits = k.select(*keys, F.when(F.col("l_orderkey") % 2 == 0, "other").otherwise("old").alias("expected"), F.lit("new").alias("replacement"))
    return sheets.replace_runs(k.where("l_linenumber < 5").withColumn("text", F.lit("old")), edits, keys)
