"""Decks of suppliers with layouts, masters and themes: colours, inherited boxes and covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decks as by_rows
from ..scratch import written
from ..sources import decks, packages, writers
from .base import query, table

_BROKEN = {5: "theme", 6: "slideMaster", 7: "slideLayout"}


def _deck(k: int, name: str) -> bytes:
    """Three slides on a ground of their own; every eighth deck each has a link that leads nowhere. The boxes of titles come
    from the slide, the layout or the master."""
    colors = {"dk1": f"{k % 4096:06X}", "lt1": "~FFFFFF", "accent1": f"{(k * 7919) % 0xFFFFFF:06X}", "accent2": "00ff7f"}
    grounds = [("scheme", "bg1"), ("scheme", "accent1" if k % 3 else "accent9"), ("rgb", "a0b0c0")]
    title, body = (900_000, 2_400_000, 7_300_000, 1_500_000), (900_000, 4_000_000, 7_300_000, 1_200_000)
    own = [title if k % 4 == 0 else None, body if k % 4 == 1 else None]
    boxes = {"title": (0, 0, 9_000_000, 1_000_000) if k % 4 == 3 else title, "body": body}
    if k % 4 == 2:
        boxes["layout"] = [("ctrTitle", "0", (800_000, 2_500_000, 7_000_000, 1_400_000)), ("body", "1", None)]
    shapes = lambda n: [("ctrTitle", "0", f"{name} {n}", own[0]), ("subTitle", "1", "" if n == 3 else f"sub {n}", own[1]), (None, None, "free", (100, 6_300_000, 500, 600))]
    slides = [{"shapes": shapes(n), "background": g, "names": {"bg1": "accent2"} if k % 5 == 0 and n == 1 else None} for n, g in enumerate(grounds, 1)]
    return decks.deck(slides, colors, {"bg1": "dk1" if k % 2 else "lt1"}, boxes=boxes, broken=_BROKEN.get(k % 8))


def _decks(spark, sf):
    def run(batches):
        return packages.made_files((path, _deck(k, n)) for path, k, n in packages.rows_of(batches, "path", "k", "name"))

    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.cast("string").alias("path"), k.alias("k"), F.col("s_name").alias("name"))
    return packages.spread(rows, "path").mapInArrow(run, "path string, content binary")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS path, s_suppkey % 8 IN (5, 6, 7) AS cut FROM supplier)
SELECT path, 1 AS slide, CASE WHEN NOT cut THEN CASE WHEN k % 5 = 0 THEN '00FF7F' WHEN k % 2 = 1 THEN upper(lpad(printf('%x', k % 4096), 6, '0')) ELSE 'FFFFFF' END END AS rgb FROM s
UNION ALL SELECT path, 2, CASE WHEN NOT cut AND k % 3 <> 0 THEN upper(lpad(printf('%x', (k * 7919) % 16777215), 6, '0')) END FROM s UNION ALL SELECT path, 3, 'A0B0C0' FROM s""")
def deck_backgrounds(spark, sf):
    files = written(_decks(spark, sf))
    return by_rows.background_colors(decks.slide_backgrounds(files), decks.deck_links(files), decks.color_maps(files), decks.theme_colors(files))


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS path, s_name AS name, s_suppkey % 8 IN (6, 7) AS no_master, s_suppkey % 8 = 7 AS no_layout, unnest([1, 2, 3]) AS slide FROM supplier),
t AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'own' WHEN k % 4 = 2 AND NOT no_layout THEN 'layout' WHEN NOT no_master THEN 'master' END AS f FROM s), b AS (SELECT *, CASE WHEN k % 4 = 1 THEN 'own' WHEN NOT no_master THEN 'master' END AS f FROM s)
SELECT path, slide, 0 AS shape, 'ctrTitle' AS holder, name || ' ' || slide AS text, CASE f WHEN 'layout' THEN 800000 WHEN 'own' THEN 900000 WHEN 'master' THEN CASE WHEN k % 4 = 3 THEN 0 ELSE 900000 END END AS x,
  CASE f WHEN 'layout' THEN 2500000 WHEN 'own' THEN 2400000 WHEN 'master' THEN CASE WHEN k % 4 = 3 THEN 0 ELSE 2400000 END END AS y, f AS box_from FROM t
UNION ALL SELECT path, slide, 1, 'subTitle', CASE WHEN slide = 3 THEN '' ELSE 'sub ' || slide END, CASE WHEN f IS NOT NULL THEN 900000 END, CASE WHEN f IS NOT NULL THEN 4000000 END, f FROM b
UNION ALL SELECT path, slide, 2, NULL, 'free', 100, 6300000, 'own' FROM s""")
def placeholder_boxes(spark, sf):
    files = written(_decks(spark, sf))
    return by_rows.inherited_boxes(decks.deck_shapes(files), decks.deck_links(files)).select("path", "slide", "shape", "holder", "text", "x", "y", "box_from")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS path, s_suppkey % 6 = 5 AS bad, s_suppkey % 4 = 3 AND s_suppkey % 8 <> 7 AS high FROM supplier)
SELECT path, CASE WHEN NOT bad THEN unnest(['Cover ground', 'Cover field', 'Cover dot', 'Cover word']) END AS name, CASE WHEN NOT bad THEN unnest([0, 6675120, 7852867, 502920]) END AS x,
  CASE WHEN NOT bad THEN unnest([0, CASE WHEN high THEN 5349240 ELSE 274320 END, CASE WHEN high THEN 5694883 ELSE 619963 END, CASE WHEN high THEN 5760720 ELSE 377190 END]) END AS y, CASE WHEN NOT bad THEN 0 END AS met, CASE WHEN bad THEN 'INVALID_INPUT' END AS issue FROM s WHERE NOT bad
UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'INVALID_INPUT' FROM s WHERE bad""")
def deck_covers(spark, sf):
    """Covers go where the title of the first slide leaves room; met counts the texts that field and word lie on."""
    word = F.when(F.col("path").cast("bigint") % 6 == 5, " ").otherwise(F.concat(F.lit("W"), "path"))
    done = writers.rewrite(_decks(spark, sf).withColumn("wanted", F.array(F.struct(word.alias("word")))), decks.add_cover, "wanted")
    done = written(done)
    # written, as boxes are met with one another: else each side reads all decks again
    boxes = written(by_rows.inherited_boxes(decks.deck_shapes(done.where("issue IS NULL")), decks.deck_links(done.where("issue IS NULL"))).where("slide = 1"))
    new, old = boxes.where("name LIKE 'Cover %'"), boxes.where("name NOT LIKE 'Cover %' AND trim(text) <> '' AND x IS NOT NULL")
    old = old.select("path", *(F.col(c).alias(f"o_{c}") for c in ("x", "y", "width", "height")))
    near = new.where("name IN ('Cover field', 'Cover word')").join(old, "path").where("x < o_x + o_width AND o_x < x + width AND y < o_y + o_height AND o_y < y + height")
    new = new.join(near.groupBy("path").agg(F.count(F.lit(1)).alias("met")), "path", "left").select("path", "name", "x", "y", F.coalesce("met", F.lit(0)).alias("met"))
    return done.select("path", "issue").join(new, "path", "left").select("path", "name", "x", "y", "met", "issue")
