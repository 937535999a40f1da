"""Decks as tables: colours through the chain of slide, layout, master and theme, and boxes that placeholders inherit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def background_colors(backgrounds: DataFrame, links: DataFrame, maps: DataFrame, colors: DataFrame) -> DataFrame:
    """(path, slide, rgb) of own backgrounds. A colour's name goes through the map of its slide, else of its layout, else
    of its master, a name that no map has stands for itself; null where a link of the chain breaks or no theme has it."""
    named = backgrounds.where("issue IS NULL").select("path", "slide", "fill", "value")
    named = named.join(links.select("path", "slide", "slide_part", "layout_part", "master_part", "theme_part"), ["path", "slide"], "left")
    for level in ("slide", "layout", "master"):
        own = maps.select("path", F.col("map_part").alias(f"{level}_part"), F.col("alias").alias("value"), F.col("name").alias(f"by_{level}"))
        named = named.join(own, ["path", f"{level}_part", "value"], "left")
    named = named.withColumn("name", F.coalesce("by_slide", "by_layout", "by_master", "value"))
    found = named.join(colors.select("path", "theme_part", "name", F.col("rgb").alias("theme_rgb")), ["path", "theme_part", "name"], "left")
    rgb = F.when(F.col("fill") == "rgb", F.upper("value")).when(F.col("master_part").isNotNull(), F.col("theme_rgb"))
    return found.select("path", "slide", rgb.alias("rgb"))


def inherited_boxes(shapes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, slide, shape, name, holder, text, x, y, width, height, box_from) of the shapes of slides: their own box, else
    that of the layout's placeholder of the same index, else of the master's of the same type (which that of the layout's
    placeholder is, if there is one; centred titles lean on titles, subtitles and objects on bodies)."""
    box = ["x", "y", "width", "height"]
    frame = lambda: F.when(F.col("x").isNotNull(), F.struct(*box))
    shapes = shapes.where("issue IS NULL").withColumn("frame", frame())
    own = shapes.join(links.select("path", "slide", F.col("slide_part").alias("shape_part"), "layout_part", "master_part"), ["path", "shape_part"])
    # of placeholders with the same index or type on one part, the first counts
    first = lambda rows, keys, name, more=(): rows.where("holder IS NOT NULL").groupBy(*keys).agg(F.min_by("frame", "shape").alias(name), *more)
    on_layout = first(shapes.withColumnRenamed("shape_part", "layout_part"), ["path", "layout_part", "idx"], "layout_frame", [F.min_by("holder", "shape").alias("layout_holder")])
    own = own.join(on_layout, ["path", "layout_part", "idx"], "left")
    kind = F.coalesce("layout_holder", "holder")
    own = own.withColumn("kind", kind).withColumn("base", F.when(kind == "ctrTitle", "title").when(kind.isin("subTitle", "obj"), "body").otherwise(kind))
    on_master = first(shapes.withColumnRenamed("shape_part", "master_part"), ["path", "master_part", "holder"], "master_frame")
    for key, name in (("kind", "kind_frame"), ("base", "base_frame")):
        own = own.join(on_master.withColumnsRenamed({"holder": key, "master_frame": name}), ["path", "master_part", key], "left")
    is_holder = F.col("holder").isNotNull()
    found = F.coalesce("frame", F.when(is_holder, F.coalesce("layout_frame", "kind_frame", "base_frame")))
    origin = F.when(F.col("frame").isNotNull(), "own").when(is_holder & F.col("layout_frame").isNotNull(), "layout").when(is_holder & F.coalesce("kind_frame", "base_frame").isNotNull(), "master")
    return own.select("path", "slide", "shape", "name", "holder", "text", *(found.getField(c).alias(c) for c in box), origin.alias("box_from"))
