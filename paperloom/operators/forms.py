"""Agreement of form fields with the widgets that pages show for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def field_problems(fields: DataFrame, widgets: DataFrame, expected: DataFrame, by: str = "path") -> DataFrame:
    """(by, name, problem) of fields that do not show what is expected (by, name, and value of a text or checked of a box).

    Problems of a field: MISSING, REPEATED, VALUE, NO_WIDGET; of one of its widgets: UNPLACED (on no page), PLACED_TWICE,
    OTHER_NAME (its own parents give another name), UNLINKED (they lead to no field), WIDGET_VALUE, NO_APPEARANCE, STATE;
    and FOREIGN: a page has a widget of this name that the field does not know. A field without a problem gives no row.
    Joins are by file and name, or file and object number; each problem is told once for a field."""
    keys = [by, "name"]
    wanted = expected.select(*keys, F.col("value").alias("want"), F.col("checked").alias("want_checked"))
    is_box = F.col("want_checked").isNotNull()

    def differs(value):
        said = F.coalesce(value, F.lit("Off")) != "Off"
        return F.when(is_box, said != F.col("want_checked")).otherwise(F.coalesce(value, F.lit("")) != F.coalesce("want", F.lit("")))

    known = fields.where("name IS NOT NULL").select(*keys, F.col("value").alias("has"), "kind", "widgets")
    met = wanted.join(known, keys, "left")
    count = F.count("kind").over(Window.partitionBy(*keys))
    met = met.withColumn("n", count)
    of_fields = met.select(
        *keys,
        F.explode(F.array_compact(F.array(
            F.when(F.col("n") == 0, "MISSING"), F.when(F.col("n") > 1, "REPEATED"), F.when((F.col("n") > 0) & differs(F.col("has")), "VALUE"), F.when((F.col("n") > 0) & (F.size("widgets") == 0), "NO_WIDGET"),
        ))).alias("problem"),
    )
    own = met.where("n > 0").select(*keys, "want", "want_checked", F.explode("widgets").alias("object"))
    shown = widgets.where("object IS NOT NULL").select(by, "object", F.col("name").alias("shown_name"), "linked", "value", "state", "appearance_bytes", F.count(F.lit(1)).over(Window.partitionBy(by, "object")).alias("times"))
    placed = own.join(shown, [by, "object"], "left")
    there = F.col("times").isNotNull()
    of_widgets = placed.select(
        *keys,
        F.explode(F.array_compact(F.array(
            F.when(~there, "UNPLACED"), F.when(F.col("times") > 1, "PLACED_TWICE"), F.when(there & ~F.col("shown_name").eqNullSafe(F.col("name")), "OTHER_NAME"), F.when(there & ~F.col("linked"), "UNLINKED"),
            F.when(there & differs(F.col("value")), "WIDGET_VALUE"), F.when(there & (F.coalesce("appearance_bytes", F.lit(0)) == 0), "NO_APPEARANCE"),
            F.when(there & is_box & ((F.coalesce("state", F.lit("Off")) != "Off") != F.col("want_checked")), "STATE"),
        ))).alias("problem"),
    )
    foreign = widgets.where("name IS NOT NULL AND NOT canonical").select(*keys).join(wanted.select(*keys), keys, "left_semi").withColumn("problem", F.lit("FOREIGN"))
    return of_fields.unionByName(of_widgets).unionByName(foreign).distinct()
