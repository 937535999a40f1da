"""Views of whole documents, put together from extracted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import packages

#: Parts of a view that can be turned off.
FLAGS = ("tables", "notes", "parts", "formatting")


def content_view(files: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """One row per package: path, paragraphs (texts in document order), and of the flags that are on: tables (paths,
    sorted), notes (kind and reference, sorted), parts (sorted), formatting (texts of bold runs, in order). What is off is
    not extracted and its column is not there. A package that is refused has empty lists."""
    order = lambda c, key: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(c)))), lambda x: x[c])
    paras = packages.paragraphs(files).withColumn("at", F.monotonically_increasing_id()).where("issue IS NULL")
    views = {"paragraphs": paras.groupBy("path").agg(order("text", "at").alias("paragraphs"))}
    if "tables" in flags:
        views["tables"] = packages.cells(files).where("issue IS NULL").groupBy("path").agg(F.sort_array(F.collect_set("table_path")).alias("tables"))
    if "notes" in flags:
        found = packages.notes(files).where("issue IS NULL").withColumn("note", F.concat_ws(":", "kind", "reference"))
        views["notes"] = found.groupBy("path").agg(F.sort_array(F.collect_set("note")).alias("notes"))
    if "parts" in flags:
        views["parts"] = packages.parts(files).where("issue IS NULL").groupBy("path").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    if "formatting" in flags:
        bold = packages.runs(files).withColumn("at", F.monotonically_increasing_id()).where("issue IS NULL AND bold")
        views["formatting"] = bold.groupBy("path").agg(order("text", "at").alias("formatting"))
    out = files.select("path")
    for name, view in views.items():
        view = view.withColumnRenamed("path", "view_path")
        out = out.join(view, F.col("path").eqNullSafe(F.col("view_path")), "left").drop("view_path")
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
