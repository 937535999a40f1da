"""Version diffs, the revision ledger and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Format changes asked for after the first version that make an intention.
STRONG_EDITS = 2
KINDS = ("format", "content", "structure", "meta", "unknown")
STAGES = ("requirement", "revision")
SOURCES = ("user", "agent", "system")


def diff(before: DataFrame, after: DataFrame, by: list[str], include_unchanged: bool = False) -> DataFrame:
    """Changes between two versions' facets (semantic_id, kind, digest, style_id, level, summary, pointer, pos).

    One full outer join on the id: added, removed, modified or unchanged, the fields that differ (text, or structure
    for tables; style; level) and the order of the new place, else the old one, then the id."""
    keys = [*by, "semantic_id"]
    cols = ["kind", "digest", "style_id", "level", "summary", "pointer", "pos"]
    old = before.select(*keys, F.struct(*cols).alias("old"))
    new = after.select(*keys, F.struct(*cols).alias("new"))
    both = old.join(new, keys, "full_outer")
    differs = lambda c: ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    fields = F.array_compact(
        F.array(
            F.when(differs("digest"), F.when(F.col("new.kind") == "tbl", "structure").otherwise("text")),
            F.when(differs("style_id"), "style"),
            F.when(differs("level"), "level"),
        )
    )
    both = both.withColumn("fields", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), fields).otherwise(F.array().cast("array<string>")))
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size("fields") > 0, "modified").otherwise("unchanged")
    )
    pick = lambda c: F.coalesce(f"new.{c}", f"old.{c}").alias(c)
    out = both.select(
        *keys, change.alias("change"), "fields", pick("kind"), F.col("old.summary").alias("before"), F.col("new.summary").alias("after"), pick("pointer"), pick("pos")
    )
    return out if include_unchanged else out.where("change <> 'unchanged'")


def number_entries(entries: DataFrame, by: list[str], order: list[str], first: DataFrame | None = None) -> DataFrame:
    """Ledger numbers: revision follows the last one of its document (first: by.., last_revision), from 1; baseline is
    the last version saved before, null for the first, so a first version has no changes."""
    mine = Window.partitionBy(*by).orderBy(*order)
    before = mine.rowsBetween(Window.unboundedPreceding, -1)
    out = entries.withColumn("revision", F.row_number().over(mine)).withColumn("baseline", F.last("version", ignorenulls=True).over(before))
    if first is not None:
        out = out.join(first, by, "left").withColumn("revision", F.col("revision") + F.coalesce("last_revision", F.lit(0))).drop("last_revision")
    return out.withColumn("compares", F.col("version").isNotNull() & F.col("baseline").isNotNull())


def next_revision(ledger: DataFrame, by: list[str]) -> DataFrame:
    return ledger.groupBy(*by).agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("next_revision"))


def intent_problems(intents: DataFrame) -> DataFrame:
    """Intents with the fields that are not valid: blank ids or text, unknown source, stage or kind."""
    bad = lambda c, ok: F.when(F.coalesce(~F.col(c).isin(*ok), F.lit(True)), c)
    blank = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", c)
    checked = intents.withColumn("problems", F.array_compact(F.array(blank("id"), blank("text"), bad("source", SOURCES), bad("stage", STAGES), bad("kind", KINDS))))
    return checked.where(F.size("problems") > 0)


def signals(intents: DataFrame, by: list[str]) -> DataFrame:
    """Evidence for governance: any format requirement, and format changes after it."""
    return intents.groupBy(*by).agg(
        F.coalesce(F.bool_or((F.col("kind") == "format") & (F.col("stage") == "requirement")), F.lit(False)).alias("explicit"),
        F.count_if((F.col("kind") == "format") & (F.col("stage") != "requirement")).alias("format_edits"),
    )


def governance(evidence: DataFrame) -> DataFrame:
    """mode and reason of rows (explicit, format_edits, single_shot, strict_text, host_explicit).

    Nothing strict is lite; one shot without an up-front format requirement is exempt; else strict, for the first of an
    explicit format, strict text, and repeated format edits."""
    explicit = F.col("explicit") | F.coalesce("host_explicit", F.lit(False))
    strict_text, strong = F.coalesce("strict_text", F.lit(False)), F.col("format_edits") >= STRONG_EDITS
    none = ~(explicit | strict_text | strong)
    single = F.coalesce("single_shot", F.lit(False)) & ~explicit
    mode = F.when(none, "lite").when(single, "exempt").otherwise("strict")
    reason = (
        F.when(none, "no-strict-signal").when(single, "single-shot-exempt").when(explicit, "explicit-format").when(strict_text, "strict-text").otherwise("format-edit-intention")
    )
    return evidence.withColumn("mode", mode).withColumn("reason", reason)


#: What a mode asks of an agent, in our words.
DIRECTIVES = {
    "lite": "Edit freely; keep the document's own styles.",
    "exempt": "One delivery only; formatting rules do not apply to it.",
    "strict": "Follow the formatting requirements and report every change of format.",
}


def with_directive(decisions: DataFrame) -> DataFrame:
    """The directive of each mode, by a lookup of three rows."""
    spark = decisions.sparkSession
    lookup = spark.createDataFrame(list(DIRECTIVES.items()), "mode string, directive string")
    return decisions.join(lookup, "mode", "left")
