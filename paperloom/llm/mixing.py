"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, staged

#: Rows of a source in one slice of its hash range; the slices of a source are summed side by side.
ROWS_PER_SLICE = 4096


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """Add target (double) to sources (sk, source_size): budgets by weight, none above max_epochs times its source.

    Weights go round the sources in the order of sk. What a full source cannot take is shared again by weight among
    the others until none is above its limit: in the order of limit over weight, the sources up to some place are full
    and the level of the others follows from prefix sums. One row per source, so the single ordered window is small.
    """
    ordered = Window.orderBy("sk")
    which = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (which + 1).cast("int"))
    t = sources.select("sk", "source_size", weight.alias("w"))
    everything = Window.partitionBy(F.lit(1))
    filled = everything.orderBy(F.col("cap") / F.col("w"), "sk").rowsBetween(Window.unboundedPreceding, -1)
    rest = everything.orderBy(F.col("cap") / F.col("w"), "sk").rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("cap", max_epochs * F.col("source_size"))
    t = t.withColumn("budget", share * F.sum("source_size").over(everything))
    t = t.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.sum("w").over(rest))
    # The level holds from the first source in this order that it does not fill.
    t = t.withColumn("open", F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "sk", "level"))).over(everything))
    return t.select(
        "sk", F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("open.level"), F.col("cap"))).alias("target")
    )


def _key(id_col: str, text_col: str, seed: str):
    """The random key of a row: the same in every run."""
    known = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(seed), known, F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """How many words of each row the mix takes: id, key, sk, size, source_size, target, taken.

    A row's size is its number of words, null texts have 0. The key is the MD5 of seed, id and the text's MD5, so a
    rerun gives the same mix and the order within a source is random. Sources are sorted by key; the whole source is
    taken floor(target / source size) times and then its rows in that order up to the exact rest of the target, of
    which the last row gives only the words still wanted. A null source is a source of its own, the last; a source
    without words gets target 0; an empty table gives no rows. Equal keys (repeated rows) are ordered by size.

    The sort within a source is a range partition without sampling: keys are uniform, so equal slices of the key range
    hold equal shares of the rows, however large the source is. Prefix sums run in each slice, and slice totals (one
    row per some thousand documents) are summed per source.
    """
    sk = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    key, size = _key(id_col, text_col, seed), word_count(F.col(text_col))
    rows = staged(docs.select(F.col(id_col).alias("id"), sk.alias("sk"), size.alias("size"), key.alias("key")), "sizes")
    sources = staged(
        rows.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources"
    )
    targets = source_targets(sources.select("sk", "source_size"), weights, share, max_epochs)
    slices = F.ceil(F.col("n") / F.lit(float(rows_per_slice)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = staged(
        sources.join(targets, "sk")
        .select("sk", "source_size", "target", slices.alias("slices"), whole.alias("epochs"))
        .withColumn("cut", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5)),
        "plan",
    )
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    placed = rows.join(sources, "sk").withColumn("slice", F.floor(part * F.col("slices")))
    inside = Window.partitionBy("sk", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = staged(placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))), "summed")
    before = Window.partitionBy("sk").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        summed.groupBy("sk", "slice")
        .agg(F.sum("size").alias("total"))
        .select("sk", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    )
    start = F.col("offset") + F.col("inside")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - start))
    return summed.join(offsets, ["sk", "slice"]).select(
        "id", "key", "sk", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for each time that a document is taken.

    The row at the cut of a source keeps its leading words up to the budget, joined by single spaces; if docs has
    n_chars, it follows. Rows of which no word is taken, so all without words, are left out.
    """
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    mine = Window.partitionBy("paperloom_mix_key").orderBy(F.desc("paperloom_mix_taken"))
    plan = staged(
        plan.where("taken > 0")
        .select(F.col("key").alias("paperloom_mix_key"), F.col("size").alias("paperloom_mix_size"), F.col("taken").alias("paperloom_mix_taken"))
        .withColumn("paperloom_mix_row", F.row_number().over(mine)),
        "taken",
    )
    names = docs.columns
    rows = docs.withColumn("paperloom_mix_key", _key(id_col, text_col, seed))
    if plan.where("paperloom_mix_row > 1").limit(1).count():
        # Rows that repeat an id and a text share a key: the first of them take what the plan gives to that key.
        same = Window.partitionBy("paperloom_mix_key").orderBy(*[F.col(c).cast("string") for c in names])
        joined = rows.withColumn("paperloom_mix_row", F.row_number().over(same)).join(plan, ["paperloom_mix_key", "paperloom_mix_row"])
    else:
        joined = rows.join(plan.drop("paperloom_mix_row"), "paperloom_mix_key")
    copies = F.ceil(F.col("paperloom_mix_taken") / F.col("paperloom_mix_size"))
    joined = joined.withColumn("paperloom_mix_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    words = F.least(F.col("paperloom_mix_size"), F.col("paperloom_mix_taken") - (F.col("paperloom_mix_copy") - 1) * F.col("paperloom_mix_size")).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD_PATTERN), 0), F.lit(1), words), " ")
    part = words < F.col("paperloom_mix_size")
    joined = joined.withColumn("paperloom_mix_text", F.when(part, head).otherwise(F.col(text_col)))
    out = {text_col: F.col("paperloom_mix_text")}
    if "n_chars" in names:
        out["n_chars"] = F.when(part, F.char_length("paperloom_mix_text").cast("long")).otherwise(F.col("n_chars"))
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in names])
