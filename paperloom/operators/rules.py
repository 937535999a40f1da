"""Three-valued checks, reports, budgets, gates and confidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Default budgets, fixed values.
BUDGETS = {
    "entries": 4096, "entryBytes": 32 << 20, "totalBytes": 256 << 20, "relationships": 4096,
    "blocks": 50_000, "tableCells": 200_000, "annotations": 10_000, "floats": 20_000, "pages": 5_000,
}
CONFIDENCE_FLOOR, LOW_LISTED = 0.5, 50


def switch_check(probed: Column, present: Column, allowed: Column) -> Column:
    """pass, fail or skip: not probed or not declared is skip, absent or allowed is pass."""
    return (
        F.when(~F.coalesce(probed, F.lit(False)) | present.isNull(), "skip").when(allowed.isNull(), "skip").when(~present | allowed, "pass").otherwise("fail")
    )


def unknown_fails(present: Column, allowed: Column) -> Column:
    """The stricter reading of some formats: an unknown indicator fails where it is forbidden."""
    return F.when(allowed.isNull(), "skip").when(allowed, "pass").when(F.coalesce(~present, F.lit(False)), "pass").otherwise("fail")


def check_rows(rows: DataFrame, keys: list[str], checks: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """A row per subject and check: keys, check_id, status, severity. checks: id to (status, severity of a failure)."""
    structs = [F.struct(F.lit(k).alias("check_id"), status.alias("status"), F.lit(severity).alias("severity")) for k, (status, severity) in checks.items()]
    return rows.select(*keys, F.inline(F.array(*structs)))


def report(checks: DataFrame, keys: list[str], errors_only: bool = False) -> DataFrame:
    """Summary per subject: total, passed, failed, skipped, ok, partial, blocking. ok means no failed check (errors_only:
    none of severity error); partial that some were skipped; blocking that an error failed."""
    failed = F.col("status") == "fail"
    error = failed & (F.col("severity") == "error")
    return checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
        (~F.bool_or(error if errors_only else failed)).alias("ok"),
        F.bool_or(F.col("status") == "skip").alias("partial"),
        F.bool_or(error).alias("blocking"),
    )


def report_mismatches(reports: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """Subjects whose stated summary is not the one that their checks give, or that name a check twice."""
    again = report(checks, keys).select(*keys, *[F.col(c).alias(f"own_{c}") for c in ("total", "passed", "failed", "skipped")])
    wrong = reports.join(again, keys, "full_outer").where(" OR ".join(f"NOT ({c} <=> own_{c})" for c in ("total", "passed", "failed", "skipped"))).select(*keys)
    twice = checks.groupBy(*keys, "check_id").count().where("count > 1").select(*keys)
    return wrong.union(twice).distinct()


def first_budget(items: DataFrame, by: list[str], order: list[str], amounts: Mapping[str, str], limits: Mapping[str, int]) -> DataFrame:
    """The first budget that a subject's items break, in their order: limit_name, position (from 1), value.

    amounts: budget name to the column that is summed up. Budgets broken by the same item count in name order. Items are
    cut into slices of their order, as many as tasks, so a subject with many items is not one task: running sums stay
    within a slice, and the totals of the slices before it are added to them."""
    cols = list(dict.fromkeys(amounts.values()))
    items = items.select(*by, *[c for c in [*order, *cols] if c not in by])
    items = written(items.repartitionByRange(*by, *order).withColumn("slice", F.spark_partition_id()))
    start = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = items.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in cols])
    before = [F.coalesce(F.sum(f"_{c}").over(start), F.lit(0)).alias(f"_before_{c}") for c in ["n", *cols]]
    offsets = totals.select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col("slice").alias("_slice"), *before)
    on = F.col("slice") == F.col("_slice")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    mine = Window.partitionBy(*by, "slice").orderBy(*order)
    running = mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = items.select(*by, "slice", F.row_number().over(mine).alias("_at"), *[F.sum(c).over(running).alias(f"_to_{c}") for c in cols])
    rows = inside.join(offsets, on)
    sums = [F.struct(F.lit(k).alias("limit_name"), (F.coalesce(f"_to_{c}", F.lit(0)) + F.col(f"_before_{c}")).alias("value"), F.lit(limits[k]).alias("most")) for k, c in amounts.items()]
    rows = rows.select(*by, (F.col("_at") + F.col("_before_n")).cast("int").alias("position"), F.inline(F.array(*sums)))
    first = rows.where("value > most").groupBy(*by).agg(F.min(F.struct("position", "limit_name", "value")).alias("hit"))
    return first.select(*by, "hit.limit_name", "hit.position", "hit.value")


def measured_budgets(totals: DataFrame, keys: list[str], limits: Mapping[str, int]) -> DataFrame:
    """Totals (one column a budget) above their limits; a limit of 0 is none."""
    structs = [F.struct(F.lit(k).alias("budget"), F.col(k).cast("bigint").alias("value"), F.lit(m).cast("bigint").alias("most")) for k, m in limits.items()]
    return totals.select(*keys, F.inline(F.array(*structs))).where("most > 0 AND value > most")


def tightened(config: DataFrame, overrides: DataFrame) -> DataFrame:
    """Limits after a call's overrides (name, value), which may only lower them: name, value, refused."""
    joined = config.select("name", F.col("value").alias("base")).join(overrides.select("name", F.col("value").alias("asked")), "name", "left")
    refused = F.coalesce(F.col("asked") > F.col("base"), F.lit(False)) | F.coalesce(F.col("asked") < 0, F.lit(False))
    return joined.select("name", F.when(refused | F.col("asked").isNull(), F.col("base")).otherwise(F.col("asked")).alias("value"), refused.alias("refused"))


def gate(*codes: tuple[str, Column]) -> Column:
    """The first code whose condition holds, in order; null if none does."""
    out = F.when(F.coalesce(codes[0][1], F.lit(False)), codes[0][0])
    for code, condition in codes[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), code)
    return out


def format_confidence(is_zip: Column, is_word: Column, known_variant: Column, extension_agrees: Column) -> Column:
    """0.3 for the container, 0.4 for the kind, 0.2 for the variant, 0.1 for the extension: 2 decimals, 1 at most."""
    part = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(part(is_zip, 0.3) + part(is_word, 0.4) + part(known_variant, 0.2) + part(extension_agrees, 0.1), 2))


def low_confidence(nodes: DataFrame, by: list[str], order: list[str], floor: float = CONFIDENCE_FLOOR, listed: int = LOW_LISTED) -> DataFrame:
    """Nodes below the floor: the first `listed` of each subject, and a summary row (node null) of how many more."""
    low = nodes.where(F.col("confidence") < floor)
    numbered = low.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    head = numbered.where(F.col("rank") <= listed).select(*by, F.col("node"), F.lit(1).cast("bigint").alias("n"))
    rest = low.groupBy(*by).agg((F.count(F.lit(1)) - listed).alias("n")).where("n > 0").select(*by, F.lit(None).cast(low.schema["node"].dataType).alias("node"), "n")
    return head.union(rest)


def warnings_of(issues: DataFrame, lookup: DataFrame, default: tuple[str, str] = ("PARTIALLY_PARSED", "warning")) -> DataFrame:
    """Warning code and severity of each issue code, the default for unknown ones; the lookup is a fixed small table."""
    known = lookup.select("issue", "code", "severity")
    out = issues.join(known, "issue", "left")
    return out.withColumn("code", F.coalesce("code", F.lit(default[0]))).withColumn("severity", F.coalesce("severity", F.lit(default[1])))


def hint_conflicts(declared_ext: Column, detected_ext: Column, declared_mime: Column, detected_mime: Column) -> Column:
    """Array of (rank, level, hint): a declared extension of another kind is a hard conflict, a media type a soft one."""
    hard = F.when(declared_ext.isNotNull() & (declared_ext != detected_ext), F.struct(F.lit(1).alias("rank"), F.lit("hard").alias("level"), F.lit("extension").alias("hint")))
    soft = F.when(declared_mime.isNotNull() & (declared_mime != detected_mime), F.struct(F.lit(2).alias("rank"), F.lit("soft").alias("level"), F.lit("mime").alias("hint")))
    return F.array_compact(F.array(hard, soft))
