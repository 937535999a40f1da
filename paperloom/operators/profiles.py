"""Format profiles, reference integrity, evidence, design choices and other small decisions over package tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features that spreadsheet writing refuses, by the start of a part's name: fixed values.
SHEET_FEATURES = {
    "charts": "xl/charts/", "drawings": "xl/drawings/", "pivotTables": "xl/pivotTables/", "pivotCache": "xl/pivotCache/", "tables": "xl/tables/", "externalLinks": "xl/externalLinks/",
    "comments": "xl/comments", "threadedComments": "xl/threadedComments/", "slicers": "xl/slicers/", "embeddings": "xl/embeddings/", "media": "xl/media/", "customXml": "customXml/",
}


def refused_features(parts: DataFrame, by: list[str]) -> DataFrame:
    """Features of each workbook whose parts are there: a theta join by prefix with a fixed table of a dozen rows."""
    lookup = parts.sparkSession.createDataFrame(list(SHEET_FEATURES.items()), "feature string, prefix string")
    met = parts.join(F.broadcast(lookup), F.col("part").startswith(F.col("prefix")))
    return met.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("parts"))


def format_profile(parts: DataFrame, relationships: DataFrame, by: list[str]) -> DataFrame:
    """One row a package: entries, bytes, and which features are there."""
    sums = parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("total_bytes"), F.max("size_bytes").alias("largest"), F.bool_or("encrypted").alias("encrypted"),
        F.bool_or(F.lower("part").contains("vbaproject")).alias("macros"), F.bool_or(F.col("part").contains("/embeddings/")).alias("embedded"),
    )
    ext = relationships.groupBy(*by).agg(F.count_if(F.col("target_mode") == "External").alias("external"), F.count(F.lit(1)).alias("relationships"))
    return sums.join(ext, by, "left").fillna(0, ["external", "relationships"])


def package_violations(parts: DataFrame, relationships: DataFrame, by: list[str], required: list[str]) -> DataFrame:
    """(by.., violation, item): unsafe part names, missing required parts, active content, internal targets without a
    part."""
    unsafe = parts.where(F.col("part").rlike(r"(^/|\\|(^|/)\.\.(/|$)|^[A-Za-z]:)")).select(*by, F.lit("unsafe-name").alias("violation"), F.col("part").alias("item"))
    active = parts.where(F.lower("part").rlike("vbaproject|activex/|macrosheets/")).select(*by, F.lit("active-content"), "part")
    wanted = parts.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(r) for r in required])).alias("part"))
    missing = wanted.join(parts, [*by, "part"], "left_anti").select(*by, F.lit("missing-part"), "part")
    lost = relationships.where("target_mode <> 'External'").select(*by, F.col("resolved").alias("part")).join(parts, [*by, "part"], "left_anti").select(*by, F.lit("dangling-target"), "part")
    return unsafe.union(active).union(missing).union(lost)


def reference_violations(rules: list[tuple[str, DataFrame, DataFrame]], keys: list[str], ref: str = "ref") -> DataFrame:
    """A family of anti-joins as one table: (keys.., rule, ref). Each rule is (name, references, targets)."""
    out = None
    for name, refs, targets in rules:
        lost = refs.where(F.col(ref).isNotNull()).join(targets.select(*keys, ref).distinct(), [*keys, ref], "left_anti").select(*keys, F.lit(name).alias("rule"), F.col(ref).cast("string").alias(ref))
        out = lost if out is None else out.union(lost)
    return out


def refined(known: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Known references completed by what was found; what is known stays."""
    right = found.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return known.join(right, keys, "left").select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def follow(start: DataFrame, hops: list[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """A chain of equi-joins: start's column `key` through (table, from, to) hops, null where it breaks."""
    out = start
    for n, (table, source, target) in enumerate(hops):
        step = table.select(F.col(source).alias(key), F.col(target).alias(f"_hop{n}"))
        out = out.join(step, key, "left").drop(key).withColumnRenamed(f"_hop{n}", key)
    return out


def design(requests: DataFrame, scenarios: DataFrame, legacy: str = "legacy") -> DataFrame:
    """The design of each request and why: the named register, else its scenario's rule, else the old default."""
    out = requests.join(scenarios.select("scenario", F.col("register").alias("by_rule")), "scenario", "left")
    why = F.when(F.col("register").isNotNull(), "explicit").when(F.col("by_rule").isNotNull(), "scenario").otherwise("legacy")
    return out.withColumn("why", why).withColumn("chosen", F.coalesce("register", "by_rule", F.lit(legacy))).drop("by_rule")


def first_existing(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The existing candidate of the lowest rank for each component, null if there is none."""
    there = F.when(F.col("found"), F.struct("rank", "path"))
    return candidates.groupBy(*by).agg(F.min(there).alias("hit")).select(*by, F.col("hit.path").alias("path"), F.col("hit.rank").alias("rank"))


def evidence(kind: str, rows: DataFrame, payload: list[str]) -> DataFrame:
    """Envelopes bound to their source: kind, source id and digest, and the payload with its keys in order."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(payload)]))
    return rows.select("source_id", "source_sha256", F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("source_id").alias("sourceId"), F.col("source_sha256").alias("sourceSha256"), body.alias("payload"))).alias("envelope"))


def canonical_json(rows: DataFrame, column: str) -> DataFrame:
    """Add canonical: the JSON of a text column with keys sorted at every depth and no blanks; null if it is not JSON,
    deeper than 80 levels or holds a number that is not finite."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "canonical string"])

    def depth(x) -> int:
        return 1 + max((depth(y) for y in (x.values() if isinstance(x, dict) else x)), default=0) if isinstance(x, (dict, list)) else 0

    def one(text):
        try:
            value = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
            return None if depth(value) > 80 else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except (TypeError, ValueError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([one(t) for t in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "canonical"])

    return rows.mapInArrow(run, schema)


def byte_range(content, start: int, size: int):
    """A range of bytes as text, moved back to whole UTF-8 characters at both ends (column of binary)."""
    piece = F.substring(content, start + 1, size)
    hexed = F.hex(piece)
    # Leading continuation bytes (80-BF) go; a trailing lead byte without its whole character goes.
    head = F.regexp_replace(hexed, "^(?:[89AB][0-9A-F]){1,3}(?=(?:[0-7C-F]|$))", "")
    tail = F.regexp_replace(head, "(?:C[0-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$", "")
    return F.decode(F.unhex(tail), "UTF-8")


def page_violations(ir: DataFrame, pages: DataFrame) -> DataFrame:
    """Integrity of page nodes (doc, pointer, page, source): pages out of range, pointers twice, (doc, rule, pointer)."""
    top = pages.groupBy("doc").agg(F.max("page").alias("pages"))
    out = ir.join(top, "doc", "left").where(~F.col("page").between(1, F.coalesce("pages", F.lit(0)))).select("doc", F.lit("page-range").alias("rule"), "pointer")
    twice = ir.groupBy("doc", "pointer").count().where("count > 1").select("doc", F.lit("pointer-twice"), "pointer")
    return out.union(twice)


def text_includes(texts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Whether each wanted text is in its document's text: pass or fail."""
    out = wanted.join(texts, by, "left")
    return out.select(*by, "wanted", F.when(F.coalesce(F.col("text").contains(F.col("wanted")), F.lit(False)), "pass").otherwise("fail").alias("status"))


def complete_pages(renders: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Renders must be pages 1..n: pass, or fail with the first missing page (a sequence anti-joined with what is there)."""
    want = expected.select(*by, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pages").cast("bigint"))).alias("page"))
    lost = want.join(renders.select(*by, F.col("page").cast("bigint").alias("page")), [*by, "page"], "left_anti").groupBy(*by).agg(F.min("page").alias("missing"))
    return expected.join(lost, by, "left").select(*by, F.when(F.col("missing").isNull(), "pass").otherwise("fail").alias("status"), "missing")


def plan_violations(plan: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values of an edit plan outside their ranges (op, field, value); null values are not asked for."""
    structs = [F.struct(F.lit(k).alias("field"), F.col(k).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in ranges.items()]
    rows = plan.select("op", F.inline(F.array(*structs)))
    return rows.where("value IS NOT NULL AND NOT value BETWEEN lo AND hi").select("op", "field", "value")


def out_of_schema_order(elements: DataFrame, by: list[str], rank: str, position: str) -> DataFrame:
    """Elements that come after one of a higher rank."""
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn("_top", F.max(rank).over(before)).where(F.col("_top") > F.col(rank)).drop("_top")
