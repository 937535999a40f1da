"""References, style chains, relationships, targets and other lookups between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

LISTED = 20


def dangling(refs: DataFrame, targets: DataFrame, key: str, by: list[str], listed: int = LISTED) -> DataFrame:
    """References without a target: the first `listed` of each subject in order, and one row (key null) with the total.
    Null references are none. One anti-join on the key."""
    lost = refs.where(F.col(key).isNotNull()).join(targets.select(key).distinct(), key, "left_anti").select(*by, key).distinct()
    ranked = lost.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    head = ranked.where(F.col("rank") <= listed).select(*by, F.col(key).alias("target"), F.lit(1).cast("bigint").alias("n"))
    total = lost.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return head.union(total.select(*by, F.lit(None).cast(lost.schema[key].dataType), "n"))


def style_inventory(used: DataFrame, defined: DataFrame, builtin: DataFrame, by: list[str]) -> DataFrame:
    """Each used style as defined, builtin-undefined or unknown."""
    marks = used.select(*by, "style_id").distinct()
    marks = marks.join(defined.select(*by, "style_id").distinct().withColumn("has", F.lit(True)), [*by, "style_id"], "left")
    marks = marks.join(builtin.select("style_id").distinct().withColumn("known", F.lit(True)), "style_id", "left")
    return marks.select(*by, "style_id", F.when(F.col("has"), "defined").when(F.col("known"), "builtin-undefined").otherwise("unknown").alias("status"))


def resolve_chain(styles: DataFrame, by: list[str], value: str, depth: int = 24, default=None) -> DataFrame:
    """First non-null value along based_on, for each style: by.., style_id, value, hops (how far up; null if none, or if
    it is `default`, the value that ends every chain).

    Each round doubles how far every open style has looked: it takes over what the style that it points at has found, or
    where that one points. So about log2(depth) joins do for all styles, each between written tables. A walk ends at a
    value, at the root or after `depth` steps; cycles end too."""
    own = styles.select(*by, "style_id", F.col("based_on").alias("up"), F.col(value).alias("found"), F.lit(0).alias("hops"), F.lit(1).alias("reach"))
    state = written(own.dropDuplicates([*by, "style_id"]))
    for _ in range((depth - 1).bit_length() + 1):
        open_up = F.col("found").isNull() & F.col("up").isNotNull()
        if not state.where(open_up).limit(1).count():
            break
        ahead = state.select(*by, F.col("style_id").alias("up"), F.col("up").alias("up_2"), F.col("found").alias("found_2"), F.col("hops").alias("hops_2"), F.col("reach").alias("reach_2"))
        met = state.where(open_up).join(ahead, [*by, "up"], "left")
        met = met.select(
            *by, "style_id", F.when(F.col("found_2").isNull(), F.col("up_2")).alias("up"), F.col("found_2").alias("found"),
            (F.col("reach") + F.coalesce("hops_2", F.lit(0))).cast("int").alias("hops"), (F.col("reach") + F.coalesce("reach_2", F.lit(1))).cast("int").alias("reach"),
        )
        state = written(state.where(~open_up).unionByName(met))
    near = F.col("found").isNotNull() & (F.col("hops") <= depth)
    found = F.when(near, F.col("found"))
    return state.select(*by, "style_id", (found if default is None else F.coalesce(found, F.lit(default))).alias(value), F.when(near, F.col("hops")).alias("hops"))


def relationship_drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """External targets of two versions: dropped, retargeted or added."""
    both = before.select(*keys, F.col("target").alias("old")).join(after.select(*keys, F.col("target").alias("new")), keys, "full_outer")
    drift = F.when(F.col("new").isNull(), "dropped").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "retargeted")
    return both.withColumn("drift", drift).where("drift IS NOT NULL").select(*keys, "drift", "old", "new")


def first_anchor(annotations: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The block of the first of an annotation's pointers that is one, null for orphans (annotations: keys..,
    annotation, pointers; blocks: keys.., pointer, block_id)."""
    steps = annotations.select(*keys, "annotation", F.posexplode_outer("pointers").alias("pos", "pointer"))
    met = steps.join(blocks.select(*keys, "pointer", "block_id"), [*keys, "pointer"], "left")
    return met.groupBy(*keys, "annotation").agg(F.min_by("block_id", F.when(F.col("block_id").isNotNull(), F.col("pos"))).alias("block_id"))


def fill_missing(base: DataFrame, model: DataFrame, keys: list[str], match: str, value: str) -> DataFrame:
    """Values of a model's observations where the base has none; of repeated keys the model's first counts."""
    first = model.groupBy(*keys, match).agg(F.min_by(value, "pos").alias("from_model"))
    out = base.join(first, [*keys, match], "left")
    return out.withColumn("filled", F.col(value).isNull() & F.col("from_model").isNotNull()).withColumn(value, F.coalesce(value, "from_model")).drop("from_model")


def bridge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows with the ids that the right knows for their pointers, only between equal sources (source_sha)."""
    known = right.select(*keys, "pointer", F.col("source_sha").alias("right_sha"), "semantic_id")
    out = left.join(known, [*keys, "pointer"], "left")
    return out.withColumn("semantic_id", F.when(F.col("source_sha") == F.col("right_sha"), F.col("semantic_id"))).drop("right_sha")


def resolve_targets(edits: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Find each edit's paragraph (edits: keys.., edit, para_id, path, scopes, digest; nodes: keys.., node, para_id, path,
    scopes, digest), as node and status. Scopes are the containers, the innermost first: cell, row, table, body.

    A native id decides if it is there: several are ambiguous, one must have the digest, else it is stale. Then the path:
    the node there if its digest agrees, else the digest within the scopes in turn, of which the first that has it
    decides. Without a path the digest anywhere. Several by digest are ambiguous, none is stale (with a path) or
    not-found. Each way is one equi-join; a null digest agrees with none."""
    e = edits.select(*keys, "edit", F.lower("para_id").alias("e_para"), F.col("path").alias("e_path"), F.col("scopes").alias("e_scopes"), F.col("digest").alias("e_digest"))
    n = nodes.select(*keys, "node", F.lower("para_id").alias("n_para"), F.col("path").alias("n_path"), F.col("scopes").alias("n_scopes"), F.col("digest").alias("n_digest"))
    same = F.coalesce(F.bool_or(F.col("n_digest") == F.col("e_digest")), F.lit(False))

    def way(left, right, condition, name, also=()):
        on = [F.col(f"e.{k}") == F.col(f"n.{k}") for k in keys]
        met = left.alias("e").join(right.alias("n"), [*on, condition])
        return met.groupBy(*[F.col(f"e.{k}") for k in keys], "edit", *also).agg(
            F.count(F.lit(1)).alias(f"{name}_n"), F.min("node").alias(f"{name}_node"), same.alias(f"{name}_same")
        )

    has_path, by_text = F.col("e_path").isNotNull(), F.col("e_digest") == F.col("n_digest")
    native = way(e.where(F.coalesce(F.col("e_para"), F.lit("")) != ""), n, F.col("e_para") == F.col("n_para"), "para")
    exact = way(e.where(has_path), n, F.col("e_path") == F.col("n_path"), "path")
    inside = e.where(has_path).select("*", F.posexplode("e_scopes").alias("level", "e_scope"))
    containers = n.select("*", F.explode(F.array_distinct("n_scopes")).alias("n_scope"))
    scoped = way(inside, containers, (F.col("e_scope") == F.col("n_scope")) & by_text, "scope", ["level"])
    first = F.min_by(F.struct("scope_n", "scope_node"), "level").alias("first")
    scoped = scoped.groupBy(*keys, "edit").agg(first).select(*keys, "edit", "first.*")
    anywhere = way(e.where(~has_path), n, by_text, "body")
    out = e
    for found in (native, exact, scoped, anywhere):
        out = out.join(found, [*keys, "edit"], "left")
    by_digest = lambda w, none: F.when(F.col(f"{w}_n") == 1, "ok").when(F.col(f"{w}_n") > 1, "ambiguous").otherwise(none)
    status = (
        F.when(F.col("para_n") > 1, "ambiguous")
        .when((F.col("para_n") == 1) & ~F.col("para_same"), "stale")
        .when(F.col("para_n") == 1, "ok")
        .when(F.col("path_same"), "ok")
        .when(has_path, by_digest("scope", "stale"))
        .otherwise(by_digest("body", "not-found"))
    )
    node = F.when(F.col("para_n") == 1, F.col("para_node")).when(F.col("path_same"), F.col("path_node")).when(has_path, F.col("scope_node")).otherwise(F.col("body_node"))
    return out.select(*keys, "edit", status.alias("status"), F.when(status == "ok", node).alias("node"))


def occurrence(matches: DataFrame, by: list[str], order: list[str], wanted: str) -> DataFrame:
    """The wanted match of each subject (0-based; null: the only one), with status ok, ambiguous or not-found."""
    mine = Window.partitionBy(*by)
    ranked = matches.withColumn("n", F.row_number().over(mine.orderBy(*order)) - 1).withColumn("of", F.count(F.lit(1)).over(mine))
    pick = F.col(wanted).eqNullSafe(F.col("n")) | (F.col(wanted).isNull() & (F.col("n") == 0))
    chosen = ranked.groupBy(*by).agg(F.max("of").alias("of"), F.max(wanted).alias(wanted), F.max(F.when(pick, F.struct(*order))).alias("hit"))
    status = F.when(F.col(wanted).isNull() & (F.col("of") > 1), "ambiguous").when(F.col("hit").isNull(), "not-found").otherwise("ok")
    return chosen.select(*by, "of", status.alias("status"), *[F.when(status == "ok", F.col(f"hit.{c}")).alias(c) for c in order])


def repeated_targets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Targets that more than one row names; a partial aggregation precedes the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, as (keys.., side)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows that no change names, and the changes."""
    return existing.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def external_category(rel_type, target):
    """Category of an external relationship: the first rule that its type ends with, or its target starts with."""
    kind, place = F.lower(rel_type), F.lower(F.regexp_replace(target, r"^\s+", ""))
    return (
        F.when(kind.endswith("/attachedtemplate"), "attachedTemplate")
        .when(kind.endswith("/hyperlink"), "hyperlink")
        .when(kind.endswith("/image"), "externalImage")
        .when(kind.endswith("/oleobject") | kind.endswith("/package"), "externalObject")
        .when(kind.contains("mailmerge") | kind.endswith("/datasource"), "dataSource")
        .when(kind.endswith("/framefile"), "externalObject")
        .when(place.startswith("dde"), "dde")
        .otherwise("other")
    )


def embedded_kind(part, content_type):
    """Kind of an embedded part by its folder first, then by its content type; null if it is none."""
    p, c = F.lower(part), F.lower(F.coalesce(content_type, F.lit("")))
    by_type = F.when(c.contains("oleobject"), "oleEmbedding").when(c.contains("shockwave-flash"), "flash").when(c.contains("activex"), "activeX")
    in_folder = (
        F.when(c.contains("oleobject"), "oleEmbedding").when(c.contains("shockwave-flash"), "flash").when(p.endswith(".swf"), "flash").when(p.endswith(".bin"), "oleEmbedding").otherwise("package")
    )
    return F.when(p.contains("/embeddings/"), in_folder).when(p.contains("/activex/"), "activeX").when(p.contains("afchunk") | c.contains("altchunk"), "altChunk").otherwise(by_type)


def macro_indicators(parts: DataFrame, by: list[str]) -> DataFrame:
    """Parts that hold macros: by name, content type or folder; each once."""
    name, kind = F.lower("part"), F.lower(F.coalesce("content_type", F.lit("")))
    how = F.when(name.rlike(r"vba(project|data)\.(bin|xml)$"), "name").when(kind.contains("vbaproject") | kind.contains("macroenabled"), "content-type").when(name.rlike(r"/(macrosheets|dialogsheets)/"), "folder")
    return parts.withColumn("how", how).where("how IS NOT NULL").groupBy(*by, "part").agg(F.min("how").alias("how"))
