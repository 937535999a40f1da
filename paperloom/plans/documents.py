"""Queries over documents as paragraphs: identity, fingerprints, revisions, ledgers, checks, briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import briefs, identity, integrity, layout, revision, rules
from .base import norm, query, table

PART = "word/document.xml"
LINES = f"""
lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ordinal,
    unnest(string_split(coalesce(text, ''), chr(10))) AS text
  FROM documents
), nodes AS (
  SELECT doc_id, ordinal, text, '/w:document/w:body/w:p[' || (ordinal + 1) || ']' AS path, {norm('text')} AS norm FROM lines
), ids AS (
  SELECT *, left(sha256('{PART}' || chr(0) || 'p' || chr(0) || path), 32) AS semantic_id,
    sha256('p' || chr(0) || norm) AS digest, '{PART}!' || path AS pointer FROM nodes
)"""


def nodes(spark, sf):
    return identity.anchored(identity.paragraphs(table(spark, sf, "documents")))


@query(f"""WITH {LINES} SELECT doc_id, ordinal, semantic_id, digest, pointer, left(norm, 160) AS quote, length(norm) AS norm_chars,
  (path <> '')::INT + (norm <> '')::INT AS selectors, ((path <> '')::INT + (norm <> '')::INT) < 2 AS weak FROM ids""")
def paragraph_identity(spark, sf):
    return nodes(spark, sf).select("doc_id", "ordinal", "semantic_id", "digest", "pointer", "quote", "norm_chars", "selectors", "weak")


@query(f"""WITH {LINES} SELECT digest, doc_id, array_to_string(list_sort(list(DISTINCT semantic_id)), ',') AS ids, count(*) AS n FROM ids GROUP BY digest, doc_id""")
def fingerprint_index(spark, sf):
    found = identity.ids_by_digest(nodes(spark, sf).select("doc_id", "digest", "semantic_id"), ["doc_id"])
    return found.select("digest", "doc_id", F.array_join("ids", ",").alias("ids"), "n")


@query(f"""WITH {LINES}, r AS (SELECT doc_id, semantic_id || chr(0) || digest || chr(0) || chr(0) AS row FROM ids)
SELECT doc_id, sha256('composite-anchor-v1' || chr(1) || string_agg(row, chr(2) ORDER BY row)) AS fingerprint FROM r GROUP BY doc_id""")
def doc_fingerprint(spark, sf):
    facets = nodes(spark, sf).withColumn("style_id", F.lit(None).cast("string")).withColumn("level", F.lit(None).cast("int"))
    return identity.fingerprints(facets, ["doc_id"])


def _versions(spark, sf):
    """Two versions: the second leaves out each 7th paragraph, changes each 5th and gives each 11th a level."""
    base = nodes(spark, sf).withColumn("k", F.pmod(F.col("doc_id") * 31 + F.col("ordinal"), F.lit(385)))
    level = F.when(F.col("k") % 11 == 3, 2)
    style = F.lit(None).cast("string")
    old = base.select("doc_id", "semantic_id", F.lit("p").alias("kind"), "digest", style.alias("style_id"), F.lit(None).cast("int").alias("level"), T.truncate("text").alias("summary"), "pointer", F.col("ordinal").alias("pos"))
    changed = F.when(F.col("k") % 5 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text"))
    new = base.where("k % 7 <> 2").withColumn("text", changed)
    new = new.select("doc_id", "semantic_id", F.lit("p").alias("kind"), T.node_digest(F.lit("p"), "text").alias("digest"), style.alias("style_id"), level.alias("level"), T.truncate("text").alias("summary"), "pointer", F.col("ordinal").alias("pos"))
    return old, new


_CUT = "CASE WHEN length({x}) > 80 THEN left({x}, 80) || '…' ELSE {x} END"


@query(f"""WITH {LINES}, b AS (SELECT *, ((doc_id * 31 + ordinal) % 385) AS k FROM ids),
o AS (SELECT doc_id, semantic_id, digest, NULL::INT AS level, {_CUT.format(x='norm')} AS summary, pointer, ordinal AS pos FROM b),
c AS (SELECT doc_id, semantic_id, CASE WHEN k % 5 = 1 THEN text || ' changed' ELSE text END AS text, CASE WHEN k % 11 = 3 THEN 2 END AS level, pointer, ordinal FROM b WHERE k % 7 <> 2),
d AS (SELECT *, {norm('text')} AS nt FROM c),
n AS (SELECT doc_id, semantic_id, sha256('p' || chr(0) || nt) AS digest, level, {_CUT.format(x='nt')} AS summary, pointer, ordinal AS pos FROM d),
j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.semantic_id, n.semantic_id) AS semantic_id,
  CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
    WHEN o.digest IS DISTINCT FROM n.digest OR o.level IS DISTINCT FROM n.level THEN 'modified' ELSE 'unchanged' END AS change,
  CASE WHEN o.doc_id IS NULL OR n.doc_id IS NULL THEN '' ELSE
    concat_ws(',', CASE WHEN o.digest IS DISTINCT FROM n.digest THEN 'text' END, CASE WHEN o.level IS DISTINCT FROM n.level THEN 'level' END) END AS fields,
  o.summary AS before, n.summary AS after, coalesce(n.pointer, o.pointer) AS pointer, coalesce(n.pos, o.pos) AS pos
  FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id AND o.semantic_id = n.semantic_id)
SELECT * FROM j WHERE change <> 'unchanged'""")
def revision_diff(spark, sf):
    old, new = _versions(spark, sf)
    out = revision.diff(old, new, ["doc_id"])
    return out.select("doc_id", "semantic_id", "change", F.array_join("fields", ",").alias("fields"), "before", "after", "pointer", "pos")


def _intents(spark, sf):
    c = table(spark, sf, "conversations")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("format", "content", "structure", "meta", "unknown")]), (F.pmod(F.length("text") + F.col("turn"), F.lit(5)) + 1).cast("int"))
    stage = F.when(F.col("turn") == 0, "requirement").otherwise("revision")
    return c.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("source"), stage.alias("stage"), kind.alias("kind"), "text")


_INTENTS = """i AS (SELECT conv_id, turn, role AS source, text, CASE WHEN turn = 0 THEN 'requirement' ELSE 'revision' END AS stage,
  (['format', 'content', 'structure', 'meta', 'unknown'])[((length(text) + turn) % 5 + 1)::INT] AS kind FROM conversations)"""


@query("""WITH v AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN sha256(text) END AS version FROM conversations),
n AS (SELECT conv_id, turn, version, row_number() OVER w AS revision,
  last_value(version IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline
  FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT *, version IS NOT NULL AND baseline IS NOT NULL AS compares FROM n""")
def ledger_numbering(spark, sf):
    entries = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", F.sha2("text", 256)).alias("version"))
    return revision.number_entries(entries, ["conv_id"], ["turn"])


@query("SELECT conv_id, max(turn) + 1 AS next_revision FROM conversations GROUP BY conv_id")
def ledger_next(spark, sf):
    return revision.next_revision(table(spark, sf, "conversations").withColumnRenamed("turn", "revision"), ["conv_id"])


@query(f"""WITH {_INTENTS}, s AS (SELECT conv_id, bool_or(kind = 'format' AND stage = 'requirement') AS explicit,
  count(*) FILTER (kind = 'format' AND stage <> 'requirement') AS format_edits FROM i GROUP BY conv_id),
f AS (SELECT *, conv_id % 3 = 0 AS single_shot, conv_id % 5 = 0 AS strict_text FROM s)
SELECT conv_id, explicit, format_edits,
  CASE WHEN NOT (explicit OR strict_text OR format_edits >= 2) THEN 'lite' WHEN single_shot AND NOT explicit THEN 'exempt' ELSE 'strict' END AS mode,
  CASE WHEN NOT (explicit OR strict_text OR format_edits >= 2) THEN 'no-strict-signal' WHEN single_shot AND NOT explicit THEN 'single-shot-exempt'
    WHEN explicit THEN 'explicit-format' WHEN strict_text THEN 'strict-text' ELSE 'format-edit-intention' END AS reason FROM f""")
def governance_mode(spark, sf):
    evidence = revision.signals(_intents(spark, sf), ["conv_id"])
    evidence = evidence.withColumns({"single_shot": F.col("conv_id") % 3 == 0, "strict_text": F.col("conv_id") % 5 == 0, "host_explicit": F.lit(False)})
    return revision.governance(evidence).select("conv_id", "explicit", "format_edits", "mode", "reason")


@query(f"""WITH {_INTENTS} SELECT conv_id, turn, concat_ws(',', CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END,
  CASE WHEN coalesce(source NOT IN ('user', 'agent', 'system'), true) THEN 'source' END) AS problems FROM i
  WHERE trim(coalesce(text, '')) = '' OR coalesce(source NOT IN ('user', 'agent', 'system'), true)""")
def intent_validation(spark, sf):
    return revision.intent_problems(_intents(spark, sf)).select("conv_id", "turn", F.array_join("problems", ",").alias("problems"))


@query("""WITH a AS (SELECT conv_id, turn, [conv_id % 1200, (conv_id * 7 + turn) % 1000, turn] AS refs FROM conversations),
e AS (SELECT conv_id, turn, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM a),
m AS (SELECT e.conv_id, e.turn, arg_min(d.doc_id, e.pos) FILTER (d.doc_id IS NOT NULL) AS block_id
  FROM e LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d ON e.ref = d.doc_id GROUP BY e.conv_id, e.turn)
SELECT conv_id, turn, block_id, block_id IS NULL AS orphan FROM m""")
def annotation_anchor(spark, sf):
    c = table(spark, sf, "conversations")
    notes = c.select("conv_id", F.col("turn").alias("annotation"), F.array(F.col("conv_id") % 1200, (F.col("conv_id") * 7 + F.col("turn")) % 1000, F.col("turn")).alias("refs"))
    notes = notes.withColumn("pointers", F.transform("refs", lambda r: r.cast("string")))
    blocks = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("pointer"), F.col("doc_id").alias("block_id"))
    steps = notes.select("conv_id", "annotation", "pointers")
    found = _anchors(steps, blocks)
    return found.select("conv_id", F.col("annotation").alias("turn"), "block_id", F.col("block_id").isNull().alias("orphan"))


def _anchors(notes, blocks):
    """Annotations of all conversations against one table of blocks: the annotation is the pair of both keys."""
    keyed = notes.select(F.struct("conv_id", "annotation").alias("annotation"), "pointers")
    return integrity.first_anchor(keyed, blocks, []).select("annotation.*", "block_id")


_CHECKS = """c AS (SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS probed, l.toxic > 0 AS toxic, l.quality > 0 AS good,
    CASE d.source WHEN 'src0' THEN true WHEN 'src1' THEN NULL ELSE false END AS allow_toxic, length(d.text) AS n
  FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (
  SELECT doc_id, 'structure' AS check_id, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status, 'error' AS severity FROM c UNION ALL
  SELECT doc_id, 'toxic', CASE WHEN NOT probed OR toxic IS NULL THEN 'skip' WHEN allow_toxic IS NULL THEN 'skip' WHEN NOT toxic OR allow_toxic THEN 'pass' ELSE 'fail' END, 'error' FROM c UNION ALL
  SELECT doc_id, 'quality', CASE WHEN NOT probed OR good IS NULL THEN 'skip' WHEN good THEN 'pass' ELSE 'fail' END, 'warning' FROM c UNION ALL
  SELECT doc_id, 'encryption', CASE WHEN coalesce(NOT toxic, false) THEN 'pass' ELSE 'fail' END, 'warning' FROM c UNION ALL
  SELECT doc_id, 'budget', CASE WHEN n > 20000 THEN 'fail' ELSE 'pass' END, 'error' FROM c)"""


def _checks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.char_length("text").alias("n"))
    labels = table(spark, sf, "labels").select("doc_id", (F.col("toxic") > 0).alias("toxic"), (F.col("quality") > 0).alias("good"), F.lit(True).alias("probed"))
    rows = docs.join(labels, "doc_id", "left")
    allow = F.when(F.col("source") == "src0", True).when(F.col("source") == "src1", None).otherwise(False)
    probed, bad = F.coalesce("probed", F.lit(False)), ~F.col("good")
    return rules.check_rows(
        rows,
        ["doc_id"],
        {
            "structure": (F.when(F.col("n") > 0, "pass").otherwise("fail"), "error"),
            "toxic": (rules.switch_check(probed, F.col("toxic"), allow), "error"),
            "quality": (rules.switch_check(probed, bad, F.lit(False)), "warning"),
            "encryption": (rules.unknown_fails(F.col("toxic"), F.lit(False)), "warning"),
            "budget": (F.when(F.col("n") > 20_000, "fail").otherwise("pass"), "error"),
        },
    )


@query(f"WITH {_CHECKS} SELECT * FROM k")
def policy_checks(spark, sf):
    return _checks(spark, sf)


@query(f"""WITH {_CHECKS} SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed,
  count(*) FILTER (status = 'skip') AS skipped, NOT bool_or(status = 'fail') AS ok, bool_or(status = 'skip') AS partial,
  bool_or(status = 'fail' AND severity = 'error') AS blocking FROM k GROUP BY doc_id""")
def policy_report(spark, sf):
    return rules.report(_checks(spark, sf), ["doc_id"])


@query(f"""WITH {_CHECKS}, r AS (SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'pass') + (CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) AS passed,
  count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skip') AS skipped FROM k GROUP BY doc_id) SELECT doc_id FROM r WHERE doc_id % 10 = 0""")
def report_reconciliation(spark, sf):
    checks = _checks(spark, sf)
    stated = rules.report(checks, ["doc_id"]).withColumn("passed", F.col("passed") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0))
    return rules.report_mismatches(stated, checks, ["doc_id"])


@query("""WITH c AS (SELECT doc_id, lang, least(1.0, round(CASE WHEN length(text) > 0 THEN 0.3 ELSE 0.0 END + CASE WHEN lang = 'en' THEN 0.4 ELSE 0.0 END
  + CASE WHEN source IN ('src0', 'src1') THEN 0.2 ELSE 0.0 END + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0.0 END, 2)) AS confidence FROM documents),
l AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM c WHERE confidence < 0.5)
SELECT lang, doc_id AS node, 1 AS n FROM l WHERE r <= 50 UNION ALL SELECT lang, NULL, count(*) - 50 FROM l GROUP BY lang HAVING count(*) > 50""")
def confidence_floor(spark, sf):
    confidence = rules.format_confidence(F.char_length("text") > 0, F.col("lang") == "en", F.col("source").isin("src0", "src1"), F.col("doc_id") % 2 == 0)
    nodes_ = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("node"), confidence.alias("confidence"))
    return rules.low_confidence(nodes_, ["lang"], ["node"])


@query("""WITH r AS (SELECT source, row_number() OVER w AS position, sum(length(text)) OVER w AS chars, count(*) OVER w AS documents
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT source, position, 'chars' AS limit_name, chars AS value FROM r WHERE chars > 40000 UNION ALL SELECT source, position, 'documents', documents FROM r WHERE documents > 20),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position, limit_name) AS k FROM h)
SELECT source, limit_name, position, value FROM f WHERE k = 1""")
def first_budget_hit(spark, sf):
    items = table(spark, sf, "documents").select("source", "doc_id", F.char_length("text").cast("bigint").alias("chars"), F.lit(1).cast("bigint").alias("one"))
    return rules.first_budget(items, ["source"], ["doc_id"], {"chars": "chars", "documents": "one"}, {"chars": 40_000, "documents": 20})


@query("""WITH t AS (SELECT source, count(*) AS blocks, max(length(text)) AS "entryBytes", sum(length(text)) AS "totalBytes" FROM documents GROUP BY source)
SELECT source, 'blocks' AS budget, blocks AS value, 30 AS most FROM t WHERE blocks > 30 UNION ALL
SELECT source, 'totalBytes', "totalBytes", 120000 FROM t WHERE "totalBytes" > 120000 UNION ALL SELECT source, 'entryBytes', "entryBytes", 12000 FROM t WHERE "entryBytes" > 12000""")
def budget_measures(spark, sf):
    n = F.char_length("text")
    totals = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.max(n).alias("entryBytes"), F.sum(n).alias("totalBytes"))
    return rules.measured_budgets(totals, ["source"], {"blocks": 30, "entryBytes": 12_000, "totalBytes": 120_000})


@query("""WITH g AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'PARSE_FAILED' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'KIND_UNSUPPORTED'
  WHEN length(text) > 15000 THEN 'LIMIT_EXCEEDED' WHEN trim(text) = '' THEN 'EMPTY_DOCUMENT' WHEN source = 'src3' AND lang <> 'en' THEN 'HINT_CONFLICT' END AS code FROM documents)
SELECT coalesce(code, 'OK') AS code, count(*) AS n FROM g GROUP BY 1""")
def usability_gate(spark, sf):
    code = rules.gate(
        ("PARSE_FAILED", F.col("text").isNull()), ("KIND_UNSUPPORTED", ~F.col("lang").isin("en", "de", "fr")), ("LIMIT_EXCEEDED", F.char_length("text") > 15_000),
        ("EMPTY_DOCUMENT", F.trim("text") == ""), ("HINT_CONFLICT", (F.col("source") == "src3") & (F.col("lang") != "en")),
    )
    return table(spark, sf, "documents").groupBy(F.coalesce(code, F.lit("OK")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(CASE WHEN r > 1 AND p IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY user_id, island""")
def island_lists(spark, sf):
    return layout.islands(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query("""SELECT 'left' AS side, source AS key FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 4 < 2 EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'es') UNION ALL
SELECT 'right', source FROM (SELECT DISTINCT source FROM documents WHERE lang = 'es' EXCEPT SELECT DISTINCT source FROM documents WHERE doc_id % 4 < 2)
UNION ALL SELECT 'none', 'row'""")
def subset_check(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("source", "key")
    out = integrity.set_differences(d.where("doc_id % 4 < 2"), d.where("lang = 'es'"), ["key"]).select("side", "key")
    return out.union(spark.range(1).select(F.lit("none"), F.lit("row")))


@query("""WITH e AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents)
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position FROM e WHERE r <= 10""")
def brief_history(spark, sf):
    return briefs.recent(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], "doc_id")


@query(f"""WITH {LINES}, r AS (SELECT doc_id, ordinal, norm, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM ids WHERE norm <> ''),
s AS (SELECT doc_id, rank, total, '[' || rank || '] ' || CASE WHEN length(norm) > 60 THEN left(norm, 60) || '…' ELSE norm END AS line FROM r WHERE rank <= 40),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY rank) || CASE WHEN max(total) > 40 THEN chr(10) || '… ' || (max(total) - 40) || ' more' ELSE '' END AS targets FROM s GROUP BY doc_id)
SELECT d.doc_id, '# title' || chr(10) || coalesce(nullif(d.source, ''), '-') || chr(10) || chr(10) || '# outline' || chr(10) || '-' || chr(10) || chr(10) || '# targets' || chr(10) || coalesce(nullif(g.targets, ''), '-')
  || chr(10) || chr(10) || '# history' || chr(10) || '-' || chr(10) || chr(10) || '# directive' || chr(10) || 'Edit freely; keep the document''s own styles.' AS brief FROM documents d LEFT JOIN g USING (doc_id)""")
def agent_brief(spark, sf):
    some = nodes(spark, sf).where("norm <> ''")
    top = briefs.targets(some, ["doc_id"], ["ordinal"])
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), T.cut(F.col("norm"), T.SNIPPET_CHARS))
    lines = top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("targets"), F.max("of").alias("total"))
    more = F.when(F.col("total") > briefs.TARGETS, F.concat(F.lit("\n… "), (F.col("total") - briefs.TARGETS).cast("string"), F.lit(" more"))).otherwise("")
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title")).join(lines.select("doc_id", F.concat("targets", more).alias("targets")), "doc_id", "left")
    empty = F.lit(None).cast("string")
    return briefs.brief(docs.withColumns({"outline": empty, "history": empty, "directive": F.lit(revision.DIRECTIVES["lite"])}), ["doc_id"])
