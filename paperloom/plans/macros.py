"""Macro code of documents: a package of each document whose macro project has the document's lines as comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import macros, packages, writers
from .base import query, table

_ODD = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _package(code: str, kind: int) -> bytes:
    """A package with two modules; by kind the project is cut, its sectors lead back to the first, or it is no project."""
    project = macros.vba_project({"Main": code, "Empty": ""})
    if kind == 3:
        project = project[: len(project) // 2]
    elif kind == 4:  # the entry of the directory's first sector names that sector
        table = 512 + 512 * int.from_bytes(project[76:80], "little")
        first = int.from_bytes(project[48:52], "little")
        project = project[: table + 4 * first] + first.to_bytes(4, "little") + project[table + 4 * first + 4 :]
    elif kind == 5:
        project = b"no project"
    return writers.packed({"[Content_Types].xml": "<Types/>", "word/vbaProject.bin": project})


def _texts(spark, sf):
    """Documents dealt over all cores before their texts are worked on, whatever pieces their table comes in."""
    return packages.spread(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text"), "path")


def _files(spark, sf):
    k = F.col("doc_id")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), _ODD, "")
    comments = F.concat(F.lit("' "), F.regexp_replace(clean, r"[\n\r\x{0085}\x{2028}\x{2029}]+", "\r\n' "))
    line = lambda every, words: F.when(k % every == 0, F.lit(f"  {words}\r\n")).otherwise(F.lit(""))
    head = F.concat(F.lit("Sub "), F.when(k % 3 == 0, F.lit("autoOPEN")).otherwise(F.lit("Later")), F.lit('()\r\n  x = "Kill ""all"" \' Shell" \' CreateObject\r\n'))
    code = F.concat(head, line(4, 'Open "f" For _\r\n  Output As #1'), line(5, 'y = shell("cmd")'), F.lit("End Sub\r\n"), comments)
    kind = F.coalesce(k % 11, F.lit(0)).cast("int").alias("kind")

    def run(batches):
        return packages.made_files((path, _package(c, n)) for path, c, n in packages.rows_of(batches, "path", "code", "kind"))

    return _texts(spark, sf).select("path", code.alias("code"), kind).mapInArrow(run, "path string, content binary")


@query("""WITH d AS (SELECT doc_id AS k, doc_id::VARCHAR AS path, coalesce(doc_id % 11, 0) IN (3, 4, 5) AS bad, coalesce(doc_id % 3 = 0, false) AS a, coalesce(doc_id % 4 = 0, false) AS w, coalesce(doc_id % 5 = 0, false) AS x FROM documents), m AS (SELECT *, unnest(CASE WHEN bad THEN [NULL] ELSE ['Main', 'Empty'] END) AS module FROM d)
SELECT path, module, CASE WHEN module IS NOT NULL THEN module = 'Main' AND a END AS auto_exec, CASE WHEN module IS NOT NULL THEN module = 'Main' AND w END AS writes, CASE WHEN module IS NOT NULL THEN module = 'Main' AND x END AS executes,
  CASE WHEN module IS NOT NULL THEN module = 'Main' AND a AND (w OR x) END AS suspicious, CASE WHEN module = 'Main' THEN concat_ws(',', CASE WHEN a THEN 'autoopen' END, CASE WHEN x THEN 'shell' END) WHEN module = 'Empty' THEN '' END AS words,
  CASE k % 11 WHEN 3 THEN 'OLE_CHAIN' WHEN 4 THEN 'OLE_CHAIN' WHEN 5 THEN 'OLE_UNREADABLE' END AS part_issue FROM m""")
def macro_code(spark, sf):
    """Words in comments and in quotes tell nothing; bad projects are rows with an issue."""
    seen = macros.macro_verdicts(macros.macro_modules(_files(spark, sf)))
    return seen.select("path", "module", "auto_exec", "writes", "executes", "suspicious", F.array_join("words", ",").alias("words"), "part_issue")


@query("""SELECT doc_id::VARCHAR AS path, length(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[^\\x20-\\x7e]', '', 'g')) AS letters FROM documents WHERE coalesce(doc_id % 11, 0) NOT IN (3, 4, 5)""")
def macro_comments(spark, sf):
    """The printable ASCII characters of the comments come back whole, but for the marks of the comments."""
    main = macros.macro_modules(_files(spark, sf)).where("module = 'Main'")
    text = F.substring_index("code", "End Sub\r\n", -1)
    said = F.regexp_replace(F.regexp_replace(text, r"(?m)^' ", ""), r"\r\n", "")
    # a question mark stands for what the code page does not have; those of the text itself are told from it by the source
    return main.select("path", said.alias("said")).join(_letters(spark, sf), "path").select("path", (F.char_length(F.regexp_replace("said", r"[^\x20-\x7e]+", "")) - F.col("lost")).alias("letters"))


def _letters(spark, sf):
    """How many characters of each document the code page does not have."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _ODD, ""), r"[\n\r\x{0085}\x{2028}\x{2029}]", "")
    kept = F.regexp_replace(clean, "[^\\x00-\\x7f\\x{a0}-\\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+", "")
    return _texts(spark, sf).select("path", (F.char_length(clean) - F.char_length(kept)).alias("lost"))
