"""Queries read whole tables: rows without an id, of high ids and of every kind are there."""

from paperloom.plans import QUERIES


def test_document_without_id(spark, tmp_path):
    rows = [(None, "en", "one\ntwo"), (1, "en", "three")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, n in {"package_paragraphs": 2, "package_scan": 5, "package_relationships": 2, "package_gate": 1, "package_counts": 1, "template_fill": 1, "text_replacement": 1}.items():
        assert QUERIES[name](spark, str(tmp_path)).where("path IS NULL").count() == n, name
    levels = {r.text: r.level for r in QUERIES["package_paragraphs"](spark, str(tmp_path)).collect()}
    assert levels == {"one": 1, "two": 3, "three": 1}
    assert QUERIES["package_relationships"](spark, str(tmp_path)).where("NOT found").count() == 0


def test_all_suppliers(spark, tmp_path):
    """sf0.001 has suppliers 0 to 9 only; here they go on to 60."""
    lines = [(k, 1 + k % 7, 1 + k % 5, k % 61, float(k % 50), float(k), "N") for k in range(700)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"TYPE {k}", k) for k in range(1, 6)], "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    for name, column in {"range_read": "sheet", "cell_upsert": "sheet", "workbook_summary": "sheet", "cell_formats": "sheet", "style_inventory": "doc", "workbook_cells": "path"}.items():
        got = {int(r[0]) for r in QUERIES[name](spark, str(tmp_path)).select(column).distinct().collect()}
        assert got == set(range(61)), name


def test_long_conversations(spark, tmp_path):
    """sf0.001 has turns up to 7 only; here they go on to 19, in conversations of any and of no id."""
    rows = [(c, t, "user" if t % 2 else "bot", "x") for c in (None, 3, 10) for t in range(20)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((str(r.conv_id), r.tr, r.format) for r in QUERIES["cell_paragraph_formats"](spark, str(tmp_path)).collect())
    assert got == sorted((c, t, "user") for c in ("10", "3", "None") for t in range(1, 11))
    # of equal texts the later turn stays, also of turns 8 and 9 whose numbers sort otherwise as text
    decks = sorted((str(r.path), r.slide) for r in QUERIES["deck_runs"](spark, str(tmp_path)).collect())
    assert decks == sorted((c, t) for c in ("10", "3", "None") for t in range(1, 21))


def test_every_document_is_described(spark, tmp_path):
    texts = ["", "short", "é" * 40, "x" * 57 + "é" * 10, "y" * 300, None]
    rows = [(k, t, None if k % 2 else "de", None if k % 3 else "src") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {int(r[0]): r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(run("evidence_envelopes")) == set(range(6))
    ranges = run("byte_ranges")
    for k, t in enumerate(texts):
        piece = None if t is None else t.encode()[57:117].decode(errors="ignore")
        want = (None, None) if t is None else (piece in t, 54 <= len(piece.encode()) <= 60)
        assert (ranges[k].inside, ranges[k].near_size) == want, k
    found = run("text_functions")
    assert set(found) == set(range(6)) and found[4].escaped == "y" * 300 and found[2].needs_font
