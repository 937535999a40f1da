"""Compound files and compressed containers made by hand, and the words of macro code."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from paperloom.sources import macros as M
from paperloom.sources.packages import Refused
from paperloom.sources.writers import packed


def refused(call, *args):
    with pytest.raises(Refused) as x:
        call(*args)
    return str(x.value)


def test_containers():
    # two containers by hand: without a copy, and one byte copied on and on
    assert M.expanded(bytes.fromhex("0119B000616263646566676800696A6B6C6D6E6F70007172737475762E")) == b"abcdefghijklmnopqrstuv."
    assert M.expanded(bytes.fromhex("0103B002614500")) == b"a" * 73
    rng = random.Random(1)
    for size in (0, 1, 2, 7, 8, 9, 4095, 4096, 4097, 30_000):
        for letters in (1, 2, 30):
            data = bytes(rng.randrange(letters) for _ in range(size))
            assert M.expanded(M.compressed(data))[:size] == data  # a chunk that does not shrink is filled up
    noise = bytes(rng.randrange(256) for _ in range(4096))
    assert M.expanded(M.compressed(noise)) == noise and len(M.compressed(noise)) == 4099
    for bad in (b"", b"\x02", b"\x01\x00\x00", b"\x01\x02\xb0\x01\x00\x00", b"\x01\x04\xb0\x02a\xff\xff"):
        assert refused(M.expanded, bad) == "VBA_CONTAINER"


def test_code_is_bounded(monkeypatch):
    monkeypatch.setattr(M, "MAX_CODE", 1000)
    assert refused(M.expanded, M.compressed(b"a" * 5000)) == "LIMIT_CODE_BYTES"


def test_compound_files():
    rng = random.Random(2)
    streams = {f"{'a/' * (k % 3)}s{k}": bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 63, 64, 65, 4095, 4096, 9000]))) for k in range(40)}
    file = M.Compound(M.compound(streams))
    assert {p: file.read(p) for p in file.streams} == streams and refused(file.read, "none") == "OLE_STREAM_MISSING"
    assert refused(M.Compound, b"") == refused(M.Compound, M.MAGIC + bytes(600)) == "OLE_UNREADABLE"


def test_chains_without_end_are_refused():
    data = bytearray(M.compound({"big": b"x" * 9000}))
    table = 512 + 512 * struct.unpack_from("<I", data, 76)[0]
    for place, value in ((0, 0), (3, 1), (0, 99_999)):
        bad = bytearray(data)
        struct.pack_into("<I", bad, table + 4 * place, value)
        assert refused(M.Compound(bytes(bad)).read, "big") == "OLE_CHAIN"
    bad = bytearray(data)
    struct.pack_into("<I", bad, 68, 0)  # the table's own chain runs through data
    assert refused(M.Compound, bytes(bad)) == "OLE_CHAIN"
    folder = bytearray(M.compound({"a/b": b"x", "a/c": b"y"}))
    entry = 512 + 512 * struct.unpack_from("<I", folder, 48)[0] + 128 * 2
    struct.pack_into("<I", folder, entry + 72, 1)  # a sibling leads back to its storage
    assert refused(M.Compound, bytes(folder)) == "OLE_CHAIN"


def test_modules_by_code_page():
    assert list(M.modules(M.vba_project({"Modul1": "x = \"é\"", "Ü": ""}))) == [("Modul1", 'x = "é"'), ("Ü", "")]
    assert list(M.modules(M.vba_project({"Я": "ж"}, "cp1251"))) == [("Я", "ж")]
    assert refused(list, M.modules(M.compound({"x": b"y"}))) == "VBA_DIRECTORY"


def test_words_of_code(spark):
    cases = [
        ("Sub AutoOpen()\nKill f", True, True, False), ("Sub document_open()\nShell x", True, False, True), ("Sub AutoOpen()\n' Shell x\nRem Kill f\n  rem Kill\ny = \"Shell \"\"Kill\"", True, False, False), ("Sub AutoOpened()\nShells x", False, False, False),
        ("Open f For Output As 1", False, True, False), ("Open f For Input As 1", False, False, False), ("Open f _\r\n For Append As 1", False, True, False), ("Declare PtrSafe Function f Lib \"k\"", False, False, True), ("x = \"a\" : Shell y ' no", False, False, True), ("", False, False, False),
    ]
    frame = spark.createDataFrame([(k, c) for k, (c, *_) in enumerate(cases)] + [(99, None)], "k int, code string")
    got = {r.k: (r.auto_exec, r.writes, r.executes, r.suspicious) for r in M.macro_verdicts(frame).collect()}
    assert got == {k: (a, w, x, a and (w or x)) for k, (_, a, w, x) in enumerate(cases)} | {99: (None,) * 4}


def test_parts_are_read_one_by_one(spark):
    good = packed({"a/vbaProject.bin": M.vba_project({"M": "code"}), "b/vbaProject.bin": b"bad", "c.xml": "<c/>"})
    files = spark.createDataFrame([("x", bytearray(good)), ("y", bytearray(good[:99]))], "path string, content binary")
    assert sorted(tuple(r) for r in M.macro_modules(files).collect() if r.path == "x") == [("x", "a/vbaProject.bin", "M", "code", None, None), ("x", "b/vbaProject.bin", None, None, "OLE_UNREADABLE", None)]
    assert [r.issue for r in M.macro_modules(files).where("path = 'y'").collect()] == ["CONTAINER_UNREADABLE"]


def test_chunks_are_searched_at_once():
    """Copies are found by array operations over a chunk, and what is written comes back whole; equal directories of
    modules are squeezed once."""
    draw = random.Random(5)
    for data in (b"", b"ab", b"a" * 9000, bytes(draw.choice(b"ab \r\n") for _ in range(9000)), bytes(draw.randrange(256) for _ in range(5000)).ljust(8192, b"x")):
        assert M.expanded(M.compressed(data)) == data
    assert len(M.compressed(b"a" * 4096)) < 20
    M._squeezed_once.cache_clear()
    for n in range(9):
        M.vba_project({"Main": f"' {n}" * 1000, "Empty": ""})
    assert M._squeezed_once.cache_info().misses == 1


def test_texts_are_dealt_before_they_are_worked_on(spark, tmp_path):
    """A table of one piece is many tasks before the expressions over its texts."""
    from paperloom.plans import macros as plan

    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert plan._letters(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() > 8
