"""New documents with pictures and contents: one of each row of documents, with its lines as headings and paragraphs."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..scratch import written
from ..sources import illustrated, packages
from .base import query
from .files import _blocks, _DOC, _join, _LINES


def _made(k: int) -> bytes:
    """A picture whose kind and size follow k: PNG, JPEG by its head, or neither."""
    wide, high = 1 + k % 40, 1 + k % 7
    if k % 9 == 8:
        return b"GIF89a"
    if k % 2:
        return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, high, wide, 1) + b"\xff\xd9"
    piece = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes((k + x) % 256 for x in range(wide)) for _ in range(high))
    return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 0, 0, 0, 0)) + piece(b"IDAT", zlib.compress(rows)) + piece(b"IEND", b"")


def _files(spark, sf):
    """Contents first, then the lines, of which the first is a heading of level 1 and every fourth one of level 3 (see the
    documents of the other queries), and a picture at the end."""
    null = lambda kind: F.lit(None).cast(kind)
    lines = _blocks(spark, sf).withColumn("pos", F.col("pos") + 1)
    more = {"data": null("binary"), "width_mm": null("double"), "height_mm": null("double"), "caption": null("string"), "levels": null("int")}
    lines = lines.withColumns(more)
    k = F.coalesce(F.col("path").cast("bigint"), F.lit(0))
    heads = lines.where("pos = 1")
    contents = heads.withColumns({"pos": F.lit(0), "kind": F.lit("contents"), "text": F.lit("Contents"), "style": null("string"), "levels": F.when(k % 3 == 0, 2).otherwise(3)})
    alt = F.concat(F.lit('picture "'), k.cast("string"), F.lit('" & more'))
    image = heads.withColumns({"pos": F.lit(1 << 20), "kind": F.lit("image"), "text": alt, "style": null("string"), "width_mm": F.when(k % 4 == 0, 20.5), "height_mm": F.when(k % 4 == 0, 10.0), "caption": F.concat(F.lit("Picture "), k.cast("string"))})

    pictures = pa.schema([("path", pa.int64()), ("data", pa.binary())])

    def run(batches):
        made = ((path, _made(x)) for path, x in packages.rows_of(batches, "path", "k"))
        return packages.batched(((len(data), (path, data)) for path, data in made), pictures)

    data = packages.spread(heads.select(F.col("path"), k.alias("k")), "path").mapInArrow(run, "path bigint, data binary")
    image = _join(image.drop("data"), data)
    return illustrated.build_illustrated(lines.unionByName(contents).unionByName(image))


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, ordinal, text, CASE WHEN ordinal = 0 THEN 1 ELSE 3 END AS level FROM l WHERE (ordinal = 0 OR ordinal % 4 = 1) AND coalesce(doc_id, 0) % 9 <> 8)
SELECT doc_id::VARCHAR AS path, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS entry, level, '_Toc' || (ordinal + 1) AS anchor, text, text AS heading FROM h WHERE level = 1 OR coalesce(doc_id, 0) % 3 <> 0""")
def document_contents(spark, sf):
    return illustrated.contents_entries(_files(spark, sf).where("content IS NOT NULL").select("path", "content")).drop("issue")


@query(f"""WITH d AS ({_DOC}), k AS (SELECT doc_id::VARCHAR AS path, coalesce(doc_id, 0) AS k FROM d)
SELECT path, CASE WHEN k % 9 <> 8 THEN CASE WHEN k % 2 = 1 THEN 'jpeg' ELSE 'png' END END AS kind, CASE WHEN k % 9 <> 8 THEN 1 + k % 40 END AS pixel_width, CASE WHEN k % 9 <> 8 THEN 1 + k % 7 END AS pixel_height,
  CASE WHEN k % 9 <> 8 THEN CASE WHEN k % 4 = 0 THEN 738000 ELSE (1 + k % 40) * 9525 END END AS width, CASE WHEN k % 9 <> 8 THEN CASE WHEN k % 4 = 0 THEN 360000 ELSE (1 + k % 7) * 9525 END END AS height,
  CASE WHEN k % 9 <> 8 THEN 'picture "' || k || '" & more' END AS alt, CASE WHEN k % 9 <> 8 THEN true END AS whole, CASE WHEN k % 9 = 8 THEN 'FORMAT_MISMATCH' END AS issue FROM k""")
def document_pictures(spark, sf):
    """whole: the bytes in the package are those that were given."""
    files = written(_files(spark, sf))

    def run(batches):
        import hashlib

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([hashlib.sha256(_made(int(x or 0))).hexdigest() for x in b.column("path").to_pylist()])], ["path", "given"])

    given = files.select("path").mapInArrow(run, "path string, given string")
    seen = _join(illustrated.pictures(files.where("content IS NOT NULL").select("path", "content")).drop("issue"), given)
    seen = seen.select("path", "kind", "pixel_width", "pixel_height", "width", "height", "alt", (F.col("sha256") == F.col("given")).alias("whole"))
    return _join(files.select("path", "issue"), seen, "left").select("path", "kind", "pixel_width", "pixel_height", "width", "height", "alt", "whole", "issue")
