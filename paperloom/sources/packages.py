"""Office packages (ZIP of XML parts) as tables: one row per part, relationship, paragraph, cell, run and so on.

Files come from Spark's binaryFile source; each extractor is one mapInArrow over (path, content) that yields flat rows,
so only the parts a query asks for are opened and bad files become rows with an issue, never failed jobs. Reading is
bounded: entries, bytes of an entry and bytes in all have budgets, checked on what is really inflated.
"""

from __future__ import annotations

import bisect
import functools
import io
import itertools
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

#: Budgets, fixed values: archive entries, bytes of one entry, bytes in all.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 4096, 32 << 20, 256 << 20
CHUNK = 64 << 10
#: Rows that are Python objects at once, and rows and bytes of a batch that goes back to Spark, fixed values.
ROWS_AT_ONCE, BATCH_ROWS, BATCH_BYTES = 16, 4096, 4 << 20
#: Bytes up to which a part is remembered by a worker, a fixed value.
SMALL_PART = 8 << 10


class Refused(Exception):
    """A package or part that is not read; its text is the issue code."""


# --- files ----------------------------------------------------------------------------------------------------------


def container(content: Column) -> Column:
    """Kind of a file by its first bytes: zip, ole, rtf, pdf or unknown."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("504B0304") | head.startswith("504B0506"), "zip")
        .when(head.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(head.startswith("7B5C727466"), "rtf")
        .when(head.startswith("255044462D"), "pdf")
        .otherwise("unknown")
    )


def read_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = MAX_TOTAL) -> DataFrame:
    """Files with identity: path, content, size_bytes, sha256, container, extension, issue. The bytes of files above
    max_bytes are not read: such a file is a row without content and digest, with the issue LIMIT_FILE_BYTES."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    read = files.where(F.col("length") <= max_bytes).select("path", "content", "length", F.lit(None).cast("string").alias("issue"))
    spared = files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary").alias("content"), "length", F.lit("LIMIT_FILE_BYTES").alias("issue"))
    return read.unionByName(spared).select(
        "path", "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), container(F.col("content")).alias("container"), T.extension("path").alias("extension"), "issue"
    )


#: Names in a PDF that tell of a feature, fixed values: keys, and types or actions.
PDF_MARKERS = {
    "javascript": r"/JS\b|/S\s*/JavaScript\b", "embedded_files": r"/EmbeddedFiles\b|/EF\b|/Type\s*/EmbeddedFile\b",
    "external_links": r"/URI\b|/S\s*/(Launch|GoToR|SubmitForm|ImportData)\b", "signatures": r"/(FT|Type)\s*/Sig\b", "acro_form": r"/AcroForm\b", "xfa": r"/XFA\b",
}


def pdf_profile(files: DataFrame) -> DataFrame:
    """What the bytes of PDF files tell without a parser: path, version, pages (page objects in sight), encrypted, and the
    features of PDF_MARKERS; files of other kinds give no row. Objects in compressed streams are out of sight, so false
    means not seen (coverage is partial); of encrypted files nothing is said. Expressions only, no Python."""
    body = files.where(container(F.col("content")) == "pdf").withColumn("body", F.decode("content", "ISO-8859-1"))
    secret = F.col("body").rlike(r"/Encrypt\b")
    seen = [F.when(~secret, F.col("body").rlike(pattern)).alias(name) for name, pattern in PDF_MARKERS.items()]
    pages = F.regexp_count("body", F.lit(r"/Type\s*/Page\b"))
    return body.select("path", F.regexp_extract("body", r"^%PDF-(\d\.\d)", 1).alias("version"), pages.alias("pages"), secret.alias("encrypted"), *seen)


# --- batches ----------------------------------------------------------------------------------------------------------


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by their keys. Python takes far longer for a row than Spark for reading it, so tasks must
    follow neither the files that a table comes in nor the few bytes of its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The values of some columns row by row; only ROWS_AT_ONCE rows are Python objects at a time, as a batch of nested
    rows takes many times its size then."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield from zip(*(_objects(part.column(c)) for c in columns), strict=True)


def _objects(column: pa.Array) -> list:
    """As to_pylist, which makes the values of lists of structs one by one: here they are made field by field."""
    if not isinstance(column, pa.ListArray) or not pa.types.is_struct(column.type.value_type) or column.null_count:
        return column.to_pylist()
    inner, names = column.flatten(), [f.name for f in column.type.value_type]
    if inner.null_count or not names or len(set(names)) < len(names):
        return column.to_pylist()
    structs = [dict(zip(names, values, strict=True)) for values in zip(*(inner.field(k).to_pylist() for k in range(len(names))), strict=True)]
    ends = list(itertools.accumulate(column.value_lengths().to_pylist(), initial=0))
    return [structs[a:b] for a, b in itertools.pairwise(ends)]


def batched(rows: Iterable[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each of which comes with the bytes that it stands for: a batch ends at BATCH_ROWS or BATCH_BYTES."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for own, row in rows:
        held.append(row)
        size += own
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


FILE = pa.schema([("path", pa.string()), ("content", pa.binary())])
TRIED = FILE.append(pa.field("issue", pa.string()))


def made_files(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of files (path, content), or with an issue behind."""
    rows = iter(rows)
    first = next(rows, None)
    if first is not None:
        yield from batched(((len(r[1] or b""), r) for r in itertools.chain([first], rows)), FILE if len(first) == 2 else TRIED)


# --- packages -------------------------------------------------------------------------------------------------------


class _NoDoctype(ElementTree.TreeBuilder):
    """Refuses document types, and with them entities, in any encoding."""

    def doctype(self, name, pubid, system):
        raise Refused("XML_FORBIDDEN")


#: The beginning of a part in UTF-8, whose document type can be seen in its bytes.
PLAIN = re.compile(rb"""<(?:\?xml version=["']1\.\d["'](?: encoding=["'](?i:utf-8)["'])?(?: standalone=["']\w+["'])? ?\?>|[A-Za-z])""")


def _tree(data: bytes) -> ElementTree.Element:
    try:
        if PLAIN.match(data) and b"<!DOCTYPE" not in data:  # nothing to refuse: the parser's own tree is made faster
            return ElementTree.fromstring(data)
        return ElementTree.fromstring(data, ElementTree.XMLParser(target=_NoDoctype()))
    except (ElementTree.ParseError, ValueError, LookupError):
        raise Refused("XML_MALFORMED") from None


def check_xml(data: bytes) -> None:
    """Refuses what _tree refuses, without a tree where there is no document type."""
    if not PLAIN.match(data) or b"<!DOCTYPE" in data:
        _tree(data)
        return
    try:
        expat.ParserCreate(None, "}").Parse(data, True)
    except (expat.ExpatError, ValueError, LookupError):
        raise Refused("XML_MALFORMED") from None


@functools.lru_cache(64)
def _rows_of_part(parse: Callable[[ElementTree.Element], Iterable[tuple]], data: bytes) -> tuple[tuple, ...]:
    return tuple(parse(_tree(data)))


class Package:
    """Bounded reading of one archive."""

    def __init__(self, content: bytes):
        self.content = content
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, OSError, EOFError, struct.error, NotImplementedError):
            raise Refused("CONTAINER_UNREADABLE") from None
        self.infos = sorted(self.zip.infolist(), key=lambda i: i.filename)
        if len(self.infos) > MAX_ENTRIES:
            raise Refused("LIMIT_ENTRIES")
        self.left = MAX_TOTAL
        self.names = {i.filename for i in self.infos}
        self.offsets = sorted(i.header_offset for i in self.infos)

    def _plain(self, info: zipfile.ZipInfo) -> bytes | None:
        """An entry that is in all what its directory says, read at once; null for any other, which is read with care."""
        at, name = info.header_offset, info.orig_filename
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.file_size > self.left or not name.isascii():
            return None
        next_one = bisect.bisect_right(self.offsets, at)
        stop = self.offsets[next_one] if next_one < len(self.offsets) else self.zip.start_dir
        head = self.content[at : at + 30]
        if len(head) < 30 or head[:4] != b"PK\3\4" or head[6] & 0x60 or self.offsets[next_one - 2 : next_one - 1] == [at]:
            return None
        length, extra = struct.unpack_from("<HH", head, 26)
        start = at + 30 + length + extra
        raw = self.content[start : start + info.compress_size]
        if self.content[at + 30 : at + 30 + length] != name.encode() or len(raw) < info.compress_size or start + info.compress_size > stop:
            return None
        if info.compress_type == zipfile.ZIP_DEFLATED:
            engine = zlib.decompressobj(-15)
            try:
                raw = engine.decompress(raw, info.file_size + 1)
            except zlib.error:
                return None
            if not engine.eof:
                return None
        return raw if len(raw) == info.file_size and zlib.crc32(raw) == info.CRC else None

    def read(self, name: str) -> bytes:
        try:
            info = self.zip.getinfo(name)
        except KeyError:
            raise Refused("PART_MISSING") from None
        if info.flag_bits & 1:
            raise Refused("ENTRY_ENCRYPTED")
        if info.file_size > MAX_ENTRY:
            raise Refused("LIMIT_ENTRY_BYTES")
        if (plain := self._plain(info)) is not None:
            self.left -= len(plain)
            return plain
        out = io.BytesIO()
        try:
            with self.zip.open(info) as f:
                while piece := f.read(CHUNK):
                    out.write(piece)
                    self.left -= len(piece)
                    if out.tell() > MAX_ENTRY or self.left < 0:
                        raise Refused("LIMIT_ENTRY_BYTES" if self.left >= 0 else "LIMIT_TOTAL_BYTES")
        except (zipfile.BadZipFile, zlib.error, OSError, EOFError, struct.error, NotImplementedError, RuntimeError):
            raise Refused("ENTRY_DAMAGED") from None
        return out.getvalue()

    def xml(self, name: str) -> ElementTree.Element:
        return _tree(self.read(name))

    def rows(self, name: str, parse: Callable[[ElementTree.Element], Iterable[tuple]]) -> Iterable[tuple]:
        """What `parse` finds in a part. Small parts often are the same in many packages, and are parsed once for some of
        those that a worker has seen last."""
        data = self.read(name)
        return _rows_of_part(parse, data) if len(data) <= SMALL_PART else parse(_tree(data))

    def optional(self, name: str) -> ElementTree.Element | None:
        return self.xml(name) if name in self.names else None


class Made(Package):
    """A package that is in parts yet, read with the budgets of one that is packed."""

    def __init__(self, parts: dict[str, bytes]):
        if len(parts) > MAX_ENTRIES:
            raise Refused("LIMIT_ENTRIES")
        self.parts, self.names, self.left = parts, set(parts), MAX_TOTAL

    def read(self, name: str) -> bytes:
        if name not in self.parts:
            raise Refused("PART_MISSING")
        data = self.parts[name]
        if len(data) > MAX_ENTRY:
            raise Refused("LIMIT_ENTRY_BYTES")
        self.left -= len(data)
        if self.left < 0:
            raise Refused("LIMIT_TOTAL_BYTES")
        return data


Rows = Iterable[tuple]
Parser = Callable[[Package], Rows]


def extract(files: DataFrame, parse: Parser, schema: str) -> DataFrame:
    """Rows that `parse` finds in each package, with path before and issue after its columns. A package that is refused
    gives one row with nulls and the issue, PARSE_FAILED if its parts are well-formed but not what they should be. Files
    that are not ZIP by their first bytes are not opened."""
    kind = StructType.fromDDL(f"path string, {schema}, issue string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    width = len(kind) - 2

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for path, content in rows_of(batches, "path", "content"):
            try:
                package = Package(content)
                left = package.left
                for row in parse(package):
                    yield left - package.left, (path, *row, None)
                    left = package.left
            except Refused as refused:
                yield 0, (path, *[None] * width, str(refused))
            except Exception:  # no package fails the job, whatever it holds
                yield 0, (path, *[None] * width, "PARSE_FAILED")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(found(batches), arrow)

    return files.where(container(F.col("content")) == "zip").select("path", "content").mapInArrow(run, kind)


def local(element_or_name) -> str:
    name = element_or_name if isinstance(element_or_name, str) else element_or_name.tag
    return _local_name(name) if isinstance(name, str) else ""


@functools.lru_cache(4096)
def _local_name(name: str) -> str:
    return name.rpartition("}")[2]


def attr(element, name: str, default: str | None = None) -> str | None:
    for key, value in element.attrib.items():
        if key == name or local(key) == name:
            return value
    return default


def child(element, *names: str):
    for name in names:
        if element is None:
            return None
        for c in element:
            if isinstance(c.tag, str) and _local_name(c.tag) == name:
                element = c
                break
        else:
            return None
    return element


def children(element, name: str):
    return [c for c in element if local(c) == name]


def whole(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", value) else None


def parts(files: DataFrame) -> DataFrame:
    """The directory of each package: part, size_bytes, compressed_bytes, encrypted."""
    return extract(
        files, lambda p: [(i.filename, i.file_size, i.compress_size, bool(i.flag_bits & 1)) for i in p.infos if not i.is_dir()], "part string, size_bytes bigint, compressed_bytes bigint, encrypted boolean"
    )


def _types_in(root: ElementTree.Element) -> Rows:
    for e in root:
        if local(e) == "Override":
            yield (attr(e, "PartName", "").lstrip("/"), attr(e, "ContentType"), False)
        elif local(e) == "Default":
            yield (attr(e, "Extension", "").lower(), attr(e, "ContentType"), True)


def _content_types(p: Package) -> Rows:
    return p.rows("[Content_Types].xml", _types_in)


def content_types(files: DataFrame) -> DataFrame:
    return extract(files, _content_types, "name string, content_type string, is_default boolean")


def typed_parts(files: DataFrame) -> DataFrame:
    """Parts with their content types: the override, else the default of the extension."""
    found = content_types(files)
    own = found.where("NOT is_default").select("path", F.col("name").alias("part"), F.col("content_type").alias("own"))
    usual = found.where("is_default").select("path", F.col("name").alias("ext"), F.col("content_type").alias("usual"))
    out = parts(files).withColumn("ext", T.extension("part")).join(own, ["path", "part"], "left").join(usual, ["path", "ext"], "left")
    return out.select("path", "part", "size_bytes", "compressed_bytes", "encrypted", T.content_type("own", "usual").alias("content_type"), "issue")


def _relationships_in(root: ElementTree.Element) -> Rows:
    for e in root:
        if local(e) == "Relationship":
            yield (attr(e, "Id"), attr(e, "Type"), attr(e, "Target"), attr(e, "TargetMode", "Internal"))


def _relationships(p: Package) -> Rows:
    for name in sorted(n for n in p.names if n.endswith(".rels")):
        for row in p.rows(name, _relationships_in):
            yield (name, *row)


def relationships(files: DataFrame) -> DataFrame:
    """Relationships with their source part and, for internal ones, the part that the target resolves to."""
    found = extract(files, _relationships, "rels_part string, id string, type string, target string, target_mode string")
    source = T.relationship_source("rels_part")
    return found.select("path", source.alias("source_part"), "id", "type", "target", "target_mode", F.when(F.col("target_mode") != "External", T.resolve_target(source, "target")).alias("resolved"), "issue")


# --- word processing ------------------------------------------------------------------------------------------------

DOCUMENT = "word/document.xml"


def text_of(element, tabs: bool = False) -> str:
    """Text nodes of an element in order; with tabs and breaks as characters if asked for."""
    out = []
    for e in element.iter():
        name = local(e)
        if name == "t":
            out.append(e.text or "")
        elif tabs and name == "tab" and not e.attrib:
            out.append("\t")
        elif tabs and name in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def _run_format(run) -> tuple:
    """(bold, size in points, colour, font) of a run; what is absent is null, not false."""
    props = child(run, "rPr")
    if props is None:
        return (None, None, None, None)
    bold, size, color, fonts = (child(props, n) for n in ("b", "sz", "color", "rFonts"))
    return (
        None if bold is None else (attr(bold, "val") or "1").lower() not in ("0", "false", "off"),
        None if size is None or (whole(attr(size, "val")) or 0) <= 0 else whole(attr(size, "val")) / 2,
        None if color is None or attr(color, "val") in ("", "auto") else attr(color, "val"),
        None if fonts is None else attr(fonts, "eastAsia") or None,
    )


#: Marks in a paragraph, and what they lead to; fixed values.
_NOTED = {"commentReference": "comment", "commentRangeStart": "comment", "footnoteReference": "footnote", "endnoteReference": "endnote"}


def _paragraph(e, path: str, ordinal: int, table: str | None, row: int | None, cell: int | None) -> tuple:
    props = child(e, "pPr")
    style = outline = num = level = None
    if props is not None:
        for name in ("pStyle", "outlineLvl"):
            found = child(props, name)
            if found is not None:
                style, outline = (attr(found, "val"), outline) if name == "pStyle" else (style, whole(attr(found, "val")))
        numbering = child(props, "numPr")
        if numbering is not None:
            num = None if child(numbering, "numId") is None else attr(child(numbering, "numId"), "val")
            level = None if child(numbering, "ilvl") is None else whole(attr(child(numbering, "ilvl"), "val"))
    notes, sizes, text, full = set(), [], [], []
    for x in e.iter():
        name = _local_name(x.tag) if isinstance(x.tag, str) else ""
        if name == "t":
            text.append(x.text or "")
            full.append(x.text or "")
        elif name == "r":
            sizes.append(_run_format(x))
        elif name == "tab":
            full.append("" if x.attrib else "\t")
        elif name in ("br", "cr"):
            full.append("\n")
        elif name in _NOTED:
            notes.add(f"{_NOTED[name]}:{attr(x, 'id')}")
    bolds = [f[0] for f in sizes]
    return (
        path, ordinal, attr(e, "paraId"), style, outline, num, level, "".join(text), "".join(full), sorted(notes),
        table, row, cell, bool(bolds) and all(bolds), max([f[1] for f in sizes if f[1] is not None], default=None),
    )


PARAGRAPH = (
    "structural_path string, ordinal int, para_id string, style_id string, outline_level int, num_id string, num_level int, text string, "
    "full_text string, notes array<string>, table_path string, row int, cell int, all_bold boolean, max_size double"
)


def _blocks(body, path: str) -> Iterator[tuple[str, ElementTree.Element, str, int]]:
    """(name, element, path, ordinal) of paragraphs and tables; content controls are gone through."""
    counts: dict[str, int] = {}
    for e in body:
        name = local(e)
        counts[name] = counts.get(name, 0) + 1
        own = f"{path}/w:{name}[{counts[name]}]"
        if name == "sdt" and child(e, "sdtContent") is not None:
            yield from _blocks(child(e, "sdtContent"), f"{own}/w:sdtContent[1]")
        elif name in ("p", "tbl"):
            yield name, e, own, counts[name] - 1


def _body(p: Package) -> ElementTree.Element:
    return body_of(p.xml(DOCUMENT))


def body_of(root: ElementTree.Element) -> ElementTree.Element:
    body = child(root, "body")
    if body is None:
        raise Refused("BODY_MISSING")
    return body


def _paragraphs(p: Package) -> Rows:
    return paragraphs_in(_body(p))


def paragraphs_in(body: ElementTree.Element) -> Rows:
    for name, e, path, ordinal in _blocks(body, "/w:document/w:body"):
        if name == "p":
            yield _paragraph(e, path, ordinal, None, None, None)
            continue
        for r, row in enumerate(children(e, "tr")):
            for c, cell in enumerate(children(row, "tc")):
                for k, para in enumerate(children(cell, "p")):
                    yield _paragraph(para, f"{path}/w:tr[{r + 1}]/w:tc[{c + 1}]/w:p[{k + 1}]", k, path, r, c)


def paragraphs(files: DataFrame) -> DataFrame:
    return extract(files, _paragraphs, PARAGRAPH)


def _cells(p: Package) -> Rows:
    for name, e, path, _ in _blocks(_body(p), "/w:document/w:body"):
        if name != "tbl":
            continue
        grid = child(e, "tblGrid")
        declared = 0 if grid is None else len(children(grid, "gridCol"))
        for r, row in enumerate(children(e, "tr")):
            props = child(row, "trPr")
            skip = [0, 0]
            for k, n in enumerate(("gridBefore", "gridAfter")):
                found = child(props, n) if props is not None else None
                skip[k] = (whole(attr(found, "val")) or 0) if found is not None else 0
            header = props is not None and child(props, "tblHeader") is not None
            for c, cell in enumerate(children(row, "tc")):
                cp = child(cell, "tcPr")
                span, merge = (child(cp, n) if cp is not None else None for n in ("gridSpan", "vMerge"))
                kind = None if merge is None else attr(merge, "val", "continue")
                nested = any(local(x) == "tbl" for x in cell.iter() if x is not cell)
                yield (path, declared, r, c, *skip, max(1, (whole(attr(span, "val")) or 1) if span is not None else 1), kind, header, nested, "\n".join(text_of(x) for x in children(cell, "p")))


def cells(files: DataFrame) -> DataFrame:
    schema = "table_path string, declared int, row int, idx int, grid_before int, grid_after int, span int, v_merge string, header boolean, nested boolean, text string"
    return extract(files, _cells, schema)


def _table_geometry(p: Package) -> Rows:
    for name, e, path, _ in _blocks(_body(p), "/w:document/w:body"):
        if name != "tbl":
            continue
        props = child(e, "tblPr")
        value = lambda n, a="val": None if props is None or child(props, n) is None else attr(child(props, n), a)  # noqa: B023, E731
        rows = children(e, "tr")
        grid = child(e, "tblGrid")
        widths = [whole(attr(c, "w")) for c in children(grid, "gridCol")] if grid is not None else []
        yield (path, value("tblStyle"), whole(value("tblW", "w")), value("jc"), value("tblLayout", "type"), widths, len(rows), bool(rows) and child(rows[0], "trPr", "tblHeader") is not None)


def table_geometry(files: DataFrame) -> DataFrame:
    """Style, width, alignment, layout, widths of the grid and header row of each table; lengths in twips."""
    return extract(files, _table_geometry, "table_path string, style_id string, width int, alignment string, layout string, grid array<int>, n_rows int, header_row boolean")


def _styles_in(root: ElementTree.Element) -> Rows:
    for e in children(root, "style"):
        name, based, outline = child(e, "name"), child(e, "basedOn"), child(e, "pPr", "outlineLvl")
        indent = child(e, "pPr", "ind")
        yield (
            attr(e, "styleId"), attr(e, "type"), None if name is None else attr(name, "val"), None if based is None else attr(based, "val"),
            None if outline is None else whole(attr(outline, "val")), None if indent is None else whole(attr(indent, "firstLine")),
            None if indent is None else whole(attr(indent, "firstLineChars")), (attr(e, "default") or "0") in ("1", "true", "on"),
        )


def _styles(p: Package) -> Rows:
    return p.rows("word/styles.xml", _styles_in) if "word/styles.xml" in p.names else ()


def styles(files: DataFrame) -> DataFrame:
    return extract(files, _styles, "style_id string, style_type string, name string, based_on string, outline_level int, first_line int, first_line_chars int, is_default boolean")


def _notes(p: Package) -> Rows:
    for part, kind in (("word/comments.xml", "comment"), ("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
        root = p.optional(part)
        for e in children(root, kind) if root is not None else ():
            if kind == "comment" or attr(e, "id") not in ("-1", "0"):
                yield (part, kind, attr(e, "id"), attr(e, "author"), attr(e, "date"), "\n".join(text_of(x) for x in children(e, "p")))


def notes(files: DataFrame) -> DataFrame:
    """Comments, footnotes and endnotes in this order; the notes -1 and 0 are separators and left out."""
    return extract(files, _notes, "part string, kind string, reference string, author string, date string, text string")


def _metadata(p: Package) -> Rows:
    root = p.optional("docProps/core.xml")
    if root is not None:
        value = lambda n: (lambda e: None if e is None else e.text)(child(root, n))
        yield tuple(value(n) for n in ("title", "creator", "subject", "lastModifiedBy", "created", "modified"))


def metadata(files: DataFrame) -> DataFrame:
    return extract(files, _metadata, "title string, creator string, subject string, last_modified_by string, created string, modified string")


def _fields(p: Package) -> Rows:
    for name in sorted(n for n in p.names if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", n)):
        root = p.xml(name)
        for e in root.iter():
            code = (e.text or "") if local(e) == "instrText" else attr(e, "instr", "") if local(e) == "fldSimple" else ""
            if re.match(r"\s*DDE(AUTO)?\b", code or "", re.I):
                yield (name, code.strip()[:512])


def dde_fields(files: DataFrame) -> DataFrame:
    """Dynamic data exchange fields of body, headers and footers, each once, cut to 512 characters."""
    return extract(files, _fields, "part string, instruction string").distinct()


def _header_texts(p: Package) -> Rows:
    for name in sorted(n for n in p.names if re.fullmatch(r"word/(header|footer)\d*\.xml", n)):
        yield (name, "\n".join(text_of(e) for e in p.xml(name) if local(e) == "p"))


def header_texts(files: DataFrame) -> DataFrame:
    """The text of each header and footer part."""
    return extract(files, _header_texts, "part string, text string")


def _chosen(element) -> Iterator[ElementTree.Element]:
    """All elements below one in order, but of alternative contents only the first choice, or the fallback if there is
    none: the same drawing is not seen twice."""
    for e in element:
        if local(e) == "AlternateContent":
            picked = child(e, "Choice") if child(e, "Choice") is not None else child(e, "Fallback")
            if picked is not None:
                yield from _chosen(picked)
            continue
        yield e
        yield from _chosen(e)


def _layout(p: Package) -> Rows:
    body = _body(p)
    blocks = [x for x in body if local(x) in ("p", "tbl", "sdt")]
    for k, e in enumerate(blocks):
        for x in _chosen(e):
            name = local(x)
            if name == "br" and attr(x, "type") == "page":
                yield _seen("break", k, kind="explicit")
            elif name == "lastRenderedPageBreak":
                yield _seen("break", k, kind="rendered")
            elif name == "pageBreakBefore" and (attr(x, "val") or "1") not in ("0", "false"):
                yield _seen("break", k, kind="explicit")
            elif name in ("anchor", "inline"):
                yield _drawing(x, k)
            elif name == "sectPr":
                yield _section(x, k)
    for x in body:
        if local(x) not in ("p", "tbl", "sdt", "sectPr"):
            yield _seen("unknown", len(blocks), kind=local(x))
    last = child(body, "sectPr")
    if last is not None:
        yield _section(last, len(blocks) - 1)


#: Columns of an observation after its name and block.
_OBSERVED = ("kind", "columns", "width", "height", "orientation", "offset_x", "offset_y", "wrap", "rel_id", "margin_top", "margin_right", "margin_bottom", "margin_left")


def _seen(obs: str, block: int, **values) -> tuple:
    return (obs, block, *(values.get(k) for k in _OBSERVED))


def _below(element, name: str):
    return next((x for x in element.iter() if local(x) == name), None)


def _drawing(x, k: int) -> tuple:
    """A floating or inline drawing: its size, how far it is from what it is placed by, how text runs round it and the
    relationship of its picture or chart."""
    number = lambda e, name: None if e is None else whole(attr(e, name))
    inline = local(x) == "inline"
    offsets = []
    for axis, letter in (("H", "x"), ("V", "y")):
        if not inline and attr(x, "simplePos") in ("1", "true") and child(x, "simplePos") is not None:
            offsets.append(number(child(x, "simplePos"), letter))
        else:
            placed = child(x, f"position{axis}", "posOffset")
            offsets.append(None if placed is None else whole(placed.text))
    behind = attr(x, "behindDoc") in ("1", "true")
    modes = {"wrapSquare": "square", "wrapTight": "tight", "wrapThrough": "through", "wrapTopAndBottom": "topAndBottom", "wrapNone": "behindText" if behind else "inFrontOfText"}
    wrap = "inline" if inline else next((mode for name, mode in modes.items() if child(x, name) is not None), "none")
    picture, chart = _below(x, "blip"), _below(x, "chart")
    rel = attr(chart, "id") if chart is not None else None if picture is None else attr(picture, "embed") or attr(picture, "link")
    return _seen("float", k, kind=local(x), width=number(child(x, "extent"), "cx"), height=number(child(x, "extent"), "cy"), offset_x=offsets[0], offset_y=offsets[1], wrap=wrap, rel_id=rel)


def _section(x, k: int) -> tuple:
    size, kind, cols, margin = (child(x, n) for n in ("pgSz", "type", "cols", "pgMar"))
    count = None if cols is None else (len(children(cols, "col")) or whole(attr(cols, "num")))
    sides = {f"margin_{n}": None if margin is None else whole(attr(margin, n)) for n in ("top", "right", "bottom", "left")}
    width, height = (None if size is None else whole(attr(size, n)) for n in ("w", "h"))
    turned = None if size is None else attr(size, "orient")
    return _seen("section", k, kind=attr(kind, "val", "nextPage") if kind is not None else "nextPage", columns=count or 1, width=width, height=height, orientation=turned, **sides)


def layout(files: DataFrame) -> DataFrame:
    """Page breaks, sections with their margins, floating or inline drawings, and elements of the body that are no
    blocks, with the index of their block."""
    numbers = ", ".join(f"margin_{n} int" for n in ("top", "right", "bottom", "left"))
    return extract(files, _layout, f"obs string, block int, kind string, columns int, width bigint, height bigint, orientation string, offset_x bigint, offset_y bigint, wrap string, rel_id string, {numbers}")


def _runs(p: Package) -> Rows:
    for name, e, path, _ in _blocks(_body(p), "/w:document/w:body"):
        for para, own in [(e, path)] if name == "p" else [
            (para, f"{path}/w:tr[{r + 1}]/w:tc[{c + 1}]/w:p[{k + 1}]")
            for r, row in enumerate(children(e, "tr")) for c, cell in enumerate(children(row, "tc")) for k, para in enumerate(children(cell, "p"))
        ]:
            align = child(para, "pPr", "jc")
            indent = child(para, "pPr", "ind")
            for r, run in enumerate(children(para, "r")):
                yield (
                    own, r, text_of(run), *_run_format(run), None if align is None else attr(align, "val"),
                    None if indent is None else whole(attr(indent, "firstLine")), None if indent is None else whole(attr(indent, "firstLineChars")),
                )


def runs(files: DataFrame) -> DataFrame:
    """Runs of all paragraphs with their own formatting and their paragraph's alignment and first-line indent; what is
    absent is null, not false."""
    return extract(files, _runs, "structural_path string, run int, text string, bold boolean, size double, color string, east_asia string, alignment string, first_line int, first_line_chars int")


# --- spreadsheets and decks -----------------------------------------------------------------------------------------


def sheet_parts(p: Package) -> list[tuple[str, str]]:
    rels = {attr(e, "Id"): attr(e, "Target", "") for e in p.xml("xl/_rels/workbook.xml.rels")}
    out = []
    for e in p.xml("xl/workbook.xml").iter():
        if local(e) == "sheet":
            target = next((rels.get(v, "") for k, v in e.attrib.items() if k.endswith("}id")), "")
            out.append((attr(e, "name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


_CELL = re.compile(r"([A-Z]{1,3})([1-9]\d{0,6})")


def _sheet_cells(p: Package) -> Rows:
    if any(n.lower().endswith("vbaproject.bin") for n in p.names):
        raise Refused("MACROS_REFUSED")
    strings = [text_of(e) for e in root if local(e) == "si"] if (root := p.optional("xl/sharedStrings.xml")) is not None else []
    for sheet, part in sheet_parts(p):
        for e in p.xml(part).iter():
            if local(e) != "c":
                continue
            found = _CELL.fullmatch((attr(e, "r") or "").upper())
            if not found:
                raise Refused("CELL_ADDRESS")
            col = 0
            for ch in found[1]:
                col = 26 * col + ord(ch) - 64
            kind, value, formula = attr(e, "t", "n"), child(e, "v"), child(e, "f")
            raw = None if value is None else value.text
            if kind == "s" and raw is not None:
                at = whole(raw)
                raw = strings[at] if at is not None and 0 <= at < len(strings) else None
            elif kind == "inlineStr":
                raw = text_of(e)
            kind = {"s": "text", "inlineStr": "text", "str": "text", "b": "boolean", "e": "error"}.get(kind, "number")
            yield (sheet, int(found[2]), col, None if raw is None else kind, raw, None if formula is None else formula.text)


def sheet_cells(files: DataFrame) -> DataFrame:
    """Cells of all sheets with the kind and text of their (cached) value; formulas are never recalculated."""
    return extract(files, _sheet_cells, "sheet string, row int, col int, kind string, value string, formula string")


def _print_layouts(p: Package) -> Rows:
    for sheet, part in sheet_parts(p):
        root = p.xml(part)
        setup, mark = child(root, "pageSetup"), child(root, "sheetPr", "pageSetUpPr")
        value = lambda n: None if setup is None else attr(setup, n)  # noqa: B023, E731
        yield (sheet, value("orientation"), whole(value("fitToWidth")), whole(value("fitToHeight")), whole(value("scale")), mark is not None and attr(mark, "fitToPage") in ("1", "true"))


def print_layouts(files: DataFrame) -> DataFrame:
    """Page setup of each sheet."""
    return extract(files, _print_layouts, "sheet string, orientation string, fit_to_width int, fit_to_height int, scale int, fit_to_page boolean")


def _slides(p: Package) -> list[str]:
    """The parts of the slides in the order of the deck, which is not that of their names."""
    rels = p.optional("ppt/_rels/presentation.xml.rels")
    targets = {attr(e, "Id"): attr(e, "Target", "") for e in rels} if rels is not None else {}
    out = []
    for e in p.xml("ppt/presentation.xml").iter():
        if local(e) == "sldId":
            target = next((targets.get(v, "") for k, v in e.attrib.items() if k.endswith("}id")), "")
            part = target.lstrip("/") if target.startswith("/") else f"ppt/{target}"
            if part not in p.names:
                raise Refused("SLIDE_MISSING")
            out.append(part)
    return out


def _slide_runs(p: Package) -> Rows:
    if any(n.lower().endswith("vbaproject.bin") for n in p.names):
        raise Refused("MACROS_REFUSED")
    for number, name in enumerate(_slides(p), 1):
        for s, shape in enumerate(x for x in p.xml(name).iter() if local(x) in ("sp", "graphicFrame")):
            props = next((x for x in shape.iter() if local(x) == "cNvPr"), None)
            holder = next((x for x in shape.iter() if local(x) == "ph"), None)
            off, ext = (next((x for x in shape.iter() if local(x) == n and "x" in x.attrib or local(x) == n and "cx" in x.attrib), None) for n in ("off", "ext"))
            box = [whole(off.get("x")) if off is not None else None, whole(off.get("y")) if off is not None else None, whole(ext.get("cx")) if ext is not None else None, whole(ext.get("cy")) if ext is not None else None]
            for k, para in enumerate(x for x in shape.iter() if local(x) == "p"):
                for r, run in enumerate(children(para, "r")):
                    rp = child(run, "rPr")
                    size = whole(rp.get("sz")) if rp is not None and rp.get("sz") else None
                    yield (number, s, attr(props, "id") if props is not None else None, None if holder is None else attr(holder, "type", "body"), k, r, text_of(run), None if size is None else size / 100, *box)


def slide_runs(files: DataFrame) -> DataFrame:
    """Runs of all slides in order, with their shape's placeholder type and box in EMU."""
    return extract(files, _slide_runs, "slide int, shape int, shape_id string, placeholder string, paragraph int, run int, text string, size double, x bigint, y bigint, width bigint, height bigint")
