"""Macro code of packages: streams of compound files, the compressed modules of VBA projects, and what their words tell.

A compound file keeps streams as chains of sectors; chains that are too long, leave the file or come back on themselves
are refused, as are modules that inflate beyond their limit. Code is read, never run.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packages import Package, Refused, Rows, extract

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
#: Marks of the sector tables and the size below which a stream lives in the small sectors, fixed values of the format.
END, FREE, TABLE, CUTOFF = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 4096
#: Limits, fixed values: directory entries, bytes of a stream, bytes of a module's code, modules.
MAX_ENTRIES, MAX_STREAM, MAX_CODE, MAX_MODULES = 100_000, 64 << 20, 16 << 20, 1000
_CHUNK = 4096


class Compound:
    """The streams of a compound file by their path."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise Refused("OLE_UNREADABLE")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini != 6:
            raise Refused("OLE_UNREADABLE")
        self.size, self.mini_size = 1 << shift, 1 << mini
        tables, directory, self.cutoff, mini_start, _, more, _ = struct.unpack_from("<II4xIIIII", data, 44)
        self.table = self._table(tables, more)
        self.mini_table = list(struct.unpack(f"<{len(x) // 4}I", x)) if (x := self._chain(mini_start)) else []
        entries = self._chain(directory)
        self.entries = [entries[k : k + 128] for k in range(0, len(entries) - 127, 128)]
        if not self.entries or len(self.entries) > MAX_ENTRIES:
            raise Refused("OLE_UNREADABLE")
        self.small = self._chain(struct.unpack_from("<I", self.entries[0], 116)[0])
        self.streams = dict(self._walk())

    def _sector(self, number: int) -> bytes:
        start = (number + 1) * self.size
        if start >= len(self.data):
            raise Refused("OLE_CHAIN")
        return self.data[start : start + self.size]

    def _table(self, count: int, more: int) -> list[int]:
        """The table of sectors; its own sectors are named in the head and then in a chain of their own."""
        places, seen = list(struct.unpack_from("<109I", self.data, 76)), set()
        while more not in (END, FREE):
            if more in seen:
                raise Refused("OLE_CHAIN")
            seen.add(more)
            sector = self._sector(more)
            numbers = struct.unpack(f"<{len(sector) // 4}I", sector)
            places += numbers[:-1]
            more = numbers[-1]
        out: list[int] = []
        for place in [p for p in places if p < TABLE][:count]:
            sector = self._sector(place)
            out += struct.unpack(f"<{len(sector) // 4}I", sector)
        return out

    def _chain(self, start: int) -> bytes:
        out, at, total, seen = [], start, 0, set()
        while at not in (END, FREE):
            if at in seen or at >= len(self.table):
                raise Refused("OLE_CHAIN")
            seen.add(at)
            out.append(self._sector(at))
            total += len(out[-1])
            if total > MAX_STREAM:
                raise Refused("LIMIT_STREAM_BYTES")
            at = self.table[at]
        return b"".join(out)

    def _small_chain(self, start: int) -> bytes:
        out, at, seen = [], start, set()
        while at not in (END, FREE):
            if at in seen or at >= len(self.mini_table):
                raise Refused("OLE_CHAIN")
            seen.add(at)
            out.append(self.small[at * self.mini_size : (at + 1) * self.mini_size])
            at = self.mini_table[at]
        return b"".join(out)

    def _walk(self) -> Iterator[tuple[str, int]]:
        """(path, number of the entry) of all streams: siblings are a tree, storages have one of their own."""
        seen: set[int] = set()
        stack = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")]
        while stack:
            number, above = stack.pop()
            if number == FREE or number >= len(self.entries):
                continue
            if number in seen:
                raise Refused("OLE_CHAIN")
            seen.add(number)
            entry = self.entries[number]
            length = min(64, struct.unpack_from("<H", entry, 64)[0])
            path = above + entry[: max(0, length - 2)].decode("utf-16-le", "replace")
            left, right, below = struct.unpack_from("<III", entry, 68)
            stack += [(left, above), (right, above)]
            if entry[66] == 1:
                stack.append((below, f"{path}/"))
            elif entry[66] == 2:
                yield path, number

    def read(self, path: str) -> bytes:
        number = next((n for p, n in self.streams.items() if p.lower() == path.lower()), None)
        if number is None:
            raise Refused("OLE_STREAM_MISSING")
        start, size = struct.unpack_from("<IQ", self.entries[number], 116)
        if self.size == 512:
            size &= 0xFFFFFFFF
        if size > MAX_STREAM:
            raise Refused("LIMIT_STREAM_BYTES")
        found = self._small_chain(start) if size < self.cutoff else self._chain(start)
        if len(found) < size:
            raise Refused("OLE_CHAIN")
        return found[:size]


def expanded(data: bytes, at: int = 0) -> bytes:
    """The bytes of a compressed container: chunks of up to 4096 bytes, in which a bit tells whether a byte or a copy of
    bytes before comes next. A copy's offset has more bits the more bytes of its chunk are done: 4 for the first 16."""
    if data[at : at + 1] != b"\x01":
        raise Refused("VBA_CONTAINER")
    out, at = bytearray(), at + 1
    while at + 2 <= len(data):
        head = struct.unpack_from("<H", data, at)[0]
        if (head >> 12) & 7 != 3:
            raise Refused("VBA_CONTAINER")
        stop, at, done = min(len(data), at + (head & 0xFFF) + 3), at + 2, 0
        if not head >> 15:
            out += data[at : at + _CHUNK]
            at += _CHUNK
            continue
        bits = 4
        while at < stop:
            flags, at = data[at], at + 1
            if not flags:  # bytes only
                piece = data[at : min(at + 8, stop)]
                out += piece
                at, done = at + len(piece), done + len(piece)
            for bit in range(8) if flags else ():
                if at >= stop:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at, done = at + 1, done + 1
                    continue
                if at + 2 > stop or not done:
                    raise Refused("VBA_CONTAINER")
                token = data[at] | data[at + 1] << 8
                while done > 1 << bits:
                    bits += 1
                back, length = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                if back > done:
                    raise Refused("VBA_CONTAINER")
                piece = out[len(out) - back :]
                out += piece[:length] if length <= back else (piece * (length // back + 1))[:length]
                at, done = at + 2, done + length
            if len(out) > MAX_CODE:
                raise Refused("LIMIT_CODE_BYTES")
    return bytes(out)


#: Bits of a copy's offset at each place of a chunk.
_BITS = np.array([max(4, (k - 1).bit_length()) if k else 4 for k in range(_CHUNK)])


def _squeezed(chunk: bytes) -> bytes:
    """The items of a chunk, eight behind each byte of their kinds."""
    count = len(chunk)
    text, places = np.frombuffer(chunk, np.uint8).astype(np.int64), np.arange(count)
    lengths, old, bits = np.zeros(count, np.int64), np.zeros(count, np.int64), _BITS[:count]
    if count > 3:
        threes = text[:-2] << 16 | text[1:-1] << 8 | text[2:]
        order = np.argsort(threes, kind="stable")  # equal ones side by side, so the last place before is the one above
        again = order[1:][threes[order[1:]] == threes[order[:-1]]]
        old[again] = order[:-1][threes[order[1:]] == threes[order[:-1]]]
        again = again[again - old[again] <= 1 << bits[again]]
        lengths[again], length, most = 3, 3, np.minimum(count - places, (0xFFFF >> bits) + 3)
        while len(again := again[most[again] > length]) and len(again := again[text[old[again] + length] == text[again + length]]):
            length += 1
            lengths[again] = length
    steps, k, at = np.maximum(lengths, 1).tolist(), 0, []
    while k < count:
        at.append(k)
        k += steps[k]
    taken = np.array(at)
    copies = lengths[taken] > 0
    ends = np.cumsum(copies + 1)
    start = ends - copies - 1 + np.arange(len(taken)) // 8 + 1
    out = np.zeros(int(ends[-1]) + (len(taken) + 7) // 8, np.uint8)
    kinds = np.packbits(copies, bitorder="little")
    out[start[::8] - 1] = kinds
    tokens = (taken - old[taken] - 1) << (16 - bits[taken]) | (lengths[taken] - 3)
    out[start] = np.where(copies, tokens & 255, text[taken])
    out[start[copies] + 1] = tokens[copies] >> 8
    return out.tobytes()


#: Short chunks, such as directories of modules, often are the same in many projects.
_squeezed_once = functools.lru_cache(64)(_squeezed)


def compressed(data: bytes) -> bytes:
    """A compressed container of some bytes: each copy is of the last place where the next three bytes stood."""
    out = bytearray(b"\x01")
    for s in range(0, len(data), _CHUNK):
        chunk = data[s : s + _CHUNK]
        body = (_squeezed_once if len(chunk) < 1024 else _squeezed)(chunk)
        if len(body) > _CHUNK:  # such a chunk is kept as it is, filled up
            out += struct.pack("<H", 0x3000 | _CHUNK - 1) + chunk.ljust(_CHUNK, b"\0")
        else:
            out += struct.pack("<H", 0xB000 | len(body) - 1) + body
    return bytes(out)


def modules(project: bytes) -> Iterator[tuple[str, str]]:
    """(name, code) of the modules of a VBA project."""
    file = Compound(project)
    folder = next((p[: -len("dir")] for p in file.streams if p.lower().endswith("vba/dir")), None)
    if folder is None:
        raise Refused("VBA_DIRECTORY")
    listing, at, page, found = expanded(file.read(f"{folder}dir")), 0, "cp1252", []
    name = stream = None
    while at + 6 <= len(listing):
        kind, size = struct.unpack_from("<HI", listing, at)
        size = 6 if kind == 0x09 else size  # the version, which gives no size
        value, at = listing[at + 6 : at + 6 + size], at + 6 + size
        if kind == 0x03 and size == 2:
            page = f"cp{struct.unpack('<H', value)[0]}"
        elif kind == 0x19:
            name = value
        elif kind == 0x1A:
            stream = value
        elif kind == 0x31 and size == 4 and stream is not None:
            found.append((name or stream, stream, struct.unpack("<I", value)[0]))
            if len(found) > MAX_MODULES:
                raise Refused("LIMIT_MODULES")
        elif kind == 0x2B:
            name = stream = None
    try:
        "".encode(page)
    except LookupError:
        page = "cp1252"
    for name, stream, offset in found:
        yield name.decode(page, "replace"), expanded(file.read(folder + stream.decode(page, "replace")), offset).decode(page, "replace")


# --- packages ---------------------------------------------------------------------------------------------------------


def _macro_modules(p: Package) -> Rows:
    for part in sorted(n for n in p.names if n.lower().endswith("vbaproject.bin")):
        try:
            rows = list(modules(p.read(part)))
        except Refused as refused:
            if str(refused).startswith("LIMIT_TOTAL"):
                raise
            yield (part, None, None, str(refused))
            continue
        for name, code in sorted(rows):
            yield (part, name, code, None)


def macro_modules(files: DataFrame) -> DataFrame:
    """The modules of the macro projects of packages, by part and name: part, module, code, part_issue. A project that
    cannot be read is a row with the reason, and other parts are read all the same."""
    return extract(files, _macro_modules, "part string, module string, code string, part_issue string")


#: Procedures that run by themselves, calls that write, and calls that run something; fixed values.
RUNS_ALONE = (
    "AutoExec AutoOpen Auto_Open AutoClose Auto_Close AutoExit AutoNew Document_Open DocumentOpen Document_Close Document_BeforeClose Document_New NewDocument Workbook_Open Workbook_Activate Workbook_Close Workbook_BeforeClose"
).split()
WRITES = "FileCopy CopyFile Kill CreateTextFile VirtualAlloc RtlMoveMemory URLDownloadToFile URLDownloadToFileA WriteProcessMemory WriteText SaveToFile SaveAs FileSaveAs MkDir RmDir SaveSetting SetAttr".split()
EXECUTES = "Shell CreateObject GetObject SendKeys MacScript FollowHyperlink CreateThread ShellExecute ShellExecuteA ExecuteExcel4Macro SetTimer".split()


def _named(words: list[str]) -> str:
    return rf"(?i)\b({'|'.join(words)})\b"


def without_comments(code: Column) -> Column:
    """Code without texts in quotes, comments and continued lines."""
    plain = F.regexp_replace(code, r"(?m)[ \t]_[ \t]*\r?\n", " ")
    plain = F.regexp_replace(plain, r'"(?:[^"\r\n]|"")*"', '""')
    return F.regexp_replace(plain, r"(?mi)(?:'|^[ \t]*rem\b).*$", "")


def macro_verdicts(modules: DataFrame) -> DataFrame:
    """What the code of each module tells: auto_exec (it runs by itself), writes, executes, the words found, and suspicious:
    it runs by itself and writes or executes. Opening a file to write and declaring a function of a library count too.
    Modules without code say nothing (nulls)."""
    code = without_comments(F.col("code"))
    alone = code.rlike(_named(RUNS_ALONE))
    writes = code.rlike(_named(WRITES)) | code.rlike(r"(?i)\bOpen\b[^\r\n]+\b(Write|Append|Binary|Output|Random)\b")
    runs = code.rlike(_named(EXECUTES)) | code.rlike(r"(?i)\bDeclare\b[^\r\n]+\bLib\b")
    words = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(code, F.lit(_named([*RUNS_ALONE, *WRITES, *EXECUTES])), F.lit(1)), F.lower)))
    return modules.withColumns({"auto_exec": alone, "writes": writes, "executes": runs, "words": words, "suspicious": alone & (writes | runs)})


# --- writing ----------------------------------------------------------------------------------------------------------


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams under paths such as VBA/dir; storages are made as they are needed."""
    names: list[tuple[str, int, int]] = [("Root Entry", 5, -1)]  # name, kind, parent
    places: dict[str, int] = {"": 0}
    for path in streams:
        folder = ""
        for part in path.split("/")[:-1]:
            whole = f"{folder}{part}/"
            if whole not in places:
                places[whole] = len(names)
                names.append((part, 1, places[folder]))
            folder = whole
        places[path] = len(names)
        names.append((path.split("/")[-1], 2, places[folder]))
    small, small_table, big, starts = b"", [], [], {}
    for path, data in streams.items():
        if len(data) < CUTOFF:
            count = -(-len(data) // 64)
            starts[places[path]] = (len(small_table) if count else END, len(data))
            small_table += [len(small_table) + k + 1 for k in range(count - 1)] + [END] * bool(count)
            small += data.ljust(count * 64, b"\0")
        else:
            big.append((places[path], data))
    table: list[int] = []
    body = b""

    def put(data: bytes) -> int:
        nonlocal body, table
        count = -(-len(data) // 512)
        if not count:
            return END
        first = len(table)
        table += [first + k + 1 for k in range(count - 1)] + [END]
        body += data.ljust(count * 512, b"\0")
        return first

    for number, data in big:
        starts[number] = (put(data), len(data))
    starts[0] = (put(small), len(small))
    entries = b""
    for number, (name, kind, _) in enumerate(names):
        kids = [k for k, (_, _, above) in enumerate(names) if above == number]
        siblings = [k for k, (_, _, above) in enumerate(names) if above == names[number][2] and number]
        after = next((k for k in siblings if k > number), FREE)
        start, size = starts.get(number, (END if kind == 2 else 0, 0))
        text = name.encode("utf-16-le")
        entries += text.ljust(64, b"\0") + struct.pack("<HBBIII36xIQ", len(text) + 2, kind, 1, FREE, after, kids[0] if kids else FREE, start, size)
    directory = put(entries + b"\0" * (-len(entries) % 512))
    mini = put(struct.pack(f"<{len(small_table)}I", *small_table).ljust(-(-len(small_table) * 4 // 512) * 512, b"\xff"))
    own = 1
    while own * 128 < len(table) + own:
        own += 1
    if own > 109:
        raise Refused("LIMIT_STREAM_BYTES")
    first = len(table)
    table += [TABLE] * own
    body += struct.pack(f"<{len(table)}I", *table).ljust(own * 512, b"\xff")
    named = [first + k if k < own else FREE for k in range(109)]
    head = MAGIC + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, own, directory, 0, CUTOFF, mini, -(-len(small_table) * 4 // 512), END, 0)
    return head + struct.pack("<109I", *named) + body


def vba_project(code: dict[str, str], page: str = "cp1252") -> bytes:
    """A macro project of modules by their name."""
    record = lambda kind, value: struct.pack("<HI", kind, len(value)) + value
    listing = record(0x03, struct.pack("<H", int(page[2:]))) + struct.pack("<HIIH", 0x09, 4, 1, 1) + record(0x0F, struct.pack("<H", len(code)))
    streams = {}
    for name, text in code.items():
        own = name.encode(page)
        listing += record(0x19, own) + record(0x47, name.encode("utf-16-le")) + record(0x1A, own) + record(0x32, name.encode("utf-16-le")) + record(0x31, struct.pack("<I", 7)) + record(0x21, b"") + record(0x2B, b"")
        streams[f"VBA/{name}"] = b"\xcc" * 7 + compressed(text.encode(page, "replace"))
    return compound({"VBA/dir": compressed(listing + record(0x10, b""))} | streams | {"PROJECT": b"ID=1\r\n"})
