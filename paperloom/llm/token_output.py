"""Token-id output: texts are encoded, written as range-coded blocks in the order of their ids, and read back."""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import range_coder
from .arrow import as_bytes, text_batches
from .common import staged

TOKENIZER = "word_bpe_49k.json"
#: Appended to each document.
END_ID = 2
#: Token ids in a block, but for a document that has more by itself.
BLOCK_IDS = 1 << 21
#: Distinct chunks, and bytes of chunks, of which a worker keeps the ids.
CACHE, CACHE_BYTES = 1_000_000, 64 << 20

#: Classes of bytes: blank, letter, digit, mark, beyond ASCII.
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[128:] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
for _c in (b"az", b"AZ"):
    _CLASS[_c[0] : _c[1] + 1] = _LETTER


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _small_letters(words: pa.BinaryArray) -> np.ndarray:
    """Which chunks hold nothing but a to z."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    other = np.concatenate([[0], np.cumsum((raw < ord("a")) | (raw > ord("z")), dtype=np.int32)])
    return (np.diff(other[ends - ends[0]]) == 0) & (np.diff(ends) > 0)


def _stays(word: str) -> bool:
    """Whether the normalizer and the pattern leave a chunk beyond a to z as it is, one word (see WordEncoder)."""
    return not word.isascii() and word.isalpha() and word.lower() == word and max(word) < "\u0530" and is_normalized("NFC", word)


def chunks_of(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All texts cut into chunks whose ids, one after another, are those of the text; with the end of each text's chunks.

    The tokenizer's normalizer works inside words once white space is set apart, its pattern never matches across white
    space and drops it. No word goes from one class of ASCII characters to another, but for a contraction, which starts
    with an apostrophe; and a digit is a word. So blanks and these places cut. ASCII chunks are lower-cased, as the
    normalizer would. A text that may hold a special token is cut at blanks only and left as it is."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    kind = _CLASS[raw]
    for k, text in enumerate(texts):
        if b"<|" in text:
            own = kind[ends[k] - sizes[k] : ends[k]]
            own[own != _BLANK] = _OTHER
    word = kind != _BLANK
    new = word.copy()
    before, now = kind[:-1], kind[1:]
    plain = (before != _OTHER) & (now != _OTHER)
    apart = plain & ((before != now) | (now == _DIGIT)) & ~((raw[:-1] == ord("'")) & (now == _LETTER))
    new[1:] &= apart | (before == _BLANK)
    starts = np.nonzero(new)[0]
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    place = np.cumsum(word) - 1  # of a byte among those that are not blank
    offsets = np.append(place[starts], word.sum())
    data, other = raw[word], kind[word] == _OTHER
    if other.any():
        seen = np.concatenate([[0], np.cumsum(other, dtype=np.int32)])
        ascii_only = np.diff(seen[offsets]) == 0
        data = np.where(np.repeat(ascii_only, np.diff(offsets)), _LOWER[data], data)
    else:
        data = _LOWER[data]
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return array, np.searchsorted(starts, ends)


class WordEncoder:
    """Encodes texts through the tokenizers library, each distinct chunk once while the cache holds it.

    Chunks of lower-case letters of the Latin, Greek and Cyrillic blocks that are composed already stay as they are in
    the normalizer and are one word of the pattern, so they go to the tokenizer's model without these two steps."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.letters = Tokenizer.from_str(definition)
        self.letters.normalizer = None
        steps = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(steps)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(self.size)])
        self.clear()

    def clear(self):
        """Forget all chunks; the first place is that of the end of a text."""
        self.known = pa.array([], pa.binary())
        self.pool = np.full(1 << 16, END_ID, np.uint32)
        self.starts = np.zeros(1 << 12, np.int32)
        self.sizes = np.ones(1 << 12, np.int32)
        self.used = self.longest = 1

    def _add(self, words: pa.BinaryArray):
        """Give the next places to new chunks."""
        plain = _small_letters(words)
        rest = np.nonzero(~plain)[0]
        texts = words.take(pa.array(rest)).cast(pa.string()).to_pylist()
        stays = np.fromiter(map(_stays, texts), bool, len(texts))
        plain[rest[stays]] = True
        letters, others = np.nonzero(plain)[0], rest[~stays]
        flat, sizes = self._encoded(words.take(pa.array(letters)).cast(pa.string()))
        more, more_sizes = self._each([t for t, s in zip(texts, stays.tolist(), strict=True) if not s])
        flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, more_sizes])
        n = 1 + len(self.known)
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.starts) < n + len(words):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.pool[self.used : self.used + len(flat)] = flat
        places = n + np.concatenate([letters, others])
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.sizes[places] = sizes
        self.longest = max(self.longest, int(sizes.max(initial=1)))
        self.used += len(flat)
        self.known = pa.concat_arrays([self.known, words])

    def _places(self, chunks: pa.BinaryArray) -> np.ndarray:
        """The place of each chunk; those not known yet are added. Known and given chunks get their codes in one pass
        of Arrow, and only new ones become Python objects."""
        n = len(self.known)
        coded = pa.concat_arrays([self.known, chunks]).dictionary_encode()
        codes = np.asarray(coded.indices)
        place = np.zeros(len(coded.dictionary), np.int32)
        place[codes[:n]] = np.arange(1, n + 1)
        new = np.nonzero(place == 0)[0]
        if len(new):
            self._add(coded.dictionary.take(pa.array(new)))
            place[new] = np.arange(n + 1, n + 1 + len(new))
        return place.take(codes[n:])

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), self.pool.dtype, int(sizes.sum())), sizes

    def _encoded(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, many to a call: each ends with the only id of its that ends a word. If the counts
        of words and of ends should differ, they are encoded one by one."""
        if not len(texts):
            return self._each([])
        starts = np.append(np.arange(0, len(texts), 64), len(texts)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), texts), " ").to_pylist()
        got = [e.ids for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([np.array(ids, self.pool.dtype) for ids in got])
        sizes = np.diff(np.nonzero(self.ends_word[flat])[0] + 1, prepend=0)
        in_line = np.add.reduceat(self.ends_word[flat].astype(np.int64), np.cumsum([0, *map(len, got[:-1])]))
        whole = len(sizes) == len(texts) and int(sizes.sum()) == len(flat) and (in_line[:-1] == 64).all()
        return (flat, sizes) if whole else self._each(texts.to_pylist())

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with END_ID, and how many each has."""
        if len(self.known) > CACHE or self.known.nbytes > CACHE_BYTES:
            self.clear()
        chunks, counts = chunks_of(texts)
        index = self._places(chunks)
        index = np.insert(index, counts, 0)  # END_ID after each text
        size = self.sizes.take(index)
        stop = np.cumsum(size, dtype=np.int32 if self.longest * len(index) < 1 << 31 else np.int64)
        at = np.repeat(self.starts.take(index) - (stop - size), size)
        at += np.arange(len(at), dtype=at.dtype)
        return self.pool.take(at), np.diff(stop[counts + np.arange(len(texts))], prepend=0)


#: The encoders of a worker, which serve its later tasks too.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(definition: str) -> WordEncoder:
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = WordEncoder(definition)
    return _ENCODERS[definition]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts (null: empty) and write blocks under path, in ascending id order (null ids first; rows that
    repeat an id in the order of their text's hash). Each row of the files is one block of the range coder's format
    with its part, its number in the part and the ids of the part before it: Spark's writer commits them whole. A range
    partition orders the texts; a worker holds one block at a time. An empty table writes no block."""
    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()

    def run(batches):
        encoder = encoder_of(definition)
        part = TaskContext.get().partitionId()
        before, number = 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[int] = []

        def block():
            nonlocal before, number, names, held, counts
            ids = np.concatenate(held)
            payload = range_coder.pack(ids, names, np.array(counts), encoder.size)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())]
            before, number = before + len(ids), number + 1
            names, held, counts = [], [], []
            return pa.RecordBatch.from_arrays(row, ["part", "number", "before", "n_ids", "payload"])

        for batch in text_batches(batches, "text"):
            ids, sizes = encoder.encode(as_bytes(batch.column("text")))
            ends = np.cumsum(sizes)
            for name, size, end in zip(batch.column("id").to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                if names and sum(counts) + size > block_ids:
                    yield block()
                names.append(name)
                counts.append(size)
                held.append(ids[end - size : end])
        if names:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = "part int, number int, before bigint, n_ids bigint, payload binary"
    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_tokens(blocks: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """From the written blocks, a row per document: <id>, start (ids of all documents before it), n_tokens, ids_crc32
    (of the little-endian unsigned 32-bit ids) and, if asked for, ids. Damaged blocks are errors. The offsets of the
    parts are prefix sums over one number a part."""
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, names, counts = range_coder.unpack(batch.column("payload")[row].as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                start = batch.column("before")[row].as_py()
                out = [
                    pa.array([batch.column("part")[row].as_py()] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(start + ends - counts),
                    pa.array(counts), pa.array(crcs, pa.int64()),
                ]
                labels = ["part", "id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(out, labels)

    schema = "part int, id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    rows = blocks.select("part", "before", "payload").mapInArrow(run, schema).join(offsets, "part")
    return rows.select(F.col("id").alias(id_col), (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
