"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and decoding.

A text's lattice has an edge for every piece that matches at a place, and the byte pieces of a character that no piece
covers. Forward filtering gives each place the sum of the weights exp(alpha * score) of all ways to it; backward
sampling draws the last piece, then the one before, in proportion. As no piece holds a blank behind another character,
or a line break, the lattice falls apart into chunks of blanks and one word: each distinct chunk of a batch is
filtered once, all chunks side by side, and every occurrence is sampled on its own. Random numbers are a hash of seed,
row key, place in the row and step, so a row's segmentation depends on nothing else.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import list_array, text_batches

MODEL = "piece_bpe_32k.model"
#: The pieces' scores are minus their merge rank; this keeps several segmentations of a word likely.
ALPHA = 2e-4
#: Bytes of text that are in work at once.
WORK_BYTES = 1 << 20
MARK = "▁"
_CHUNK = re.compile(f" *[^ \n{MARK}]+| +|\n|{MARK}")
_BIG = np.float32(3.0)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@dataclass
class Pieces:
    """The vocabulary: a trie, whose steps (state, class of the next character) are in a hash table with open addresses
    that compares whole keys, and the bytes of each piece."""

    step_key: np.ndarray
    step_to: np.ndarray
    probes: int
    piece_of: np.ndarray
    class_of: np.ndarray
    score: np.ndarray
    byte_piece: np.ndarray
    pool: np.ndarray
    pool_start: np.ndarray
    pool_size: np.ndarray
    prefix: bool
    longest: int

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The next state of each, 0 where there is none."""
        key = state * np.int64(1 << 16) + kind
        slot = _slot(key)
        to = np.where(self.step_key[slot] == key, self.step_to[slot], 0)
        open_ = np.nonzero((self.step_key[slot] != key) & (self.step_key[slot] >= 0))[0]
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + probe) & (_SLOTS - 1)
            found = self.step_key[at]
            hit = found == key[open_]
            to[open_[hit]] = self.step_to[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return to


_SLOTS = 1 << 19


def _slot(key):
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)


def load(path: str | None = None) -> Pieces:
    """Read a model with byte fallback and no text normalisation (others are refused: decoding would lose text)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path or model_path(), "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("the model changes texts before it encodes them")
    names = [p.piece for p in model.pieces]
    normal = [k for k, p in enumerate(model.pieces) if p.type == 1]
    if any(MARK in names[k].lstrip(MARK) or "\n" in names[k] for k in normal):
        raise ValueError("a piece spans words")
    byte_piece = np.zeros(256, np.int32)
    data = []
    for k, p in enumerate(model.pieces):
        if p.type == 6:
            byte_piece[int(p.piece[3:5], 16)] = k
            data.append(bytes([int(p.piece[3:5], 16)]))
        else:
            data.append(p.piece.replace(MARK, " ").encode() if p.type == 1 else b"")
    chars = sorted({c for k in normal for c in names[k]})
    class_of = np.zeros(0x110000, np.uint16)
    class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    class_of[ord(" ")] = class_of[ord(MARK)]
    children: list[dict[str, int]] = [{}, {}]  # 0: dead, 1: root
    piece_of = [-1, -1]
    for k in normal:
        at = 1
        for c in names[k]:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                piece_of.append(-1)
            at = children[at][c]
        piece_of[at] = k
    keys = np.array([t * 65536 + int(class_of[ord(c)]) for t, steps in enumerate(children) for c in steps], np.int64)
    to = np.array([n for steps in children for n in steps.values()], np.int32)
    step_key, step_to, probes = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int32), 1
    for slot, key, n in zip(_slot(keys).tolist(), keys.tolist(), to.tolist(), strict=True):
        probe = 0
        while step_key[(slot + probe) & (_SLOTS - 1)] >= 0:
            probe += 1
        step_key[(slot + probe) & (_SLOTS - 1)], step_to[(slot + probe) & (_SLOTS - 1)] = key, n
        probes = max(probes, probe + 2)
    sizes = np.array([len(d) for d in data], np.int64)
    return Pieces(
        step_key, step_to, probes, np.array(piece_of, np.int32), class_of, np.array([p.score for p in model.pieces], np.float64), byte_piece,
        np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes, bool(spec.add_dummy_prefix), max(len(names[k]) for k in normal),
    )


def _lattices(pieces: Pieces, chunks: list[str], alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filter distinct chunks. For each place (the end of a character; places of a chunk follow one another): the piece
    that ends there by its number of characters, and the cumulative chances of those pieces. -2: bytes of a character.
    The third array is the last place of each chunk."""
    codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    classes = pieces.class_of[codes].astype(np.int64)
    # A mark in the text itself is not a blank: only its bytes stand for it.
    classes[codes == ord(MARK)] = 0
    total, width = len(codes), pieces.longest
    piece = np.full((total, width), -1, np.int32)
    limit = np.repeat(ends, lengths)
    start, state = np.arange(total), np.ones(total, np.int64)
    for k in range(width):
        ok = start + k < limit[start]
        start, state = start[ok], state[ok]
        if not len(start):
            break
        state = pieces.step(state, classes[start + k]).astype(np.int64)
        ok = state > 0
        start, state = start[ok], state[ok]
        found = pieces.piece_of[state]
        hit = found >= 0
        piece[start[hit] + k, k] = found[hit]
    bare = piece[:, 0] < 0
    single = bare & (codes < 128)
    piece[single, 0] = pieces.byte_piece[codes[single]]
    piece[bare & (codes >= 128), 0] = -2
    fallback = pieces.score.min(initial=0, where=pieces.score > -1e8) - 10
    weight = np.append(alpha * pieces.score, [alpha * fallback, -np.inf])  # [-2]: bytes, [-1]: none
    weight[pieces.byte_piece] = alpha * fallback
    reached = np.zeros(total + 1)
    chance = np.full((total, width), _BIG, np.float32)
    order = np.argsort(-lengths, kind="stable")
    by_length, first = -lengths[order], starts[order]
    for r in range(int(lengths.max(initial=0))):
        here = first[: int(np.searchsorted(by_length, -r, side="left"))] + r
        own = min(width, r + 1)
        p = piece[here, :own]
        used = int((p != -1).any(axis=0).nonzero()[0][-1]) + 1
        x = weight[p[:, :used]]
        for k in range(used):
            if r - k - 1 >= 0:
                x[:, k] += reached[here - k - 1]
        top = x.max(axis=1)
        e = np.exp(x - top[:, None])
        sums = e.cumsum(axis=1)
        reached[here] = top + np.log(sums[:, -1])
        c = (sums / sums[:, -1:]).astype(np.float32)
        c[sums >= sums[:, -1:]] = _BIG
        chance[here, :used] = c
    return piece, chance, ends - 1


def _uniform(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)


def sample(pieces: Pieces, texts: list[str], keys: list[str], alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts in a row, and where each text's ids end. An empty text has none."""
    split = [_CHUNK.findall(" " + t if pieces.prefix else t) if t else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    names: dict[str, int] = {}
    number = names.setdefault
    total = int(counts.sum())
    which = np.fromiter((number(c, len(names)) for cs in split for c in cs), np.int64, total)
    if not total:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    chunks = list(names)
    piece, chance, last = _lattices(pieces, chunks, alpha)
    first = last - np.fromiter(map(len, chunks), np.int64, len(chunks))
    base = np.array([xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass"), seed) for k in keys], np.uint64)
    place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    stream = np.repeat(base, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, stop, row = last[which], first[which], np.arange(total)
    steps = np.zeros(total, np.int64)
    drawn: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    turn = 0
    while len(row):
        u = _uniform(stream[row] + np.uint64((turn + 1) * 0xD1342543DE82EF95 % 2**64))
        k = (chance[at] <= u[:, None]).sum(axis=1)
        drawn.append((row, piece[at, k], at))
        steps[row] += 1
        at = at - k - 1
        on = at > stop
        row, at, stop = row[on], at[on], stop[on]
        turn += 1
    filled = np.cumsum(steps)
    ids, spot = np.empty(int(filled[-1]), np.int64), np.empty(int(filled[-1]), np.int64)
    for turn, (row, got, at) in enumerate(drawn):
        ids[filled[row] - 1 - turn], spot[filled[row] - 1 - turn] = got, at
    ends = np.concatenate([[0], filled])[np.cumsum(counts)]
    if (ids == -2).any():
        ids, ends = _spell(pieces, ids, spot, ends, "".join(chunks))
    return ids.astype(np.int32), ends


def _spell(pieces, ids, spot, ends, text):
    """Put the byte pieces of characters in place of -2."""
    odd = np.nonzero(ids == -2)[0]
    spelt = [np.frombuffer(text[s].encode("utf-8", "surrogatepass"), np.uint8) for s in spot[odd]]
    size = np.ones(len(ids), np.int64)
    size[odd] = [len(b) for b in spelt]
    stops = np.cumsum(size)
    out = np.repeat(ids, size)
    for k, b in zip(odd, spelt, strict=True):
        out[stops[k] - len(b) : stops[k]] = pieces.byte_piece[b]
    return out, np.concatenate([[0], stops])[ends]


def join_pieces(pieces: Pieces, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each ends; the blank that the model puts first is taken off."""
    size = pieces.pool_size[ids]
    stops = np.cumsum(size)
    where = np.repeat(pieces.pool_start[ids] - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)
    data = pieces.pool[where]
    text_ends = np.concatenate([[0], stops])[ends]
    if pieces.prefix:
        starts = np.concatenate([[0], text_ends[:-1]])
        some = text_ends > starts
        keep = np.ones(len(data), bool)
        keep[starts[some]] = False
        data = data[keep]
        text_ends = text_ends - np.cumsum(some)
    return data, text_ends


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """<id>, text, ids: one sampled segmentation of each whole text, the same in every run.

    The row key is the id: rows that repeat an id and a text get the same ids; a null id is a key of its own. Null and
    empty texts have no ids (text is then empty). An empty table gives no rows. Other columns are not read."""
    packed = pickle.dumps(load(path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces = pickle.loads(packed)
        for batch in text_batches(batches, "text", WORK_BYTES):
            keys = [str(k) for k in batch.column("id").to_pylist()]
            ids, ends = sample(pieces, batch.column("text").to_pylist(), keys, alpha, seed)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), list_array(ids, ends, pa.int32())], [id_col, "text", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, text string, ids array<int>")


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """All columns and out_col, which takes the place of a column of its name: the text of the ids (null ids: empty
    text). Ids that spell no valid UTF-8 are decoded with replacement characters."""
    packed = pickle.dumps(load(path))
    encoded = encoded.drop(out_col) if out_col != ids_col else encoded
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{out_col}` string"])

    def run(batches):
        pieces = pickle.loads(packed)
        for whole in batches:
            for batch in (whole.slice(s, 256) for s in range(0, whole.num_rows, 256)):
                lists = batch.column(ids_col)
                sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
                data, ends = join_pieces(pieces, np.asarray(lists.flatten()), np.cumsum(sizes))
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                text = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                try:
                    text = text.cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([b.decode("utf-8", "replace") for b in text.to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, out_col])

    return encoded.mapInArrow(run, schema)
