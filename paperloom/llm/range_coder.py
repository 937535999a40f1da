"""An adaptive context-mixing range coder for token ids, in blocks that are independent of one another.

A block's ids are cut into lanes of consecutive ids that are coded side by side, one id of every lane a step, so that
each step is a few numpy operations. The lanes share one model, which starts empty in every block and learns from all
of them: order-2 and order-1 contexts each predict an id with a confidence; how often predictions of such confidences
came true gives the weights with which the two predictions and the order-0 distribution are mixed. The id's share of
the mixture narrows the lane's range: first which part of the mixture, then, for order 0, which id.

Block: a header (see HEADER), the documents (ids, whether an id is null, counts of token ids), the number of 16-bit
words of each lane, the words, and a CRC-32 of all that. The header has a CRC-32 of the token ids too.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Format mark, version, vocabulary size, token ids, documents, lanes, CRC-32 of the ids (little-endian uint32).
HEADER = struct.Struct("<4sHIQIII")
MAGIC, VERSION = b"PLCM", 1
LANES, LANE_IDS = 8192, 256
CONTEXTS = 1 << 17
_SPLIT_BITS, _ID_BITS = 16, 22
_LIMIT = np.uint64(1 << 32)
_MASK = np.uint64((1 << 48) - 1)
_W = np.uint64(16)
_RENEW = 16


#: Change of a confidence by its value, after a wrong guess and (from 16) after a right one; a wrong guess of the
#: confidence 0 or 1 is replaced.
_CHANGE = np.array([-((t + 1) >> 1) for t in range(16)] + [int(t < 15) for t in range(16)], np.int64)


class _Model:
    """What both sides know before a step. Slots hold id * 16 + confidence."""

    def __init__(self, size: int):
        self.size = size
        self.second = np.zeros(CONTEXTS, np.int64)
        self.first = np.zeros(size + 1, np.int64)
        self.counts = np.zeros(size, np.int64)
        self.tally = np.tile(np.array([1, 1, 2], np.int64), (512, 1))
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.steps, self.due = 0, 1
        self._renew()

    def _renew(self):
        for kind, part, missed in self.kept:
            self.tally += np.bincount(kind * 3 + part, minlength=1536).reshape(512, 3)
            self.counts += np.bincount(missed, minlength=self.size)
        self.kept = []
        total = self.tally.sum(axis=1)
        room = (1 << _SPLIT_BITS) - 3
        self.bound2 = 1 + self.tally[:, 0] * room // total
        self.bound1 = self.bound2 + 1 + self.tally[:, 1] * room // total
        seen = np.concatenate([[0], np.cumsum(self.counts)])
        self.below = np.arange(self.size + 1) + seen * ((1 << _ID_BITS) - self.size) // max(1, int(seen[-1]))
        self.below[-1] = 1 << _ID_BITS

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose shares hold the values, looked up in rising order, which keeps to the processor's cache."""
        order = np.argsort(value)
        out = np.empty(len(value), np.int64)
        out[order] = np.searchsorted(self.below, value[order], side="right") - 1
        return out

    def predict(self, before: np.ndarray, before2: np.ndarray):
        self.slot = ((before * 0x9E3779B1 + before2 * 0x85EBCA77) >> 11) & (CONTEXTS - 1)
        self.before = before
        self.cell2, self.cell1 = self.second.take(self.slot), self.first.take(before)
        self.guess2, self.guess1 = self.cell2 >> 4, self.cell1 >> 4
        self.trust2, self.trust1 = self.cell2 & 15, self.cell1 & 15
        self.kind = (self.trust2 << 4) + self.trust1
        self.kind += (self.guess2 == self.guess1) * np.int64(256)
        return self.bound2.take(self.kind), self.bound1.take(self.kind)

    def learn(self, ids: np.ndarray, part: np.ndarray, missed: np.ndarray):
        fresh = (ids << 4) + 1
        for table, slot, cell, guess, trust in (
            (self.second, self.slot, self.cell2, self.guess2, self.trust2),
            (self.first, self.before, self.cell1, self.guess1, self.trust1),
        ):
            right = (ids == guess) * np.int64(16)
            new = cell + _CHANGE.take(trust + right)
            gone = np.nonzero((trust < 2) & (right == 0))[0]
            new[gone] = fresh[gone]
            table[slot] = new
        self.kept.append((self.kind, part, missed))
        self.steps += 1
        if self.steps >= self.due:
            self._renew()
            self.due = self.steps + min(_RENEW, self.steps)


def _shape(n: int) -> tuple[int, int]:
    """Lanes and ids in a lane (the last lanes may have fewer)."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    per = -(-n // lanes)
    return -(-n // per) if n else 0, per


def _coded(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    lanes, per = _shape(n)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    out, pos = np.zeros((lanes, 4 * per + 4), np.uint32), np.zeros(lanes, np.int64)
    model = _Model(size)
    padded = np.zeros(lanes * per, np.int64)
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, per).T)
    before = before2 = np.full(lanes, size, np.int64)

    def emit(rows, base, width, tight):
        while True:
            at = np.nonzero(tight)[0]
            if not len(at):
                return
            own = rows[at]
            spot = pos[own]
            out[own, spot] = (base[at] >> np.uint64(32)).astype(np.uint32)
            pos[own] = spot + 1
            base[at] = (base[at] << _W) & _MASK
            width[at] <<= _W
            tight = width < _LIMIT

    def narrow(rows, base, width):
        """Renew base and width of the given lanes: carries go to the word before, tight ranges give words out."""
        over = base > _MASK
        if over.any():
            own = rows[over]
            out[own, pos[own] - 1] += np.uint32(1)
            base &= _MASK
        emit(rows, base, width, width < _LIMIT)

    everyone = np.arange(lanes)
    edges = np.zeros((4, lanes), np.int64)  # of the three parts
    edges[3] = 1 << _SPLIT_BITS
    for t in range(per):
        m = -(-(n - t) // per)
        x = grid[t, :m]
        bound2, bound1 = model.predict(before[:m], before2[:m])
        hit2 = x == model.guess2
        hit1 = (x == model.guess1) & ~hit2
        part = 2 - hit1 - 2 * hit2.astype(np.int64)
        edges[1, :m], edges[2, :m] = bound2, bound1
        flat = part * lanes + everyone[:m]
        start, stop = edges.take(flat), edges.take(flat + lanes)
        unit = span[:m] >> np.uint64(_SPLIT_BITS)
        base, width = low[:m] + unit * start.view(np.uint64), unit * (stop - start).view(np.uint64)
        narrow(everyone[:m], base, width)
        rest = np.nonzero(part == 2)[0]
        missed = x[rest]
        if len(rest):
            lower = model.below.take(missed)
            unit = width[rest] >> np.uint64(_ID_BITS)
            new_base, new_width = base[rest] + unit * lower.view(np.uint64), unit * (model.below.take(missed + 1) - lower).view(np.uint64)
            narrow(rest, new_base, new_width)
            base[rest], width[rest] = new_base, new_width
        low[:m], span[:m] = base, width
        model.learn(x, part, missed)
        before, before2 = x, before[:m]
    for shift in (32, 16, 0):
        out[np.arange(lanes), pos] = ((low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint32)
        pos += 1
    for k in range(int(pos.max(initial=0)) - 1, 0, -1):  # carries
        out[:, k - 1] += out[:, k] >> np.uint32(16)
        out[:, k] &= np.uint32(0xFFFF)
    return pos.astype(np.uint32), out[np.arange(out.shape[1]) < pos[:, None]].astype("<u2")


def _decoded(words: np.ndarray, sizes: np.ndarray, n: int, size: int) -> np.ndarray:
    lanes, per = _shape(n)
    stream = np.concatenate([words, np.zeros(4, words.dtype)]).astype(np.uint64)
    pos = np.cumsum(sizes.astype(np.int64)) - sizes
    code = stream[pos] << np.uint64(32) | stream[pos + 1] << _W | stream[pos + 2]
    pos += 3
    span = np.full(lanes, (1 << 48) - 1, np.uint64)
    model = _Model(size)
    grid = np.zeros((per, lanes), np.int64)
    before = before2 = np.full(lanes, size, np.int64)

    def narrow(rows, base, width):
        tight = width < _LIMIT
        while True:
            at = np.nonzero(tight)[0]
            if not len(at):
                return
            own = rows[at]
            spot = pos[own]
            base[at] = base[at] << _W | stream.take(spot)
            width[at] <<= _W
            pos[own] = spot + 1
            tight = width < _LIMIT

    everyone = np.arange(lanes)
    edges = np.zeros((4, lanes), np.int64)
    edges[3] = 1 << _SPLIT_BITS
    for t in range(per):
        m = -(-(n - t) // per)
        bound2, bound1 = model.predict(before[:m], before2[:m])
        unit = span[:m] >> np.uint64(_SPLIT_BITS)
        value = np.minimum(code[:m] // unit, np.uint64((1 << _SPLIT_BITS) - 1)).view(np.int64)
        part = (value >= bound2).astype(np.int64) + (value >= bound1)
        edges[1, :m], edges[2, :m] = bound2, bound1
        flat = part * lanes + everyone[:m]
        start, stop = edges.take(flat), edges.take(flat + lanes)
        x = np.where(part == 0, model.guess2, model.guess1)
        base, width = code[:m] - unit * start.view(np.uint64), unit * (stop - start).view(np.uint64)
        narrow(everyone[:m], base, width)
        rest = np.nonzero(part == 2)[0]
        missed = rest
        if len(rest):
            unit = width[rest] >> np.uint64(_ID_BITS)
            value = np.minimum(base[rest] // unit, np.uint64((1 << _ID_BITS) - 1)).view(np.int64)
            missed = model.find(value)
            x[rest] = missed
            lower = model.below.take(missed)
            new_base, new_width = base[rest] - unit * lower.view(np.uint64), unit * (model.below.take(missed + 1) - lower).view(np.uint64)
            narrow(rest, new_base, new_width)
            base[rest], width[rest] = new_base, new_width
        code[:m], span[:m] = base, width
        model.learn(x, part, missed)
        grid[t, :m] = x
        before, before2 = x, before[:m]
    return grid.T.reshape(-1)[:n].astype("<u4")


def pack(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, size: int) -> bytes:
    """A block: the token ids of its documents one after another."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >= size:
        raise ValueError("an id is beyond the vocabulary")
    lanes, words = _coded(ids, size)
    head = HEADER.pack(MAGIC, VERSION, size, len(ids), len(doc_ids), len(lanes), zlib.crc32(ids.tobytes()))
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is not None for x in doc_ids], "u1").tobytes()
    body = head + names + np.asarray(counts, "<u4").tobytes() + lanes.astype("<u4").tobytes() + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(block: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """The token ids, document ids and counts of a block; ValueError if it is not whole."""
    if len(block) < HEADER.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("the block is damaged")
    magic, version, size, n, docs, lanes, check = HEADER.unpack_from(block)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a block of this format")
    at = HEADER.size
    names = np.frombuffer(block, "<i8", docs, at)
    known = np.frombuffer(block, "u1", docs, at + 8 * docs)
    counts = np.frombuffer(block, "<u4", docs, at + 9 * docs).astype(np.int64)
    sizes = np.frombuffer(block, "<u4", lanes, at + 13 * docs).astype(np.int64)
    words = np.frombuffer(block[at + 13 * docs + 4 * lanes : -4], "<u2")
    ids = _decoded(words, sizes, n, size) if n else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != check:
        raise ValueError("the ids of the block are damaged")
    return ids, [int(x) if k else None for x, k in zip(names, known, strict=True)], counts
