"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Texts of more bytes than this are handed to a kernel in a batch of their own.
BATCH_BYTES = 8 << 20


def text_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of a text column stay near limit: memory is bounded by it and the longest text."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(_offsets(batch.column(column)), dtype=np.int64))
        start = 0
        ends = np.cumsum(sizes)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(array: pa.Array) -> bytes:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, kind)
    return raw.astype(np.int64).tobytes()


def as_bytes(array: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def list_array(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the end of each row."""
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = ends
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Cut sorted batches where the integer keys change: yields batches of whole groups with the bounds of their groups.
    Rows of a group that goes on in the next batch are held back for it."""

    def cuts_of(batch):
        changed = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in keys:
            column = np.asarray(batch.column(k))
            changed |= column[1:] != column[:-1]
        return np.nonzero(changed)[0] + 1

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last, first = held[-1], batch
            same = all(last.column(k)[last.num_rows - 1] == first.column(k)[0] for k in keys)
            if same and not len(cuts_of(batch)):
                held.append(batch)
                continue
        batch = _joined([*held, batch])
        cuts = cuts_of(batch)
        end = int(cuts[-1]) if len(cuts) else 0
        held = [batch.slice(end)]
        if end:
            yield batch.slice(0, end), np.concatenate([[0], cuts])
    if held:
        batch = _joined(held)
        yield batch, np.concatenate([[0], cuts_of(batch), [batch.num_rows]])


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
