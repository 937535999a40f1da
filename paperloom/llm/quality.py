"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics and traversal are numpy over Arrow batches; trees are complete and flattened into arrays, so that all rows
go down all trees one level at a time. The trees learn from all labelled rows: a few are fitted on the driver, more of them
where they lie, from counts of their bins.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, text_batches
from .common import free, small, staged

#: Labelled rows up to which the trees are fitted on the driver.
TRAIN_ROWS = 20_000
#: Of the 64 bits of a number those that do not count where all rows are counted for quantiles: 128 cells a power of two.
GRID_BITS = 45
#: Gradients are summed as whole numbers of this part of one, so that sums do not depend on how rows are dealt.
UNIT = 2.0**30
#: Trees after which rows are written anew with their sums; between, each pass goes down the trees since.
TREES_A_TABLE = 15
TREES, DEPTH, BINS, RATE = 120, 4, 64, 0.1
THRESHOLD = 0.3

_BYTE_SETS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" ",
    "line": b"\n",
    "stop": b".!?",
    "comma": b",;:",
    "bar": b"|",
    "sign": b"#$%&*@^~+=",
    "bracket": b"()[]{}<>",
    "slash": b"/\\_-",
    "quote": b"\"'`",
    "high": bytes(range(128, 256)),
    "control": bytes(x for x in range(32) if x not in (9, 10, 13)),
}
NAMES = [
    "bytes", "words", "lines", *_BYTE_SETS, "entropy", "word_length", "word_length_sd", "long_words", "short_words",
    "distinct_words", "top_word", "top_three", "distinct_lines", "line_words", "short_lines", "ended_lines",
    "capital_words", "signed_words", "distinct_triples",
]
_SETS = np.zeros((256, len(_BYTE_SETS)))
for _k, _chars in enumerate(_BYTE_SETS.values()):
    _SETS[list(_chars), _k] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each whole text; an empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for row, text in enumerate(texts):
        if text:
            out[row] = _statistics(text)
    return out


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[list(_BYTE_SETS["upper"])] = True
_MARK[[x for x in range(33, 127) if not chr(x).isalnum()]] = True


def _statistics(text: bytes) -> list[float]:
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    size = len(text)
    p = counts[counts > 0] / size
    edge = np.empty(size + 2, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = _SPACE[raw]
    starts = np.nonzero(edge[:-1] & ~edge[1:])[0]
    ends = np.nonzero(~edge[:-1] & edge[1:])[0]
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    lengths = ends - starts if words else np.zeros(1)
    seen = sorted(Counter(words).values())
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    line_words = np.fromiter((x.count(b" ") for x in lines), np.int64, len(lines)) + 1
    return [
        size, len(words), len(lines), *(counts @ _SETS / size), float(-(p * np.log2(p)).sum()),
        lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths < 3).mean(),
        len(seen) / n, sum(seen[-1:]) / n, sum(seen[-3:]) / n, len(set(lines)) / m, len(words) / m,
        (line_words < 4).sum() / m, sum(x.endswith((b".", b"!", b"?")) for x in lines) / m,
        _UPPER[raw[starts]].sum() / n, _MARK[raw[ends - 1]].sum() / n,
        triples / max(1, n - 2),
    ]


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of inner node k of tree t at [t, k], children at 2k+1 and
    2k+2; a row goes right where its value is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range(inner.bit_length()):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        logit = self.base + self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-logit))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = 5.0, least: int = 20) -> Trees:
    """Boosted trees for the logistic loss. Without rows, or with one class only, a constant (0.5 without rows)."""
    inner = 2**depth - 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(y) < 2 * least or len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)])
    features, thresholds, leaves = [], [], []
    logit = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node = at - first
            sums = ([np.bincount(node * bins + column, v, width * bins).reshape(width, bins) for v in (g, h, np.ones(len(y)))] for column in binned)
            chosen, code = _splits(sums, [len(q) for q in cuts], width, l2, least)
            feature[first : first + width] = chosen
            threshold[first : first + width] = [cuts[f][k] if k >= 0 else np.inf for f, k in zip(chosen, code, strict=True)]
            right = x[np.arange(len(y)), feature[at]] > threshold[at]
            at = 2 * at + 1 + right
        spot = at - inner
        value = -rate * np.bincount(spot, g, inner + 1) / (np.bincount(spot, h, inner + 1) + l2)
        logit += value[spot]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(np.stack(features), np.stack(thresholds), np.stack(leaves), base)


def _splits(sums, n_cuts: list[int], width: int, l2: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `width` nodes the feature and the number of the cut that gain most, 0 and -1 where nothing gains; sums
    are for each feature the sums (g, h, rows) by node and bin."""
    best, feature, code = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1)
    for f, own in enumerate(sums):
        (gl, hl, nl), (gt, ht, nt) = (c := [s.cumsum(axis=1) for s in own]), (s[:, -1:] for s in c)
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(nl < least) | (nt - nl < least)] = 0
        gain[:, n_cuts[f] :] = 0
        k = gain.argmax(axis=1)
        top = gain[np.arange(width), k]
        better = top > best + 1e-9
        best[better], feature[better], code[better] = top[better], f, k[better]
    return feature, code


# --- fitting where the rows are -------------------------------------------------------------------------------------


def _cells(x: np.ndarray) -> np.ndarray:
    """The cell of each number; cells are in the order of the numbers."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits) >> GRID_BITS


def _cell_end(cells: np.ndarray) -> np.ndarray:
    """The largest number of each cell."""
    bits = ((cells + 1) << GRID_BITS) - 1
    return np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits).view(np.float64)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten()).reshape(batch.num_rows, -1)


def _cuts(rows: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """The quantiles of each feature over all rows, as ends of cells: rows are counted by cell, and only these counts,
    whose number the cells bound, come to the driver."""
    half, span = 1 << (63 - GRID_BITS), 1 << (64 - GRID_BITS)

    def run(batches):
        held = np.zeros((2, 0), np.int64)
        for batch in batches:
            cells = _cells(_stats_of(batch)) + half
            cells, counts = np.unique(cells + span * np.arange(cells.shape[1]), return_counts=True)
            cells, at = np.unique(np.concatenate([held[0], cells]), return_inverse=True)
            held = np.stack([cells, np.bincount(at, np.concatenate([held[1], counts]), len(cells)).astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["cell", "n"])

    got = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    cells, counts = (np.asarray(got.column(k)) for k in ("cell", "n"))
    out = []
    for f in np.unique(cells // span):
        own, below = cells[cells // span == f] % span - half, np.cumsum(counts[cells // span == f])
        wanted = np.searchsorted(below, np.linspace(0, 1, bins + 1)[1:-1] * n, side="left")
        out.append(np.unique(_cell_end(own[np.minimum(wanted, len(own) - 1)])))
    return out


def _node(codes: np.ndarray, feature: np.ndarray, code: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after some levels of one tree; a row goes right where its bin is above the code."""
    at, rows = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
    for _ in range(levels):
        at = 2 * at + 1 + (codes[feature[at], rows] > code[at])
    return at


def fit_rows(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = 5.0, least: int = 20) -> Trees:
    """The trees of `fit` from a table (y, stats) of any size. Rows stay in tasks as bins of a byte each; every level of a
    tree is one pass over all of them, of which the sums by node, feature and bin come to the driver. The sums are of
    whole numbers, so that a model does not depend on how its rows are dealt."""
    inner = 2**depth - 1
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    mean = float(np.clip(good / n, 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    if n < 2 * least or good in (0, n):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = _cuts(rows, n, bins)
    schema = "codes binary, y binary, logit binary"

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                codes = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, _stats_of(batch).T, strict=True)]).astype(np.uint8)
                y = np.asarray(batch.column("y")).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, y, np.full(len(y), base))], ["codes", "y", "logit"])

    def read(batches, since):
        """Bins, labels and logits of some thousand rows at a time, the trees since the table was written put in."""
        for batch in batches:
            for codes, y, logit in zip(*(batch.column(k) for k in ("codes", "y", "logit")), strict=True):
                y, logit = np.frombuffer(y.as_py(), np.uint8), np.frombuffer(logit.as_py()).copy()
                codes = np.frombuffer(codes.as_py(), np.uint8).reshape(len(cuts), len(y))
                for feature, code, leaf in since:
                    logit += leaf[_node(codes, feature, code, depth) - inner]
                yield codes, y, logit

    def moved(table, since):
        def run(batches):
            for codes, y, logit in read(batches, since):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, y, logit)], ["codes", "y", "logit"])

        return staged(table.mapInArrow(run, schema), "boosted")

    def sums(table, since, feature, code, level):
        first, width = 2**level - 1, 2**level

        def run(batches):
            out = np.zeros((len(cuts), 3, width, bins), np.int64)
            for codes, y, logit in read(batches, since):
                p = 1 / (1 + np.exp(-logit))
                parts = (np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT), np.ones(len(y)))
                node = (_node(codes, feature, code, level) - first) * bins
                for f, column in enumerate(codes):
                    cell = node + column
                    for k, v in enumerate(parts):
                        out[f, k] += np.bincount(cell, v, width * bins).reshape(width, bins).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        got = table.mapInArrow(run, "sums binary").toArrow().column("sums")
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in got).reshape(len(cuts), 3, width, bins)
        return total / np.array([UNIT, UNIT, 1.0])[:, None, None]

    table, since, done = staged(rows.select("y", "stats").mapInArrow(binned, schema), "binned"), [], []
    for t in range(trees):
        if len(since) == TREES_A_TABLE:
            old, table, since = table, moved(table, since), []
            free(old)
        feature, code = np.zeros(inner, np.int64), np.full(inner, 255)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            total = sums(table, since, feature, code, level)
            feature[first : first + width], k = _splits(total, [len(q) for q in cuts], width, l2, least)
            code[first : first + width] = np.where(k >= 0, k, 255)
        own = total[feature[first:], :, np.arange(width)]  # of each last node, (g, h, rows) by bin of its feature
        left = np.where(np.arange(bins) <= code[first:, None, None], own, 0).sum(axis=2)
        ends = np.stack([left, own.sum(axis=2) - left], axis=1).reshape(2 * width, 3)
        since.append((feature, code, -rate * ends[:, 0] / (ends[:, 1] + l2)))
        done.append(since[-1])
    free(table)
    threshold = [[cuts[f][k] if k < 255 else np.inf for f, k in zip(feature, code, strict=True)] for feature, code, _ in done]
    return Trees(np.stack([f for f, _, _ in done]), np.array(threshold, float), np.stack([v for _, _, v in done]), base)


# --- training and scoring -------------------------------------------------------------------------------------------


def bounded_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """The rows with the smallest hash of id: the same ones in every run."""
    return labelled.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("train")), "id").limit(rows)


def training_labels(labels: DataFrame, label_col: str, id_col: str, folds: int, held: int, rows: int | None = None) -> DataFrame:
    """(id, y) of the labelled rows that may be learned from: null ids and labels are left out, of repeated ids the
    largest label counts, and ids whose crc32 leaves the remainder `held` by `folds` are held out. All of them, or as many
    as the caller asks for. A written table, which is broadcast if it is small."""
    labelled = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    labelled = labelled.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    labelled = labelled.where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held)
    return small(staged(labelled if rows is None else bounded_sample(labelled, rows), "labels"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0, rows: int | None = None) -> Trees:
    """Fit trees on all labelled documents outside the held-out fold, or on as many as `rows` asks for. The statistics of
    TRAIN_ROWS documents at most come to the driver; more are fitted where they lie. An id counts once: of rows that
    repeat it, the one with the smallest statistics."""
    wanted = training_labels(labels, label_col, id_col, folds, held, rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, y int, stats array<double>"

    def run(batches):
        for batch in text_batches(batches, "text"):
            stats = statistics(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array(list(stats), pa.list_(pa.float64()))], ["id", "y", "stats"]
            )

    once = sample.select("id", "y", "text").mapInArrow(run, schema).groupBy("id").agg(F.min("y").alias("y"), F.min("stats").alias("stats"))
    once = staged(once, "statistics")
    try:
        if once.count() > TRAIN_ROWS:
            return fit_rows(once)
        got = once.orderBy("id", "stats").toArrow()
    finally:
        free(once)
    x = np.array(got.column("stats").to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, np.array(got.column("y").to_pylist(), float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """<id>, score, predicted of each row: null texts count as empty and have a score too; repeated rows are scored
    alike; an empty table gives no rows; other columns are not read."""
    packed = pickle.dumps(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"

    def run(batches):
        trees = pickle.loads(packed)
        for batch in text_batches(batches, "text"):
            scores = trees.score(statistics(as_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id_col, "score", "predicted"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns."""
    packed = pickle.dumps(model)

    def run(batches):
        trees = pickle.loads(packed)
        for batch in text_batches(batches, text_col):
            texts = as_bytes(batch.column(text_col))
            yield batch.filter(pa.array(trees.score(statistics(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
