"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to embedding rows; filters of several widths slide over a document's words, each keeps its largest
response (max pooling, with a floor of 0), and a logistic layer scores the pooled values. It learns from all labelled
rows: a few train it on the driver, more of them in shards, whose networks are averaged after each epoch. The thresholds of
the operator are calibrated by language.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, list_array, text_batches
from .common import free, staged
from .quality import training_labels

#: Labelled rows and words of them up to which the classifier is trained on the driver, and rows of a shard beyond.
TRAIN_ROWS = 12_000
TRAIN_WORDS = 50_000_000
#: Words of a shard.
SHARD_WORDS = 5_000_000
#: Numbers of a network that are averaged in one group, and cells of scores that thresholds are chosen between.
BLOCK, CELLS = 8192, 10_000
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 6, 128, 0.05
#: Words of fewer training documents than this keep the zero embedding: they cannot be learned by heart.
LEAST_DOCS = 4
#: And words whose share of toxic documents is within so many standard deviations of the usual one.
LEAST_Z = 2.0
THRESHOLD = 0.3

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word of the whole texts (runs of letters and digits, A-Z lower-cased), and each text's end."""
    crc, mask = zlib.crc32, BUCKETS - 1
    words = [_WORD.findall(t.lower()) for t in texts]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    flat = np.fromiter((crc(w) for ws in words for w in ws), np.uint32, int(ends[-1]) if len(ends) else 0)
    return (flat & np.uint32(mask)).astype(np.int32), ends


@dataclass
class Network:
    """rows: embeddings of the buckets in `known` (sorted), all others are zero; kernels: by width, (width, SIZE,
    FILTERS); bias: by width; weight, base: the logistic layer; thresholds: by language, "" for all others."""

    known: np.ndarray
    rows: np.ndarray
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    base: float
    thresholds: dict[str, float]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each bucket (0: unknown), and for each slot its response at each place of each kernel."""
        slot = np.zeros(BUCKETS, np.int32)
        slot[self.known] = np.arange(1, len(self.known) + 1)
        places = np.concatenate([k.transpose(1, 0, 2).reshape(SIZE, -1) for k in self.kernels], axis=1)
        return slot, np.concatenate([np.zeros((1, places.shape[1]), np.float32), (self.rows @ places).astype(np.float32)])

    def pooled(self, slots: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text (floor 0) and the word at which it begins (-1: the floor).

        A window without a known word gives the filter's bias wherever it is, so the first of each text stands for all
        of them; a text's end cuts its windows off, and no window depends on the texts beside it."""
        docs, width = len(ends), len(WIDTHS) * FILTERS
        best, where = np.zeros((docs, width), np.float32), np.full((docs, width), -1, np.int64)
        hits = np.nonzero(slots)[0]
        begins = np.concatenate([[0], ends[:-1]]) if docs else ends
        of_hit = begins[np.searchsorted(ends, hits, side="right")]
        begun = np.zeros(len(slots), bool)
        for k in range(max(WIDTHS)):
            begun[hits[hits - k >= of_hit] - k] = True
        bare = np.append(np.nonzero(~begun)[0], len(slots))
        bare = bare[np.searchsorted(bare, begins)]
        begun[bare[bare < ends]] = True
        starts = np.nonzero(begun)[0]
        if not len(starts):
            return best, where
        doc = np.searchsorted(ends, starts, side="right")
        padded = np.concatenate([slots, np.zeros(max(WIDTHS), slots.dtype)])
        response, column = np.zeros((len(starts), width), np.float32), 0
        for k, w in enumerate(WIDTHS):
            part = response[:, k * FILTERS : (k + 1) * FILTERS]
            part += self.bias[k]
            for place in range(w):
                inside = np.where(starts + place < ends[doc], padded[starts + place], 0)
                part += table[inside, column : column + FILTERS]
                column += FILTERS
        groups = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
        top = np.maximum.reduceat(response, groups, axis=0)
        best[doc[groups]] = np.maximum(top, 0)
        return best, self._places(response, starts, groups, doc, top, where)

    @staticmethod
    def _places(response, starts, groups, doc, top, where):
        of = np.cumsum(np.concatenate([[0], np.diff(doc) != 0]))
        r, f = np.nonzero((response == top[of]) & (response > 0))
        where[doc[r[::-1]], f[::-1]] = starts[r[::-1]]  # the first place stays
        return where

    def score(self, slots: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
        logit = self.pooled(slots, ends, table)[0] @ self.weight + self.base
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -50, 50)))


def fit(ids: np.ndarray, ends: np.ndarray, y: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> Network:
    """Train by AdaGrad on the logistic loss, positives weighted up; deterministic. One class only: a constant."""
    rng = np.random.default_rng(seed)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    doc = np.repeat(np.arange(len(ends)), ends - starts)
    pairs = np.unique(doc * np.int64(BUCKETS) + ids)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    held_by = np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    toxic = np.bincount(pairs % BUCKETS, y[pairs // BUCKETS], BUCKETS)
    known = np.nonzero(_telling(held_by, toxic, mean))[0]
    net = _start(known, mean, rng)
    if len(np.unique(y)) < 2 or not len(known):
        net.weight[:] = 0
        return net
    net.rows[:] = rng.normal(0, 0.01, net.rows.shape)
    slot = np.zeros(BUCKETS, np.int32)
    slot[known] = np.arange(1, len(known) + 1)
    square = _squares(net)
    for epoch in range(epochs):
        _epoch(net, square, slot[ids], starts, ends, y, mean, rng, epoch < epochs - 1)
    return net


def _start(known: np.ndarray, mean: float, rng) -> Network:
    return Network(
        known, np.zeros((len(known), SIZE), np.float32), [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS], np.abs(rng.normal(0, 0.5, len(WIDTHS) * FILTERS)).astype(np.float32), float(np.log(mean / (1 - mean))), {"": THRESHOLD},
    )


def _telling(held_by, toxic, mean: float):
    """Whether words are learned, by the training documents that hold them and the toxic ones among these."""
    return (held_by >= LEAST_DOCS) & ((toxic - held_by * mean) ** 2 > LEAST_Z**2 * mean * (1 - mean) * held_by)


def _squares(net: Network) -> dict[str, np.ndarray]:
    """AdaGrad's sums before the first step."""
    sizes = {"rows": (len(net.known), 1), "weight": net.weight.shape, "base": (1,)}
    sizes |= {f"k{k}": x.shape for k, x in enumerate(net.kernels)} | {f"b{k}": x.shape for k, x in enumerate(net.bias)}
    return {k: np.full(x, 1e-2, float if k == "base" else np.float32) for k, x in sizes.items()}


def _epoch(net: Network, square: dict[str, np.ndarray], all_slots, starts, ends, y, mean: float, rng, drop: bool) -> None:
    """One epoch over documents, in batches; words are left out at random if `drop` says so."""
    gain = np.where(y > 0, min(4.0, (1 - mean) / mean), 1.0)

    def step(name, value, grad):
        square[name] = square[name] + grad**2
        value -= RATE * grad / np.sqrt(square[name])

    order = rng.permutation(len(y))
    for s in range(0, len(order), BATCH):
        take = order[s : s + BATCH]
        slots = np.concatenate([all_slots[starts[d] : ends[d]] for d in take])
        stops = np.cumsum(ends[take] - starts[take])
        if drop:
            slots = np.where(rng.random(len(slots)) < 0.1, 0, slots)
        places = np.concatenate([k.transpose(1, 0, 2).reshape(SIZE, -1) for k in net.kernels], axis=1)
        table = np.concatenate([np.zeros((1, places.shape[1]), np.float32), net.rows @ places])
        pooled, where = net.pooled(slots, stops, table)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.weight + net.base, -50, 50)))
        err = ((p - y[take]) * gain[take] / len(take)).astype(np.float32)
        grad_rows = np.zeros_like(net.rows)
        padded = np.concatenate([slots, np.zeros(max(WIDTHS), slots.dtype)])
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            at = where[:, own]
            g = np.where(at >= 0, err[:, None] * net.weight[own], 0)
            grad_kernel = np.zeros_like(net.kernels[k])
            for place in range(w):
                inside = np.where((at >= 0) & (at + place < stops[:, None]), padded[np.maximum(at, 0) + place], 0)
                d, f = np.nonzero(inside)
                row = inside[d, f] - 1
                np.add.at(grad_rows, row, g[d, f, None] * net.kernels[k][place].T[f])
                np.add.at(grad_kernel[place].T, f, g[d, f, None] * net.rows[row])
            step(f"k{k}", net.kernels[k], grad_kernel + 1e-5 * net.kernels[k])
            step(f"b{k}", net.bias[k], g.sum(axis=0))
        step("weight", net.weight, pooled.T @ err + 1e-4 * net.weight)
        base = np.array([net.base])
        step("base", base, np.array([err.sum()]))
        net.base = float(base[0])
        moved = np.nonzero(np.abs(grad_rows).sum(axis=1))[0]
        square["rows"][moved] += (grad_rows[moved] ** 2).mean(axis=1, keepdims=True)
        net.rows[moved] -= RATE * grad_rows[moved] / np.sqrt(square["rows"][moved]) + 1e-4 * net.rows[moved]


# --- training where the rows are --------------------------------------------------------------------------------------


def _packed(net: Network, square: dict[str, np.ndarray]) -> np.ndarray:
    """All numbers of a network and its sums in one array."""
    parts = [net.rows, *net.kernels, *net.bias, net.weight, np.array([net.base]), *(square[k] for k in sorted(square))]
    return np.concatenate([x.ravel().astype(float) for x in parts])


def _unpacked(values: np.ndarray, net: Network) -> tuple[Network, dict[str, np.ndarray]]:
    """A network of the shapes of `net`, and its sums, from their numbers."""
    at = 0

    def take(like):
        nonlocal at
        at += like.size
        return values[at - like.size : at].reshape(like.shape).astype(like.dtype)

    rows, kernels, bias = take(net.rows), [take(k) for k in net.kernels], [take(b) for b in net.bias]
    weight, base = take(net.weight), float(take(np.zeros(1))[0])
    sums = _squares(net)
    return Network(net.known, rows, kernels, bias, weight, base, dict(net.thresholds)), {k: take(sums[k]) for k in sorted(sums)}


def _vocabulary(docs: DataFrame, mean: float) -> np.ndarray:
    """The buckets of the words that are learned, by all documents (y, words)."""

    def run(batches):
        held, toxic = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            words, y = batch.column("words"), np.asarray(batch.column("y"))
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(words.value_lengths()))
            pairs = np.unique(doc * np.int64(BUCKETS) + np.asarray(words.flatten()))
            held += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            toxic += np.bincount(pairs[y[pairs // BUCKETS] > 0] % BUCKETS, minlength=BUCKETS)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at]), pa.array(toxic[at])], ["bucket", "held", "toxic"])

    counts = docs.select("y", "words").mapInArrow(run, "bucket long, held long, toxic long").groupBy("bucket").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic"))
    return np.sort(np.asarray(counts.where(_telling(F.col("held"), F.col("toxic"), mean)).select("bucket").toArrow().column(0))).astype(np.int64)


def fit_rows(docs: DataFrame, seed: int = 1, epochs: int = EPOCHS) -> Network:
    """Train on a table (id, y, words) of any size. Documents are dealt by their ids over shards of TRAIN_ROWS documents
    and SHARD_WORDS words or so. In each epoch every shard goes on from the common network; what its numbers were moved by
    is averaged over the shards that moved them. Words are chosen by all documents."""
    n, good, words = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0))).first()
    mean = float(np.clip(good / n, 1e-3, 1 - 1e-3)) if n else 0.5
    known, rng = _vocabulary(docs, mean), np.random.default_rng(seed)
    if good in (0, n) or not len(known):  # a constant
        net = fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
        net.base = float(np.log(mean / (1 - mean)))
        return net
    net = _start(known, mean, rng)
    net.rows[:] = rng.normal(0, 0.01, net.rows.shape)
    shards = max(-(-n // TRAIN_ROWS), -(-words // SHARD_WORDS), 1)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        words, slot = table.column("words").combine_chunks(), np.zeros(BUCKETS, np.int32)
        slot[known] = np.arange(1, len(known) + 1)
        columns = (slot[np.asarray(words.flatten())], np.cumsum(np.asarray(words.value_lengths()).astype(np.int64)), np.asarray(table.column("y")).astype(np.uint8))
        return pa.table([table.column("shard")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=["shard", "slots", "ends", "y"])

    shard = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("shard")), F.lit(shards)).cast("int")
    dealt = docs.select(shard.alias("shard"), "id", "y", "words").groupBy("shard").applyInArrow(pack, "shard int, slots binary, ends binary, y binary")
    dealt = staged(dealt.repartitionByRange(min(shards, 4096), "shard"), "shards")
    state = _packed(net, _squares(net))
    for epoch in range(epochs):
        state = state + _moves(dealt, net, state, seed, epoch, mean, epoch < epochs - 1)
    free(dealt)
    return _unpacked(state, net)[0]


def _moves(dealt: DataFrame, net: Network, state: np.ndarray, seed: int, epoch: int, mean: float, drop: bool) -> np.ndarray:
    """By how much an epoch moves each number of the common network: the average over the shards that move it."""

    def run(batches):
        for batch in batches:
            for shard, slots, ends, y in zip(*(batch.column(k) for k in ("shard", "slots", "ends", "y")), strict=True):
                own, sums = _unpacked(state, net)
                stops = np.frombuffer(ends.as_py(), np.int64)
                starts = np.concatenate([[0], stops[:-1]])
                rng = np.random.default_rng([seed, epoch, shard.as_py()])
                _epoch(own, sums, np.frombuffer(slots.as_py(), np.int32), starts, stops, np.frombuffer(y.as_py(), np.uint8).astype(float), mean, rng, drop)
                moved = _packed(own, sums) - state
                for block in range(-(-len(moved) // BLOCK)):
                    part = moved[block * BLOCK : (block + 1) * BLOCK].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard.as_py()], pa.int32()), pa.array([part], pa.binary())], ["block", "shard", "moved"])

    def mean_of(table: pa.Table) -> pa.Table:
        total = counted = 0
        for part in table.sort_by("shard").column("moved"):
            part = np.frombuffer(part.as_py())
            total, counted = total + part, counted + (part != 0)
        return pa.table([table.column("block")[:1], pa.array([(total / np.maximum(counted, 1)).tobytes()], pa.binary())], names=["block", "moved"])

    got = dealt.mapInArrow(run, "block int, shard int, moved binary").groupBy("block").applyInArrow(mean_of, "block int, moved binary").orderBy("block").toArrow()
    return np.concatenate([np.frombuffer(x.as_py()) for x in got.column("moved")])


def _calibrated(docs: DataFrame, net: Network) -> dict[str, float]:
    """The thresholds by language from a table (y, lang, words) of any size: its rows are counted by language and score, in
    CELLS cells, and only the counts come to the driver."""

    def run(batches):
        slot, table = net.tables()
        for batch in batches:
            words = batch.column("words")
            ends = np.cumsum(np.asarray(words.value_lengths()).astype(np.int64))
            scores = net.score(slot[np.asarray(words.flatten())], ends, table)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.rint(scores * CELLS).astype(np.int32)), batch.column("y")], ["lang", "cell", "y"])

    counts = docs.select("lang", "words", "y").mapInArrow(run, "lang string, cell int, y int").groupBy("lang", "cell").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    got = counts.orderBy("lang", "cell").toArrow()
    cell, y, n = (np.asarray(got.column(k)).astype(float) for k in ("cell", "y", "n"))
    return calibrate(cell / CELLS, y, got.column("lang").to_pylist(), counts=n)


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list[str | None], least: int = 30, counts: np.ndarray | None = None) -> dict[str, float]:
    """By language the threshold of the best F1 over labelled rows; languages with fewer than `least` rows or without
    both labels take that of all rows, "", and that is THRESHOLD if there is nothing to learn from. With counts each entry
    stands for so many rows, and y for the toxic ones among them."""
    counts = np.ones(len(y)) if counts is None else counts

    def best(s, t, n):
        if n.sum() < least or t.sum() in (0, n.sum()):
            return None
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(t[order])
        f1 = 2 * hit / (np.cumsum(n[order]) + t.sum())
        f1[:-1][s[order][1:] == s[order][:-1]] = -1
        k = int(f1.argmax())
        return float((s[order][k] + (s[order][k + 1] if k + 1 < len(t) else 0)) / 2)

    out = {"": best(scores, y, counts) or THRESHOLD}
    for lang in sorted({x for x in langs if x}):
        mine = np.array([x == lang for x in langs])
        out[lang] = best(scores[mine], y[mine], counts[mine]) or out[""]
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, rows: int | None = None) -> Network:
    """Train on all labelled documents outside the held-out fold, or on as many as `rows` asks for; a fifth of them, by
    hash of id, only sets the thresholds by language. Word buckets of TRAIN_ROWS documents and TRAIN_WORDS words at most
    come to the driver; more are trained on where they lie. An id counts once: of rows that repeat it, that with the
    smallest hash of its words."""
    wanted = training_labels(labels, label_col, id_col, folds, held, rows)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang")).join(wanted, "id")
    sample = sample.withColumn("fold", (F.crc32(F.concat(F.lit("thresholds"), F.col("id").cast("string")).cast("binary")) % 5).cast("int"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, y int, fold int, lang string, words array<int>"

    def run(batches):
        for batch in text_batches(batches, "text"):
            ids, ends = word_ids(as_bytes(batch.column("text")))
            columns = [batch.column(k) for k in ("id", "y", "fold", "lang")]
            yield pa.RecordBatch.from_arrays([*columns, list_array(ids, ends, pa.int32())], ["id", "y", "fold", "lang", "words"])

    found = sample.select("id", "y", "fold", "lang", "text").mapInArrow(run, schema)
    one = F.min_by(F.struct("y", "fold", "lang", "words"), F.struct(F.xxhash64("words"), "lang")).alias("one")
    found = staged(found.groupBy("id").agg(one).select("id", "one.*"), "training")
    n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0))).first()
    if n > TRAIN_ROWS or total > TRAIN_WORDS:
        net = fit_rows(found.where("fold > 0"))
        net.thresholds = _calibrated(found.where("fold = 0"), net)
        free(found)
        return net
    got = found.orderBy("id", "y", "lang", "words").toArrow().combine_chunks()
    words = got.column("words").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    ids = np.asarray(words.flatten()).astype(np.int32)
    lengths = np.asarray(words.value_lengths()).astype(np.int64)
    y, fold = (np.asarray(got.column(k)).astype(float) for k in ("y", "fold"))
    parts = np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []

    def subset(mask):
        take = np.nonzero(mask)[0]
        return np.concatenate([ids[:0], *[parts[k] for k in take]]), np.cumsum(lengths[take])

    free(found)
    net = fit(*subset(fold > 0), y[fold > 0])
    slot, table = net.tables()
    own, ends = subset(fold == 0)
    langs = [x for x, f in zip(got.column("lang").to_pylist(), fold, strict=True) if f == 0]
    net.thresholds = calibrate(net.score(slot[own], ends, table), y[fold == 0], langs)
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """<id>, score, predicted (by the one threshold), flagged (by the calibrated threshold of the row's language).

    Whole texts are read; null texts count as empty and score the network's base; the language only chooses the
    threshold of `flagged` (null or unknown: that of all rows). An empty table gives no rows; repeated rows score
    alike; other columns are not read."""
    packed = pickle.dumps(net)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, flagged boolean"

    def run(batches):
        model: Network = pickle.loads(packed)
        slot, table = model.tables()
        rest = model.thresholds[""]
        for batch in text_batches(batches, "text"):
            ids, ends = word_ids(as_bytes(batch.column("text")))
            scores = model.score(slot[ids], ends, table)
            limits = np.array([model.thresholds.get(x or "", rest) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(scores >= limits)],
                [id_col, "score", "predicted", "flagged"],
            )

    return docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
