"""Hard negatives of anchors by product quantisation with stored residual norms.

A vector is stored as one code of each pair of its components, with the length of what the codes leave out. A table of
the anchor's products with all codes gives each row an estimate by look-ups, and by Cauchy-Schwarz its true inner
product lies within the anchor's length times that residual length of it. Rows whose bounds cannot reach the wanted
places or window are left out with certainty; exact integer products decide among the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import whole_groups
from .blocks import best, finite, pieces, scaled_ints, within
from .common import free, staged

#: Vectors that codebooks are fitted on at most (those with the smallest hash of their number), codes of a book, and
#: components that share a code.
FIT_ROWS, CODES, SPAN = 8192, 256, 2
#: Anchors and rows that meet in one piece.
ANCHOR_BLOCK, ROW_BLOCK = 4096, 8192
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this many hundredths of the positive's.
LEAST = 80
#: Integer components lie within 2 to this power, so that inner products fit a long.
BITS = 25


def fit(sample: np.ndarray, rounds: int = 8, seed: int = 0) -> list[np.ndarray]:
    """A codebook for each SPAN components, by k-means from different sample rows."""
    rng, books = np.random.default_rng(seed), []
    for s in range(0, sample.shape[1], SPAN):
        part = sample[:, s : s + SPAN]
        seen = np.unique(part, axis=0)
        book = seen[rng.permutation(len(seen))[:CODES]].astype(np.float64)
        for _ in range(rounds):
            own = _nearest(part, book)
            n = np.bincount(own, minlength=len(book))
            sums = np.stack([np.bincount(own, part[:, j], len(book)) for j in range(part.shape[1])], axis=1)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        books.append(book)
    return books


def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows by books) and residual lengths, these rounded up."""
    codes, rest = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x))
    for k, book in enumerate(books):
        part = x[:, k * SPAN : (k + 1) * SPAN].astype(np.float64)
        codes[:, k] = _nearest(part, book)
        rest += ((part - book[codes[:, k]]) ** 2).sum(axis=1)
    return codes, np.sqrt(rest) * (1 + 1e-9)


class Scorer:
    """Bounds of the inner products of anchors with the coded rows of a piece."""

    def __init__(self, codes: np.ndarray, rest: np.ndarray, books: list[np.ndarray]):
        starts = np.cumsum([0, *(len(b) for b in books)])[:-1].astype(np.int64)
        self.places, self.rest, self.books = codes + starts, rest, books
        self.size = max((float(np.abs(b).max()) for b in books), default=0.0)

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = anchor.astype(np.float64)
        if not self.books:  # nothing was learned about vectors of this length: no row can be left out
            return np.full(len(self.rest), -np.inf), np.full(len(self.rest), np.inf)
        table = np.concatenate([b @ a[k * SPAN : (k + 1) * SPAN] for k, b in enumerate(self.books)])
        near = table[self.places].sum(axis=1)
        room = np.sqrt(a @ a) * self.rest * (1 + 1e-9) + 1e-9 * (1 + np.abs(a).sum() * self.size)
        return near - room, near + room


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def _first(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rids, ids, -scores))[:k]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.int32) for v in column]).astype(np.int64)


class Piece:
    """Anchors beside coded rows."""

    def __init__(self, batch: pa.RecordBatch, books: dict[int, list[np.ndarray]]):
        anchors = int((np.asarray(batch.column("side")) == 0).sum())
        self.anchors, self.rows = batch.slice(0, anchors), batch.slice(anchors)
        if not anchors or not len(self.rows):
            return
        own = books.get(batch.column("dim")[0].as_py(), [])
        codes = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in self.rows.column("codes")]) if own else np.zeros((len(self.rows), 0), np.uint8)
        self.scorer = Scorer(codes, np.asarray(self.rows.column("rest")), own)
        self.a, self.x = _matrix(self.anchors.column("vector")), _matrix(self.rows.column("vector"))
        self.labels, self.own_labels = np.asarray(self.rows.column("label")), np.asarray(self.anchors.column("label"))
        self.rids, self.own_rids = np.asarray(self.rows.column("rid")), np.asarray(self.anchors.column("rid"))
        self.ids = np.asarray(self.rows.column("id").fill_null(np.iinfo(np.int64).max))

    def positives(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the anchor's label with the k largest products, the anchor itself left out."""
        low, high = self.scorer.bounds(self.a[n])
        same = (self.labels == self.own_labels[n]) & (self.rids != self.own_rids[n])
        some = np.nonzero(same & (high >= _kth(low[same], k)))[0]
        scores = self.x[some] @ self.a[n]
        top = _first(scores, self.ids[some], self.rids[some], k)
        return some[top], scores[top]

    def negatives(self, n: int, windows: list[tuple[int, int]], k: int):
        """For each window, rows of other labels with the k largest products in it."""
        low, high = self.scorer.bounds(self.a[n])
        other = self.labels != self.own_labels[n]
        for least, most in windows:
            sure = other & (low >= least) & (high <= most)
            some = np.nonzero(other & (high >= max(least, _kth(low[sure], k))) & (low <= most))[0]
            scores = self.x[some] @ self.a[n]
            fits = (scores >= least) & (scores <= most)
            some, scores = some[fits], scores[fits]
            top = _first(scores, self.ids[some], self.rids[some], k)
            yield some[top], scores[top]


def _each(books: dict[int, list[np.ndarray]], of_piece):
    def run(batches):
        for batch, cuts in whole_groups(batches, ["dim", "pa", "pb"]):
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                piece = Piece(batch.slice(s, e - s), books)
                if len(piece.anchors) and len(piece.rows):
                    out = of_piece(piece)
                    if out is not None:
                        yield out

    return run


FOUND = "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, rid bigint, id bigint, score bigint"


def _batch(piece: Piece, who: list[int], place, positive_id, positive_score, rows: list[np.ndarray], scores: list[np.ndarray]):
    counts = [len(r) for r in rows]
    if not sum(counts):
        return None
    spread = pa.array(np.repeat(np.arange(len(who)), counts))
    at = pa.array(np.concatenate(rows))
    owner = pa.array(who).take(spread)
    columns = [
        piece.anchors.column("rid").take(owner), piece.anchors.column("id").take(owner), pa.array(place, pa.int32()).take(spread),
        pa.array(positive_id, pa.int64()).take(spread), pa.array(positive_score, pa.int64()).take(spread),
        piece.rows.column("rid").take(at), piece.rows.column("id").take(at), pa.array(np.concatenate(scores), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _positives(k: int):
    def run(piece: Piece):
        got = [piece.positives(n, k) for n in range(len(piece.a))]
        none = [None] * len(got)
        return _batch(piece, list(range(len(got))), none, none, none, [r for r, _ in got], [s for _, s in got])

    return run


def _negatives(k: int, least: int):
    def run(piece: Piece):
        who, place, ids, wanted, rows, scores = [], [], [], [], [], []
        for n, found in enumerate(piece.anchors.column("positives").to_pylist()):
            windows = [(-((-least * p["score"]) // 100), p["score"]) for p in found]
            for p, (r, s) in zip(found, piece.negatives(n, windows, k), strict=True):
                who.append(n)
                place.append(p["place"])
                ids.append(p["id"])
                wanted.append(p["score"])
                rows.append(r)
                scores.append(s)
        return _batch(piece, who, place, ids, wanted, rows, scores) if rows else None

    return run


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where the condition
    `anchors` holds and each of its first `positives` other rows of the same label, the first `negatives` rows of other
    labels with least * positive_score <= 100 * negative_score <= 100 * positive_score.

    Components x become floor(256 * x); scores are exact integer inner products with the anchor; higher scores come
    first, then smaller ids (null ids last), then the order of rows. `label` is an expression in place of the label
    column. Rows with a null label, a null vector or null or non-finite components take no part; nor do vectors with a
    component of 2**25 or more after scaling, as their products fit no long. Vectors of different lengths do not meet,
    empty ones have score 0. Rows that repeat an id are rows of their own, and repeated anchors have results each.
    Anchors without partners give no rows, and so does an empty table. Ids and labels are integers; other columns are
    ignored. Nothing is approximate: the codes only rule rows out.
    """
    own_label = (F.col(label_col) if label is None else label).cast("long")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), own_label.alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & finite("vector")).where(within("vector", BITS))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "asks", scaled_ints("vector").alias("ints"))
    rows = staged(rows, "vectors")
    books = _books(rows)

    def place(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("ints").value_lengths())
            for dim in np.unique(sizes).tolist():
                some = batch.take(pa.array(np.nonzero(sizes == dim)[0]))
                x = np.asarray(some.column("ints").flatten()).astype(np.int32).reshape(len(some), dim)
                codes, rest = encode(x, books.get(dim, []))
                columns = [some.column(c) for c in ("rid", "id", "label", "asks")]
                columns += [pa.array([dim] * len(x), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "id", "label", "asks", "dim", "vector", "codes", "rest"])

    schema = "rid bigint, id bigint, label bigint, asks boolean, dim int, vector binary, codes binary, rest double"
    coded = staged(rows.mapInArrow(place, schema), "coded")
    asking = coded.where("asks").select("rid", "id", "label", "dim", "vector")
    members = coded.drop("asks")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("rid")]
    both = pieces(asking, members, ["dim"], ANCHOR_BLOCK, ROW_BLOCK)
    found = staged(both.mapInArrow(_each(books, _positives(positives)), FOUND), "positives")
    top = best(found, ["anchor"], order, positives, "place")
    top = top.groupBy("anchor").agg(F.collect_list(F.struct("place", "id", "score")).alias("positives"))  # a few each
    asking = staged(asking.join(top.withColumnRenamed("anchor", "rid"), "rid"), "anchors")
    both = pieces(asking, members, ["dim"], ANCHOR_BLOCK, ROW_BLOCK)
    hard = staged(both.mapInArrow(_each(books, _negatives(negatives, least)), FOUND), "negatives")
    free(rows, coded, found, asking)
    out = best(hard, ["anchor", "place"], order, negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _books(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Codebooks of each vector length in a bounded sample."""
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(FIT_ROWS).select("ints").toArrow()
    by_dim: dict[int, list] = {}
    for vector in sample.column("ints").to_pylist():
        by_dim.setdefault(len(vector), []).append(vector)
    return {dim: fit(np.array(x, np.float64)) for dim, x in by_dim.items() if dim}
