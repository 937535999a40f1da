"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles, each hashed once to 64 bits. The K smallest hashes are its sketch, the
LISTED smallest of them are its retained values. Inverted lists of retained values bring together documents that share
one; the estimate of the Jaccard index from the union of two sketches filters pairs, each in the list of the smallest
value that its two share; the full sets confirm links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, list_array, text_batches, whole_groups
from .common import components, free, hot_keys, hot_of, small, spread_join, staged

SHINGLE = 5
K = 64
#: A pair at the threshold shares none of its union's LISTED smallest values with probability 0.25 ** 16 = 2e-10.
LISTED = 16
#: Lists of up to so many documents and shingles are compared in one piece; longer ones in pieces of two blocks.
LIST_BLOCK, SET_BLOCK = 2048, 4 << 20
LEAST = 0.75
#: Standard deviations of the estimate below the threshold at which a pair is still verified: an estimate of a pair at
#: the threshold is lower with a probability of about 1e-6.
DEVIATIONS = 5.0
#: Lists of up to so many documents are compared pair by pair, many lists at a time.
SMALL = 32
#: Documents of a long list that all its blocks are compared with first, so that a group of near copies is one component
#: before any two blocks meet.
LEADERS = 8
#: Links of a node in the tree that stands for the links of a component of one list.
FAN = 64

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes: A-Z lower-cased, words between ASCII white space; a text of
    fewer words than width has its whole sequence as its only shingle; a text without words has none."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    digest = xxhash.xxh3_64_intdigest
    flat = np.fromiter((digest(w) for ws in words for w in ws), np.uint64, total)
    n = max(0, total - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled = _mixed(rolled * _STEP + flat[i : i + n] + np.uint64(i + 1))
    start = 0
    for c in counts.tolist():
        if c >= width:
            yield np.unique(rolled[start : start + c - width + 1])
        elif c:
            h = np.array([c], np.uint64) * _STEP
            for x in flat[start : start + c]:
                h = _mixed(h * _STEP + x)
            yield h
        else:
            yield flat[:0]
        start += c


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _profiles(batches):
    for batch in text_batches(batches, "text"):
        sets = list(shingle_sets(as_bytes(batch.column("text"))))
        sketches = [s[:K] for s in sets]
        flat = np.concatenate(sketches) if sketches else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("h"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                list_array(flat.view(np.int64), np.cumsum([len(s) for s in sketches], dtype=np.int64), pa.int64()),
            ],
            ["id", "h", "n", "cid", "sketch"],
        )


# --- pairs of a list whose sketches may belong to a link --------------------------------------------------------------


def _matrix(lists: pa.Array) -> np.ndarray:
    """Sketches as rows of K values, shorter ones filled up with _NONE."""
    ends = np.asarray(lists.offsets).astype(np.int64)
    sizes = np.diff(ends)
    out = np.full((len(sizes), K), _NONE, np.uint64)
    out[np.arange(K) < sizes[:, None]] = np.asarray(lists.values)[ends[0] : ends[-1]].view(np.uint64)
    return out


def _slack(seen, union):
    """How far the estimate may fall below the threshold: it follows the size of the sketch of the union and the part
    of the union that it is, and is 0 where the sketches hold both sets."""
    seen = np.maximum(1, seen)
    return DEVIATIONS * np.sqrt(LEAST * (1 - LEAST) / seen * np.maximum(0, 1 - seen / union))


def close_pairs(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) may reach the threshold and share no value smaller than that of their list.

    Two sketches hold all values up to the smaller of their last ones (all values, if a set is no larger than its
    sketch): the shared and distinct values up to it are a sketch of the union."""
    good = np.zeros(len(i), bool)
    smaller, larger = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    fits = np.nonzero(4 * smaller >= 3 * larger)[0]
    for start in range(0, len(fits), 16384):
        at = fits[start : start + 16384]
        x, y = i[at], j[at]
        both = np.sort(np.concatenate([sketch[x], sketch[y]], axis=1), axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
        shared = twice.sum(axis=1)
        first = both[np.arange(len(at)), twice.argmax(axis=1)] == value[at]
        top = np.minimum(np.where(n[x] <= K, _NONE, sketch[x, -1]), np.where(n[y] <= K, _NONE, sketch[y, -1]))
        seen = ((both <= top[:, None]) & (both != _NONE)).sum(axis=1) - shared
        union = np.maximum(seen, (n[x] + n[y]) / (1 + LEAST))
        slack = np.where((n[x] <= K) & (n[y] <= K), 0, _slack(seen, union))
        good[at] = first & (shared >= (LEAST - slack) * seen - 1e-9)
    return good


def close_matrix(sketch: np.ndarray, n: np.ndarray, value: np.uint64 | None) -> np.ndarray:
    """The same for all pairs of one long list, by products of incidence matrices. The union's sketch has K values at
    least (all, of small sets), so the shared values that this many need are the bound. Without a value, pairs that
    share smaller ones count too."""
    m = len(n)
    values, inverse, counts = np.unique(sketch, return_inverse=True, return_counts=True)
    often = (counts > 1) & (values != _NONE)
    column = np.cumsum(often) - 1
    inverse = inverse.reshape(sketch.shape)
    rows, at = np.nonzero(often[inverse])
    cols = column[inverse[rows, at]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    values = values[often]
    less = int(np.searchsorted(values, value)) if value is not None else 0
    shared = np.zeros((m, m), np.float32)
    first = np.ones((m, m), bool)

    def add(lo: int, hi: int):
        for start in range(lo, hi, 2048):
            stop = min(hi, start + 2048)
            s, e = np.searchsorted(cols, [start, stop])
            block = np.zeros((m, stop - start), np.float32)
            block[rows[s:e], cols[s:e] - start] = 1
            np.add(shared, block @ block.T, out=shared)

    if less:
        add(0, less)
        first = shared == 0
    add(less, len(values))
    larger = np.maximum.outer(n, n)
    sized = np.minimum(K, larger)
    need = np.maximum(1, (LEAST - np.where(larger <= K, 0, _slack(sized, np.inf))) * sized - 1e-6)
    close = first & (shared >= need) & (4 * np.minimum.outer(n, n) >= 3 * larger)
    np.fill_diagonal(close, False)
    return close


def _marked(batches):
    """Of each piece of a list, the documents with a partner in it that may be linked with them."""
    for batch, cuts in whole_groups(batches, ["v", "p", "q"]):
        sketch, n = _matrix(batch.column("sketch")), np.asarray(batch.column("n"))
        value = np.asarray(batch.column("v")).view(np.uint64)
        part, home = np.asarray(batch.column("part")), np.asarray(batch.column("home").cast(pa.int8())) > 0
        keep = np.zeros(len(n), bool)
        sizes = np.diff(cuts)
        for m in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
            a, b = np.triu_indices(m, 1)
            starts = cuts[:-1][sizes == m]
            i, j = ((starts[:, None] + x).ravel() for x in (a, b))
            good = close_pairs(sketch, n, i, j, value[i]) & ((part[i] != part[j]) | (home[i] & home[j]))
            keep[i[good]] = keep[j[good]] = True
        for s, e in zip(cuts[:-1][sizes > SMALL].tolist(), cuts[1:][sizes > SMALL].tolist(), strict=True):
            close = close_matrix(sketch[s:e], n[s:e], value[s])
            close &= (part[s:e, None] != part[None, s:e]) | (home[s:e, None] & home[None, s:e])
            keep[s:e] = close.any(axis=1)
        out = batch.filter(pa.array(keep))
        yield out.select(["cid", "id", "h", "v", "p", "q"])


# --- links of a list on the full sets ---------------------------------------------------------------------------------


def _full_sets(batches):
    """The full set of each wanted class, from a text that has it; of equal rows, one in a task is enough."""
    done: set[bytes] = set()
    for batch in text_batches(batches, "text"):
        sets = list(shingle_sets(as_bytes(batch.column("text"))))
        good = []
        for k, cid in enumerate(batch.column("cid").to_pylist()):
            if cid not in done and len(sets[k]) and set_key(sets[k]) == cid:
                done.add(cid)
                good.append(k)
        rows = batch.select(["id", "cid", "lists"]).take(pa.array(good, pa.int64()))
        hashes = pa.array([sets[k].tobytes() for k in good], pa.binary())
        yield pa.RecordBatch.from_arrays([*rows.columns, hashes], ["id", "cid", "lists", "hashes"])


def linked(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets have 100 * intersection >= 75 * union with this one."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    both = np.add.reduceat(one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * both >= 75 * (len(one) + sizes - both)


def list_components(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of a list the first one of its component. Links are looked for only between sets that are not yet
    in one component, so a group of near copies of one another costs about one comparison a set."""
    m = len(sets)
    root = np.arange(m)
    n = np.fromiter(map(len, sets), np.int64, m)
    close = None
    if m > SMALL:
        sketch = np.full((m, K), _NONE, np.uint64)
        for k, s in enumerate(sets):
            sketch[k, : min(K, len(s))] = s[:K]
        close = close_matrix(sketch, n, None)
    for i in range(m - 1):
        near = (root[i + 1 :] != root[i]) & (4 * np.minimum(n[i], n[i + 1 :]) >= 3 * np.maximum(n[i], n[i + 1 :]))
        if close is not None:
            near &= close[i, i + 1 :]
        others = i + 1 + np.nonzero(near)[0]
        total = np.cumsum(n[others])
        start = 0
        while start < len(others):  # some million values at a time
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (4 << 20), side="right")))
            piece = others[start:stop]
            piece = piece[linked(sets[i], [sets[k] for k in piece])]
            for old in np.unique(root[piece]).tolist():
                low, high = min(old, root[i]), max(old, root[i])
                root[root == high] = low
            start = stop
    return root


def _links(batches):
    """For each component of a list two or more documents: links that join it, as a tree of FAN links a node."""
    for batch, cuts in whole_groups(batches, ["v", "p", "q"]):
        cids, hashes = batch.column("cid").to_pylist(), batch.column("hashes")
        above: list[int] = []
        below: list[int] = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = sorted(dict(zip(cids[s:e], range(s, e), strict=True)).items())
            if len(rows) < 2:
                continue
            rows = np.array([at for _, at in rows])
            root = list_components([np.frombuffer(hashes[at].as_buffer(), np.uint64) for at in rows.tolist()])
            for name in np.unique(root).tolist():
                members = rows[root == name]
                below += members[1:].tolist()
                above += members[np.arange(len(members) - 1) // FAN].tolist()
        ends = [batch.select(["id", "cid"]).take(pa.array(x, pa.int64())) for x in (above, below)]
        yield pa.RecordBatch.from_arrays([c for x in ends for c in x.columns], ["x", "x_cid", "y", "y_cid"])


# --- the operator -----------------------------------------------------------------------------------------------------


def _postings(classes: DataFrame) -> DataFrame:
    """Each class in each of its inverted lists: (cid, v, parts, part), with the blocks that the list is cut into, one for
    short lists, and the block of the class."""
    postings = classes.select("cid", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    lengths = postings.groupBy("v").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    lengths = staged(lengths, "lengths")
    parts = lengths.select("v", _parts("rows", "shingles").alias("parts"))
    rows = spread_join(postings.select("cid", "v", "n"), parts, "v", hot_of(lengths, "v", classes.count() * LISTED))
    return rows.withColumn("part", F.pmod(F.xxhash64("cid", "v"), F.col("parts")).cast("int"))


def _parts(rows: str, shingles: str):
    """Blocks of so many documents and shingles: one where these fit into a piece, else two blocks fit into one."""
    fits = (F.col(rows) <= LIST_BLOCK) & (F.col(shingles) <= SET_BLOCK)
    return F.when(fits, 1).otherwise(F.greatest(F.ceil(F.col(rows) * 2.5 / LIST_BLOCK), F.ceil(F.col(shingles) * 2.5 / SET_BLOCK))).cast("int")


def _first_pieces(rows: DataFrame) -> DataFrame:
    """Pieces (cid, v, p, q, part, home) of the first round: a list, or a block of a long list with the list's LEADERS."""
    own = rows.select("cid", "v", F.col("part").alias("p"), F.col("part").alias("q"), F.lit(0).alias("part"), F.lit(True).alias("home"))
    long = rows.where("parts > 1")
    picked = [F.min_by("cid", F.xxhash64(F.lit(k), F.col("cid"))).alias(f"c{k}") for k in range(LEADERS)]
    leaders = long.groupBy("v").agg(F.first("parts").alias("parts"), *picked)
    leaders = leaders.select("v", "parts", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(LEADERS)]))).alias("cid"))
    leaders = leaders.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(F.col("p") != F.pmod(F.xxhash64("cid", "v"), F.col("parts")))
    return own.unionByName(leaders.select("cid", "v", "p", F.col("p").alias("q"), F.lit(0).alias("part"), F.lit(True).alias("home")))


def _paired(rows: DataFrame) -> DataFrame:
    """Pieces (cid, v, p, q, part, home) in which any two of a list's blocks meet: (cid, v, parts, part). Documents of one
    block meet in the one piece where they are at home."""
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("other", other).where("parts = 1 OR other <> part")
    home = F.col("other") == (F.col("part") + 1) % F.col("parts")
    return rows.select("cid", "v", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", home.alias("home"))


def _second_pieces(long: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Pieces of the second round: of each long list the documents outside its largest component so far meet one another,
    and those of that component. None if every long list is one component."""
    known = staged(long.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "known")
    by_root = known.groupBy("v", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("rows", "root", "shingles")).alias("top")
    sizes = by_root.groupBy("v").agg(largest, F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")).where("rows > top.rows")
    sizes = sizes.select("v", "top.root", (F.col("rows") - F.col("top.rows")).alias("left_rows"), (F.col("shingles") - F.col("top.shingles")).alias("left_shingles"), F.col("top.rows").alias("top_rows"), F.col("top.shingles").alias("top_shingles"))
    sizes = sizes.select("v", F.col("root").alias("top"), *(_parts(f"{k}_rows", f"{k}_shingles").alias(f"{k}_parts") for k in ("left", "top")))
    sizes = staged(sizes, "outside")
    if not sizes.limit(1).count():
        free(known, sizes)
        return None
    met = spread_join(known.select("cid", "v", "root"), sizes, "v", hot_keys(known, "v"))
    part = lambda k, parts: F.pmod(F.xxhash64(F.lit(k), F.col("cid"), F.col("v")), F.col(parts)).cast("int")
    outside = met.where("root <> top").withColumn("part", part(1, "left_parts"))
    among = _paired(outside.select("cid", "v", F.col("left_parts").alias("parts"), "part"))
    # the pieces with the largest component have numbers of their own
    number = lambda n: (-1 - n).alias("q")
    beside = outside.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("top_parts") - 1))).select("cid", "v", F.col("part").alias("p"), number(F.col("t")), F.lit(0).alias("part"))
    inside = met.where("root = top").select("cid", "v", F.explode(F.sequence(F.lit(0), F.col("left_parts") - 1)).alias("p"), number(part(2, "top_parts")), F.lit(1).alias("part"))
    return among.unionByName(beside.unionByName(inside).withColumn("home", F.lit(False)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups, one row per input row: <id>, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= 75 * |union| of their shingle sets; component_id is the
    smallest id that links reach. Documents without words (null, empty, white) are linked with nothing and are their
    own component. Documents with equal sets count as linked whatever their order of words; rows that repeat an id are
    in one component only if their sets are linked. Null ids never become a component's id unless it has no other.
    Other columns are ignored; an empty table gives no rows.

    Equal sets are one class and never expanded into pairs. Classes meet in inverted lists of retained values; no list is
    capped and none is left out. A long list is cut in blocks, each compared within itself and with some leaders of the
    list; then only the documents outside the largest component of the list meet all its blocks, as the others are
    joined already. In a piece, pairs are estimated by their
    sketches, and the full sets of the classes with a possible partner are brought to it. There links are confirmed
    between sets that are not yet joined, and a tree of links stands for each component, so pairs of a group are
    nowhere listed. Shingles are compared by 64-bit hashes: two different ones of two documents of 20 000 shingles are
    taken for one with a probability of 2e-11.
    """
    out = _grouped(docs, id_col, text_col)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, cid, root, component) of each row: the key of its set and the key that names its component (null without
    words), and the component's id."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    schema = f"id {id_type}, h bigint, n bigint, cid binary, sketch array<bigint>"
    profiles = staged(docs.mapInArrow(_profiles, schema), "profiles")
    one = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("one")
    classes = profiles.where("n > 0").groupBy("cid").agg(one, F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(classes.select("cid", "one.id", "one.h", "rows", "n", "sketch"), "classes")

    # nodes sort by id, nulls last, so the smallest node of a component bears its id
    end = lambda k: F.struct(F.col(k).isNull().alias("z"), F.col(k).alias("id"), F.col(f"{k}_cid").alias("cid"))

    def found(pieces: DataFrame) -> DataFrame:
        """Links that stand for all links of the pieces: sketches mark what may be linked, full sets decide."""
        rows = pieces.join(classes.select("cid", "id", "h", "n", "sketch"), "cid").repartition("v", "p", "q").sortWithinPartitions("v", "p", "q")
        marked = rows.mapInArrow(_marked, f"cid binary, id {id_type}, h bigint, v bigint, p int, q int")
        wanted = marked.groupBy("cid", "id", "h").agg(F.collect_list(F.struct("v", "p", "q")).alias("lists"))
        wanted = staged(wanted.withColumnsRenamed({"id": "one_id", "h": "one_h"}), "wanted")
        texts = docs.join(small(wanted), F.col("id").eqNullSafe(F.col("one_id")) & (F.col("h") == F.col("one_h")))
        lists = "lists array<struct<v: bigint, p: int, q: int>>"
        sets = texts.select("id", "cid", "lists", "text").mapInArrow(_full_sets, f"id {id_type}, cid binary, {lists}, hashes binary")
        sets = sets.select(F.explode("lists").alias("at"), "id", "cid", "hashes").select("at.*", "id", "cid", "hashes")
        sets = sets.repartition("v", "p", "q").sortWithinPartitions("v", "p", "q")
        links = sets.mapInArrow(_links, f"x {id_type}, x_cid binary, y {id_type}, y_cid binary")
        links = staged(links.select(end("x").alias("a"), end("y").alias("b")).distinct(), "links")
        free(wanted)
        return links

    rows = staged(_postings(classes), "postings")
    links = found(_first_pieces(rows))
    roots = components(links)
    long = rows.where("parts > 1")
    if long.limit(1).count():
        pieces = _second_pieces(long, roots.select(F.col("node.cid").alias("cid"), F.col("root.cid").alias("root")))
        if pieces is not None:
            more = found(pieces)
            side = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
            ends = more.join(side("a"), "a", "left").join(side("b"), "b", "left")
            if ends.where(~F.coalesce("a_root", "a").eqNullSafe(F.coalesce("b_root", "b"))).limit(1).count():
                roots = components(links.unionByName(more))
    roots = roots.select(F.col("node.cid").alias("cid"), "root")

    named = classes.select("cid", "id").join(roots, "cid", "left")
    head = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("root.id")).alias("component")
    named = staged(named.select("cid", F.coalesce("root.cid", "cid").alias("root"), head), "named")
    hot = staged(hot_of(classes.select("cid", "rows"), "cid", profiles.count()), "hot")
    free(classes, rows, links)
    slim = profiles.select("id", "n", "cid")
    out = spread_join(slim.where("n > 0"), named, "cid", hot).select("id", "n", "cid", "root", "component")
    wordless = slim.where("n = 0").select("id", "n", "cid", F.lit(None).cast("binary").alias("root"), F.col("id").alias("component"))
    return out.unionByName(wordless)


def _with_set_keys(batches):
    for batch in text_batches(batches, "paperloom_text"):
        sets = shingle_sets(as_bytes(batch.column("paperloom_text")))
        keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
        columns = [k for k in batch.schema.names if k != "paperloom_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in columns), keys], [*columns, "paperloom_cid"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each component, with all columns; documents without words stay."""
    from .exact_dedup import keep_rows, longest_rows

    groups = _grouped(docs, id_col, text_col).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
    groups = staged(groups.select(F.col("id").alias(id_col), "kept", "cid", "root"), "decided")

    def longest(rows: DataFrame) -> DataFrame:
        best = groups.where("kept AND root IS NOT NULL").select(F.col(id_col).alias("paperloom_best"), F.col("cid").alias("paperloom_cid"), F.col("root").alias("paperloom_key")).distinct()
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "paperloom_cid binary"])
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        keyed = staged(rows.withColumn("paperloom_text", text).mapInArrow(_with_set_keys, schema), "repeated")
        found = keyed.join(best, "paperloom_cid").where(F.col(id_col).eqNullSafe(F.col("paperloom_best")))
        return keyed.where("paperloom_cid IS NULL").select(*docs.columns).unionByName(longest_rows(found, "paperloom_key", docs.columns, text_col))

    return keep_rows(docs, groups.select(id_col, "kept"), id_col, longest)
