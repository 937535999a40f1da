"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

The leaves of a tree are small blocks of pre-tokens with the characters and tokens they hold, inner nodes are sums. An
edit re-encodes the blocks it touches and the boundary context that can change with them, and updates the sums on
their ways to the root; everything else keeps its counts.
"""

from __future__ import annotations

import base64
import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import list_array, text_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens in a new block, and in a block at most before the tree is built anew.
BLOCK, FULL = 32, 256
#: Distinct pre-tokens whose counts a worker keeps.
CACHE = 200_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_ranks(path: str | None = None) -> tuple[str, dict[bytes, int]]:
    """The pattern of pre-tokens and the ranks of a vocabulary file."""
    import public_tokenizers

    with open(path or vocabulary_path(), "rb") as f:
        return public_tokenizers.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import tiktoken

        self.find = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def tokens(self, pre_tokens: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pre_tokens]
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        encode = self.encoding.encode_ordinary
        for p in set(pre_tokens):
            if p not in known:
                known[p] = len(encode(p))
        return [known[p] for p in pre_tokens]

    def matches(self, text: str, start: int):
        return self.find.finditer(text, start)


class Tree:
    """chars and tokens are heaps: the root at 1, the children of k at 2k and 2k+1, leaves at len/2 and on."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def over(cls, leaves: list[tuple[int, int]]) -> Tree:
        size = 1
        while size < len(leaves):
            size *= 2
        tree = cls([0] * (2 * size), [0] * (2 * size))
        for k, (c, t) in enumerate(leaves):
            tree.chars[size + k], tree.tokens[size + k] = c, t
        for k in range(size - 1, 0, -1):
            tree.chars[k] = tree.chars[2 * k] + tree.chars[2 * k + 1]
            tree.tokens[k] = tree.tokens[2 * k] + tree.tokens[2 * k + 1]
        return tree

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end of the text) and where it starts."""
        k, start, size = 1, 0, len(self.chars) // 2
        while k < size:
            left = self.chars[2 * k]
            if position - start < left or not self.chars[2 * k + 1]:
                k = 2 * k
            else:
                start, k = start + left, 2 * k + 1
        return k - size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = len(self.chars) // 2 + leaf
        more_chars, more_tokens = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += more_chars
            self.tokens[k] += more_tokens
            k //= 2


def blocks_of(pre_tokens: list[str], tokens: list[int], size: int = BLOCK) -> list[tuple[int, int]]:
    lengths = list(map(len, pre_tokens))
    return [(sum(lengths[k : k + size]), sum(tokens[k : k + size])) for k in range(0, len(lengths), size)] or [(0, 0)]


def build(counter: Counter, text: str) -> Tree:
    pre_tokens = counter.find.findall(text)
    return Tree.over(blocks_of(pre_tokens, counter.tokens(pre_tokens)))


def edit(counter: Counter, tree: Tree, text: str, start: int, removed: int, inserted: str) -> tuple[Tree, str, int]:
    """Replace `removed` characters from `start` by `inserted`: the tree, the text and the characters re-encoded.

    Positions beyond the text are its end. Encoding begins at a block that starts before the edit and after a character
    that is not white space: the pre-tokens before it looked at no character that the edit changes. It ends where a
    pre-token ends with an old block: what follows is the same text, so the same pre-tokens.
    """
    start = max(0, min(start, len(text)))
    stop = min(len(text), start + max(0, removed))
    after = text[:start] + inserted + text[stop:]
    shift = len(after) - len(text)
    size = len(tree.chars) // 2
    leaf, at = tree.leaf_at(start)
    while leaf and (at >= start or tree.chars[size + leaf] == 0 or text[at - 1].isspace()):
        leaf -= 1
        at -= tree.chars[size + leaf]
    last, old_end = leaf, at + tree.chars[size + leaf]
    found: list[str] = []
    end = at
    for match in counter.matches(after, at):
        found.append(match.group())
        end = match.end()
        while last + 1 < size and old_end + shift < end:
            last += 1
            old_end += tree.chars[size + last]
        if end >= start + len(inserted) and old_end >= stop and end == old_end + shift:
            break
    else:
        last, end = size - 1, len(after)
    tokens = counter.tokens(found)
    room = last - leaf + 1
    if len(found) > room * FULL:
        rest = [(tree.chars[size + k], tree.tokens[size + k]) for k in range(size)]
        return Tree.over([x for x in rest[:leaf] + blocks_of(found, tokens) + rest[last + 1 :] if x[0]]), after, end - at
    each = max(1, -(-len(found) // room))
    for k, (c, t) in enumerate((blocks_of(found, tokens, each) + [(0, 0)] * room)[:room]):
        tree.put(leaf + k, c, t)
    return tree, after, end - at


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """<id>, text, n_tokens, tree_chars, tree_tokens of each row, and the columns `keep` as they are.

    Whole texts; null counts as empty and has 0 tokens; repeated rows each have their tree; an empty table gives no
    rows; other columns are not read."""
    packed = pickle.dumps(load_ranks(path))
    names = [id_col, *keep]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        counter = Counter(*pickle.loads(packed))
        for batch in text_batches(batches, "text"):
            trees = [build(counter, t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(t.chars) for t in trees], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    batch.column("text"),
                    pa.array([t.tokens[1] for t in trees], pa.int64()),
                    list_array(np.array([x for t in trees for x in t.chars], np.int32), ends, pa.int32()),
                    list_array(np.array([x for t in trees for x in t.tokens], np.int32), ends, pa.int32()),
                ],
                [*names, "text", "n_tokens", "tree_chars", "tree_tokens"],
            )

    rows = docs.select(*names, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"{kept}, text string, n_tokens bigint, tree_chars array<int>, tree_tokens array<int>")


def gather_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Trees with the column edits: those of the table (<id>, seq, start, removed, inserted), in the order of seq.
    Edits of ids without a tree have no effect; the edits of one document meet in one row."""
    listed = edits.groupBy(F.col(id_col).alias("edit_id")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias("edits")
    )
    listed = listed.select("edit_id", F.transform("edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["removed"].cast("int").alias("removed"), F.coalesce(e["inserted"], F.lit("")).alias("inserted"))).alias("edits"))
    return trees.join(listed, F.col(id_col).eqNullSafe(F.col("edit_id")), "left").drop("edit_id")


def apply_edits(trees: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """<id>, text, n_tokens, tree_chars, tree_tokens after the edits of each row's column edits (array of start,
    removed, inserted; null: none), and n_tokens_before and reencoded (characters encoded again). Positions count code
    points of the text as the edits before have left it; beyond the end they are the end."""
    packed = pickle.dumps(load_ranks(path))
    id_type = trees.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(*pickle.loads(packed))
        for batch in text_batches(batches, "text"):
            texts, done, work = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("text", "tree_chars", "tree_tokens", "edits")]
            for text, chars, tokens, edits in zip(*columns, strict=True):
                tree, again = Tree(chars, tokens), 0
                for e in edits or ():
                    tree, text, more = edit(counter, tree, text, e["start"], e["removed"], e["inserted"] or "")
                    again += more
                texts.append(text)
                done.append(tree)
                work.append(again)
            ends = np.cumsum([len(t.chars) for t in done], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array(texts, pa.string()),
                    pa.array([t.tokens[1] for t in done], pa.int64()),
                    list_array(np.array([x for t in done for x in t.chars], np.int32), ends, pa.int32()),
                    list_array(np.array([x for t in done for x in t.tokens], np.int32), ends, pa.int32()),
                    batch.column("n_tokens"),
                    pa.array(work, pa.int64()),
                ],
                [id_col, "text", "n_tokens", "tree_chars", "tree_tokens", "n_tokens_before", "reencoded"],
            )

    schema = f"`{id_col}` {id_type}, text string, n_tokens bigint, tree_chars array<int>, tree_tokens array<int>, n_tokens_before bigint, reencoded bigint"
    return trees.select(id_col, "text", "n_tokens", "tree_chars", "tree_tokens", "edits").mapInArrow(run, schema)
