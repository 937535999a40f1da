import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from paperloom.llm import token_output as to

TEXTS = ["Some words, and MORE words!", None, "", " \n", "é é ́x Ǆ İstanbul ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "日本語 text　wide\xa0blank\x1cx\x85y", "it's don't 'S 12345", "\'!\'s x\'ll!! A\x1cB\x0b1a2--B <| end |> Don\'T", "word " * 4000, "wörd's, (naïve)e\u0301,x A\u030a! l'été—d,…", "Ünïcode'S don't_stop... éa.b"]


def want(rows):
    tokenizer = Tokenizer.from_file(to.tokenizer_path())
    start, out = 0, []
    for doc, text in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files_hold_what_the_library_gives(spark, tmp_path):
    rows = [(k * 7 % 101, TEXTS[k % len(TEXTS)]) for k in range(101)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int")
    for block in (50, 1 << 20):
        path = f"file://{tmp_path}/{block}"
        to.write_tokens(frame, path, block_ids=block)
        got = to.read_tokens(spark.read.parquet(path), with_ids=True).collect()
        assert sorted(tuple(r) for r in got) == want(rows)


def test_empty_and_null_ids(spark, tmp_path):
    frame = spark.createDataFrame([(None, "x"), (3, "y"), (3, "y")], "doc_id long, text string")
    to.write_tokens(frame, f"file://{tmp_path}/a")
    got = to.read_tokens(spark.read.parquet(f"file://{tmp_path}/a")).collect()
    assert sorted((r.start, str(r.doc_id), r.n_tokens) for r in got) == [(0, "None", 2), (2, "3", 2), (4, "3", 2)]
    to.write_tokens(frame.where("doc_id > 5"), f"file://{tmp_path}/b")
    assert to.read_tokens(spark.read.parquet(f"file://{tmp_path}/b")).count() == 0


def test_cuts_change_no_id():
    """Random runs of letters, marks, blanks, special tokens and characters whose normal forms differ."""
    bits = list("abzABZJKk019 '\"-,.!?<|>=\n\t\x0b\x0c\x1c\x00\x7f\xa0\x85")
    bits += ["'s", "'re", "'LL", "'t", "''", "<|", "<|endoftext|>", "|>", "\u0301", "\u030c", "\u0338", "\u20e3", "\u212a", "\u0130", "\u03a3", "\u03c2"]
    bits += ["\xdf", "e\u0301", "\xc9", "\u65e5\u672c", "\u3000", "\u2028", "\u0663", "\xbd", "\xb2", "\u01c6", "\u2177", "\U0001f642", "\u0430", "\u042f", "\u200d", "\u02bc", "\u2019s", "\ufb01", "A\u030a"]
    rng = random.Random(11)
    encoder, tokenizer = to.WordEncoder(open(to.tokenizer_path()).read()), Tokenizer.from_file(to.tokenizer_path())
    for _ in range(30):
        texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 60]))) for _ in range(2000)]
        ids, sizes = encoder.encode([t.encode() for t in texts])
        got = np.split(ids, np.cumsum(sizes)[:-1])
        want = [e.ids + [to.END_ID] for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [t for t, g, w in zip(texts, got, want, strict=True) if g.tolist() != w] == []
