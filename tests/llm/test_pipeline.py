import re
from collections import Counter

import pytest
from brute import near_components

import corpus_pipeline
from paperloom.llm import mixing, quality, sentencepiece_sampling

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """What each stage kept, as (name, rows in, rows out)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, folder = {"": docs}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        found[name] = docs
    return found


def test_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert outputs[name].dtypes == outputs[""].dtypes


def test_quality_drops_what_scores_low(spark, outputs):
    docs = outputs[""]
    trees = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, trees).where("score >= 0.3").collect()}
    assert {r.doc_id for r in outputs["quality"].collect()} == want


def test_exact_copies_go(outputs):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for r in outputs["quality"].collect():
        best[body(r.text)] = min(best.get(body(r.text), (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in outputs["exact_dedup"].collect()) == sorted(x[1] for x in best.values())


def test_near_copies_go(outputs):
    rows = [(r.doc_id, r.text) for r in outputs["exact_dedup"].collect()]
    want = sorted({c for _, c in near_components(rows).values()})
    assert sorted(r.doc_id for r in outputs["near_dedup"].collect()) == want


def test_mix_follows_its_plan(outputs):
    plan = mixing.mix_plan(outputs["near_dedup"])
    want = {r.sk: (r.target, r.taken) for r in plan.groupBy("sk").agg({"taken": "sum", "target": "max"}).selectExpr("sk", "`max(target)` AS target", "`sum(taken)` AS taken").collect()}
    words = Counter()
    for r in outputs["mixing"].collect():
        words["1" if r.source is None else "0" + r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    for source, (target, taken) in want.items():
        assert words[source] == taken and abs(taken - target) <= 0.5


def test_pieces_spell_the_texts(outputs):
    out = sentencepiece_sampling.decode(outputs["sentencepiece"]).collect()
    assert all(r.decoded == r.text for r in out)
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in outputs["mixing"].collect())


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
