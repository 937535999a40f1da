import glob
import json

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import ledger as L


def test_ledger_keeps_revisions_and_baselines_over_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    first = [{"document_id": "d", "id": "i1", "seq": 1, "fingerprint": "f1"}, {"document_id": "d", "id": "i2", "seq": 2, "fingerprint": None}, {"document_id": "e", "id": "j1", "seq": 1, "fingerprint": None}]
    (source / "1.json").write_text("\n".join(map(json.dumps, first)))
    stream = spark.readStream.schema("document_id string, id string, seq int, fingerprint string").option("maxFilesPerTrigger", 1).json(str(source))

    def run():
        L.write_ledger(L.ledger(stream), str(out), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    (source / "2.json").write_text(json.dumps({"document_id": "d", "id": "i3", "seq": 3, "fingerprint": "f2"}))
    run()
    assert glob.glob(f"{out}/batch=*")
    got = {r.id: (r.revision, r.baseline, r.compares) for r in spark.read.parquet(str(out)).collect()}
    assert got == {"i1": (1, None, False), "i2": (2, "f1", False), "j1": (1, None, False), "i3": (3, "f1", True)}


@pytest.mark.parametrize("operator, want", [(L.windowed_counts, {("10:00", 2), ("11:40", 1), ("12:00", 1)}), (L.sessions, {("10:00", 2), ("11:44", 1), ("12:00", 1)})])
def test_rows_behind_the_watermark_are_left_out(spark, tmp_path, operator, want):
    """Each file is a batch: after 12:00 the watermark is 11:30, so 10:06 is late and 11:44 is not."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = spark.readStream.schema("ts timestamp, kind string, value double").json(str(source))
    for k, times in enumerate((["10:00", "10:05", "12:00"], ["10:06", "11:44"], ["20:00"])):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{t}:00Z", "kind": "a", "value": 1.0}) for t in times))
        done = operator(stream, ["kind"]).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        done.start(str(out)).awaitTermination()
    got = spark.read.parquet(str(out)).select(F.date_format("start", "HH:mm"), "n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_an_event_at_the_end_of_the_gap_goes_on_with_the_session(spark):
    rows = [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:15:00"), ("a", "2024-01-01 10:30:01"), ("b", "2024-01-01 10:15:00")]
    events = spark.createDataFrame(rows, "kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.kind, r.n) for r in L.sessions(events, ["kind"]).collect()) == [("a", 1), ("a", 2), ("b", 1)]
