"""Streams: the revision ledger as a keyed stateful operator, and windowed counts of events with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENTRY = "document_id string, id string, revision bigint, fingerprint string, baseline string, compares boolean"
STATE = "revision bigint, baseline string"


def _entries(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Number a document's intents in the order of their sequence; the baseline moves only when a version comes."""
    revision, baseline = state.get if state.exists else (0, None)
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    out = []
    for entry in rows.itertuples(index=False):
        revision += 1
        version = entry.fingerprint if isinstance(entry.fingerprint, str) else None
        out.append((key[0], entry.id, revision, version, baseline, version is not None and baseline is not None))
        baseline = version or baseline
    state.update((revision, baseline))
    yield pd.DataFrame(out, columns=["document_id", "id", "revision", "fingerprint", "baseline", "compares"])


def ledger(intents: DataFrame) -> DataFrame:
    """Entries of a stream of intents (document_id, id, seq, fingerprint): revisions and baselines per document.

    State is one number and one fingerprint a document, in the state store, so executors may be lost."""
    return intents.groupBy("document_id").applyInPandasWithState(_entries, ENTRY, STATE, "append", GroupStateTimeout.NoTimeout)


def write_ledger(entries: DataFrame, path: str, checkpoint: str):
    """Append entries as a table. A batch that is run again overwrites its own folder, so each entry is there once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return entries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, by: list[str], width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums in tumbling (or sliding) windows of event time, with a watermark for late rows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, by: list[str], gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions that end after more than a gap without events: one exactly at the gap's end still belongs."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def ring(events: DataFrame, order: list, size: int = 256) -> DataFrame:
    """The newest events: a top-k that keeps `size` rows of each partition before they meet."""
    return events.orderBy(*order).limit(size)
