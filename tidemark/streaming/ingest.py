"""Structured Streaming: a stream of changes into a store, and the newest state of each key.

A micro-batch is the flush unit: it becomes one run. The batch's number is committed with its run, in
one manifest, so a batch that is repeated after a failure is written once. One stream writes to a
store. Runs are merged by tiers of size, so rows are not rewritten at every compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..model import EngineConfig
from ..operators.compaction import should_compact
from ..operators.numbering import numbered
from ..sources.runs import RunStore


def ingest(changes: DataFrame, store: RunStore, checkpoint: str, order: list[str], config: EngineConfig = EngineConfig(), trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of (user_key, value_type, value, ...) rows to ``store``. Each batch's rows get the
    next seqnos in the order of ``order``; runs are compacted from the threshold on."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= store.last_batch() or batch.isEmpty():
            return
        start = max([r.max_seqno for r in store.runs()], default=0) + 1
        rows = numbered(batch, order, start, "seqno")
        store.flush(rows.select("user_key", "seqno", F.col("value_type").cast("int"), "value"), batch_id)
        if should_compact(len(store.runs()), config):
            store.compact_tier(config.compaction_threshold)

    writer = changes.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def newest_state(changes: DataFrame) -> DataFrame:
    """Stream of (user_key, seqno, value_type, value), in update mode: each batch gives the keys that it
    has rows of, with their newest version so far. One version a key is kept as state, in the JVM; late, older versions change nothing."""
    version = F.struct(F.col("seqno").cast("long").alias("seqno"), F.col("value_type").cast("int").alias("value_type"), "value")
    newest = changes.groupBy("user_key").agg(F.max_by(version, F.col("seqno").cast("long")).alias("v"))
    return newest.select("user_key", "v.seqno", "v.value_type", "v.value")


def windowed_activity(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Writes and deletes for each event-time window, with a watermark for late rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"))
    counted = w.agg(F.count_if(F.col("event_type") != "error").alias("puts"), F.count_if(F.col("event_type") == "error").alias("deletes"))
    return counted.select(F.col("w.start").alias("window_start"), "puts", "deletes")
