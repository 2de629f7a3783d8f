"""The write buffer: sizes, counters, and where an ordered stream of writes is cut into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of seqno and type in a key, and the overhead counted for a buffered entry.
TRAILER_BYTES, ENTRY_OVERHEAD = 9, 64


def buffered_size() -> Column:
    """Bytes counted for an entry in the buffer; a tombstone's value has none."""
    return F.octet_length("user_key") + TRAILER_BYTES + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_OVERHEAD


def buffer_statistics(pending: DataFrame) -> DataFrame:
    """One row: entries, approximate_size, min_seqno, max_seqno (null when empty), next_seqno."""
    return pending.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(buffered_size().cast("long")), F.lit(0)).alias("approximate_size"),
        F.min("seqno").alias("min_seqno"),
        F.max("seqno").alias("max_seqno"),
        (F.coalesce(F.max("seqno"), F.lit(0)) + 1).alias("next_seqno"),
    )


def should_flush(size: int, limit: int) -> bool:
    """A buffer is flushed after the insert that reaches the limit."""
    return size >= limit


def cut_numbers(sizes: np.ndarray, limit: int, carried: int = 0) -> tuple[np.ndarray, int]:
    """For sizes in order: how many flushes came before each entry, and the bytes left in the buffer
    at the end. An entry that makes the buffer reach ``limit`` is the last of its flush. One search a
    flush, none an entry."""
    total = np.cumsum(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), np.int64)
    begin, base, flush = 0, -carried, 0
    while begin < len(sizes):
        end = int(np.searchsorted(total, base + limit, side="left"))
        if end >= len(sizes):
            out[begin:] = flush
            return out, int(total[-1] - base)
        out[begin : end + 1] = flush
        base, begin, flush = int(total[end]), end + 1, flush + 1
    return out, 0


def flush_assignment(log: DataFrame, limit: int, stream: str = "stream") -> DataFrame:
    """``log`` with flush_id: which flush of its stream takes each write, in the order of seqno.

    Accumulate-and-reset is sequential in a stream, so streams (ingest shards) are the unit of
    parallelism; a task reads its sorted streams batch by batch and keeps one counter."""
    size = F.col(stream), F.col("seqno")
    rows = log.withColumn("_size", buffered_size().cast("long")).repartition(F.col(stream)).sortWithinPartitions(*size)
    schema = T.StructType([*log.schema.fields, T.StructField("flush_id", T.LongType())])
    at, sz, n = rows.columns.index(stream), len(rows.columns) - 1, len(log.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, carried, done = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, sizes = batch.column(at).to_pylist(), batch.column(sz).to_numpy()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            ids = np.zeros(len(names), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if current is None or names[a] != current[0]:
                    current, carried, done = (names[a],), 0, 0
                part, carried = cut_numbers(sizes[a:b], limit, carried)
                ids[a:b] = part + done
                done = int(ids[b - 1]) + (carried == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(ids)], [*batch.schema.names[:n], "flush_id"])

    return rows.mapInArrow(run, schema)
