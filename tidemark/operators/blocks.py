"""Blocks of a sorted run: order, restart points, packing, block index and lookups through it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import encoded_size
from ..functions.names import fresh
from ..model import RunOptions
from .numbering import numbered, scratch

#: Bytes of a restart offset, and of the counters and checksum that end a block.
RESTART_BYTES, BLOCK_TAIL = 4, 24
#: Probes are kept in lists of so many; runs are dealt to so many copies of the lists, at most one a run.
SPAN_ITEMS, SPAN_DEALS = 1024, 32


def sorted_position(log: DataFrame, run: str = "run_id") -> DataFrame:
    """``log`` with position: 0, 1, 2, ... in each run, by key and newest first. One range sort numbers all
    runs through, and each run's first number is taken off, so a run of any size is spread over tasks."""
    n = fresh("row_number", log.columns)
    rows = numbered(log, [run, "user_key", F.desc("seqno")], name=n)
    firsts = rows.groupBy(run).agg(F.min(n).alias(f"{n}_first"))  # one row a run
    return rows.join(F.broadcast(firsts), run).select(*log.columns, (F.col(n) - F.col(f"{n}_first")).alias("position"))


def is_restart(position: Column, interval: int) -> Column:
    """Whether the entry at this position of a block is a restart point."""
    return position % interval == 0


def pack_sizes(sizes: np.ndarray, opts: RunOptions, state: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, tuple[int, int]]:
    """Whether each entry opens a block. ``state``: bytes and entries of the open block.

    The first entry that does not fit is found by search over the cumulated sizes, which count
    four bytes for each restart point; so the work is one search a block."""
    n, r = len(sizes), opts.restart_interval
    opens = np.zeros(n, bool)
    total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    held, count = state
    i = 0
    while i < n:
        if count == 0:
            opens[i] = True
            held, count, i = int(sizes[i]), 1, i + 1
            continue
        # entry i + k fits if bytes before it, restart points before it, the tail and it itself fit
        reach = min(n - i, max(64, opts.block_size // 8))
        k = np.arange(reach)
        before = held + total[i : i + reach] - total[i]
        restarts = -(-(count + k) // r) * RESTART_BYTES
        full = np.flatnonzero(before + restarts + BLOCK_TAIL + sizes[i : i + reach] > opts.block_size)
        step = int(full[0]) if len(full) else reach
        held, count, i = held + int(total[i + step] - total[i]), count + step, i + step
        if len(full):
            count = 0
    return opens, (held, count)


def pack_blocks(log: DataFrame, opts: RunOptions = RunOptions(), run: str = "run_id", offsets: bool = False) -> DataFrame:
    """``log`` with block_id (in its run) and slot (in its block), cut as a writer of the format
    would: a block is closed when the next entry would take it over ``block_size``. With ``offsets``
    also block_offset, the bytes of the run's blocks before."""
    rows = log.withColumn("_size", encoded_size().cast("long")).repartition(F.col(run)).sortWithinPartitions(run, "user_key", F.desc("seqno"))
    added = ["block_id", "slot", "block_offset"][: 3 if offsets else 2]
    schema = T.StructType([*log.schema.fields, *[T.StructField(c, T.LongType()) for c in added]])
    at, n = rows.columns.index(run), len(log.columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, block, slot, begin, held, restarts = None, (0, 0), -1, 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, sizes = batch.column(at).to_pylist(), batch.column(n).to_numpy()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            ids, slots, begins = (np.zeros(len(names), np.int64) for _ in range(3))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if current is None or names[a] != current[0]:
                    current, state, block, slot, begin, held, restarts = (names[a],), (0, 0), -1, 0, 0, 0, 0
                opens, state = pack_sizes(sizes[a:b], opts, state)
                ids[a:b] = block + np.cumsum(opens)
                first = np.maximum.accumulate(np.where(opens, np.arange(b - a), -1))
                slots[a:b] = np.where(first >= 0, np.arange(b - a) - first, np.arange(b - a) + slot)
                # where a block would begin at each entry: after the entries, restart points and tails before it
                size, restart = sizes[a:b].astype(np.int64), slots[a:b] % opts.restart_interval == 0
                at_entry = held + np.cumsum(size) - size + RESTART_BYTES * (restarts + np.cumsum(restart) - restart) + BLOCK_TAIL * ids[a:b]
                begins[a:b] = np.where(first >= 0, at_entry[np.maximum(first, 0)], begin)
                block, slot, begin, held, restarts = int(ids[b - 1]), int(slots[b - 1]) + 1, int(begins[b - 1]), held + int(size.sum()), restarts + int(restart.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *map(pa.array, (ids, slots, begins)[: len(added)])], [*batch.schema.names[:n], *added])

    return rows.mapInArrow(pack, schema)


def block_index(packed: DataFrame, opts: RunOptions = RunOptions(), run: str = "run_id") -> DataFrame:
    """One row a block: last_key, entries, block_len, block_offset (bytes of the blocks before)."""
    entries = F.count(F.lit(1))
    length = F.sum(encoded_size().cast("long")) + F.ceil(entries / opts.restart_interval) * RESTART_BYTES + BLOCK_TAIL
    blocks = packed.groupBy(run, "block_id").agg(F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"), entries.alias("entries"), length.cast("long").alias("block_len"))
    before = Window.partitionBy(run).orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("block_offset", F.coalesce(F.sum("block_len").over(before), F.lit(0)))


def find_block(index: DataFrame, probes: DataFrame, run: str = "run_id") -> DataFrame:
    """For each probe key and run: the first block whose last key is at or above it; keys beyond a
    run's last key, and null keys, have no row. A block's probes are a span of the sorted probes (`in_spans`)."""
    # equal keys may end several blocks: the first of them counts, so entries are taken by their least id
    ends = index.groupBy(run, "last_key").agg(F.min("block_id").alias("block_id"))
    ends = ends.select(run, "block_id", F.col("last_key").alias("_key"), F.lit(2).alias("_side"))
    items, placed = in_order(probes.select("user_key").distinct(), ends)
    before = Window.partitionBy(run).orderBy("_key")
    spans = placed.select(run, "block_id", F.coalesce(F.lag("_n").over(before), F.lit(0)).alias("_from"), F.col("_n").alias("_to"))
    return in_spans(items, spans, run).select(run, "user_key", "block_id")


def in_order(items: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items`` (user_key and others) with their number _n from 0 in the order of all their columns, and ``points``
    (_key, _side and others) with _n, the number of items below _key (_side 0) or at or below it (_side 2). Null keys are left out.

    Items and points are sorted together and written once; the items of each part are counted, so no task sees more than its part."""
    spark, names, others = items.sparkSession, items.columns, [c for c in points.columns if c not in ("_key", "_side")]
    asked = items.where("user_key IS NOT NULL").select(F.col("user_key").alias("_key"), F.lit(1).alias("_side"), F.struct(*names).alias("_item"))
    both = asked.unionByName(points.where("_key IS NOT NULL").select("_key", "_side", F.struct(*others).alias("_point")), allowMissingColumns=True)
    marked = both.orderBy("_key", "_side", "_item", "_point").withColumn("_mark", F.monotonically_increasing_id())
    path = scratch(spark, "in-order")
    marked.write.parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path).withColumn("_part", F.shiftrightunsigned("_mark", 33))
    is_item = (F.col("_side") == 1).cast("long")
    offsets, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in rows.groupBy("_part").agg(F.sum(is_item)).collect()):  # one row a part
        offsets.append((part, total))
        total += n
    so_far = F.sum(is_item).over(Window.partitionBy("_part").orderBy("_mark").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_n", so_far).join(F.broadcast(spark.createDataFrame(offsets, "_part long, _offset long")), "_part").withColumn("_n", F.col("_n") + F.col("_offset"))
    return rows.where("_side = 1").select("_item.*", (F.col("_n") - 1).alias("_n")), rows.where("_side <> 1").select("_point.*", "_key", "_side", "_n")


def in_spans(items: DataFrame, spans: DataFrame, run: str = "run_id") -> DataFrame:
    """Each row of ``spans`` with each of the items numbered _from <= _n < _to. Items are kept in lists of SPAN_ITEMS, and spans meet lists, so what
    is shuffled are items and spans, and pairs are made where they are used. Runs are dealt to SPAN_DEALS, each with lists of its own."""
    names = [c for c in items.columns if c != "_n"]
    deal = F.pmod(F.xxhash64(run), F.lit(SPAN_DEALS)).cast("int").alias("_deal")
    spans = spans.where("_from < _to").select("*", deal)
    first, last = F.floor(F.col("_from") / SPAN_ITEMS), F.floor((F.col("_to") - 1) / SPAN_ITEMS)
    pieces = spans.select("*", F.explode(F.sequence(first, last)).alias("_list"))
    lists = items.groupBy(F.floor(F.col("_n") / SPAN_ITEMS).alias("_list")).agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*names).alias("_item"))))["_item"].alias("_items"))
    lists = lists.join(F.broadcast(spans.select("_deal").distinct()))
    begin = F.greatest(F.col("_from") - F.col("_list") * SPAN_ITEMS, F.lit(0)).cast("int")
    end = F.least(F.col("_to") - F.col("_list") * SPAN_ITEMS, F.lit(SPAN_ITEMS)).cast("int")
    met = pieces.join(lists.hint("merge"), ["_deal", "_list"])
    kept = [c for c in spans.columns if c not in ("_from", "_to", "_deal")]
    return met.select(*kept, F.explode(F.slice("_items", begin + 1, end - begin)).alias("_item")).select(*kept, "_item.*")
