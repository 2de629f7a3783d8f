"""Merging runs: newest version of each key, tombstones, snapshots, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETE, PUT, EngineConfig
from .reads import newest


def should_compact(runs: int, config: EngineConfig = EngineConfig()) -> bool:
    return runs >= config.compaction_threshold


def merge(runs: list[DataFrame], drop_tombstones: bool) -> DataFrame:
    """Newest version of each key over all runs. A tombstone erases older puts in any run; whether
    it stays itself is decided afterwards."""
    rows = newest(reduce(DataFrame.unionByName, runs))
    return rows.where(F.col("value_type") == PUT) if drop_tombstones else rows


def merge_with_snapshots(log: DataFrame, fences: list[int], drop_tombstones: bool = True) -> DataFrame:
    """Merge that keeps what registered snapshots can see: of each key the newest version, and for
    each fence the newest version at or below it. A tombstone goes only if nothing older of its key
    is kept (then absence says the same)."""
    cuts = sorted(set(fences))
    # a version belongs to the first fence at or above it; the newest of each interval is seen
    interval = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        interval = F.when(F.col("seqno") <= cuts[i], i).otherwise(interval)
    tagged = log.withColumn("_interval", interval)
    kept = tagged.groupBy("user_key", "_interval").agg(F.max_by(F.struct("seqno", "value_type", "value"), "seqno").alias("_v")).select("user_key", "_v.*")
    if not drop_tombstones:
        return kept
    older = Window.partitionBy("user_key").orderBy("seqno").rowsBetween(Window.unboundedPreceding, -1)
    puts = F.coalesce(F.max((F.col("value_type") == PUT).cast("int")).over(older), F.lit(0))
    return kept.withColumn("_older", puts).where((F.col("value_type") == PUT) | (F.col("_older") == 1)).drop("_older")


def statistics(log: DataFrame, drop_tombstones: bool = True) -> DataFrame:
    """One row: entries in and out of a compaction, runs made obsolete, whether a run is written."""
    per_key = log.groupBy("user_key").agg(F.count(F.lit(1)).alias("n"), F.max_by("value_type", "seqno").alias("t"))
    out = F.count_if(F.lit(not drop_tombstones) | (F.col("t") == PUT))
    totals = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_entries"), out.alias("output_entries"), F.count_if(F.col("t") == DELETE).alias("newest_is_delete"))
    runs = log.agg(F.count_distinct("run_id").alias("obsolete_runs"))  # one row
    return totals.join(F.broadcast(runs)).withColumn("new_runs", F.when(F.col("output_entries") > 0, 1).otherwise(0).cast("long"))
