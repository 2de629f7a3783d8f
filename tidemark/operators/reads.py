"""Reads of a versioned log: newest, as of a version, by probe keys, and history.

``max_by`` of a struct is the core: it aggregates on the map side, so a hot key moves one row a task,
and a struct is never null, so tombstones are not skipped. Tombstones are filtered only after
the newest version is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETE, PUT

_VERSION = ("seqno", "value_type", "value")
#: Seqnos that one task may see of a key, where the versions of a key are read in order.
SPAN = 1 << 20
FOUND, DELETED, NOT_FOUND = "Found", "Deleted", "NotFound"


def newest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones included; with ``as_of`` only versions with
    ``seqno <= as_of`` are seen (inclusive)."""
    seen = log if as_of is None else log.where(F.col("seqno") <= as_of)
    return seen.groupBy("user_key").agg(F.max_by(F.struct(*_VERSION), "seqno").alias("_v")).select("user_key", "_v.*")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys whose newest visible version is a put."""
    return newest(log, as_of).where(F.col("value_type") == PUT).select("user_key", "seqno", "value")


def deleted(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys whose newest visible version is a tombstone (the key need not have been put before)."""
    return newest(log, as_of).where(F.col("value_type") == DELETE).select("user_key", "seqno")


def get(log: DataFrame, key: object, as_of: int | None = None) -> DataFrame:
    """One key's live value, or no row. The key predicate reaches the scan."""
    return live(log.where(F.col("user_key") == F.lit(key)), as_of)


def get_detail(log: DataFrame, probes: DataFrame, as_of: int | None = None) -> DataFrame:
    """Each probe key with status Found, Deleted or NotFound, and the value where found. Probes
    restrict the log before it is aggregated."""
    wanted = probes.select("user_key").distinct()
    state = newest(log.join(wanted, "user_key", "left_semi"), as_of)
    return probes.select("user_key").join(state, "user_key", "left").select("user_key", status(F.col("value_type")).alias("status"), "seqno", "value")


def status(value_type: Column) -> Column:
    """Lookup result of a newest version (null: there is none)."""
    return F.when(value_type == PUT, FOUND).when(value_type == DELETE, DELETED).otherwise(NOT_FOUND)


def get_at(log: DataFrame, probes: DataFrame, span: int = SPAN) -> DataFrame:
    """As-of join: for each probe (user_key, as_of) the newest version with ``seqno <= as_of``.

    Probes and versions are merged into one stream ordered by version and the last version is carried to
    the probes behind it: linear in both sides, where a range join would pair every probe with all older
    versions of its key. Streams are (key, ``span`` seqnos), so a hot key is spread over tasks; what is
    carried into a span is the newest version of the spans before, one row a key and span."""
    keys = probes.select("user_key").distinct()
    span_of = lambda c: F.floor(F.col(c) / span).alias("_span")
    versions = log.join(keys, "user_key", "left_semi").select(
        "user_key", F.col("seqno").alias("_at"), span_of("seqno"), F.lit(0).alias("_probe"), F.struct(*_VERSION).alias("_v")
    )
    none = F.lit(None).cast(versions.schema["_v"].dataType).alias("_v")
    asked = probes.select("user_key", F.col("as_of").alias("_at"), span_of("as_of"), F.lit(1).alias("_probe"), none)
    before = Window.partitionBy("user_key", "_span").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    merged = versions.unionByName(asked).withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_probe = 1")
    ends = versions.groupBy("user_key", "_span").agg(F.max_by("_v", "_at").alias("_v"))
    both = ends.unionByName(asked.select("user_key", "_span", "_v").distinct()).groupBy("user_key", "_span").agg(F.max("_v").alias("_v"))
    earlier = Window.partitionBy("user_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select("user_key", "_span", F.last("_v", ignorenulls=True).over(earlier).alias("_carried"))
    found = merged.join(carried, ["user_key", "_span"], "left").withColumn("_v", F.coalesce("_v", "_carried"))
    kind = F.col("_v.value_type")
    return found.select("user_key", F.col("_at").alias("as_of"), status(kind).alias("status"), F.col("_v.seqno").alias("seqno"), F.when(kind == PUT, F.col("_v.value")).alias("value"))


def history(log: DataFrame, span: int = SPAN) -> DataFrame:
    """All versions of each key, numbered from the newest (1), with the seqno that ended each.

    Versions are numbered in (key, ``span`` seqnos), so a hot key is spread over tasks; a span's rows go on from
    the number of versions in the spans after it, and its newest version was ended by the oldest of those."""
    rows = log.withColumn("_span", F.floor(F.col("seqno") / span))
    inside = Window.partitionBy("user_key", "_span").orderBy(F.desc("seqno"))
    after = Window.partitionBy("user_key").orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("user_key", "_span").agg(F.count(F.lit(1)).alias("_n"), F.min("seqno").alias("_oldest"))
    spans = spans.select("user_key", "_span", F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_newer"), F.min("_oldest").over(after).alias("_next"))
    rows = rows.withColumn("_place", F.row_number().over(inside)).withColumn("_ended", F.lag("seqno").over(inside))
    version, ended = (F.col("_newer") + F.col("_place")).alias("version"), F.coalesce("_ended", "_next").alias("superseded_by")
    return rows.join(spans, ["user_key", "_span"]).select(*log.columns, version, ended)


def resurrected(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Puts whose preceding version of the same key is a tombstone; read in spans as in ``history``."""
    rows = log.withColumn("_span", F.floor(F.col("seqno") / span))
    inside = Window.partitionBy("user_key", "_span").orderBy("seqno")
    earlier = Window.partitionBy("user_key").orderBy("_span").rowsBetween(-1, -1)
    spans = rows.groupBy("user_key", "_span").agg(F.max_by("value_type", "seqno").alias("_last"))
    spans = spans.select("user_key", "_span", F.first("_last").over(earlier).alias("_last"))
    rows = rows.withColumn("_before", F.lag("value_type").over(inside)).join(spans, ["user_key", "_span"])
    return rows.where((F.coalesce("_before", "_last") == DELETE) & (F.col("value_type") == PUT)).select("user_key", "seqno", "value")


def present(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Probe keys that are live (semi join)."""
    return probes.join(live(log).select("user_key"), "user_key", "left_semi")


def absent(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Probe keys that are deleted or unknown (anti join)."""
    return probes.join(live(log).select("user_key"), "user_key", "left_anti")


def scan(log: DataFrame, first: object | None = None, last: object | None = None, as_of: int | None = None) -> DataFrame:
    """Live rows with ``first <= key < last`` in key order (an extension: range scan)."""
    rows = log
    if first is not None:
        rows = rows.where(F.col("user_key") >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col("user_key") < F.lit(last))
    return live(rows, as_of).orderBy("user_key")


def sources_consulted(log: DataFrame) -> DataFrame:
    """Read amplification: how many runs, newest first, a lookup of each key opens before it meets
    the key, if no run is skipped. Runs are numbered from 1 in order of age."""
    runs = log.agg(F.max("run_id").alias("_newest"))  # one row
    return log.groupBy("user_key").agg(F.max("run_id").alias("run_id")).join(F.broadcast(runs)).select("user_key", (F.col("_newest") - F.col("run_id") + 1).alias("runs_read"))


def candidate_runs(manifest: DataFrame, probes: DataFrame) -> DataFrame:
    """Runs that may hold a version visible to a probe (user_key, as_of): the key is in the run's
    range and the run has a seqno at or below as_of. A manifest has one row a run."""
    inside = (F.col("user_key") >= F.col("first_key")) & (F.col("user_key") <= F.col("last_key")) & (F.col("min_seqno") <= F.col("as_of"))
    return probes.join(F.broadcast(manifest.select("run_id", "first_key", "last_key", "min_seqno")), inside).select("user_key", "as_of", "run_id")
