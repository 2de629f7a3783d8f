"""Data model: the versioned log, its invariants and the settings of an engine.

A log row is one version of one key::

    user_key BINARY, seqno LONG, value_type INT, value BINARY

``seqno`` grows with every write, starting at 1; the row with the largest seqno of a key is its
newest version. ``value_type`` is 0 for a put and 1 for a delete (a tombstone, whose value is null).
Keys compare as unsigned bytes. All operators take the key column as it is: STRING keys work too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE = 0, 1
MAX_KEY_BYTES = (1 << 16) - 1
MAX_VALUE_BYTES = (1 << 31) - 1  # of one Spark value; the codec's field would allow 32 bits

@dataclass(frozen=True)
class RunOptions:
    """Layout of a sorted run. Fixed values of the format: 4 KiB blocks, a restart point every 16
    entries, 10 filter bits a key (0 turns the filter off), 7 hashes. Sorted files are cut at ``target_file_bytes``."""

    block_size: int = 4096
    restart_interval: int = 16
    bloom_bits_per_key: int = 10
    target_file_bytes: int = 128 << 20


@dataclass(frozen=True)
class EngineConfig:
    """Fixed defaults: a buffer of 64 MiB is flushed, 4 runs are compacted."""

    buffer_size_limit: int = 64 << 20
    compaction_threshold: int = 4


def changelog(events: DataFrame) -> DataFrame:
    """The ``events`` table as a log: one key a user, one version an event; errors delete."""
    kind = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return events.select(
        F.format_string("user_%06d", "user_id").alias("user_key"),
        (F.col("event_id") + 1).alias("seqno"),
        kind.cast("int").alias("value_type"),
        F.when(kind == PUT, F.col("props")).alias("value"),
    )


def value_type_name(value_type: Column) -> Column:
    """``put`` or ``delete``; null for any other code."""
    return F.when(value_type == PUT, "put").when(value_type == DELETE, "delete")


def checked_value_type(code: Column) -> Column:
    """The code itself; any other than 0 and 1 raises an error when it is met."""
    bad = F.raise_error(F.concat(F.lit("unknown value type "), F.coalesce(code.cast("string"), F.lit("null"))))
    return F.when(code.isin(PUT, DELETE), code.cast("int")).otherwise(bad.cast("int"))


def violations(log: DataFrame) -> DataFrame:
    """Rows (rule, n) of each broken invariant; empty for a sound log. One pass for the row rules,
    one aggregation by (key, seqno) for uniqueness."""
    key, value = F.col("user_key"), F.col("value")
    rules = {
        "null key": key.isNull(),
        "key too long": F.octet_length(key) > MAX_KEY_BYTES,
        "value too long": F.octet_length(value) > MAX_VALUE_BYTES,
        "seqno below 1": F.col("seqno").isNull() | (F.col("seqno") < 1),
        "unknown value type": F.col("value_type").isNull() | ~F.col("value_type").isin(PUT, DELETE),
        "delete with a value": (F.col("value_type") == DELETE) & (F.octet_length(value) > 0),
        "put without a value": (F.col("value_type") == PUT) & value.isNull(),
    }
    counts = log.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    found = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules])).alias("r")).select("r.rule", "r.n")
    repeated = log.groupBy("user_key", "seqno").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated version").alias("rule"), "n")
    return found.unionByName(repeated).where("n > 0")
