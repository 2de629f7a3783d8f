"""Checksums of entries, blocks and runs, from built-in hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import encode_entry


def checksum128(data: Column) -> Column:
    """32 hexadecimal digits from two independent 64-bit hashes of the bytes."""
    second = F.xxhash64(F.lit(0x5EED).cast("long"), data)
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(data), second)])


def entry_checksums(log: DataFrame) -> DataFrame:
    """``log`` with checksum: sha-256 of each encoded entry."""
    return log.withColumn("checksum", F.sha2(encode_entry(), 256))


def run_checksums(log: DataFrame, run: str = "run_id") -> DataFrame:
    """One order-independent checksum a run: XOR of the entries' crc32 and their sum, so it is made by
    partial aggregation and does not depend on how a run is split."""
    crc = F.crc32(encode_entry())
    return log.groupBy(run).agg(F.bit_xor(crc).alias("crc_xor"), F.sum(crc).cast("long").alias("crc_sum"), F.count(F.lit(1)).alias("entries"))


def verify_runs(log: DataFrame, expected: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs whose rows do not give the expected checksums (missing and unexpected runs too)."""
    now = run_checksums(log, run)
    pair = now.alias("n").join(expected.alias("e"), F.col(f"n.{run}") == F.col(f"e.{run}"), "full")
    differs = ~F.col("n.crc_xor").eqNullSafe(F.col("e.crc_xor")) | ~F.col("n.crc_sum").eqNullSafe(F.col("e.crc_sum")) | ~F.col("n.entries").eqNullSafe(F.col("e.entries"))
    return pair.where(differs).select(F.coalesce(F.col(f"n.{run}"), F.col(f"e.{run}")).alias(run))
