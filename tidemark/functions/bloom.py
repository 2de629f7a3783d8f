"""Bloom filters of runs: built by groups of keys, probed in Arrow batches.

A run's keys are dealt to parts of about ``part_keys`` keys by a hash, each with a filter of its own, so that no
row holds the filter of a large run and no task all of its keys or probes. A filter stores its number of bits, so
building and probing agree for every number of keys and there are no false negatives. A key's bits come
from the two halves of one 128-bit hash, as many as are needed by repeated addition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the filter's format.
HASHES = 7
LEAST_BITS = 64
PART_KEYS = 1_000_000


def filter_bits(keys: int, bits_per_key: int) -> int:
    """Bits of a filter for so many keys."""
    return max(keys * bits_per_key, LEAST_BITS)


def positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Keys x HASHES bit numbers."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return (halves[:, :1] + np.arange(HASHES, dtype=np.uint64) * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)


def build(keys: list[bytes], bits_per_key: int) -> tuple[int, bytes]:
    """(number of bits, bytes); the lowest bit of a byte comes first."""
    bits = filter_bits(len(keys), bits_per_key)
    on = np.zeros(-(-bits // 8), np.uint8)
    if keys:
        at = positions(keys, bits).ravel()
        np.bitwise_or.at(on, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits, on.tobytes()


def may_contain(keys: list[bytes], bits: int, data: bytes) -> np.ndarray:
    """False only for keys that are not in the filter."""
    if not keys:
        return np.zeros(0, bool)
    at, raw = positions(keys, bits).astype(np.int64), np.frombuffer(data, np.uint8)
    return ((raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _part(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("binary")), parts).cast("int")


def build_filters(log: DataFrame, bits_per_key: int = 10, run: str = "run_id", part_keys: int = PART_KEYS) -> DataFrame:
    """(run, part, parts, n_keys, num_bits, bits): the filters of each run, over the keys of all its versions."""
    sizes = log.groupBy(run).agg(F.ceil(F.count(F.lit(1)) / part_keys).cast("int").alias("parts"))  # one row a run
    keyed = log.select(run, F.col("user_key").cast("binary").alias("key")).join(F.broadcast(sizes), run).withColumn("part", _part(F.col("key"), F.col("parts")))
    kind = log.schema[run].dataType.simpleString()

    def make(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        bits, data = build(keys, bits_per_key)
        first = {c: table.column(c).slice(0, 1) for c in (run, "part", "parts")}
        return pa.table({**first, "n_keys": pa.array([len(keys)], pa.int64()), "num_bits": pa.array([bits], pa.int64()), "bits": pa.array([data], pa.binary())})

    return keyed.groupBy(run, "part").applyInArrow(make, f"{run} {kind}, part int, parts int, n_keys long, num_bits long, bits binary")


def probe_filters(filters: DataFrame, probes: DataFrame, run: str = "run_id") -> DataFrame:
    """``probes`` (run, user_key) with may_contain. Probes meet their part of the run's filter in one group;
    a run without filters holds no key."""
    kind = filters.schema[run].dataType.simpleString()
    key_kind = probes.schema["user_key"].dataType.simpleString()
    parts = filters.groupBy(run).agg(F.max("parts").alias("parts"))  # one row a run
    asked = probes.select(run, "user_key").join(F.broadcast(parts), run, "left")
    asked = asked.withColumn("part", F.coalesce(_part(F.col("user_key"), F.col("parts")), F.lit(0))).drop("parts")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("user_key").cast(pa.binary()).to_pylist()
        hit = may_contain(keys, left.column("num_bits")[0].as_py(), left.column("bits")[0].as_py()) if left.num_rows else np.zeros(len(keys), bool)
        return pa.table({run: right.column(run), "user_key": right.column("user_key"), "may_contain": pa.array(hit, pa.bool_())})

    both = filters.groupBy(run, "part").cogroup(asked.groupBy(run, "part"))
    return both.applyInArrow(check, f"{run} {kind}, user_key {key_kind}, may_contain boolean")
