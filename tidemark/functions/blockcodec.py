"""Blocks as bytes: built by aggregation, read back and searched in Arrow batches.

A block is its entries, the offsets of its restart points (4 bytes each), their number (4), the number of
entries (4), and a checksum of all before (16); numbers are big-endian. A search halves the restart points by
(key, newest first) and reads on from the last one before the version it wants, so versions of a key on both sides of a restart
point are found."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RunOptions
from .codec import encode_entry

#: Fixed value: bytes of the two counters and the checksum.
TAIL = 24


def _number(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


def block_payloads(packed: DataFrame, opts: RunOptions = RunOptions(), run: str = "run_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(run, block_id, entries, payload): the bytes of each block without its checksum, from rows with
    block_id and slot. Blocks are bounded by ``block_size`` (or one entry), so groups are small. Columns ``also``
    have one value in a block and are kept."""
    none = F.unhex(F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct("slot", encode_entry().alias("e"))))
    blocks = packed.groupBy(run, "block_id", *also).agg(F.count(F.lit(1)).alias("entries"), rows.alias("rows"))
    start = F.struct(none.alias("bytes"), none.alias("restarts"))

    def add(acc: Column, row: Column) -> Column:
        restart = F.when(row["slot"] % opts.restart_interval == 0, _number(F.octet_length(acc["bytes"]))).otherwise(none)
        return F.struct(F.concat(acc["bytes"], row["e"]).alias("bytes"), F.concat(acc["restarts"], restart).alias("restarts"))

    blocks = blocks.withColumn("b", F.aggregate("rows", start, add))
    tail = F.concat(_number(F.octet_length(F.col("b.restarts")) / 4), _number(F.col("entries")))
    return blocks.select(run, "block_id", *also, "entries", F.concat("b.bytes", "b.restarts", tail).alias("payload"))


def checksum(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def seal_blocks(payloads: DataFrame, run: str = "run_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(run, block_id, block) and columns ``also``: payloads with their checksums."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sealed = [p + checksum(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sealed, pa.binary()), *b.columns[3:]], [run, "block_id", "block", *also])

    kinds = {c: payloads.schema[c].dataType.simpleString() for c in (run, *also)}
    kept = "".join(f", {c} {kinds[c]}" for c in also)
    return payloads.select(run, "block_id", "payload", *also).mapInArrow(run_, f"{run} {kinds[run]}, block_id long, block binary{kept}")


def parse_block(block: bytes) -> tuple[list[tuple[bytes, int, int, bytes]], list[int]]:
    """Entries and restart offsets; ValueError for too few bytes, a wrong checksum, bad counts or types."""
    body, end, restarts, count = _body(block)
    offsets = list(struct.unpack(f">{restarts}I", body[end : end + 4 * restarts]))
    rows, at = [], 0
    for _ in range(count):
        (k,) = struct.unpack_from(">H", body, at)
        key = body[at + 2 : at + 2 + k]
        seqno, kind, n = struct.unpack_from(">QBI", body, at + 2 + k)
        at += 15 + k
        if kind > 1 or at + n > end:
            raise ValueError("an entry is malformed")
        rows.append((key, seqno, kind, body[at : at + n]))
        at += n
    if at != end:
        raise ValueError("bytes are left after the entries")
    return rows, offsets


def _body(block: bytes) -> tuple[bytes, int, int, int]:
    """Contents without the checksum (which is checked), where the entries end, restart points, entries."""
    if len(block) < TAIL:
        raise ValueError("a block has 24 bytes at least")
    body = block[:-16]
    if checksum(body) != block[-16:]:
        raise ValueError("checksum mismatch")
    restarts, count = struct.unpack(">II", body[-8:])
    end = len(body) - 8 - 4 * restarts
    if end < 0:
        raise ValueError("restart points do not fit")
    return body, end, restarts, count


def _entry(body: bytes, at: int) -> tuple[bytes, int, int, int, int]:
    """Key, seqno, type, where the value begins and ends."""
    (k,) = struct.unpack_from(">H", body, at)
    seqno, kind, n = struct.unpack_from(">QBI", body, at + 2 + k)
    return body[at + 2 : at + 2 + k], seqno, kind, at + 15 + k, at + 15 + k + n


def search_block(block: bytes, key: bytes, limit: int = (1 << 63) - 1) -> tuple[int, int, bytes] | None:
    """(seqno, value_type, value) of the newest version of the key at or below ``limit``."""
    body, end, restarts, _ = _body(block)
    wanted = (key, -limit)

    def place(i: int) -> tuple[bytes, int]:
        k, seqno, *_ = _entry(body, struct.unpack_from(">I", body, end + 4 * i)[0])
        return k, -seqno

    after = bisect_right(range(restarts), wanted, key=place)
    at = struct.unpack_from(">I", body, end + 4 * max(after - 1, 0))[0] if restarts else 0
    while at < end:
        k, seqno, kind, begin, at = _entry(body, at)
        if (k, -seqno) >= wanted:
            return (seqno, kind, body[begin:at]) if k == key else None
    return None


def open_blocks(blocks: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, block_id, slot, user_key, seqno, value_type, value) rows again; a damaged block is an error."""
    kind = blocks.schema[run].dataType.simpleString()

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, _ = parse_block(b.column(2)[i].as_py())
                if rows:
                    keys, seqnos, kinds, values = zip(*rows, strict=True)
                    values = [None if t else v for t, v in zip(kinds, values, strict=True)]
                    n = len(rows)
                    columns = [pa.array([b.column(0)[i].as_py()] * n, b.schema.field(0).type), pa.array([b.column(1)[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64())]
                    columns += [pa.array(keys, pa.binary()), pa.array(seqnos, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [run, "block_id", "slot", "user_key", "seqno", "value_type", "value"])

    shape = f"{run} {kind}, block_id long, slot long, user_key binary, seqno long, value_type int, value binary"
    return blocks.select(run, "block_id", "block").mapInArrow(run_, shape)
