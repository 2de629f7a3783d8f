"""Sorted files: sealed blocks, an index of their last keys, a filter and a trailer; point reads through them.

A file is ``blocks | index | filter | trailer``, numbers big-endian. An index entry is the block's last key (length
in 2 bytes, key, seqno in 8), its offset (8) and length (4). The trailer has a fixed size and says where index and filter
are; a checksum covers index, filter and trailer, each block has its own. A read asks the filter, then the index
for the first block that can hold the version, then the block's restart points; it goes on to the next block where versions of a key
cross a border. A run is cut into files of about ``target_file_bytes`` at block borders."""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DELETE, PUT, RunOptions
from ..operators.blocks import in_order, in_spans, pack_blocks
from ..operators.reads import DELETED, FOUND, NOT_FOUND
from .blockcodec import block_payloads, checksum, parse_block, seal_blocks, search_block
from .bloom import build, may_contain

MAGIC = b"tidemk01"
#: index offset and length, filter offset, length and bits, blocks, entries, least and largest seqno
_FIELDS = struct.Struct(">QIQQQIQQQ")
TRAILER_BYTES = _FIELDS.size + 16 + len(MAGIC)
LATEST = (1 << 63) - 1


class DamagedFile(ValueError):
    """A file that is refused; the message says why."""


def encode_index_entry(key: bytes, seqno: int, offset: int, length: int) -> bytes:
    return struct.pack(">H", len(key)) + key + struct.pack(">QQI", seqno, offset, length)


def decode_index(data: bytes) -> list[tuple[bytes, int, int, int]]:
    """(last key, its seqno, offset, length) of each block."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            raise DamagedFile("an index entry is cut")
        (k,) = struct.unpack_from(">H", data, at)
        if at + 22 + k > len(data):
            raise DamagedFile("an index entry is cut")
        out.append((data[at + 2 : at + 2 + k], *struct.unpack_from(">QQI", data, at + 2 + k)))
        at += 22 + k
    return out


def write_file(blocks: list[bytes], bits_per_key: int = 10) -> bytes:
    """The file of sealed blocks, in order."""
    index, keys, seqnos, offset = [], [], [], 0
    for b in blocks:
        rows, _ = parse_block(b)
        index.append(encode_index_entry(rows[-1][0], rows[-1][1], offset, len(b)))
        keys += [r[0] for r in rows]
        seqnos += [r[1] for r in rows]
        offset += len(b)
    listed = b"".join(index)
    bits, data = build(keys, bits_per_key) if bits_per_key else (0, b"")
    fields = _FIELDS.pack(offset, len(listed), offset + len(listed), len(data), bits, len(blocks), len(keys), min(seqnos, default=0), max(seqnos, default=0))
    return b"".join([*blocks, listed, data, fields, checksum(listed + data + fields), MAGIC])


class SortedFile:
    """An open file. Opening checks everything but the blocks, which are checked when they are read."""

    def __init__(self, data: bytes):
        if len(data) < TRAILER_BYTES:
            raise DamagedFile("a file has a trailer at least")
        if data[-len(MAGIC) :] != MAGIC:
            raise DamagedFile("not a sorted file")
        trailer = data[-TRAILER_BYTES:]
        fields = trailer[: _FIELDS.size]
        index_at, index_len, filter_at, filter_len, self.filter_bits, blocks, self.entries, self.min_seqno, self.max_seqno = _FIELDS.unpack(fields)
        if index_at + index_len != filter_at or filter_at + filter_len != len(data) - TRAILER_BYTES:
            raise DamagedFile("index and filter do not fit")
        listed, self._filter = data[index_at:filter_at], data[filter_at : filter_at + filter_len]
        if checksum(listed + self._filter + fields) != trailer[_FIELDS.size : _FIELDS.size + 16]:
            raise DamagedFile("checksum mismatch")
        self.index = decode_index(listed)
        if len(self.index) != blocks or sum(e[3] for e in self.index) != index_at:
            raise DamagedFile("the index does not list the blocks")
        self._data = data
        self._ends = [(e[0], -e[1]) for e in self.index]

    def block(self, i: int) -> bytes:
        _, _, offset, length = self.index[i]
        return self._data[offset : offset + length]

    def may_contain(self, key: bytes) -> bool:
        return not self.filter_bits or bool(may_contain([key], self.filter_bits, self._filter)[0])

    def get(self, key: bytes, limit: int = LATEST) -> tuple[int, int, bytes] | None:
        """(seqno, value_type, value) of the newest version of the key at or below ``limit``."""
        return self._search(key, limit) if self.may_contain(key) else None

    def get_many(self, keys: list[bytes], limits: list[int]) -> list[tuple[int, int, bytes] | None]:
        """What `get` returns for each key and limit; the filter is asked for all keys at once."""
        maybe = may_contain(keys, self.filter_bits, self._filter) if self.filter_bits else [True] * len(keys)
        return [self._search(k, n) if m else None for k, n, m in zip(keys, limits, maybe, strict=True)]

    def _search(self, key: bytes, limit: int) -> tuple[int, int, bytes] | None:
        i = bisect_left(self._ends, (key, -limit))  # the first block that ends at or after the version
        return search_block(self.block(i), key, limit) if i < len(self.index) else None

    def rows(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        for i in range(len(self.index)):
            yield from parse_block(self.block(i))[0]


def build_files(log: DataFrame, opts: RunOptions = RunOptions(), run: str = "run_id") -> DataFrame:
    """(run, file_no, entries, min_seqno, max_seqno, first_key, last_key, data): the files of each run."""
    packed = pack_blocks(log.withColumn("user_key", F.col("user_key").cast("binary")).withColumn("value", F.col("value").cast("binary")), opts, run, offsets=True)
    packed = packed.withColumn("file_no", F.floor(F.col("block_offset") / opts.target_file_bytes).cast("long"))
    blocks = seal_blocks(block_payloads(packed, opts, run, ("file_no",)), run, ("file_no",))
    kind = log.schema[run].dataType.simpleString()

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_id")
        data = write_file(table.column("block").to_pylist(), opts.bloom_bits_per_key)
        f = SortedFile(data)
        first = parse_block(f.block(0))[0][0][0]
        out = {run: table.column(run).slice(0, 1), "file_no": table.column("file_no").slice(0, 1)}
        out |= {k: pa.array([v], pa.int64()) for k, v in (("entries", f.entries), ("min_seqno", f.min_seqno), ("max_seqno", f.max_seqno))}
        return pa.table(out | {k: pa.array([v], pa.binary()) for k, v in (("first_key", first), ("last_key", f.index[-1][0]), ("data", data))})

    shape = f"{run} {kind}, file_no long, entries long, min_seqno long, max_seqno long, first_key binary, last_key binary, data binary"
    return blocks.groupBy(run, "file_no").applyInArrow(make, shape)


def read_files(files: DataFrame, run: str = "run_id") -> DataFrame:
    """All entries of the files, in order in each."""
    kind = files.schema[run].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = SortedFile(data)
                for i in range(len(f.index)):
                    keys, seqnos, kinds, values = zip(*parse_block(f.block(i))[0], strict=True)
                    columns = [pa.array([r] * len(keys), b.schema.field(0).type), pa.array(keys, pa.binary()), pa.array(seqnos, pa.int64()), pa.array(kinds, pa.int32())]
                    columns.append(pa.array([None if t == DELETE else v for t, v in zip(kinds, values, strict=True)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, [run, "user_key", "seqno", "value_type", "value"])

    return files.select(run, "data").mapInArrow(read, f"{run} {kind}, user_key binary, seqno long, value_type int, value binary")


def candidates(files: DataFrame, probes: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, file_no, user_key, as_of): the files that can hold a probe's version. Their range of keys has the key, and their least
    seqno is not above as_of; a key may cross several files of a run."""
    at = lambda key, side: files.select(run, "file_no", "min_seqno", F.col(key).alias("_key"), F.lit(side).alias("_side"))
    items, placed = in_order(probes, at("first_key", 0).unionByName(at("last_key", 2)))
    bounds = placed.groupBy(run, "file_no", "min_seqno").agg(F.min("_n").alias("_from"), F.max("_n").alias("_to"))
    found = in_spans(items, bounds, run)
    return found.where("as_of IS NULL OR as_of >= min_seqno").select(run, "file_no", "user_key", "as_of")


def point_get(files: DataFrame, probes: DataFrame, run: str = "run_id") -> DataFrame:
    """(user_key, as_of, status, seqno, value) of each probe (user_key, as_of long) through filter, index and block of the files that can
    hold it. A file and its probes meet in one group. ``files`` are read twice, so they should be stored."""
    probes = probes.select(F.col("user_key").cast("binary").alias("user_key"), "as_of").distinct()
    asked = candidates(files, probes, run).select(F.col(run).alias("at_run"), F.col("file_no").alias("at_file"), "user_key", "as_of")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, limits = right.column("user_key").to_pylist(), right.column("as_of").to_pylist()
        found = SortedFile(left.column("data")[0].as_py()).get_many(keys, [LATEST if n is None else n for n in limits]) if keys else []
        hit = [i for i, x in enumerate(found) if x]
        out = {"user_key": pa.array([keys[i] for i in hit], pa.binary()), "as_of": pa.array([limits[i] for i in hit], pa.int64())}
        out |= {"seqno": pa.array([found[i][0] for i in hit], pa.int64()), "value_type": pa.array([found[i][1] for i in hit], pa.int32())}
        return pa.table(out | {"value": pa.array([found[i][2] for i in hit], pa.binary())})

    both = files.select(run, "file_no", "data").groupBy(run, "file_no").cogroup(asked.groupBy("at_run", "at_file"))
    got = both.applyInArrow(look, "user_key binary, as_of long, seqno long, value_type int, value binary")
    newest = got.groupBy("user_key", "as_of").agg(F.max_by(F.struct("seqno", "value_type", "value"), "seqno").alias("v"))
    newest = newest.select(F.col("user_key").alias("_key"), F.col("as_of").alias("_as_of"), "v.*")
    joined = probes.join(newest, (F.col("user_key") == F.col("_key")) & F.col("as_of").eqNullSafe(F.col("_as_of")), "left")
    status = F.when(F.col("value_type") == PUT, FOUND).when(F.col("value_type") == DELETE, DELETED).otherwise(NOT_FOUND)
    return joined.select("user_key", "as_of", status.alias("status"), "seqno", F.when(F.col("value_type") == PUT, F.col("value")).alias("value"))
