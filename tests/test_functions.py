"""Codec, filters, checksums and encryption."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import blockcodec, bloom, codec, crypto, integrity, sortedfile
from tidemark.model import RunOptions
from tidemark.operators.blocks import pack_blocks

SCHEMA = "user_key binary, seqno long, value_type int, value binary"


def rows():
    rng = random.Random(1)
    out = [(bytearray(b""), 1, 0, bytearray(b"")), (bytearray(b"\xff\x00"), 2**62, 1, None)]
    return out + [(bytearray(rng.randbytes(rng.randrange(40))), i + 3, 0, bytearray(rng.randbytes(rng.randrange(300)))) for i in range(60)]


def test_codec_bytes_and_roundtrip(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for r in df.select("*", codec.encode_entry().alias("e"), codec.encode_key().alias("ik"), codec.encoded_size().alias("n"), codec.encoded_key_size().alias("kn")).collect():
        k, v = bytes(r.user_key), bytes(r.value or b"")
        ik = struct.pack(">H", len(k)) + k + struct.pack(">QB", r.seqno, r.value_type)
        assert bytes(r.ik) == ik and bytes(r.e) == ik + struct.pack(">I", len(v)) + v and (r.n, r.kn) == (len(r.e), len(ik))
    tail = F.concat(codec.encode_entry(), F.unhex(F.lit("AABB")))  # bytes behind an entry are left
    for r in df.select("*", codec.decode_entry(tail).alias("d")).collect():
        assert (bytes(r.d.user_key), r.d.seqno, r.d.value_type, bytes(r.d.value)) == (bytes(r.user_key), r.seqno, r.value_type, bytes(r.value or b""))
        assert r.d.used == len(r.user_key) + len(r.value or b"") + 15


def test_codec_refuses_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b),) for b in (b"", b"\x00", b"\x00\x05ab", b"\x00\x00" + bytes(8) + b"\x02" + bytes(4), b"\x00\x00" + bytes(9) + b"\x00\x00\x00\x09x")], "b binary")
    assert [r.d for r in df.select(codec.decode_entry(F.col("b")).alias("d")).collect()] == [None] * 5
    long_key = spark.createDataFrame([(bytearray(70_000), 1, 0, bytearray(b"x"))], SCHEMA)
    with pytest.raises(Exception, match="65535"):
        long_key.select(codec.encode_entry()).collect()


@pytest.mark.parametrize("n", [1, 7, 9, 10, 50, 1000])
def test_filter_has_no_false_negatives(n):
    keys = [f"key_{i:06d}".encode() for i in range(n)] + [b""]
    bits, data = bloom.build(keys, 10)
    assert bits == max(10 * len(keys), 64) and len(data) == -(-bits // 8)
    assert bloom.may_contain(keys, bits, data).all()


def test_filter_false_positive_rate():
    bits, data = bloom.build([f"exist_{i:08d}".encode() for i in range(10_000)], 10)
    assert bloom.may_contain([f"noexist_{i:08d}".encode() for i in range(10_000)], bits, data).mean() < 0.012  # the design's target is 1 %


def test_distributed_filter_equals_local(spark):
    keys = [(f"user_{i % 700:05d}", i % 3) for i in range(3000)]
    df = spark.createDataFrame(keys, "user_key string, run_id long").repartition(6)
    for r in bloom.build_filters(df).collect():
        own = [k.encode() for k, run in keys if run == r.run_id]
        assert (r.n_keys, r.num_bits) == (len(own), 10 * len(own)) and bytes(r.bits) == bloom.build(own, 10)[1]


def test_filters_are_split_by_keys(spark):
    log = spark.range(3000).select(F.format_string("k%05d", "id").alias("user_key"), (F.col("id") % 2).alias("run_id"))
    filters = bloom.build_filters(log, part_keys=400)
    assert sorted((r.run_id, r.part, r.parts) for r in filters.collect()) == [(run, p, 4) for run in (0, 1) for p in range(4)]
    assert bloom.probe_filters(filters, log).where("NOT may_contain").count() == 0
    other = spark.range(3000).select(F.concat(F.lit("absent"), "id").alias("user_key"), (F.col("id") % 3).alias("run_id"))
    missed = {r.run_id: r.m for r in bloom.probe_filters(filters, other).groupBy("run_id").agg(F.avg(F.col("may_contain").cast("int")).alias("m")).collect()}
    assert missed[2] == 0 and max(missed.values()) < 0.02


def test_checksums_against_plain_python(spark):
    import zlib

    rows = [(bytearray(b"a"), 1, 0, bytearray(b"x"), 1), (bytearray(b"b"), 2, 1, None, 1), (bytearray(b"c"), 3, 0, bytearray(b""), 2)]
    want = {}
    for k, s, t, v, run in rows:
        c = zlib.crc32(codec_entry(bytes(k), s, t, bytes(v or b"")))
        x, total, n = want.get(run, (0, 0, 0))
        want[run] = (x ^ c, total + c, n + 1)
    got = integrity.run_checksums(spark.createDataFrame(rows, SCHEMA + ", run_id long")).collect()
    assert {r.run_id: (r.crc_xor, r.crc_sum, r.entries) for r in got} == want


def test_checksums_notice_changes(spark):
    df = spark.createDataFrame([(bytearray(b"a"), 1, 0, bytearray(b"x"), 1), (bytearray(b"b"), 2, 0, bytearray(b"y"), 2)], SCHEMA + ", run_id long")
    expected = integrity.run_checksums(df)
    assert integrity.verify_runs(df, expected).count() == 0
    assert [r.run_id for r in integrity.verify_runs(df.where("run_id = 1"), expected).collect()] == [2]
    sums = {r.c for r in df.select(integrity.checksum128(F.col("value")).alias("c")).collect()}
    assert len(sums) == 2 and all(len(c) == 32 for c in sums)


def test_encryption(spark):
    key = crypto.EncryptionKey(bytes(range(32)))
    df = spark.createDataFrame([(bytearray(b"k"), i, 0, bytearray(b"sensitive data")) for i in range(1, 5)] + [(bytearray(b"t"), 9, 1, None)], SCHEMA).withColumn("run_id", F.lit(3).cast("long"))
    sealed = crypto.encrypt_values(df, key)
    stored = [bytes(r.value) for r in sealed.where("value IS NOT NULL").collect()]
    assert all(len(s) == 14 + crypto.OVERHEAD and b"sensitive" not in s for s in stored) and len({s[:12] for s in stored}) == 4
    assert stored == [bytes(r.value) for r in crypto.encrypt_values(df, key).where("value IS NOT NULL").collect()]  # deterministic
    assert sorted(crypto.decrypt_values(sealed, key).collect()) == sorted(df.collect())
    moved = sealed.withColumn("run_id", F.lit(4).cast("long"))
    assert {(r.seqno, r.authentic) for r in crypto.decrypt_values(moved, key, strict=False).collect()} == {(1, False), (2, False), (3, False), (4, False), (9, True)}
    with pytest.raises(Exception):
        crypto.decrypt_values(sealed, crypto.EncryptionKey(bytes(32))).collect()
    secret = bytes(range(32)).hex()
    plan = sealed._jdf.queryExecution().toString().lower()
    assert secret not in plan and "redacted" in repr(key)
    with pytest.raises(ValueError):
        crypto.EncryptionKey(b"short")


def test_blocks_round_trip_and_search(spark):
    """40 versions of a key among neighbours cross restart points and blocks; none is missed."""
    rows = [(bytearray(f"k{i:02d}".encode()), 1000 + i, 0, bytearray(b"n" * 30)) for i in range(20)]
    rows += [(bytearray(b"k10"), i + 1, i % 7 == 0, None if i % 7 == 0 else bytearray(f"v{i}".encode())) for i in range(40)]
    rows = [(k, s, int(t), v) for k, s, t, v in rows]
    log = spark.createDataFrame(rows, SCHEMA).withColumn("run_id", F.lit(1).cast("long"))
    blocks = blockcodec.seal_blocks(blockcodec.block_payloads(pack_blocks(log, RunOptions(block_size=400, restart_interval=4)), RunOptions(block_size=400, restart_interval=4)))
    opened = blockcodec.open_blocks(blocks).collect()
    assert sorted((bytes(r.user_key), r.seqno, r.value_type, r.value and bytes(r.value)) for r in opened) == sorted((bytes(k), s, t, v and bytes(v)) for k, s, t, v in rows)
    kept = [bytes(r.block) for r in blocks.orderBy("block_id").collect()]
    assert len(kept) > 3 and all(len(b) <= 400 for b in kept)
    for limit in range(1, 41):
        hits = [h for h in (blockcodec.search_block(b, b"k10", limit) for b in kept) if h]
        assert max(hits)[0] == limit
    entries, restarts = blockcodec.parse_block(kept[0])
    assert restarts[0] == 0 and len(restarts) == -(-len(entries) // 4)


def test_sorted_files(spark):
    """Versions that cross restart points, blocks and files are found through filter, index and block, as of any seqno."""
    rows = [(bytearray(f"k{i:02d}".encode()), 1000 + i, 0, bytearray(b"n" * 30)) for i in range(20)]
    rows += [(bytearray(b"k10"), i + 1, int(i % 7 == 0), None if i % 7 == 0 else bytearray(f"v{i}".encode())) for i in range(40)]
    log = spark.createDataFrame(rows, SCHEMA).withColumn("run_id", (F.col("seqno") % 2).cast("long"))
    files = sortedfile.build_files(log, RunOptions(block_size=200, restart_interval=4, target_file_bytes=500)).cache()
    assert files.count() >= 4 and files.agg(F.sum("entries")).first()[0] == len(rows)
    back = sortedfile.read_files(files).select("run_id", "user_key", "seqno", "value_type", "value")
    assert sorted(back.collect()) == sorted(log.select(*back.columns).collect())
    asked = [(bytearray(k), n) for k in (b"k10", b"k11", b"k00", b"zz", b"", b"k1") for n in (None, 0, 1, 5, 15, 22, 39, 40, 999, 1010, 1011)]
    got = {(bytes(r.user_key), r.as_of): (r.status, r.seqno, r.value and bytes(r.value)) for r in sortedfile.point_get(files, spark.createDataFrame(asked, "user_key binary, as_of long")).collect()}
    for k, n in asked:
        seen = [(s, t, v) for key, s, t, v in rows if key == k and (n is None or s <= n)]
        s, t, v = max(seen) if seen else (None, None, None)
        assert got[bytes(k), n] == (("NotFound", "Found", "Deleted")[0 if t is None else 1 + t], s, bytes(v) if t == 0 else None), (k, n)
    reader = sortedfile.SortedFile(bytes(files.first().data))
    assert sum(reader.may_contain(f"x{i}".encode()) for i in range(500)) < 25


def test_damaged_files_are_refused():
    block = (lambda body: body + blockcodec.checksum(body))(codec_entry(b"k", 1, 0, b"v") + struct.pack(">III", 0, 1, 1))
    good = sortedfile.write_file([block])
    assert sortedfile.SortedFile(good).get(b"k") == (1, 0, b"v") and sortedfile.SortedFile(good).get(b"x") is None
    assert list(sortedfile.SortedFile(sortedfile.write_file([])).rows()) == []
    flip = lambda at: good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
    for bad in (b"", good[:50], good[:-1], good + b"x", flip(-1), flip(-10), flip(-60), flip(len(block) + 1), good[3:]):
        with pytest.raises(sortedfile.DamagedFile):
            sortedfile.SortedFile(bad)
    with pytest.raises(ValueError):  # a block is checked when it is read
        sortedfile.SortedFile(flip(4)).get(b"k")


@pytest.mark.parametrize("damage", [lambda b: b[:10], lambda b: b[:-1] + bytes([b[-1] ^ 1]), lambda b: bytes([b[0] ^ 1]) + b[1:], lambda b: b""])
def test_damaged_blocks_are_refused(damage):
    body = codec_entry(b"k", 1, 0, b"v") + struct.pack(">III", 0, 1, 1)
    block = body + blockcodec.checksum(body)
    assert blockcodec.parse_block(block) == ([(b"k", 1, 0, b"v")], [0])
    with pytest.raises(ValueError):
        blockcodec.parse_block(damage(block))


def codec_entry(key, seqno, kind, value):
    return struct.pack(">H", len(key)) + key + struct.pack(">QBI", seqno, kind, len(value)) + value
