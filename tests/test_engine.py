"""Stores and the engine: flush, compaction, reopen, encryption, streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.crypto import EncryptionKey
from tidemark.model import EngineConfig, RunOptions, changelog
from tidemark.operators import reads
from tidemark.plans.engine import Engine, open_default
from tidemark.sources.encrypted import EncryptedStore
from tidemark.sources.memory import MemoryStore
from tidemark.sources.runs import RunStore
from tidemark.streaming.ingest import ingest, newest_state, windowed_activity

MANUAL = EngineConfig(buffer_size_limit=1 << 30, compaction_threshold=100)


@pytest.fixture(params=["memory", "folder", "encrypted"])
def store(request, spark, tmp_path):
    if request.param == "memory":
        return MemoryStore(spark)
    folder = RunStore(spark, f"file://{tmp_path}/store")
    return folder if request.param == "folder" else EncryptedStore(folder, EncryptionKey(b"k" * 32))


def test_life_of_an_engine(spark, store):
    db = Engine(spark, store, MANUAL)
    assert db.current_seqno() == 1 and db.get(b"x") is None and db.run_count() == 0
    assert db.put(b"key", b"v1") == 1
    db.force_flush()
    snapshot = db.current_seqno() - 1
    db.put(b"key", b"v2")
    db.delete(b"ghost")
    assert (db.buffer_entries(), db.run_count(), db.current_seqno()) == (2, 1, 4)
    assert db.get(b"key") == b"v2" and db.get_at(b"key", snapshot) == b"v1" and db.get_at(b"key", 0) is None
    assert db.get_detail(b"ghost").status == "Deleted" and db.get_detail(b"none").status == "NotFound"
    db.force_flush()
    db.force_flush()  # nothing to flush
    db.delete(b"key")
    assert db.get(b"key") is None and db.get_at(b"key", 2) == b"v2"
    db.put(b"", b"")
    db.force_flush()
    assert db.run_count() == 3 and db.get(b"") == b"" and db.get_detail(b"").status == "Found"
    assert db.force_compact()["input_entries"] == 5
    assert db.run_count() == 1 and db.get_detail(b"key").status == "NotFound" and db.get(b"") == b""
    assert db.force_compact() is None
    probes = spark.createDataFrame([(bytearray(b""),), (bytearray(b"key"),)], "user_key binary")
    assert {bytes(r.user_key): r.status for r in db.get_many(probes).collect()} == {b"": "Found", b"key": "NotFound"}


def test_random_operations(spark, store):
    db, model, rng = Engine(spark, store, EngineConfig(buffer_size_limit=1500, compaction_threshold=4)), {}, random.Random(3)
    for i in range(120):
        key = f"k{rng.randrange(15)}".encode()
        if rng.random() < 0.25:
            db.delete(key)
            model.pop(key, None)
        else:
            db.put(key, f"value {i}".encode())
            model[key] = f"value {i}".encode()
    assert db.run_count() < 4 and db.current_seqno() == 121
    assert {bytes(r.user_key): bytes(r.value) for r in db.live().collect()} == model
    assert max(r.max_seqno for r in store.runs()) <= 120


def test_all_deleted_leaves_no_run(spark, store):
    db = Engine(spark, store, MANUAL)
    for part in ((b"a", b"b"), (b"c",)):
        for k in part:
            db.delete(k)
        db.force_flush()
    done = db.force_compact()
    assert (done["new_runs"], len(done["obsolete_runs"]), db.run_count()) == ([], 2, 0)
    assert db.live().count() == 0


def test_flush_threshold(spark):
    db = Engine(spark, MemoryStore(spark), EngineConfig(buffer_size_limit=2 * (1 + 9 + 1 + 64), compaction_threshold=100))
    db.put(b"a", b"1")
    assert (db.buffer_size(), db.run_count()) == (75, 0)
    db.put(b"b", b"2")  # reaches the limit
    assert (db.buffer_size(), db.run_count()) == (0, 1)
    with pytest.raises(ValueError):
        db.put(bytes(70_000), b"")
    assert open_default(spark).buffer_report().first().entries == 0


def test_folder_is_reopened(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    db = Engine(spark, RunStore(spark, root), MANUAL)
    for i in range(20):
        db.put(f"k{i:02d}".encode(), b"old")
    db.force_flush()
    for i in range(0, 20, 2):
        db.put(f"k{i:02d}".encode(), b"new")
    db.force_flush()
    again = Engine(spark, RunStore(spark, root), MANUAL)
    assert again.current_seqno() == 31 and again.run_count() == 2
    assert {bytes(r.user_key): bytes(r.value) for r in again.live().collect()} == {f"k{i:02d}".encode(): b"old" if i % 2 else b"new" for i in range(20)}
    store = again.store
    assert store.file_ids() == [1, 2] and store.file_count() == 2 and store.total_bytes() > 0 and store.run_path(2).endswith(store.runs()[0].folder)
    assert store.rebuild_manifest() == store.runs()
    again.put(b"z", b"z")
    again.force_flush()
    assert store.file_ids() == [1, 2, 3]
    store.delete_run(3)
    assert not store.exists(3) and store.vacuum() == []
    with pytest.raises(FileNotFoundError):
        store.delete_run(3)
    with pytest.raises(FileNotFoundError):
        store.read_run(3)
    with pytest.raises(ValueError):
        store.flush(store.read().where("false"))


def test_runs_are_skipped_and_sorted(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s", RunOptions(), "string")
    rows = lambda a, b, s: spark.createDataFrame([(f"k{i:03d}", s + i, 0, "v") for i in range(a, b)], store.schema)
    store.flush(rows(0, 100, 1))
    store.flush(rows(100, 200, 1000))
    first = store.runs()[1].folder
    assert store.read("k050").inputFiles() and all(first in f for f in store.read("k050").inputFiles())
    assert all(first in f for f in store.read(as_of=500).inputFiles())
    assert store.read("zzz").count() == 0
    keys = [r.user_key for r in store.read_run(1).collect()]
    assert keys == sorted(keys)


def test_many_probes_skip_runs(spark, store):
    db = Engine(spark, store, MANUAL)
    for keys in ((b"a", b"b"), (b"k", b"m"), (b"y", b"z")):
        for k in keys:
            db.put(k, k * 2)
        db.force_flush()
    db.put(b"l", b"buffered")
    assert {bytes(r.user_key) for r in store.read(within=(bytearray(b"b"), bytearray(b"k"))).collect()} == {b"b", b"k"}
    assert store.read(within=(bytearray(b"c"), bytearray(b"j"))).isEmpty()
    probes = spark.createDataFrame([(bytearray(k),) for k in (b"k", b"l", b"n")], "user_key binary")
    assert {bytes(r.user_key): r.value and bytes(r.value) for r in db.get_many(probes).collect()} == {b"k": b"kk", b"l": b"buffered", b"n": None}
    assert db.get_many(probes.limit(0)).isEmpty()
    db.delete(b"k")  # the buffer is read anew after a write
    assert {r.status for r in db.get_many(probes.limit(1)).collect()} == {"Deleted"}


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both open the same state; the second to commit finds its version taken, reads the new state and tries again."""
    root = f"file://{tmp_path}/s"
    row = lambda k, s: spark.createDataFrame([(k, s, 0, "v")], "user_key string, seqno long, value_type int, value string")
    a, b = RunStore(spark, root, RunOptions(), "string"), RunStore(spark, root, RunOptions(), "string")
    a.flush(row("k1", 1))
    stale, real, calls = b._state(), b._state, []
    b._state = lambda: calls.append(1) or (stale if len(calls) == 1 else real())
    a.flush(row("k2", 2))
    assert b.flush(row("k3", 3)).run_id == 3 and len(calls) == 2
    again = RunStore(spark, root, RunOptions(), "string")
    assert sorted(r.user_key for r in again.read().collect()) == ["k1", "k2", "k3"] and again.rebuild_manifest() == again.runs()
    # a flush between the reading and the commit of a compaction stays
    publish, late = a._publish, []
    a._publish = lambda *x: (late or late.append(b.flush(row("k4", 4)))) and publish(*x)
    done = a.compact()
    assert len(done["obsolete_runs"]) == 3 and sorted(r.user_key for r in again.read().collect()) == ["k1", "k2", "k3", "k4"] and again.file_count() == 2


def test_readers_outlive_a_compaction(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s", RunOptions(), "string")
    for i in range(3):
        store.flush(spark.createDataFrame([(f"k{i}", i + 1, 0, "v")], store.schema))
    before, old = store.read(), {r.folder for r in store.runs()}
    store.compact()
    assert before.count() == 3 and store.vacuum() == []
    assert set(store.vacuum(older_than=-60)) == old and store.read().count() == 3


def test_tiers(spark, tmp_path):
    """Small runs are merged among themselves; tombstones stay until the oldest run is merged."""
    store = RunStore(spark, f"file://{tmp_path}/s", RunOptions(), "string")
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.md5(F.concat_ws("-", "id", k))))
    store.flush(spark.range(2000).select(F.format_string("k%05d", "id").alias("user_key"), (F.col("id") + 1).alias("seqno"), F.lit(0).alias("value_type"), text.alias("value")))
    for i in range(4):
        store.flush(spark.createDataFrame([("k00007", 3000 + i, i % 2, None if i % 2 else "v")], store.schema))
    done = store.compact_tier(4)
    assert (done["input_entries"], done["output_entries"], len(done["obsolete_runs"])) == (4, 1, 4) and store.file_count() == 2
    assert reads.newest(store.read()).where("user_key = 'k00007' AND value_type = 1").count() == 1
    assert store.compact_tier(4)["obsolete_runs"] == [] and store.compact_tier(2)["obsolete_runs"] == []
    assert store.compact()["output_entries"] == 1999


def test_nonces_are_not_used_twice(spark, tmp_path):
    """A run whose commit failed and its repetition, with the same id and seqnos, are sealed differently."""
    store = EncryptedStore(RunStore(spark, f"file://{tmp_path}/s"), EncryptionKey(b"k" * 32))
    rows = spark.createDataFrame([(bytearray(b"k"), 1, 0, bytearray(b"one value"))], store.schema)
    lost = store._write_run(rows)
    store.flush(rows)
    stored = [bytes(spark.read.parquet(f"{store.root}/data/{f}").first().value) for f in (lost.folder, store.runs()[0].folder)]
    assert stored[0][:12] != stored[1][:12] and bytes(store.read().first().value) == b"one value"
    # files moved to another run's folder fail to open
    store.flush(rows)
    a, b = (r.folder for r in store.runs())
    spark.read.parquet(f"{store.root}/data/{a}").write.mode("overwrite").parquet(f"{store.root}/data/{b}")
    with pytest.raises(Exception):
        store.read_run(1).collect()


def test_streams_into_every_store(spark, store, tmp_path):
    src = str(tmp_path / "in")
    for i in range(5):
        events(spark, 100).where(F.floor(F.col("event_id") / 20) == i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    changes = changelog(stream).select(F.col("user_key").cast("binary").alias("user_key"), F.col("seqno").alias("arrival"), "value_type", F.col("value").cast("binary").alias("value"))
    ingest(changes, store, str(tmp_path / "checkpoint"), ["arrival"], EngineConfig(compaction_threshold=4)).awaitTermination()
    assert store.last_batch() == 4 and len(store.runs()) < 5
    want = {r.user_key.encode(): r.value.encode() for r in reads.live(changelog(events(spark, 100))).collect()}
    assert {bytes(r.user_key): bytes(r.value) for r in reads.live(store.read()).collect()} == want


def test_ciphertext_is_stored(spark, tmp_path):
    inner = RunStore(spark, f"file://{tmp_path}/s")
    db = Engine(spark, EncryptedStore(inner, EncryptionKey(b"k" * 32)), MANUAL)
    db.put(b"k", b"plain text")
    db.force_flush()
    raw = bytes(inner.read_run(1).first().value)
    assert b"plain" not in raw and len(raw) == 10 + 28
    with pytest.raises(Exception):
        Engine(spark, EncryptedStore(inner, EncryptionKey(b"x" * 32)), MANUAL).get(b"k")


def test_bulk_writes(spark):
    db = Engine(spark, MemoryStore(spark, "string"), MANUAL)
    db.put_all(spark.range(50).select(F.format_string("k%02d", "id").alias("user_key"), F.lit("v").alias("value"), "id"), ["id"])
    db.delete_all(spark.range(10).select(F.format_string("k%02d", "id").alias("user_key"), "id"), ["id"])
    assert db.current_seqno() == 61 and db.live().count() == 40


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, n):
    kind = F.when(F.col("id") % 7 == 0, "error").otherwise("click")
    return spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 13).alias("user_id"), kind.alias("event_type"), F.lit(1.0).alias("value"), F.col("id").cast("string").alias("props"))


def test_stream_into_store_is_exactly_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), RunStore(spark, f"file://{tmp_path}/s", RunOptions(), "string")
    whole = events(spark, 300)
    for i in range(3):
        whole.where(F.floor(F.col("event_id") / 100) == i).coalesce(1).write.mode("append").parquet(src)
    for attempt in range(2):  # the second finds everything committed
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
        changes = changelog(stream).withColumnRenamed("seqno", "arrival")
        ingest(changes, store, str(tmp_path / f"checkpoint{attempt}"), ["arrival"], MANUAL).awaitTermination()
    assert store.read().count() == 300 and store.read().select("seqno").distinct().count() == 300 and store.last_batch() == 2
    assert {r.user_key for r in reads.live(store.read()).collect()} <= {r.user_key for r in reads.newest(changelog(whole)).collect()}


def test_streamed_state_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark, 200).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(EVENTS).parquet(src)
    q = newest_state(changelog(stream)).writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_key: (r.seqno, r.value_type, r.value) for r in spark.table("newest").collect()}
    assert got == {r.user_key: (r.seqno, r.value_type, r.value) for r in reads.newest(changelog(events(spark, 200))).collect()}
    q = windowed_activity(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("hours").collect()) == sorted(windowed_activity(events(spark, 200)).collect())
