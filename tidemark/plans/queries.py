"""Registered queries over the ``events`` table as a versioned log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blockcodec, bloom, codec, crypto, integrity, sortedfile
from ..model import EngineConfig, RunOptions, changelog, value_type_name, violations
from ..operators import blocks, buffer, compaction, numbering, reads
from ..sources.encrypted import EncryptedStore
from ..sources.files import FolderFiles, MemoryFiles
from ..sources.memory import MemoryStore
from ..sources.runs import RunStore, describe_runs
from .engine import Engine, open_default

RUN_ROWS, SNAPSHOT, FENCES = 2500, 5000, [2000, 6000]
FLUSH_LIMIT = 4096
TEST_KEY = bytes(range(32))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def log(spark: SparkSession, sf: str) -> DataFrame:
    return changelog(_events(spark, sf))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The log with run_id, as if each RUN_ROWS writes had been flushed."""
    return log(spark, sf).withColumn("run_id", F.floor((F.col("seqno") - 1) / RUN_ROWS).cast("long"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """All keys, and as many that do not exist."""
    keys = _events(spark, sf).select(F.format_string("user_%06d", "user_id").alias("k")).distinct()
    return keys.select(F.explode(F.array("k", F.concat("k", F.lit("_absent")))).alias("user_key"))


def dated_probes(spark: SparkSession, sf: str) -> DataFrame:
    return probes(spark, sf).select("user_key", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1000, 5000, 9000)])).alias("as_of"))


def _seqno(df: DataFrame, column: str = "seqno") -> DataFrame:
    """0 for a missing seqno: real ones begin at 1."""
    return df.withColumn(column, F.coalesce(column, F.lit(0).cast("long")))


def get_latest_live(spark, sf):
    return reads.live(log(spark, sf))


def get_detail_probes(spark, sf):
    return _seqno(reads.get_detail(log(spark, sf), probes(spark, sf)))


def get_point(spark, sf):
    return reads.get(log(spark, sf), "user_000003")


def get_at_snapshot(spark, sf):
    return reads.live(log(spark, sf), SNAPSHOT)


def get_at_probes(spark, sf):
    return _seqno(reads.get_at(log(spark, sf), dated_probes(spark, sf)))


def deleted_keys(spark, sf):
    return reads.deleted(log(spark, sf))


def live_semi(spark, sf):
    return reads.present(log(spark, sf), probes(spark, sf))


def absent_anti(spark, sf):
    return reads.absent(log(spark, sf), probes(spark, sf))


def resurrected_keys(spark, sf):
    return reads.resurrected(log(spark, sf))


def version_history(spark, sf):
    return _seqno(reads.history(log(spark, sf)).select("user_key", "seqno", "version", "superseded_by"), "superseded_by")


def range_scan(spark, sf):
    return reads.scan(log(spark, sf), "user_000002", "user_000010")


def memtable_stats(spark, sf):
    return buffer.buffer_statistics(log(spark, sf))


def entry_sizes(spark, sf):
    return log(spark, sf).select("seqno", buffer.buffered_size().cast("long").alias("buffered"), codec.encoded_size().cast("long").alias("encoded"), codec.encoded_key_size().cast("long").alias("encoded_key"))


def flush_assignment(spark, sf):
    return buffer.flush_assignment(runs(spark, sf), FLUSH_LIMIT, "run_id").select("run_id", "seqno", "flush_id")


def _split(spark, sf):
    whole = runs(spark, sf)
    return [whole.where(F.col("run_id") % 4 == i).drop("run_id") for i in range(4)]


def merge_keep_tombstones(spark, sf):
    return compaction.merge(_split(spark, sf), drop_tombstones=False)


def merge_drop_tombstones(spark, sf):
    return compaction.merge(_split(spark, sf), drop_tombstones=True)


def merge_with_snapshots(spark, sf):
    return compaction.merge_with_snapshots(log(spark, sf), FENCES)


def compaction_stats(spark, sf):
    return compaction.statistics(runs(spark, sf))


def run_manifest(spark, sf):
    return describe_runs(runs(spark, sf))


def l0_candidates(spark, sf):
    return reads.candidate_runs(describe_runs(runs(spark, sf)), dated_probes(spark, sf))


def read_amplification(spark, sf):
    return reads.sources_consulted(runs(spark, sf))


def sorted_entries(spark, sf):
    return blocks.sorted_position(runs(spark, sf)).select("run_id", "position", "user_key", "seqno")


def global_order(spark, sf):
    ordered = log(spark, sf).withColumn("newest_first", -F.col("seqno"))
    return numbering.numbered(ordered, ["user_key", "newest_first"], name="position").select("position", "user_key", "seqno")


def seqno_assignment(spark, sf):
    """Dense seqnos for writes in the order of arrival (ts, event_id)."""
    return numbering.numbered(_events(spark, sf).select("ts", "event_id"), ["ts", "event_id"], start=1, name="seqno").select("event_id", "seqno")


def restart_points(spark, sf):
    placed = blocks.sorted_position(runs(spark, sf))
    return placed.where(blocks.is_restart(F.col("position"), RunOptions().restart_interval)).select("run_id", "position", "user_key", "seqno")


def encode_hex(spark, sf):
    return log(spark, sf).select("seqno", F.hex(codec.encode_entry()).alias("entry"), F.hex(codec.encode_key()).alias("internal_key"))


def decode_roundtrip(spark, sf):
    d = log(spark, sf).select(codec.decode_entry(codec.encode_entry()).alias("d")).select("d.*")
    return d.select(F.decode("user_key", "UTF-8").alias("user_key"), "seqno", "value_type", F.decode("value", "UTF-8").alias("value"), "used")


def value_type_codes(spark, sf):
    code = (F.col("event_id") % 4).cast("int")
    return _events(spark, sf).groupBy(code.alias("code"), value_type_name(code).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def log_violations(spark, sf):
    """A log in which every rule is broken in some rows."""
    n = F.col("seqno")
    broken = log(spark, sf).select(
        F.when(n % 101 != 0, F.col("user_key")).alias("user_key"),
        F.when(n % 103 != 0, n).otherwise(0).alias("seqno"),
        F.when(n % 107 != 0, F.col("value_type")).otherwise(7).alias("value_type"),
        F.when(n % 11 == 0, F.lit("x")).when(n % 109 != 0, F.col("value")).alias("value"),
        n.alias("n"),
    )
    return violations(broken.unionByName(broken.where(F.col("n") % 211 == 0)).drop("n"))


def _packed(spark, sf):
    return blocks.pack_blocks(runs(spark, sf))


def block_packing(spark, sf):
    return _packed(spark, sf).select("run_id", "user_key", "seqno", "block_id", "slot")


def block_index(spark, sf):
    return blocks.block_index(_packed(spark, sf)).select("run_id", "block_id", "last_key", "entries", "block_len", "block_offset")


def block_lookup(spark, sf):
    return blocks.find_block(blocks.block_index(_packed(spark, sf)), probes(spark, sf))


def block_payloads(spark, sf):
    return blockcodec.block_payloads(_packed(spark, sf)).select("run_id", "block_id", "entries", F.sha2("payload", 256).alias("sha256"))


def block_roundtrip(spark, sf):
    """Blocks are sealed with checksums, opened and decoded again."""
    opened = blockcodec.open_blocks(blockcodec.seal_blocks(blockcodec.block_payloads(_packed(spark, sf))))
    text = lambda c: F.decode(c, "UTF-8").alias(c)
    return opened.select("run_id", text("user_key"), "seqno", "value_type", text("value"), "block_id", "slot")


def bloom_no_false_negatives(spark, sf):
    rows = runs(spark, sf)
    found = bloom.probe_filters(bloom.build_filters(rows), rows.select("run_id", "user_key").distinct())
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("may_contain")).alias("missed"))


def bloom_false_positives(spark, sf):
    rows = runs(spark, sf)
    absent = rows.select("run_id", F.concat(F.lit("absent_"), F.col("seqno").cast("string")).alias("user_key"))
    return bloom.probe_filters(bloom.build_filters(rows), absent).groupBy("run_id").agg(F.avg(F.col("may_contain").cast("int")).alias("rate"))


def entry_checksums(spark, sf):
    return integrity.entry_checksums(log(spark, sf)).select("seqno", "checksum")


def run_checksums(spark, sf):
    return integrity.run_checksums(runs(spark, sf))


def changed_runs(spark, sf):
    """Checksums find the run in which one value was changed."""
    rows = runs(spark, sf)
    changed = rows.withColumn("value", F.when(F.col("seqno") == 100, F.lit("changed")).otherwise(F.col("value")))
    return integrity.verify_runs(changed, integrity.run_checksums(rows))


def encrypt_roundtrip(spark, sf):
    key = crypto.EncryptionKey(TEST_KEY)
    back = crypto.decrypt_values(crypto.encrypt_values(runs(spark, sf), key), key)
    return back.select("user_key", "seqno", "value_type", F.decode("value", "UTF-8").alias("value"))


def tamper_detect(spark, sf):
    """Values moved to another run, cut, or opened with another key fail; others pass."""
    key, other = crypto.EncryptionKey(TEST_KEY), crypto.EncryptionKey(bytes(32))
    sealed = crypto.encrypt_values(runs(spark, sf), key)
    kind = (F.col("seqno") % 3).cast("int")
    moved = sealed.withColumn("run_id", F.when(kind == 1, F.col("run_id") + 1).otherwise(F.col("run_id")))
    moved = moved.withColumn("value", F.when(kind == 2, F.substring(F.col("value"), F.lit(1), F.octet_length("value") - 1)).otherwise(F.col("value")))
    right = crypto.decrypt_values(moved, key, strict=False).select("seqno", "authentic")
    wrong = crypto.decrypt_values(sealed, other, strict=False).select("seqno", F.col("authentic").alias("with_other_key"))
    return right.join(wrong, "seqno")


def encrypted_sizes(spark, sf):
    sealed = crypto.encrypt_values(runs(spark, sf), crypto.EncryptionKey(TEST_KEY))
    return sealed.where("value IS NOT NULL").select("seqno", F.octet_length("value").cast("long").alias("stored_bytes"))


def _filled_store(spark, sf) -> RunStore:
    store = RunStore(spark, numbering.scratch(spark, "store"), key_type="string")
    rows = log(spark, sf)
    for i in range(4):  # four flushes, in turn
        store.flush(rows.where(F.col("seqno") % 4 == i))
    return store


def store_reopened_live(spark, sf):
    """Four runs are flushed, the store is opened anew from its folder, and read."""
    store = _filled_store(spark, sf)
    return reads.live(RunStore(spark, store.root, key_type="string").read())


def store_compacted_detail(spark, sf):
    """After compaction a deleted key is unknown, not deleted."""
    store = _filled_store(spark, sf)
    store.compact()
    return reads.get_detail(store.read(), probes(spark, sf)).select("user_key", "status")


def store_point(spark, sf):
    """A key is read from the runs whose range holds it."""
    return reads.live(_filled_store(spark, sf).read("user_000003"))


def store_inspection(spark, sf):
    """The manifest after reopening, made anew from the files."""
    store = RunStore(spark, _filled_store(spark, sf).root, key_type="string")
    rows = [(r.run_id, r.num_entries, r.min_seqno, r.max_seqno, r.first_key, r.last_key, r.run_id in store.file_ids()) for r in store.rebuild_manifest()]
    return spark.createDataFrame(rows, "run_id long, num_entries long, min_seqno long, max_seqno long, first_key string, last_key string, listed boolean")


def store_tiers_detail(spark, sf):
    """Four similar runs are merged as a tier; with a fifth the newest versions are right."""
    store = _filled_store(spark, sf)
    store.compact_tier(4)
    store.flush(log(spark, sf).where("seqno % 4 = 0").withColumn("seqno", F.col("seqno") + 1_000_000_000))
    return reads.get_detail(store.read(), probes(spark, sf)).select("user_key", "status")


def _binary(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_key").cast("binary").alias("user_key"), "seqno", "value_type", F.col("value").cast("binary").alias("value"))


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.decode(c, "UTF-8").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def encrypted_store_live(spark, sf):
    """Four encrypted runs, compacted, opened anew with the key."""
    root, key = numbering.scratch(spark, "sealed-store"), crypto.EncryptionKey(TEST_KEY)
    store, rows = EncryptedStore(RunStore(spark, root), key), _binary(log(spark, sf))
    for i in range(4):
        store.flush(rows.where(F.col("seqno") % 4 == i))
    store.compact()
    return _text(reads.live(EncryptedStore(RunStore(spark, root), key).read()))


def encrypted_store_inner(spark, sf):
    """What lies in the store: the sizes of the values are those of ciphertext."""
    store = EncryptedStore(RunStore(spark, numbering.scratch(spark, "sealed-store")), crypto.EncryptionKey(TEST_KEY))
    store.flush(_binary(log(spark, sf)))
    stored = store.inner.read_run(1).join(store.read_run(1).select("seqno", F.col("value").alias("plain")), "seqno")
    return stored.select("seqno", F.octet_length("value").cast("long").alias("stored_bytes"), (F.col("value") == F.col("plain")).alias("readable"))


def memory_store_live(spark, sf):
    store, rows = MemoryStore(spark, "string"), log(spark, sf)
    for i in range(4):
        store.flush(rows.where(F.col("seqno") % 4 == i))
    store.compact(drop_tombstones=False)
    return reads.live(store.read())


def _written_engine(spark, sf, config: EngineConfig) -> Engine:
    """An engine on a folder, with the events written in bulk in four parts of their order."""
    db, rows = Engine(spark, RunStore(spark, numbering.scratch(spark, "engine"), key_type="string"), config), log(spark, sf).withColumnRenamed("seqno", "arrival")
    n = rows.count()
    for i in range(4):
        db.write_all(rows.where(F.floor((F.col("arrival") - 1) * 4 / n) == i), ["arrival"])
    return db


def engine_bulk_live(spark, sf):
    """The fourth run starts a compaction; seqnos are given in the order of arrival."""
    db = _written_engine(spark, sf, EngineConfig())
    if db.run_count() != 1:
        raise RuntimeError("four runs were not compacted")
    return db.live()


def engine_snapshot_live(spark, sf):
    return _written_engine(spark, sf, EngineConfig(compaction_threshold=100)).live(SNAPSHOT)


def engine_reopened_detail(spark, sf):
    db = _written_engine(spark, sf, EngineConfig(compaction_threshold=100))
    db = Engine(spark, RunStore(spark, db.store.root, key_type="string"))
    return _seqno(db.get_many(probes(spark, sf)))


def engine_single_writes(spark, sf):
    """Puts and deletes one by one (a row a nation), over flushes at 600 bytes and compactions; then each key's state."""
    db = open_default(spark)
    db.config = EngineConfig(buffer_size_limit=600)
    names = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()
    for r in names:
        db.put(r.n_name.encode(), b"first")
    for r in names:
        db.put(r.n_name.encode(), r.n_name.lower().encode()) if r.n_regionkey else db.delete(r.n_name.encode())
    keys = spark.read.parquet(f"{sf}/nation.parquet").select(F.explode(F.array(*[c.cast("binary") for c in (F.col("n_name"), F.concat("n_name", F.lit("?")))])).alias("user_key"))
    out = db.get_many(keys).select("user_key", F.when(F.col("status") == "Found", "Found").otherwise("gone").alias("status"), "value")
    return _text(out)


def engine_short_buffers(spark, sf):
    """A value is copied into a buffer of six bytes if it fits."""
    db, out = open_default(spark), []
    names = [r.n_name for r in spark.read.parquet(f"{sf}/nation.parquet").collect()]
    for n in names:
        db.put(n.encode(), n.encode())
    for n in [*names, "NOWHERE"]:
        buffer = bytearray(6)
        status, length = db.get_into(n.encode(), buffer)
        out.append((n, status, length, bytes(buffer[:length]).decode() if status == "Found" else ""))
    return spark.createDataFrame(out, "name string, status string, length long, value string")


def byte_files(spark, sf):
    """A file a nation, in memory and in a folder: written in two parts, closed, read in parts; every third is deleted."""
    names, out = [r.n_name for r in spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()], []
    for kind, files in (("memory", MemoryFiles()), ("folder", FolderFiles(spark, numbering.scratch(spark, "files")))):
        for text in names:
            n = files.create()
            at = files.append(n, b"<") + files.append(n, text.encode())
            files.sync(n)
            files.close(n)
            if n % 3 == 0:
                files.delete(n)
                out.append((kind, n, files.exists(n), 0, "", at))
            else:
                out.append((kind, n, files.exists(n), files.size(n), files.read_at(n, 1, 4).decode() + files.read_all(n).decode(), at))
        if files.total_bytes() != sum(r[3] for r in out if r[0] == kind) or files.numbers() != [r[1] for r in out if r[0] == kind and r[2]]:
            raise RuntimeError("the files are not what was written")
    return spark.createDataFrame(out, "place string, number long, there boolean, size long, read string, second_at long")


def sst_point_get(spark, sf):
    """Probes as of four seqnos through sorted files: filter, index, block."""
    path, files = numbering.scratch(spark, "sorted-files"), sortedfile.build_files(runs(spark, sf), RunOptions(target_file_bytes=64 << 10))
    files.write.parquet(path)
    files = spark.read.schema(files.schema).parquet(path)
    got = sortedfile.point_get(files, dated_probes(spark, sf))
    return _seqno(_text(got))


def sst_files(spark, sf):
    """Each file's entries and range, as its trailer and index say, by run."""
    files = sortedfile.build_files(runs(spark, sf), RunOptions(target_file_bytes=64 << 10))
    out = files.groupBy("run_id").agg(F.sum("entries").alias("entries"), F.min("min_seqno").alias("min_seqno"), F.max("max_seqno").alias("max_seqno"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    return _text(out)


def sst_roundtrip(spark, sf):
    return _text(sortedfile.read_files(sortedfile.build_files(runs(spark, sf))))


def sst_open_refusals(spark, sf):
    """Damaged copies of each run's first file, and whether opening refuses them."""
    files = sortedfile.build_files(runs(spark, sf), RunOptions(target_file_bytes=64 << 10)).where("file_no = 0").select("run_id", "data")
    n, tail = F.octet_length("data"), sortedfile.TRAILER_BYTES
    cut = lambda a, b: F.substring(F.col("data"), F.lit(a) if isinstance(a, int) else a, F.lit(b) if isinstance(b, int) else b)
    kinds = {
        "whole": F.col("data"), "empty": F.unhex(F.lit("")), "short": cut(1, tail - 1), "cut at the end": cut(1, n - 1), "longer": F.concat("data", F.unhex(F.lit("00"))),
        "cut at the beginning": cut(2, n), "other kind": F.concat(cut(1, n - 8), F.lit("unknown!").cast("binary")), "index changed": F.concat(cut(1, n - tail - 1), F.unhex(F.lit("A5A5")), cut(n - tail + 2, n)),
    }
    damaged = files.select("run_id", F.explode(F.array(*[F.struct(F.lit(k).alias("damage"), v.alias("data")) for k, v in kinds.items()])).alias("d")).select("run_id", "d.*")

    def tried(batches):
        import pyarrow as pa

        for b in batches:
            refused = []
            for data in b.column(2).to_pylist():
                try:
                    sortedfile.SortedFile(data)
                    refused.append(False)
                except sortedfile.DamagedFile:
                    refused.append(True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(refused, pa.bool_())], ["run_id", "damage", "refused"])

    return damaged.mapInArrow(tried, "run_id long, damage string, refused boolean")


def stream_ingest_live(spark, sf):
    """The events as a stream, batch by batch into a store; then the live state."""
    from ..streaming.ingest import ingest

    events = _events(spark, sf)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    store = RunStore(spark, numbering.scratch(spark, "stream-store"), key_type="string")
    ingest(changelog(stream).withColumnRenamed("seqno", "arrival"), store, numbering.scratch(spark, "stream-checkpoint"), ["arrival"]).awaitTermination()
    return reads.live(store.read())


def windowed_activity(spark, sf):
    """Puts and deletes by hour (the batch form of the stream of the same name)."""
    from ..streaming.ingest import windowed_activity as activity

    return activity(_events(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [
        get_latest_live, get_detail_probes, get_point, get_at_snapshot, get_at_probes, deleted_keys, live_semi, absent_anti, resurrected_keys,
        version_history, range_scan, memtable_stats, entry_sizes, flush_assignment, merge_keep_tombstones, merge_drop_tombstones,
        merge_with_snapshots, compaction_stats, run_manifest, l0_candidates, read_amplification, sorted_entries, global_order, seqno_assignment,
        restart_points, encode_hex, decode_roundtrip, value_type_codes, log_violations, block_packing, block_index, block_lookup, block_payloads, block_roundtrip,
        bloom_no_false_negatives, bloom_false_positives, entry_checksums, run_checksums, changed_runs, encrypt_roundtrip, tamper_detect,
        encrypted_sizes, store_reopened_live, store_compacted_detail, store_point, store_inspection, store_tiers_detail, encrypted_store_live,
        encrypted_store_inner, memory_store_live, engine_bulk_live, engine_snapshot_live, engine_reopened_detail, engine_single_writes, engine_short_buffers,
        byte_files, sst_point_get, sst_files, sst_roundtrip, sst_open_refusals, stream_ingest_live, windowed_activity,
    ]
    return {f.__name__: f for f in names}
