"""Reads, merges, buffer and blocks against small cases and a dictionary model."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sortedfile
from tidemark.functions.codec import encoded_size
from tidemark.model import DELETE, PUT, RunOptions, checked_value_type, value_type_name, violations
from tidemark.operators import blocks, buffer, compaction, numbering, reads

SCHEMA = "user_key string, seqno long, value_type int, value string"


def table(spark, rows):
    return spark.createDataFrame([(k, s, t, v if t == PUT else None) for k, s, t, v in rows], SCHEMA)


def random_log(seed, n=300, keys=12):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", i + 1, DELETE if rng.random() < 0.25 else PUT, f"v{i}") for i in range(n)]


def model(rows, limit=None):
    state = {}
    for k, s, t, v in sorted(rows, key=lambda r: r[1]):
        if limit is None or s <= limit:
            state[k] = (s, t, v if t == PUT else None)
    return state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reads_follow_model(spark, seed):
    rows = random_log(seed)
    log = table(spark, rows)
    for limit in (None, 0, 1, 77, 300):
        state = model(rows, limit)
        assert {r.user_key: (r.seqno, r.value_type, r.value) for r in reads.newest(log, limit).collect()} == state
        assert {r.user_key: r.value for r in reads.live(log, limit).collect()} == {k: v for k, (_, t, v) in state.items() if t == PUT}
        assert {r.user_key for r in reads.deleted(log, limit).collect()} == {k for k, (_, t, _) in state.items() if t == DELETE}
    # a snapshot equals the newest state of the log cut at it
    assert sorted(reads.live(log, 150).collect()) == sorted(reads.live(log.where("seqno <= 150")).collect())


def test_versions_snapshot_and_resurrection(spark):
    log = table(spark, [("key1", 1, PUT, "original"), ("key1", 5, DELETE, None), ("key1", 10, PUT, "again")])
    probes = spark.createDataFrame([("key1", n) for n in (0, 1, 3, 5, 7, 10, 99)], "user_key string, as_of long")
    got = {r.as_of: (r.status, r.value) for r in reads.get_at(log, probes).collect()}
    assert got == {
        0: ("NotFound", None), 1: ("Found", "original"), 3: ("Found", "original"), 5: ("Deleted", None), 7: ("Deleted", None), 10: ("Found", "again"), 99: ("Found", "again"),
    }
    assert [(r.seqno, r.value) for r in reads.resurrected(log).collect()] == [(10, "again")]
    assert [(r.seqno, r.version, r.superseded_by) for r in reads.history(log).orderBy("version").collect()] == [(10, 1, None), (5, 2, 10), (1, 3, 5)]


@pytest.mark.parametrize("span", [1, 7, 50, 1 << 20])
def test_dated_probes_in_spans(spark, span):
    rows = random_log(9, 200, 4)
    probes = spark.createDataFrame([(f"k{k}", n) for k in range(6) for n in range(0, 260, 13)], "user_key string, as_of long")
    got = {(r.user_key, r.as_of): (r.seqno, r.value) for r in reads.get_at(table(spark, rows), probes, span).collect()}
    want = {(f"k{k}", n): (lambda s: (s[0], s[2]) if s else (None, None))(model(rows, n).get(f"k{k}")) for k in range(6) for n in range(0, 260, 13)}
    assert got == want


@pytest.mark.parametrize("span", [1, 7, 50, 1 << 20])
def test_history_and_resurrection_in_spans(spark, span):
    rows = random_log(10, 200, 4)
    rows = [r for r in rows if not 60 < r[1] < 90]  # spans without a version
    log, of = table(spark, rows), {}
    for k, s, t, v in rows:
        of.setdefault(k, []).append((s, t, v))
    want = {(k, s): (len(vs) - i, vs[i + 1][0] if i + 1 < len(vs) else None) for k, vs in of.items() for i, (s, _, _) in enumerate(vs)}
    assert {(r.user_key, r.seqno): (r.version, r.superseded_by) for r in reads.history(log, span).collect()} == want
    again = {(k, b[0], b[2]) for k, vs in of.items() for a, b in zip(vs, vs[1:], strict=False) if a[1] == DELETE and b[1] == PUT}
    assert again and {tuple(r) for r in reads.resurrected(log, span).collect()} == again


def test_ghost_delete_and_empty_key(spark):
    log = table(spark, [("ghost", 1, DELETE, None), ("", 2, PUT, "")])
    probes = spark.createDataFrame([("ghost",), ("",), ("none",)], "user_key string")
    got = {r.user_key: (r.status, r.value) for r in reads.get_detail(log, probes).collect()}
    assert got == {"ghost": ("Deleted", None), "": ("Found", ""), "none": ("NotFound", None)}
    assert [r.user_key for r in reads.present(log, probes).collect()] == [""]
    assert {r.user_key for r in reads.absent(log, probes).collect()} == {"ghost", "none"}
    assert reads.get(log, "").first().value == "" and reads.get(log, "ghost").first() is None


def test_empty_log(spark):
    log = table(spark, [])
    assert reads.live(log).count() == 0 and compaction.statistics(log.withColumn("run_id", F.lit(1))).first().input_entries == 0
    row = buffer.buffer_statistics(log).first()
    assert (row.entries, row.approximate_size, row.min_seqno, row.next_seqno) == (0, 0, None, 1)


def test_binary_keys_order_unsigned(spark):
    keys = [b"\x80", b"\x7f", b"", b"\x7f\x00"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "user_key binary")
    assert [bytes(r.user_key) for r in df.orderBy("user_key").collect()] == sorted(keys)


def test_merge(spark):
    old = table(spark, [("key1", 1, PUT, "old"), ("key2", 2, PUT, "b"), ("alive", 3, PUT, "c"), ("dead", 4, PUT, "d")])
    new = table(spark, [("key1", 5, PUT, "new"), ("dead", 6, DELETE, None), ("ghost", 7, DELETE, None)])
    kept = {r.user_key: (r.seqno, r.value_type) for r in compaction.merge([new, old], False).collect()}
    assert kept == {"key1": (5, PUT), "key2": (2, PUT), "alive": (3, PUT), "dead": (6, DELETE), "ghost": (7, DELETE)}
    assert {r.user_key for r in compaction.merge([old, new], True).collect()} == {"key1", "key2", "alive"}


def test_merge_with_snapshots_keeps_what_fences_see(spark):
    for seed in range(3):
        rows = random_log(seed, 120, 5)
        fences = [10, 40, 90]
        merged = compaction.merge_with_snapshots(table(spark, rows), fences)
        assert merged.count() < len(rows)
        for limit in [*fences, None]:
            assert sorted(reads.live(merged, limit).collect()) == sorted(reads.live(table(spark, rows), limit).collect())


def test_flush_assignment(spark):
    rows = [(f"k{i}", i + 1, PUT, "x" * (i % 50)) for i in range(500)]
    log = table(spark, rows).withColumn("stream", F.col("seqno") % 3)
    got = {r.seqno: r.flush_id for r in buffer.flush_assignment(log, 700).collect()}
    for s in range(3):
        held = flush = 0
        for k, seq, _, v in rows:
            if seq % 3 == s:
                assert got[seq] == flush
                held += len(k) + 73 + len(v)
                if buffer.should_flush(held, 700):
                    held, flush = 0, flush + 1


def test_cut_numbers_carries_over():
    sizes = np.array([5, 5, 5, 5])
    assert buffer.cut_numbers(sizes, 10)[0].tolist() == [0, 0, 1, 1]
    a, left = buffer.cut_numbers(sizes[:1], 10)
    assert (a.tolist(), left) == ([0], 5)
    assert buffer.cut_numbers(sizes[1:], 10, left) [0].tolist() == [0, 1, 1]


def test_pack_sizes_equals_loop():
    rng = np.random.default_rng(0)
    for opts in (RunOptions(), RunOptions(block_size=200, restart_interval=3)):
        sizes = rng.integers(15, 400, 2000)
        opens, state = blocks.pack_sizes(sizes, opts)
        cut = 700
        first, mid = blocks.pack_sizes(sizes[:cut], opts)
        second, end = blocks.pack_sizes(sizes[cut:], opts, mid)
        assert np.array_equal(opens, np.r_[first, second]) and end == state
        held = count = 0
        for s, o in zip(sizes, opens, strict=True):
            expect = count == 0 or held + 4 * -(-count // opts.restart_interval) + 24 + s > opts.block_size
            assert o == expect
            held, count = (s, 1) if expect else (held + s, count + 1)


def test_block_lookup(spark):
    rows = [(f"key_{i:04d}", i + 1, PUT, "v" * 40) for i in range(400)] + [("key_0100", 1000 + i, PUT, "w" * 60) for i in range(200)]
    log = table(spark, rows).withColumn("run_id", F.lit(7).cast("long"))
    index = blocks.block_index(blocks.pack_blocks(log, RunOptions(block_size=1024)))
    last = {r.block_id: r.last_key for r in index.collect()}
    probes = spark.createDataFrame([("",), ("key_0100",), ("key_0399",), ("zzz",)], "user_key string")
    got = {r.user_key: r.block_id for r in blocks.find_block(index, probes).collect()}
    assert got == {p: min(b for b, k in last.items() if k >= p) for p in ("", "key_0100", "key_0399")}
    total = sum(r.block_len for r in index.collect())
    top = max(index.collect(), key=lambda r: r.block_id)
    assert top.block_offset + top.block_len == total
    assert log.agg(F.sum(encoded_size())).first()[0] + 24 * len(last) <= total


def shuffled_rows(spark, name, work):
    """What ``work`` returns, and the rows that its stages wrote to shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = work()
    finally:
        sc._jsc.clearJobGroup()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(name) for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    return out, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_block_lookup_over_many_runs_and_probes(spark):
    """Every pair of a probe and a run is in the result, none of them in a shuffle."""
    last = [(r, b, f"k{(b + 1) * 500 - 1 - r:05d}") for r in range(50) for b in range(6)] + [(0, 6, "k02999")]  # two blocks of run 0 end with one key
    index = spark.createDataFrame(last, "run_id long, block_id long, last_key string")
    probes = [f"k{i:05d}" for i in range(3100)]
    given = spark.createDataFrame([(p,) for p in [*probes, probes[0], None]], "user_key string")
    got, shuffled = shuffled_rows(spark, "many runs", lambda: blocks.find_block(index, given).collect())
    ends = {r: [(k, b) for s, b, k in last if s == r] for r in range(50)}
    want = sorted((r, p, min(b for k, b in ends[r] if k >= p)) for r in range(50) for p in probes if p <= ends[r][-1][0])
    assert shuffled < len(want) / 4
    assert sorted((r.run_id, r.user_key, r.block_id) for r in got) == want


def test_point_get_asks_files_that_can_hold_the_version(spark):
    """Forty runs with keys of their own, and one key that crosses the files of all; other files are not asked."""
    rows = [(r, f"k{r:02d}_{i:03d}", r * 1000 + i + 1, PUT, f"v{r}.{i}") for r in range(40) for i in range(100)]
    rows += [(r, "common", r * 1000 + 500 + i, PUT, f"c{r}.{i}") for r in range(40) for i in range(30)]
    log = spark.createDataFrame(rows, "run_id long, user_key string, seqno long, value_type int, value string")
    opts = RunOptions(block_size=400, restart_interval=4, target_file_bytes=1200)
    whole = blocks.block_index(blocks.pack_blocks(log, opts), opts).select("run_id", "block_id", "block_offset")
    assert blocks.pack_blocks(log, opts, offsets=True).select("run_id", "block_id", "block_offset").distinct().exceptAll(whole).isEmpty()
    built = sortedfile.build_files(log, opts)
    files = spark.createDataFrame(built.collect(), built.schema)
    keys = sorted({r[1] for r in rows if r[0] % 3 == 0} | {f"k{r:02d}_{i:03d}x" for r in range(40) for i in range(0, 100, 9)})
    asked = [(k.encode(), n) for k in keys for n in (0, 12050, None)]
    probes = spark.createDataFrame([*asked, (None, 5)], "user_key binary, as_of long")
    got, shuffled = shuffled_rows(spark, "many files", lambda: sortedfile.point_get(files, probes).collect())
    assert shuffled < len(asked) * 20  # half of a row for each run and probe
    versions = {}
    for _, k, s, _, v in sorted(rows, key=lambda r: r[2]):
        versions.setdefault(k.encode(), []).append((s, v.encode()))
    want = {(k, n): next(((s, v) for s, v in reversed(versions.get(k, [])) if n is None or s <= n), (None, None)) for k, n in asked} | {(None, 5): (None, None)}
    assert {(r.user_key and bytes(r.user_key), r.as_of): (r.seqno, r.value and bytes(r.value)) for r in got} == want and len(got) == len(want)
    ranges = [(r.run_id, r.file_no, bytes(r.first_key), bytes(r.last_key), r.min_seqno) for r in files.collect()]
    pairs = {(r, f, k, n) for r, f, a, b, s in ranges for k, n in asked if a <= k <= b and (n is None or s <= n)}
    found = [(r.run_id, r.file_no, bytes(r.user_key), r.as_of) for r in sortedfile.candidates(files, probes).collect()]
    assert set(found) == pairs and len(found) == len(pairs)


def test_numbering_is_dense(spark):
    df = spark.range(1000).withColumn("h", F.xxhash64("id")).repartition(7)
    got = numbering.numbered(df, ["h", "id"], start=5, name="n").orderBy("h").collect()
    assert [r.n for r in got] == list(range(5, 1005))
    assert numbering.numbered(df.where("id < 0"), ["id"]).count() == 0


def test_violations_and_types(spark):
    good = table(spark, random_log(4))
    assert violations(good).count() == 0
    bad = spark.createDataFrame([("a", 1, 0, None), ("a", 1, 1, "x"), (None, 0, 7, "y")], SCHEMA)
    assert {r.rule: r.n for r in violations(bad).collect()} == {
        "null key": 1, "seqno below 1": 1, "unknown value type": 1, "delete with a value": 1, "put without a value": 1, "repeated version": 1,
    }
    names = spark.createDataFrame([(0,), (1,), (2,)], "c int").select(value_type_name(F.col("c")).alias("n")).collect()
    assert [r.n for r in names] == ["put", "delete", None]
    with pytest.raises(Exception, match="unknown value type"):
        spark.createDataFrame([(9,)], "c int").select(checked_value_type(F.col("c"))).collect()


def test_candidate_runs_and_read_amplification(spark):
    manifest = spark.createDataFrame([(1, 1, 10, "a", "m"), (2, 11, 20, "k", "z")], "run_id long, min_seqno long, max_seqno long, first_key string, last_key string")
    probes = spark.createDataFrame([("b", 5), ("l", 5), ("l", 15), ("zz", 99)], "user_key string, as_of long")
    assert sorted((r.user_key, r.as_of, r.run_id) for r in reads.candidate_runs(manifest, probes).collect()) == [("b", 5, 1), ("l", 5, 1), ("l", 15, 1), ("l", 15, 2)]
    log = spark.createDataFrame([("a", 1), ("b", 1), ("b", 3)], "user_key string, run_id long")
    assert {r.user_key: r.runs_read for r in reads.sources_consulted(log).collect()} == {"a": 3, "b": 1}


def test_point_read_pushes_predicates(spark, tmp_path):
    table(spark, random_log(5)).write.parquet(str(tmp_path / "log"))
    plan = reads.get(spark.read.parquet(str(tmp_path / "log")), "k3", 50)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_key,k3)" in plan and "LessThanOrEqual(seqno,50)" in plan
