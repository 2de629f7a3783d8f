"""Packing, mixing, sharding, fingerprints and line rules: brute force, round trips, odd inputs."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint, line_rules, mixing, packing, sharding
from tidemark.llm.common import read, shared_dir
from tidemark.llm.oracles import oracle_sql
from tidemark.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, sf):
    return {r.doc_id: r.text for r in read(spark, sf, "documents").select("doc_id", "text").collect()}


# --- packing ---


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        lengths = np.sort(rng.choice(np.arange(1, 60), n, replace=False))
        counts = rng.integers(1, 20, n)
        for k in (1, 2, 3, 4):
            best = min(
                sum(int(c) * (min(e for e in [*ends, lengths[-1]] if e >= x) - x) for x, c in zip(lengths, counts, strict=True))
                for ends in itertools.combinations(lengths[:-1], min(k, n) - 1)
            )
            edges = packing.choose_boundaries(lengths, counts, k)
            assert len(edges) <= k and edges[-1] == lengths[-1] and edges == sorted(edges)
            assert sum(int(c) * (min(e for e in edges if e >= x) - x) for x, c in zip(lengths, counts, strict=True)) == best
    assert packing.choose_boundaries(np.array([], int), np.array([], int), 4) == []


def check_packing(rows, cfg):
    batches = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.padding == r.boundary - r.length
        batches[r.bucket, r.batch].append(r)
    members = collections.Counter(r.bucket for r in rows)
    for (bucket, _), rs in batches.items():
        room = max(1, cfg.budget // max(1, rs[0].boundary))
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= room
        assert len(rs) * rs[0].boundary <= max(cfg.budget, rs[0].boundary)
    for bucket, n in members.items():  # all batches but the last are full
        room = max(1, cfg.budget // max(1, next(r.boundary for r in rows if r.bucket == bucket)))
        assert len([1 for b, _ in batches if b == bucket]) == -(-n // room)


def test_packing_of_documents(spark, sf):
    cfg = packing.PackConfig(buckets=6, budget=4000, stream_rows=17)
    rows = packing.pack(read(spark, sf, "documents"), cfg).collect()
    own = texts(spark, sf)
    assert {r.doc_id: r.length for r in rows} == {k: len(WORD.findall(v or "")) for k, v in own.items()} and len(rows) == len(own)
    check_packing(rows, cfg)


def test_boundaries_of_many_lengths():
    """Halving ranges gives what trying every start gives, ties included."""
    rng = np.random.default_rng(2)
    for n, most in ((700, 10**6), (300, 320)):
        lengths, counts = np.sort(rng.choice(np.arange(1, most), n, replace=False)), rng.integers(1, 50, n)
        docs, toks = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
        table, back = np.r_[0, lengths * docs[1:] - toks[1:]], []
        for _ in range(7):
            tried = [table[:j] + lengths[j - 1] * (docs[j] - docs[:j]) - (toks[j] - toks[:j]) for j in range(1, n + 1)]
            back.append([0] + [int(np.argmin(c)) for c in tried])
            table = np.r_[0, [c.min() for c in tried]]
        want, j = [], n
        for step in [*back[::-1], [0] * (n + 1)]:
            if j > 0:
                want.append(int(lengths[j - 1]))
                j = step[j]
        assert packing.choose_boundaries(lengths, counts, 8) == want[::-1]
    assert len(packing.choose_boundaries(np.arange(1, 200_001), np.ones(200_000, int), 4)) == 4


def test_packing_carries_columns(spark, sf, odd_documents):
    docs = read(spark, sf, "documents")
    out = packing.pack(docs, packing.PackConfig(buckets=6, budget=4000, stream_rows=17))
    assert out.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(tuple, out.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    light = packing.pack(docs, packing.PackConfig(buckets=6, budget=4000, stream_rows=17), columns=["doc_id"])
    assert sorted(map(tuple, out.select(*light.columns).collect())) == sorted(map(tuple, light.collect()))
    clash = odd_documents.withColumnRenamed("copies", "bucket")
    assert packing.pack(clash).columns[len(clash.columns) :] == ["length", "_bucket", "boundary", "batch", "slot", "padding"]


def test_packing_odd(odd_documents, no_documents):
    rows = packing.pack(odd_documents).collect()
    assert len(rows) == odd_documents.count() and {r.length for r in rows if r.doc_id in (2, 3, 4)} == {0}
    check_packing(rows, packing.PackConfig())
    assert packing.pack(no_documents).count() == 0


# --- mixing ---


def test_mix_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracle_sql()["op2_mix_pareto_sample"])
    df = queries()["op2_mix_pareto_sample"](spark, sf).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_mix_targets_and_caps(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), s) for s, n in (("a", 400), ("b", 30), ("c", 3), (None, 200)) for i in range(1000 * ord((s or "z")[0]), 1000 * ord((s or "z")[0]) + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    total = sum(size.values())
    # water-filling by hand: weights 3, 1, 2, 3 in the order a, b, c, null
    weight, cap = {"a": 3, "b": 1, "c": 2, None: 3}, {s: 2 * n for s, n in size.items()}
    left, open_, want = 1.5 * total, set(cap), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= cap[s]}
        if not over:
            break
        for s in over:
            want[s] = cap[s]
            left -= cap[s]
            open_.discard(s)
    want |= {s: level * weight[s] for s in open_}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and size[s] == next(r.source_size for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= 20 + 1e-6  # half the longest document
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in got if r.copies}
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect())) == sorted(map(tuple, mixing.mix_report(docs).collect()))


def test_unequal_inclusion_probabilities(spark):
    """Documents of a source with a larger p are taken more often: shares follow targets."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("copies").alias("m")).collect()
    got = {r.source: r.m for r in rows}
    assert got["a"] == pytest.approx(2.0, abs=0.01) and got["b"] == pytest.approx(1.0, abs=0.01)  # 3 : 1, a stops at 2


def test_inclusion_follows_odds(spark):
    """Sizes of 1, 16, 81 and 256 words have four inclusion probabilities; how often each is taken follows them, over seeds."""
    root = {1: 1, 16: 2, 81: 3, 256: 4}
    rows = [(i, " ".join(["w"] * n), s) for i in range(1000) for k, n in enumerate(root) for i, s in ((4 * i + k, "a"),)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    level = 1.5 * sum(root) / sum(n * x for n, x in root.items())
    want = {n: level * x for n, x in root.items()}
    assert 0 < want[1] < want[16] < 1 < want[81] < want[256] < 2  # three of them are drawn with different odds, none is certain
    mean = collections.Counter()
    for seed in ("x", "y", "z"):
        cfg = mixing.MixConfig(seed=seed)
        for r in mixing.mix_report(docs, cfg).groupBy("size").agg(F.avg("copies").alias("m"), F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect():
            mean[r["size"]] += r.m / 3
            assert (r.lo, r.hi) == (int(want[r["size"]]), int(want[r["size"]]) + 1)
    for n in root:  # over three samples, 4 standard errors are at most 0.037
        assert mean[n] == pytest.approx(want[n], abs=0.04)


def test_levels_with_full_sizes(spark):
    """The largest documents stop at two copies; the level is as found by bisection."""
    sizes = [1] * 50 + [10] * 20 + [10_000]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    cfg = mixing.MixConfig(budget_percent=195)
    plan = mixing.targets(mixing.sizes_of(docs), cfg).first()
    lo, hi = 0.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * min(2.0, mid * n**0.25) for n in sizes) < 1.95 * sum(sizes) else (lo, mid)
    assert plan.level == pytest.approx(lo) and plan.target == pytest.approx(1.95 * sum(sizes))
    got = {r.doc_id: r.copies for r in mixing.mix_report(docs, mixing.MixConfig(budget_percent=199)).collect()}
    assert got[70] == 2


def test_mix_odd(odd_documents, no_documents):
    rows = mixing.mix_report(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(odd_documents).columns == odd_documents.columns
    assert mixing.mix_report(no_documents).count() == 0 and mixing.mix(no_documents).count() == 0


# --- sharding ---


def test_similar_runs():
    run = lambda name, size: sharding.Run(name, 1, size, 1)
    cfg = sharding.ShardConfig(min_merge=3, max_merge=4, spread=2.0, small_bytes=10)
    runs = [run("a", 1), run("b", 10), run("c", 19), run("d", 40), run("e", 100), run("f", 90), run("g", 91)]
    assert [[r.name for r in g] for g in sharding.similar_runs(runs, cfg)] == [["a", "b", "c"], ["f", "g", "e"]]
    assert [len(g) for g in sharding.similar_runs([run(str(i), 5) for i in range(9)], cfg)] == [4, 4]
    assert sharding.similar_runs([], cfg) == []


def test_shards_round_trip(spark, sf):
    docs = read(spark, sf, "documents")
    got = sharding.shard_report(docs, shared_dir(spark, "t"), arrivals=9, config=sharding.ShardConfig(small_bytes=1 << 24))
    own = texts(spark, sf)
    rows = got.collect()
    assert {r.doc_id: r.text_sha256 for r in rows} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in own.items()} and len(rows) == len(own)
    assert {r.n_chars for r in rows if r.doc_id == 0} == {len(own[0])}
    assert max(r.run_level for r in rows) >= 1 and len({r.run for r in rows}) < 9


def test_shard_versions(spark, odd_documents, no_documents):
    root = shared_dir(spark, "t")
    cfg = sharding.ShardConfig(min_merge=3, small_bytes=1 << 24)
    store = sharding.ShardStore(spark, root, cfg)
    assert store.manifest() is None and store.compact() is None and store.vacuum() == 0
    assert store.append(no_documents) is None
    for _ in range(3):
        store.append(odd_documents)
    n = odd_documents.count()
    assert [store.read(v).count() for v in (1, 2, 3)] == [n, 2 * n, 3 * n] and store.manifest().version == 3
    merged = store.compact()
    assert (merged.version, len(merged.runs), merged.runs[0].rows, merged.runs[0].merged_from) == (4, 1, 3 * n, 3)
    assert store.read(3).count() == store.read().count() == 3 * n and store.read().columns == odd_documents.columns
    assert store.read().exceptAll(odd_documents.union(odd_documents).union(odd_documents)).count() == 0
    assert store.vacuum() == 3 and store.read().count() == 3 * n
    again = sharding.ShardStore(spark, root, cfg)
    with pytest.raises(sharding.CommitConflict):  # a version is never replaced
        again._publish(sharding.Manifest(4, merged.schema, ()))
    assert again.read().count() == 3 * n
    assert again.append(odd_documents).version == 5


def test_lost_race_is_tried_again(spark, odd_documents):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"))
    store.append(odd_documents)
    other = sharding.ShardStore(spark, store.root)
    real, calls = store._publish, []

    def publish(manifest):
        if not calls:
            calls.append(1)
            other.append(odd_documents)  # another writer is first
        return real(manifest)

    store._publish = publish
    assert store.append(odd_documents).version == 3 and store.read().count() == 3 * odd_documents.count()


def test_shards_odd(spark, odd_documents, no_documents):
    rows = sharding.shard_report(odd_documents, shared_dir(spark, "t"), arrivals=3).collect()
    assert len(rows) == odd_documents.count() and [r.text_sha256 for r in rows if r.doc_id == 2] == [None]
    assert sharding.shard_report(no_documents, shared_dir(spark, "t")).count() == 0


# --- fingerprints ---


def shingle_set(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, sf):
    rows = {r.doc_id: r for r in fingerprint.fingerprint_report(read(spark, sf, "documents")).collect()}
    own = texts(spark, sf)
    ids = sorted(own)
    errors = []
    for i, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = own[i], len(own[i])
        edited = t[: n - n // 4] + own[nxt][: n // 4]
        assert rows[i].n_chars == n and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(rows[i].near_edited - jaccard(shingle_set(t), shingle_set(edited)))
        assert abs(rows[i].near_next - jaccard(shingle_set(t), shingle_set(own[nxt]))) < 0.2
        assert len(rows[i].fingerprint) == 256 == len(rows[i].edited_fingerprint)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045 and np.max(np.abs(errors)) < 0.2
    by_text = collections.defaultdict(set)
    for i, t in own.items():
        by_text[t].add(rows[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def plain_fingerprint(text):
    """One-permutation MinHash with optimal densification in plain Python, on the same hash function."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in WORD.findall(text)]
    if not words:
        return "0" * 256
    bins = {}
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), seed=h)
        h &= (1 << 63) - 1
        bins[h >> 55] = min(h, bins.get(h >> 55, 1 << 64))
    digits = []
    for i in range(256):
        if i in bins:
            digits.append(bins[i] & 15)
            continue
        donor = min(bins, key=lambda j: (fingerprint._place(256 * i + j), j))  # noqa: B023
        h = xxhash.xxh64_intdigest(struct.pack("<q", signed(bins[donor])), seed=42)
        digits.append(xxhash.xxh64_intdigest(struct.pack("<i", i), seed=h) & 15)
    longs = [sum(d << (4 * k) for k, d in enumerate(digits[g : g + 16])) for g in range(0, 256, 16)]
    return "".join(f"{x:016x}" for x in longs)


def test_fingerprints_equal_plain_python(spark, odd_documents):
    """Bins, donors and packing, from one shingle (all donors from one bin) to thousands."""
    texts_ = [" ".join(f"w{i}_{n}" for i in range(n)) for n in (1, 4, 5, 6, 8, 20, 100, 300, 1500, 4000)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts_)], "doc_id long, text string").unionByName(odd_documents.select("doc_id", "text"))
    rows = fingerprint.with_fingerprint(docs, "text", "fp").select("text", fingerprint.as_text(F.col("fp")).alias("f")).collect()
    for r in rows:
        assert r.f == plain_fingerprint(r.text or ""), (r.text or "")[:40]


def test_buckets_of_odd_ids(spark):
    """An id far away, null and string ids: no bucket holds more than a small share of the rows."""
    far = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id) AS text").unionByName(spark.createDataFrame([(10**18, "far")], "doc_id long, text string"))
    nulls = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('t', id) AS text")
    names = spark.range(5000).selectExpr("concat('name-', id) AS doc_id", "concat('t', id) AS text")
    for docs in (far, nulls, names):
        cfg = fingerprint.NeighbourConfig(cells=16, bucket_rows=100)
        ids = docs.select("doc_id", F.xxhash64("text").alias("h"))
        sizes = [r["count"] for r in ids.groupBy(fingerprint._bucket(ids, "h", cfg).alias("b")).count().collect()]
        assert max(sizes) <= 800 and len(sizes) >= 12
        rows = fingerprint.with_next(docs, ["text"], cfg=cfg).collect()
        assert sorted(r.next_text for r in rows) == sorted(r.text for r in rows)  # one ring
        if docs is not nulls:
            want = sorted(((r.doc_id, r.text) for r in rows))
            assert {r.doc_id: r.next_text for r in rows} == {a[0]: b[1] for a, b in zip(want, [*want[1:], want[0]], strict=True)}


def test_likeness_is_unbiased_for_short_sets(spark):
    pairs = []
    for n in (1, 2, 5, 30, 100, 400):
        for seed in range(8):
            a = [f"{seed}_{n}_{i}" for i in range(n + 4)]
            b = a[: n // 2 + 4] + [f"z{seed}_{i}" for i in range(n - n // 2)]
            pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "fa"), "b", "fb")
    rows = df.select("a", "b", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("s")).collect()
    errors = [r.s - jaccard(shingle_set(r.a), shingle_set(r.b)) for r in rows]
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.25


def test_next_row_crosses_buckets(spark):
    ids = [*range(0, 300, 3), 10**15, 10**15 + 1, -5]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, ["text"], cfg=fingerprint.NeighbourConfig(cells=7, bucket_rows=10)).collect()}
    ids = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_fingerprints_odd(spark, odd_documents, no_documents):
    rows = fingerprint.fingerprint_report(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 256}
    assert fingerprint.fingerprint_report(no_documents).count() == 0
    one = fingerprint.fingerprint_report(odd_documents.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    clash = fingerprint.with_fingerprint(odd_documents.withColumn("fp_words", F.lit(1)), "text", "fp")
    assert "fp_words" in clash.columns and clash.where("fp IS NOT NULL").count() == 8


# --- line rules ---


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_line_statistics(spark, sf):
    own = texts(spark, sf)
    own |= {-1: "a b c d e f g h i " * 30, -2: " ".join(["x"] * 500), -3: "l1 x\n\nl1 x\n  \nl1 x\nl2", -4: "a b c d e f g h z a b c d e f g h " + " ".join(map(str, range(40)))}
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    for r in line_rules.report(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == statistics(own[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_verdicts_follow_labels(spark, sf):
    rows = line_rules.report(read(spark, sf, "documents")).join(read(spark, sf, "labels"), "doc_id").where("NOT base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)


def test_lines_are_removed(spark):
    good = "This is a decent sentence with enough words to be kept in the text.\nAnother one follows it, and it is fine as well, with commas.\nA third and last line makes the text somewhat longer than its junk."
    junk = "Home | About | Contact | Help | Login\nWe use cookies to make this better.\nAll rights reserved.\n### $$$ %%% &&&"
    docs = spark.createDataFrame([(1, good + "\n" + junk + "\nAll rights reserved."), (2, junk + "\n" + junk.replace("Home", "Top").replace("better", "fine")), (3, good)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_rules.clean(docs).collect()}
    assert kept == {1: good, 3: good}


def test_line_rules_odd(odd_documents, no_documents):
    rows = {r.doc_id: r for r in line_rules.report(odd_documents).collect()}
    for i in (2, 3, 4):
        assert (rows[i].n_words, rows[i].base_failed, rows[i].kept) == (0, True, False)
    assert rows[5].n_words == 120_000
    assert line_rules.report(no_documents).count() == 0 and line_rules.clean(odd_documents).columns == odd_documents.columns
