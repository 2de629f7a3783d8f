"""Sharding by size-tiered compaction (DataFrame functions only).

A store is a folder of immutable runs (a run: a folder of Parquet shards) and of versioned
manifests. An append writes a small run and commits a manifest that lists it. When enough runs of
similar size are there, they are merged into one run of target-sized shards, and one commit puts
it in the place of its inputs. Readers see whole versions only.

A merge moves no row between tasks: a task reads a few neighbouring small shards and writes one
file (coalesced scan partitions), so there is no shuffle and no hot key; all merges of a round
are one job. A commit creates ``v<number>.json`` by a rename that fails if the file is there; a
writer that loses the race reads the new version, checks that its inputs are still live, and
tries again. Files of failed or lost tasks never appear in a manifest.

Null and empty texts, repeated rows and any columns are stored as they are. Appending an empty
table commits nothing. Names of columns are kept; arrival numbers come as values beside the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh


@dataclass(frozen=True)
class ShardConfig:
    target_bytes: int = 128 << 20
    min_merge: int = 4  # runs of similar size
    max_merge: int = 32
    spread: float = 2.0  # largest over smallest in a tier
    small_bytes: int = 1 << 20  # runs below are similar to each other


@dataclass(frozen=True)
class Run:
    name: str
    rows: int
    bytes: int
    shards: int
    merged_from: int = 1  # arrivals in it
    level: int = 0  # merges that its rows have seen at most


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    runs: tuple[Run, ...] = field(default=())


class CommitConflict(RuntimeError):
    pass


def similar_runs(runs: list[Run] | tuple[Run, ...], cfg: ShardConfig) -> list[list[Run]]:
    """Groups of at least ``min_merge`` runs of similar size: from the smallest up, a tier takes
    runs up to ``spread`` times its smallest (sizes under ``small_bytes`` count as that)."""
    out, tier = [], []
    size = lambda r: max(r.bytes, cfg.small_bytes)
    for r in sorted(runs, key=lambda r: (size(r), r.name)):
        if tier and (size(r) > cfg.spread * size(tier[0]) or len(tier) == cfg.max_merge):
            out.append(tier)
            tier = []
        tier.append(r)
    out.append(tier)
    return [t for t in out if len(t) >= cfg.min_merge]


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, config: ShardConfig = ShardConfig()):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files ---
    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A version of the table, by default the last; None for an empty store."""
        versions = self._versions()
        if not versions:
            return None
        stream = self._fs().open(self._path("manifest", f"v{version or versions[-1]:010d}.json"))
        raw = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return Manifest(raw["version"], raw["schema"], tuple(Run(**r) for r in raw["runs"]))

    def _publish(self, manifest: Manifest) -> None:
        """Create the version's file, or raise CommitConflict if another writer has."""
        text = json.dumps({"version": manifest.version, "schema": manifest.schema, "runs": [asdict(r) for r in manifest.runs]})
        draft, final = self._path("manifest", f".draft-{uuid.uuid4().hex}"), self._path("manifest", f"v{manifest.version:010d}.json")
        stream = self._fs().create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)
        except Exception as e:
            self._fs().delete(draft, False)
            if self._fs().exists(final):
                raise CommitConflict(manifest.version) from e
            raise

    def _commit(self, change: Callable[[tuple[Run, ...]], tuple[Run, ...]], schema: str, tries: int = 20) -> Manifest:
        for _ in range(tries):
            now = self.manifest()
            new = Manifest((now.version if now else 0) + 1, schema, change(now.runs if now else ()))
            try:
                self._publish(new)
                return new
            except CommitConflict:
                continue
        raise CommitConflict(f"no commit in {tries} tries")

    def _describe(self, name: str, merged_from: int, level: int, rows: int) -> Run:
        files = [s for s in self._fs().listStatus(self._path("data", name)) if s.getPath().getName().endswith(".parquet")]
        return Run(name, rows, sum(s.getLen() for s in files), len(files), merged_from, level)

    def _row_counts(self, folder: str, schema: T.StructType) -> dict[str, int]:
        """Rows below each subfolder, from Parquet footers (one row a subfolder)."""
        df = self.spark.read.schema(schema).parquet(folder)
        rows = df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run")).groupBy("run").count()
        return {r["run"]: r["count"] for r in rows.collect()}

    # --- operations ---
    def append(self, df: DataFrame) -> Manifest | None:
        """One arrival: a small run, committed at once."""
        return self.append_each(df, F.lit(0))

    def append_each(self, df: DataFrame, arrival: Column, after: Callable[[], object] | None = None) -> Manifest | None:
        """Arrivals numbered by ``arrival`` (int), written in one job and committed in that order, one
        version each; ``after`` is called after each commit."""
        by, stamp = fresh("arrival", df.columns), uuid.uuid4().hex[:12]
        staging = self._path("data", f"staging-{stamp}")
        df.withColumn(by, arrival.cast("int")).write.partitionBy(by).parquet(str(staging))
        schema, last = df.schema, self.manifest()
        found = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in self._fs().listStatus(staging) if s.isDirectory()}
        counts = self._row_counts(str(staging), schema) if found else {}
        for k, number in enumerate(sorted(found)):
            name, rows = f"a{k:06d}-{stamp}", counts.get(found[number].getName(), 0)
            if rows:
                self._fs().rename(found[number], self._path("data", name))
                run = self._describe(name, 1, 0, rows)
                last = self._commit(lambda runs, run=run: (*runs, run), schema.json())
                if after:
                    after()
        self._fs().delete(staging, True)
        return last

    def compact(self) -> Manifest | None:
        """Merge tiers until none has enough runs; each round is one job and one commit."""
        while True:
            now = self.manifest()
            groups = similar_runs(now.runs, self.config) if now else []
            if not groups:
                return now
            schema = T.StructType.fromJson(json.loads(now.schema))
            by, stamp = fresh("run", schema.names), uuid.uuid4().hex[:12]
            parts = []
            for k, group in enumerate(groups):
                files = max(1, round(sum(r.bytes for r in group) / self.config.target_bytes))
                df = self.spark.read.schema(schema).parquet(*[str(self._path("data", r.name)) for r in group])
                parts.append(df.coalesce(files).withColumn(by, F.lit(k)))
            staging = self._path("data", f"staging-{stamp}")
            reduce(DataFrame.unionByName, parts).write.partitionBy(by).parquet(str(staging))
            merged = []
            for k, group in enumerate(groups):
                name = f"m{k:06d}-{stamp}"
                self._fs().rename(self._jvm.org.apache.hadoop.fs.Path(staging, f"{by}={k}"), self._path("data", name))
                level = 1 + max(r.level for r in group)
                merged.append(self._describe(name, sum(r.merged_from for r in group), level, sum(r.rows for r in group)))
            self._fs().delete(staging, True)
            gone = {r.name for g in groups for r in g}

            def change(runs: tuple[Run, ...], gone=gone, merged=tuple(merged)) -> tuple[Run, ...]:
                if not gone <= {r.name for r in runs}:
                    raise RuntimeError("another compaction has replaced runs of this one")
                return (*[r for r in runs if r.name not in gone], *merged)

            self._commit(change, now.schema)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete runs that none of the last versions lists; older manifests go too. To be called by
        one maintainer, with no append on its way. Returns the number of runs deleted."""
        versions = self._versions()
        if not versions:
            return 0
        live = {r.name for v in versions[-keep_versions:] for r in self.manifest(v).runs}
        for v in versions[:-keep_versions]:
            self._fs().delete(self._path("manifest", f"v{v:010d}.json"), False)
        dead = [s.getPath() for s in self._fs().listStatus(self._path("data")) if s.getPath().getName()[0] in "am" and s.getPath().getName() not in live]
        for p in dead:
            self._fs().delete(p, True)
        return len(dead)

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        if m is None or not m.runs:
            return self.spark.createDataFrame([], schema or (T.StructType.fromJson(json.loads(m.schema)) if m else T.StructType([])))
        return self.spark.read.schema(T.StructType.fromJson(json.loads(m.schema))).parquet(*[str(self._path("data", r.name)) for r in m.runs])


def arrivals_by_id(docs: DataFrame, n: int) -> Column:
    """Arrival number of a row when documents come in the order of doc_id, in ``n`` arrivals of
    equal ranges; null ids come first. Ids that are strings come by their hash."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return F.lit(0)
    if isinstance(lo, str):
        return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    width = max(float(hi) - float(lo) + 1.0, 1.0) / n
    place = F.least(F.floor((F.col("doc_id").cast("double") - F.lit(float(lo))) / F.lit(width)), F.lit(n - 1))
    return F.coalesce(place, F.lit(0)).cast("int")


def shard_report(docs: DataFrame, root: str, arrivals: int = 16, config: ShardConfig = ShardConfig()) -> DataFrame:
    """Append ``docs`` in arrivals with compaction after each, then one row per stored row: doc_id,
    n_chars, text_sha256, run, run_level, shard (file in its run), version."""
    store = ShardStore(docs.sparkSession, root, config)

    def tidy() -> None:
        before = store.manifest().version
        if store.compact().version != before:
            store.vacuum()

    store.append_each(docs, arrivals_by_id(docs, arrivals), tidy)
    m = store.manifest()
    rows = store.read(schema=docs.schema)
    if m is None:
        path, runs = F.lit(""), {}
    else:
        path, runs = F.col("_metadata.file_path"), {r.name: r.level for r in m.runs}
    rows = rows.select("doc_id", "text", F.split(path, "/").alias("path")).select("doc_id", "text", F.element_at("path", -2).alias("run") if m else F.lit("").alias("run"), F.element_at("path", -1).alias("shard"))
    level = F.lit(0)
    for name, lv in runs.items():
        if lv:
            level = F.when(F.col("run") == name, lv).otherwise(level)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        "run",
        level.cast("int").alias("run_level"),
        "shard",
        F.lit(m.version if m else 0).cast("long").alias("version"),
    )
