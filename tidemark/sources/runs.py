"""Sorted runs in a shared folder, listed by a manifest.

Layout: ``data/<random name>/*.parquet`` (a run: immutable, sorted by key and newest version first, with Parquet
bloom filters on the key) and ``manifest/v<version>.json`` (the runs of a version). Every attempt to write a run has a
folder of its own, so no writer touches another's files. A commit publishes the next version by a rename
that never replaces a file; a writer that comes second reads the new state and tries again, so runs of
several writers are all kept (seqnos are the writers' business). Rows become visible with their manifest only, and folders
that no manifest lists, those of failed attempts or of runs that were compacted, stay until ``vacuum``, so that readers of an
earlier version go on. The rename is atomic on HDFS and local disks; an object store needs a committer
that has conditional writes. Reopening a store needs nothing but its folder."""

from __future__ import annotations

import base64
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RunOptions
from ..operators.compaction import merge


@dataclass(frozen=True)
class RunMeta:
    run_id: int
    num_entries: int
    min_seqno: int
    max_seqno: int
    first_key: object
    last_key: object
    file_size: int
    folder: str = ""


def describe_runs(log: DataFrame, run: str = "run_id") -> DataFrame:
    """The manifest's row of each run, rebuilt from the rows (file_size: bytes of the entries)."""
    from ..functions.codec import encoded_size

    return log.groupBy(run).agg(
        F.count(F.lit(1)).alias("num_entries"),
        F.min("seqno").alias("min_seqno"),
        F.max("seqno").alias("max_seqno"),
        F.min("user_key").alias("first_key"),
        F.max("user_key").alias("last_key"),
        F.sum(encoded_size().cast("long")).alias("file_size"),
    )


def may_hold(run: RunMeta, key: object | None, as_of: int | None, within: tuple[object, object] | None) -> bool:
    """Whether a run's ranges admit the key, the seqno limit and the range of keys (None: any)."""
    first, last = within or (run.first_key, run.last_key)
    inside = first <= run.last_key and run.first_key <= last
    return inside and (key is None or run.first_key <= key <= run.last_key) and (as_of is None or run.min_seqno <= as_of)


def restricted(log: DataFrame, key: object | None, as_of: int | None, within: tuple[object, object] | None) -> DataFrame:
    """The rows of ``log`` for the key, the seqno limit and the range of keys (None: any)."""
    if key is not None:
        log = log.where(F.col("user_key") == F.lit(key))
    if within is not None:
        log = log.where(F.col("user_key").between(F.lit(within[0]), F.lit(within[1])))
    return log if as_of is None else log.where(F.col("seqno") <= as_of)


class RunStore:
    """A folder of runs. ``key_type`` is the Spark type of keys and values (binary or string)."""

    def __init__(self, spark: SparkSession, root: str, options: RunOptions = RunOptions(), key_type: str = "binary"):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.schema = T._parse_datatype_string(f"user_key {key_type}, seqno long, value_type int, value {key_type}")
        self._binary = key_type == "binary"

    # --- files -------------------------------------------------------------------------------
    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _run(self, run_id: int) -> RunMeta:
        found = [r for r in self.runs() if r.run_id == run_id]
        if not found:
            raise FileNotFoundError(f"{self.root}: run {run_id}")
        return found[0]

    def run_path(self, run_id: int) -> str:
        """Where a run is; an unknown id is an error."""
        return f"{self.root}/data/{self._run(run_id).folder}"

    def _versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:].split(".")[0]) for n in names if n.startswith("v"))

    # --- manifest ----------------------------------------------------------------------------
    def _key_out(self, key: object) -> str:
        return base64.b64encode(bytes(key)).decode() if self._binary else str(key)

    def _key_in(self, text: str) -> object:
        return bytearray(base64.b64decode(text)) if self._binary else text

    def _state(self) -> tuple[list[RunMeta], int, int, int]:
        """(runs newest first, next run id, last stream batch, version)."""
        versions = self._versions()
        if not versions:
            return [], 1, -1, 0
        stream = self._fs().open(self._path("manifest", f"v{versions[-1]:010d}.json"))
        try:
            state = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        runs = [replace(RunMeta(**r), first_key=self._key_in(r["first_key"]), last_key=self._key_in(r["last_key"])) for r in state["runs"]]
        return sorted(runs, key=lambda r: -r.run_id), state["next_run"], state["last_batch"], versions[-1]

    def runs(self) -> list[RunMeta]:
        """Runs, newest first."""
        return self._state()[0]

    def last_batch(self) -> int:
        """The stream batch committed last; -1 if there is none."""
        return self._state()[2]

    def manifest(self) -> DataFrame:
        """The manifest as a table, newest run first."""
        key = self.schema["user_key"].dataType.simpleString()
        shape = f"run_id long, num_entries long, min_seqno long, max_seqno long, first_key {key}, last_key {key}, file_size long"
        return self.spark.createDataFrame([tuple(vars(r).values())[:-1] for r in self.runs()], shape)

    def _publish(self, runs: list[RunMeta], next_run: int, last_batch: int, version: int) -> bool:
        """Publish a version by renaming a finished file; False if another writer was first."""
        listed = [asdict(replace(r, first_key=self._key_out(r.first_key), last_key=self._key_out(r.last_key))) for r in runs]
        draft = self._path("manifest", f"draft-{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps({"runs": listed, "next_run": next_run, "last_batch": last_batch}).encode()))
        out.close()
        final = self._path("manifest", f"v{version:010d}.json")
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _commit(self, change: Callable[[list[RunMeta], int, int], tuple[list[RunMeta], int, int] | None]) -> None:
        """Apply ``change`` to the newest state until no other writer comes between; None: nothing to do."""
        while True:
            runs, next_run, last_batch, version = self._state()
            new = change(runs, next_run, last_batch)
            if new is None or self._publish(*new, version + 1):
                return

    # --- writes ------------------------------------------------------------------------------
    def _sealed(self, rows: DataFrame, folder: str) -> DataFrame:
        """Rows as they are stored in a folder."""
        return rows

    def _opened(self, rows: DataFrame) -> DataFrame:
        """Stored rows as they were written."""
        return rows

    def _write_run(self, rows: DataFrame) -> RunMeta | None:
        """A run that no manifest lists yet; its id is given by the commit."""
        folder = uuid.uuid4().hex
        path = f"{self.root}/data/{folder}"
        ordered = self._sealed(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]), folder)
        ordered = ordered.repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seqno"))
        bits = self.options.bloom_bits_per_key
        writer = ordered.write.option("parquet.bloom.filter.enabled#user_key", str(bits > 0).lower())
        if bits > 0:
            # the filter's size follows the number of keys in a file
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.fpp#user_key", str(0.6185**bits))
        writer.parquet(path)
        done = self.spark.read.schema(self.schema).parquet(path)
        m = done.agg(F.count(F.lit(1)), F.min("seqno"), F.max("seqno"), F.min("user_key"), F.max("user_key")).first()
        if not m[0]:
            self._fs().delete(self._path("data", folder), True)  # this attempt's own
            return None
        size = self._fs().getContentSummary(self._path("data", folder)).getLength()
        return RunMeta(0, m[0], m[1], m[2], m[3], m[4], size, folder)

    def flush(self, rows: DataFrame, batch: int | None = None) -> RunMeta | None:
        """Write rows as the newest run. No rows: ValueError, and no run. ``batch``: the number of the
        stream batch that the rows are; it is committed with them, once: None if another attempt did it."""
        made = self._write_run(rows)
        if made is None:
            raise ValueError("nothing to write: the table is empty")
        out: list[RunMeta] = []

        def add(runs: list[RunMeta], next_run: int, last_batch: int):
            out.clear()
            if batch is not None and batch <= last_batch:
                return None
            out.append(replace(made, run_id=next_run))
            return [out[0], *runs], next_run + 1, last_batch if batch is None else batch

        self._commit(add)
        return out[0] if out else None

    def compact(self, drop_tombstones: bool = True) -> dict[str, object]:
        """Merge all runs into one. Up to one run: nothing happens. If nothing is left, there is no new
        run, and the inputs are obsolete all the same. Runs that others flush meanwhile stay."""
        return self._merge(self.runs(), drop_tombstones)

    def compact_tier(self, least: int = 4, ratio: float = 2.0) -> dict[str, object]:
        """Merge the newest runs as long as the next is no larger than ``ratio`` times all before it, if they are
        ``least`` or more: a row is rewritten about as often as the store doubles, not at every compaction.
        Tombstones go only when the oldest run is merged too."""
        runs, total, n = self.runs(), 0, 0
        while n < len(runs) and (n == 0 or runs[n].file_size <= ratio * total):
            total, n = total + runs[n].file_size, n + 1
        return self._merge(runs[:n] if n >= least else [], n == len(runs))

    def _merge(self, runs: list[RunMeta], drop_tombstones: bool) -> dict[str, object]:
        if len(runs) <= 1:
            return {"new_runs": [], "obsolete_runs": [], "input_entries": 0, "output_entries": 0}
        made = self._write_run(merge([self._read_runs([r]) for r in runs], drop_tombstones))
        old, out = {r.run_id for r in runs}, []

        def swap(now: list[RunMeta], next_run: int, last_batch: int):
            if not old <= {r.run_id for r in now}:
                raise RuntimeError("another writer has compacted these runs")
            out[:] = [replace(made, run_id=next_run)] if made else []
            return [*out, *[r for r in now if r.run_id not in old]], next_run + 1, last_batch

        self._commit(swap)
        return {
            "new_runs": [r.run_id for r in out],
            "obsolete_runs": [r.run_id for r in runs],
            "input_entries": sum(r.num_entries for r in runs),
            "output_entries": made.num_entries if made else 0,
        }

    def delete_run(self, run_id: int) -> None:
        """Take a run out; an unknown id is an error."""

        def drop(runs: list[RunMeta], next_run: int, last_batch: int):
            if run_id not in {r.run_id for r in runs}:
                raise FileNotFoundError(f"{self.root}: run {run_id}")
            return [r for r in runs if r.run_id != run_id], next_run, last_batch

        self._commit(drop)

    def vacuum(self, older_than: float = 3600.0) -> list[str]:
        """Delete run folders that the manifest does not list and that were last changed over ``older_than`` seconds ago (younger
        ones may belong to a writer, or to readers of an earlier version); returns their names."""
        live, folder = {r.folder for r in self.runs()}, self._path("data")
        found = list(self._fs().listStatus(folder)) if self._fs().exists(folder) else []
        limit = (time.time() - older_than) * 1000
        dead = sorted(s.getPath().getName() for s in found if s.getPath().getName() not in live and s.getModificationTime() <= limit)
        for name in dead:
            self._fs().delete(self._path("data", name), True)
        return dead

    # --- reads -------------------------------------------------------------------------------
    def exists(self, run_id: int) -> bool:
        return any(r.run_id == run_id and self._fs().exists(self._path("data", r.folder)) for r in self.runs())

    def _read_runs(self, runs: list[RunMeta]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._opened(self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{r.folder}" for r in runs]))

    def read_run(self, run_id: int) -> DataFrame:
        return self._read_runs([self._run(run_id)])

    def read(self, key: object | None = None, as_of: int | None = None, within: tuple[object, object] | None = None) -> DataFrame:
        """The log over all runs, as of the manifest's newest version. With a key, a range of keys (``within``: the first and the
        last) or a seqno limit, runs whose ranges exclude them are not opened, and the predicates reach the scans of the others."""
        return restricted(self._read_runs([r for r in self.runs() if may_hold(r, key, as_of, within)]), key, as_of, within)

    # --- inspection --------------------------------------------------------------------------
    def file_count(self) -> int:
        return len(self.runs())

    def total_bytes(self) -> int:
        return sum(r.file_size for r in self.runs())

    def file_ids(self) -> list[int]:
        return sorted(r.run_id for r in self.runs())

    def rebuild_manifest(self) -> list[RunMeta]:
        """Manifest rows made anew from the runs' files, for a check or after its loss."""
        out = []
        for r in self.runs():
            m = self.read_run(r.run_id).agg(F.count(F.lit(1)), F.min("seqno"), F.max("seqno"), F.min("user_key"), F.max("user_key")).first()
            out.append(RunMeta(r.run_id, m[0], m[1], m[2], m[3], m[4], r.file_size, r.folder))
        return out
