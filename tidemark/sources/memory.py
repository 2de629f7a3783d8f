"""Runs held as cached tables of the session, for tests and small stores. Same calls as RunStore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compaction import merge
from .runs import RunMeta, may_hold, restricted


class MemoryStore:
    def __init__(self, spark: SparkSession, key_type: str = "binary"):
        self.spark = spark
        self.schema = T._parse_datatype_string(f"user_key {key_type}, seqno long, value_type int, value {key_type}")
        self._tables: dict[int, DataFrame] = {}
        self._meta: dict[int, RunMeta] = {}
        self._next, self._batch = 1, -1

    def last_batch(self) -> int:
        """The stream batch that was flushed last; -1 if there is none."""
        return self._batch

    def runs(self) -> list[RunMeta]:
        return [self._meta[i] for i in sorted(self._meta, reverse=True)]

    def manifest(self) -> DataFrame:
        key = self.schema["user_key"].dataType.simpleString()
        shape = f"run_id long, num_entries long, min_seqno long, max_seqno long, first_key {key}, last_key {key}, file_size long"
        return self.spark.createDataFrame([tuple(vars(r).values())[:-1] for r in self.runs()], shape)

    def _put(self, rows: DataFrame) -> RunMeta | None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).persist()
        size = F.sum(F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 15)
        m = rows.agg(F.count(F.lit(1)), F.min("seqno"), F.max("seqno"), F.min("user_key"), F.max("user_key"), size).first()
        if not m[0]:
            rows.unpersist()
            return None
        meta = RunMeta(self._next, *m)  # file_size: bytes of the entries
        self._tables[self._next], self._meta[self._next] = rows, meta
        self._next += 1
        return meta

    def flush(self, rows: DataFrame, batch: int | None = None) -> RunMeta | None:
        if batch is not None and batch <= self._batch:
            return None
        meta = self._put(rows)
        if meta is None:
            raise ValueError("nothing to write: the table is empty")
        self._batch = self._batch if batch is None else batch
        return meta

    def compact(self, drop_tombstones: bool = True) -> dict[str, object]:
        runs = self.runs()
        if len(runs) <= 1:
            return {"new_runs": [], "obsolete_runs": [], "input_entries": 0, "output_entries": 0}
        meta = self._put(merge([self._tables[r.run_id] for r in runs], drop_tombstones))
        for r in runs:
            self.delete_run(r.run_id)
        return {
            "new_runs": [meta.run_id] if meta else [],
            "obsolete_runs": [r.run_id for r in runs],
            "input_entries": sum(r.num_entries for r in runs),
            "output_entries": meta.num_entries if meta else 0,
        }

    def compact_tier(self, least: int = 4, ratio: float = 2.0) -> dict[str, object]:
        """Runs in memory are merged all at once."""
        return self.compact() if len(self._meta) >= least else {"new_runs": [], "obsolete_runs": [], "input_entries": 0, "output_entries": 0}

    def delete_run(self, run_id: int) -> None:
        if run_id not in self._tables:
            raise FileNotFoundError(f"run {run_id}")
        self._tables.pop(run_id).unpersist()
        del self._meta[run_id]

    def exists(self, run_id: int) -> bool:
        return run_id in self._tables

    def read_run(self, run_id: int) -> DataFrame:
        if run_id not in self._tables:
            raise FileNotFoundError(f"run {run_id}")
        return self._tables[run_id]

    def read(self, key: object | None = None, as_of: int | None = None, within: tuple[object, object] | None = None) -> DataFrame:
        log = self.spark.createDataFrame([], self.schema)
        for r in self.runs():
            if may_hold(r, key, as_of, within):
                log = log.unionByName(self._tables[r.run_id])
        return restricted(log, key, as_of, within)

    def file_count(self) -> int:
        return len(self._meta)

    def total_bytes(self) -> int:
        return sum(r.file_size for r in self._meta.values())

    def file_ids(self) -> list[int]:
        return sorted(self._meta)
