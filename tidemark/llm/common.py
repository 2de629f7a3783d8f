"""Shared pieces: word definition, hold-out folds, training samples, shared folder, batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_area: ContextVar[str | None] = ContextVar("work_area", default=None)


@contextmanager
def work_area(spark: SparkSession, name: str) -> Iterator[None]:
    """Work tables made inside lie in a folder of their own, which is deleted at the end: results must be
    written elsewhere (``write_out``) before."""
    path = shared_dir(spark, name)
    token = _area.set(path)
    try:
        yield
    finally:
        _area.reset(token)
        delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, where that is
    unset and driver and executors are one process, under a temporary folder. On a cluster without
    the setting: RuntimeError, as executors would write to their own disks."""
    base = _area.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return write_out(df, shared_dir(df.sparkSession, name))


def write_out(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def uniform(seed: str, key: Column) -> Column:
    """52-bit hash of seed and key in (0, 1)."""
    hexa = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(hexa, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def passage(text: Column, room: int) -> Column:
    """``text``, or of a longer one ``room`` characters, which begin where a hash of the text says."""
    spare = F.length(text) - F.lit(room)
    begin = F.when(spare > 0, F.pmod(F.crc32(text.cast("binary")), spare + 1)).otherwise(F.lit(0)).cast("int")
    return F.substring(text, begin + 1, F.lit(room))


def labelled_sample(
    docs: DataFrame, label: DataFrame, label_col: str, train: Column, per_class: int, max_chars: int
) -> list[tuple[str, object]]:
    """At most ``per_class`` (text, label) rows of each of the labels 0 and 1 with ``train`` true, of documents
    that are there with a text; which ones is decided by a hash of the id. Of a text over ``max_chars``
    characters a passage is taken. An id that is labelled both ways is not used; of several texts of
    an id the smallest in code point order is."""
    there = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    y = label.select(F.col("doc_id").alias("_id"), F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1)).where(train)
    y = y.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_other")).where("_y = _other")
    y = y.join(there.select("_id"), "_id", "left_semi").select("_id", "_y", F.xxhash64("_id").alias("_h"))
    best = [y.where(F.col("_y") == v).orderBy("_h", "_id").limit(per_class) for v in (0, 1)]
    keep = F.broadcast(best[0].unionByName(best[1]))  # at most 2 * per_class rows
    found = there.join(keep, "_id").select("_id", "_y", "_h", passage(F.col("_text"), max_chars).alias("_text"))
    rows = found.groupBy("_id", "_y", "_h").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: (r["_h"], str(r["_id"])))
    return [(r["_text"], r["_y"]) for r in rows]


def label_share(label: DataFrame, label_col: str, train: Column) -> float | None:
    """Share of label 1 among all labelled rows with ``train`` true (None without such rows)."""
    y = label.select(F.col("doc_id").alias("_id"), F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1)).where(train)
    ones, n = y.agg(F.sum("_y"), F.count(F.lit(1))).first()
    return ones / n if n else None


def prior_shift(share: float | None, ones: int, zeros: int) -> float:
    """What a logit learned on ``ones`` and ``zeros`` rows needs to hold where label 1 has ``share``."""
    if share is None or not 0 < share < 1 or not ones or not zeros:
        return 0.0
    return float(np.log(share / (1 - share)) - np.log(ones / zeros))


def text_chunks(batch: pa.RecordBatch, column: str, max_chars: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with at most ``max_chars`` characters of text each (a longer single text
    stands alone), with the texts as strings; null becomes empty."""
    texts = [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > max_chars:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(x)
    if len(texts) > start:
        yield batch.slice(start), texts[start:]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton steps for L2-regularised logistic regression; the last weight is the intercept."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    reg = np.full(a.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) + reg * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(reg)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores put before it until no column has it (names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
