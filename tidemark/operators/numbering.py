"""Dense numbers for the rows of a distributed table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fresh


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (spark.checkpoint.dir; where that is unset and both are
    one process, a temporary folder; otherwise an error)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list[str | Column], start: int = 0, name: str = "n") -> DataFrame:
    """``df`` with start, start + 1, ... in the order of columns ``order``.

    The sorted table is written once, its parts are counted, and each row gets its place in its part plus
    the rows of the parts before; no task sees more than its part (one row a part reaches the driver)."""
    path, mark = scratch(df.sparkSession, "numbered"), fresh("row_mark", df.columns)
    marked = df.orderBy(*order).withColumn(mark, F.monotonically_increasing_id())
    marked.write.parquet(path)
    rows = df.sparkSession.read.schema(marked.schema).parquet(path)
    part, inner = F.shiftrightunsigned(mark, 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("part")).count().collect())
    offsets, total = [], start
    for p, n in counts:
        offsets.append((p, total))
        total += n
    by = fresh("part", rows.columns)
    table = df.sparkSession.createDataFrame(offsets, f"{by} long, {by}_offset long")
    return rows.withColumn(by, part).join(F.broadcast(table), by).withColumn(name, F.col(f"{by}_offset") + inner).drop(by, f"{by}_offset", mark)
