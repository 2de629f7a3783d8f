"""Packing into optimal length buckets.

The global histogram of lengths is made by one aggregation; a dynamic program over it chooses
the bucket boundaries that minimise padding (every document is padded to its bucket's upper
boundary). Batches of a token budget form inside each bucket: a batch holds
``budget // boundary`` documents, one at least.

The histogram has a row for each distinct length, so it is bounded by the longest text, not by the
number of texts; the program is exact on it. Its cost is monotone (the best start of a bucket does not
decrease with its end), so every step halves ranges and takes n log n for n distinct lengths.

Positions in a bucket are global although no task sees a whole bucket: rows are ordered by a hash of
doc_id, dealt to streams of about ``stream_rows`` by ranges of it, numbered inside streams, and offset by
the sizes of the streams before. So every batch but a bucket's last is full, and a hot length is spread.

Null and empty texts have length 0 and form the bucket of boundary 0, ``budget`` documents a
batch. Documents over the budget get batches of their own. Repeated rows are packed as often as
they come. Order is by a hash of doc_id (of the text where it is null), ties by doc_id and length. An
empty table gives an empty result. Columns of ``docs`` that have the name of a result are put under another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, uniform, words


@dataclass(frozen=True)
class PackConfig:
    buckets: int = 16
    budget: int = 65_536
    stream_rows: int = 10_000
    seed: str = "pack"


def choose_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least total padding. ``lengths``
    are distinct and ascending. Ties: fewer buckets, then smaller boundaries."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(lengths)
    if n == 0:
        return []
    docs, toks = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    edge = np.r_[0, lengths]

    def best(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each end j = 1..n of a last bucket the least padding and the smallest start i that gives it;
        ``prev[i]``: the least padding of the lengths before i. Middles of all ranges of a level at once."""
        cur, arg = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        lo, hi, first, last = (np.array([x], np.int64) for x in (1, n, 0, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            stop = np.minimum(last, mid - 1)
            width = stop - first + 1
            begin = np.cumsum(width) - width
            i = np.arange(int(width.sum())) - np.repeat(begin, width) + np.repeat(first, width)
            j = np.repeat(mid, width)
            cost = prev[i] + edge[j] * (docs[j] - docs[i]) - (toks[j] - toks[i])
            least = np.minimum.reduceat(cost, begin)
            where = np.flatnonzero(cost == np.repeat(least, width))
            at = where[np.searchsorted(where, begin)]  # the first of each range
            cur[mid], arg[mid] = least, i[at]
            left, right = lo < mid, mid < hi
            lo, hi = np.r_[lo[left], mid[right] + 1], np.r_[mid[left] - 1, hi[right]]
            first, last = np.r_[first[left], i[at][right]], np.r_[i[at][left], last[right]]
        return cur, arg

    table = np.full(n + 1, 0, np.int64)
    table[1:] = lengths * docs[1:] - toks[1:]  # one bucket, for each end j = 1..n
    tables, back = [table], [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        cur, arg = best(tables[-1])
        tables.append(cur)
        back.append(arg)
    k = int(np.argmin([t[n] for t in tables]))
    out, j = [], n
    while j > 0:
        out.append(int(lengths[j - 1]))
        j = int(back[k][j]) if k else 0
        k -= 1
    return out[::-1]


def pack(docs: DataFrame, cfg: PackConfig = PackConfig(), length: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: its ``columns`` (by default all), length, bucket, boundary, batch, slot, padding.
    ``length`` is a column expression; by default the number of words. Rows are moved once, with their columns, so a batch's
    documents lie together; without the text (``columns=["doc_id"]``) only numbers are moved."""
    size = F.size(words(F.col("text"))).cast("long") if length is None else length.cast("long")
    columns = docs.columns if columns is None else columns
    t = {k: fresh(k, columns) for k in ("length", "bucket", "boundary", "batch", "slot", "padding", "u", "stream", "rank", "offset")}
    c = {k: F.col(v) for k, v in t.items()}
    by = uniform(cfg.seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))))
    # a generator keeps the count of words from being repeated in every expression above it
    both = F.explode(F.array(F.struct(F.coalesce(size, F.lit(0)).alias("length"), by.alias("u"))))
    made = fresh("made", columns)
    rows = docs.select(*columns, both.alias(made)).select(*columns, F.col(made)["length"].alias(t["length"]), F.col(made)["u"].alias(t["u"]))
    if "text" not in columns:
        rows = materialize(rows, "pack-lengths")  # numbers only: texts are read once
    histogram = rows.groupBy(c["length"]).count().collect()  # a row for each distinct length
    count = {r[0]: r[1] for r in histogram}
    zero, rest = count.pop(0, 0), sorted(count)
    edges = choose_boundaries(np.array(rest, np.int64), np.array([count[x] for x in rest], np.int64), cfg.buckets)
    if zero or not edges:
        edges = [0, *edges]
    members = [0] * len(edges)
    for x, n in [(0, zero), *count.items()]:
        members[int(np.searchsorted(edges, x))] += n
    streams = [max(1, -(-n // cfg.stream_rows)) for n in members]

    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    bucket = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        bucket = F.when(c["length"] <= edges[i], i).otherwise(bucket)
    rows = rows.withColumn(t["bucket"], bucket.cast("int"))
    # streams are ranges of the hash by which a bucket is ordered
    rows = rows.withColumn(t["stream"], F.floor(c["u"] * at(streams, c["bucket"])))
    sums = Window.partitionBy(t["bucket"]).orderBy(t["stream"]).rowsBetween(Window.unboundedPreceding, -1)
    sized = materialize(rows.groupBy(t["bucket"], t["stream"]).count(), "pack-streams")
    offsets = sized.withColumn(t["offset"], F.coalesce(F.sum("count").over(sums), F.lit(0))).drop("count")
    if sum(streams) <= 100_000:  # counted
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(t["bucket"], t["stream"]).orderBy(t["u"], "doc_id", t["length"])
    rows = rows.withColumn(t["rank"], F.row_number().over(inside)).join(offsets, [t["bucket"], t["stream"]])
    position = c["offset"] + c["rank"] - 1
    room = at([max(1, cfg.budget // max(1, e)) for e in edges], c["bucket"]).cast("long")
    boundary = at(edges, c["bucket"]).cast("long")
    return rows.select(
        *columns,
        t["length"],
        t["bucket"],
        boundary.alias(t["boundary"]),
        F.floor(position / room).cast("long").alias(t["batch"]),
        F.pmod(position, room).cast("int").alias(t["slot"]),
        (boundary - c["length"]).alias(t["padding"]),
    )
