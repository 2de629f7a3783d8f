"""Document fingerprints: one-permutation MinHash (DataFrame functions only).

A text's distinct five-word shingles are hashed once; the top bits of a hash choose one of 256
bins, and each bin keeps its smallest hash. Empty bins are filled by optimal densification: bin i
tries bins in an order of its own, drawn by a hash of (bin, bin tried), and takes the first that has a hash, so
each empty bin draws its own donor (mixed with i, so that chance agreements
stay independent). The low 4 bits of each bin's hash are packed: 16 longs, 256 hexadecimal digits as text. The likeness of two fingerprints is the
share of equal bins, corrected for the 1 in 16 that are equal by chance.

Bins are found by sorting the hashes together with a largest value for each bin and taking the
first of each bin, so one array of 256 results with no loop over bins. The first twelve tries
are made in turn and stop at the first hit; texts so short that none hits take the filled bin whose hash
comes first, which is the same donor.

Null texts are as empty ones: no shingle, all digits 0; two empty texts have likeness 1, an empty
and another text 0. Texts with one to four words are one shingle. Words are taken as they are
(case kept). Repeated rows have equal fingerprints. Texts of any length are taken whole, an empty table
gives an empty result, and new columns get other names where the table has them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, words

BINS, BITS, WIDTH = 256, 4, 5
_SHIFT = 63 - 8  # hashes of 63 bits; the top 8 choose the bin
_LOW = (1 << _SHIFT) - 1
_TRIES = 12


_MASK = (1 << 31) - 1
_MULTIPLIERS = (0x5E3779B1, 0x45D9F3B)


def _place(pair):
    """Where bin j comes in the order in which bin i tries (pair: 256 i + j), as number or column; ties by j."""
    if isinstance(pair, Column):
        x = (pair * _long(_MULTIPLIERS[0])).bitwiseAND(_long(_MASK))
        x = (x.bitwiseXOR(F.shiftright(x, 15)) * _long(_MULTIPLIERS[1])).bitwiseAND(_long(_MASK))
        return x.bitwiseXOR(F.shiftright(x, 13))
    x = (pair * _MULTIPLIERS[0]) & _MASK
    x = ((x ^ (x >> 15)) * _MULTIPLIERS[1]) & _MASK
    return x ^ (x >> 13)


def _tries() -> list[list[int]]:
    """For each of the first tries the bin that every bin tries."""
    orders = [sorted((j for j in range(BINS) if j != i), key=lambda j: (_place(i * BINS + j), j)) for i in range(BINS)]
    return [[order[k] for order in orders] for k in range(_TRIES)]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array of 16 longs, null for a text without words."""
    t = {k: fresh(f"fp_{k}", [*df.columns, out]) for k in ("words", "first", "code", "held", "dense")}
    col = {k: F.col(v) for k, v in t.items()}
    df = df.withColumn(t["words"], F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size(col["words"])
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(col["words"], i + k) for k in range(WIDTH)]).bitwiseAND(_long((1 << 63) - 1)),
    )
    guards = F.array(*[_long((b << _SHIFT) | _LOW) for b in range(BINS)])
    df = df.withColumn(t["first"], F.when(n > 0, F.sort_array(F.concat(hashes, guards))))
    s = col["first"]
    firsts = F.filter(s, lambda x, j: (j == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, j - 1), _SHIFT)))
    empty = lambda x: x.bitwiseAND(_long(_LOW)) == _long(_LOW)
    df = df.withColumn(t["code"], F.transform(firsts, lambda x: F.when(~empty(x), x)))
    c = col["code"]
    df = df.withColumn(t["held"], F.filter(F.transform(c, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()))
    tried = [F.array(*[F.lit(j) for j in bins]) for bins in _tries()]

    def donor(x: Column, i: Column) -> Column:
        tries = [F.get(c, F.get(bins, i)) for bins in tried]
        order = lambda j: F.shiftleft(_place((i * BINS + j).cast("long")), 8).bitwiseOR(j.cast("long"))
        nearest = F.array_min(F.transform(col["held"], order)).bitwiseAND(_long(BINS - 1)).cast("int")
        # a copied hash is mixed with the bin, or the chance of equal digits would not be independent
        copied = F.xxhash64(F.coalesce(*tries, F.get(c, nearest)), i)
        return F.coalesce(x, copied).bitwiseAND(_long((1 << BITS) - 1)).cast("int")

    df = df.withColumn(t["dense"], F.transform(c, donor))
    per = 64 // BITS

    def packed(g: Column) -> Column:
        total = F.get(col["dense"], g * per).cast("long")
        for k in range(1, per):
            total = total.bitwiseOR(F.shiftleft(F.get(col["dense"], g * per + k).cast("long"), BITS * k))
        return total

    groups = F.sequence(F.lit(0), F.lit(BINS // per - 1))
    # a generator ends the chain: a filter on the result stays above it, where pushing it down would
    # put the whole chain into the filter many times over
    result = F.when(col["dense"].isNotNull(), F.transform(groups, packed))
    return df.withColumn(out, F.explode(F.array(result))).drop(*t.values())


def as_text(fp: Column) -> Column:
    """256 hexadecimal digits; zeros for a text without words."""
    digits = F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return F.coalesce(digits, F.lit("0" * (BINS * BITS // 4)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(_long(0x1111111111111111))).cast("int")

    wrong = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, x: acc + x)
    chance = 1.0 / (1 << BITS)
    share = (1 - wrong / F.lit(float(BINS)) - chance) / (1 - chance)
    both = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


@dataclass(frozen=True)
class NeighbourConfig:
    cells: int = 1024
    bucket_rows: int = 1000
    max_broadcast_buckets: int = 1_000_000


def _bucket(ids: DataFrame, order: str, cfg: NeighbourConfig) -> Column:
    """Number of the bucket of a row with doc_id and ``order`` (a hash that orders equal and null ids); buckets are in that order and
    hold about ``bucket_rows`` rows. Up to ``cells`` ranges of equal numbers of rows are found by one range partitioning of
    the ids; ranges of numbers that are still larger are divided by their width."""
    n = ids.count()
    if not n:
        return F.lit(0).cast("long")
    cells = min(cfg.cells, -(-n // cfg.bucket_rows))
    placed = ids.repartitionByRange(cells, F.col("doc_id").asc_nulls_first(), order).withColumn("cell", F.spark_partition_id())
    key = F.struct("doc_id", order)
    stats = placed.groupBy("cell").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    stats = sorted(stats.collect(), key=lambda r: r["cell"])  # at most ``cells`` rows
    kind = ids.schema["doc_id"].dataType
    edge = lambda r: F.struct(F.lit(r["first"][0]).cast(kind).alias("doc_id"), F.lit(r["first"][1]).cast("long").alias(order))
    below = lambda edges: F.size(F.filter(edges, lambda x: x <= key)) - 1
    chunks = [stats[i : i + 32] for i in range(0, len(stats), 32)]
    outer = F.greatest(below(F.array(*[edge(c[0]) for c in chunks])), F.lit(0))
    inner = F.get(F.array(*[F.array(*[edge(r) for r in c]) for c in chunks]), outer)
    cell = (outer * 32 + F.greatest(below(inner), F.lit(0))).cast("int")
    if not isinstance(kind, T.NumericType):
        return cell.cast("long")
    parts = [max(1, -(-r["n"] // cfg.bucket_rows)) for r in stats]
    lo = [float(r["lo"]) if r["lo"] is not None else 0.0 for r in stats]
    width = [max((float(r["hi"]) - x) / p, 1e-9) if r["hi"] is not None else 1.0 for r, x, p in zip(stats, lo, parts, strict=True)]
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), cell)
    part = F.least(F.floor((F.col("doc_id").cast("double") - at(lo)) / at(width)), at(parts) - 1)
    return cell.cast("long") * _long(1 << 32) + F.coalesce(F.greatest(part, F.lit(0)), F.lit(0))


def with_next(docs: DataFrame, carried: list[str], ids: DataFrame | None = None, cfg: NeighbourConfig = NeighbourConfig()) -> DataFrame:
    """``docs`` with ``next_<c>`` (or another name, where the table has that) for each carried column: its value in the row of the next
    doc_id (after the last: the first; null ids come first, equal ids in the order of a hash of the text, then of the text).
    ``ids``: a table with the same ids and texts that is cheaper to read, if there is one.

    A row goes to its bucket; the first row of a bucket goes also, as a guard, behind the last row
    of the bucket before. So one shuffle carries the texts and no task sees more than a bucket."""
    names = {c: fresh(f"nb_{c}", docs.columns) for c in ("bucket", "first", "before", "to", "guard", "order")}
    order = names["order"]
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    slim = materialize((docs if ids is None else ids).select("doc_id", tie.alias(order)), "fp-ids")
    bucket, key = _bucket(slim, order, cfg), F.struct("doc_id", order)
    firsts = slim.groupBy(bucket.alias("bucket")).agg(F.min(key).alias("first"))
    by = Window.orderBy("bucket")  # a row for each bucket
    firsts = firsts.withColumn("before", F.lag("bucket").over(by))
    last = F.max("bucket").over(Window.partitionBy())
    firsts = materialize(firsts.withColumn("before", F.coalesce("before", last)), "fp-buckets")
    table = firsts.select(*[F.col(c).alias(names[c]) for c in ("bucket", "first", "before")])
    if firsts.count() <= cfg.max_broadcast_buckets:
        table = F.broadcast(table)
    rows = docs.withColumn(order, tie).withColumn(names["bucket"], bucket).join(table, names["bucket"])
    is_first = F.col("doc_id").eqNullSafe(F.col(names["first"])["doc_id"]) & (F.col(order) == F.col(names["first"])[order])
    here = F.struct(F.col(names["bucket"]).alias("b"), F.lit(0).alias("g"))
    there = F.struct(F.col(names["before"]).alias("b"), F.lit(1).alias("g"))
    rows = rows.withColumn(names["to"], F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
    rows = rows.withColumn(names["guard"], F.col(names["to"])["g"]).withColumn(names["bucket"], F.col(names["to"])["b"])
    rows = rows.drop(names["to"], names["first"], names["before"])
    run = Window.partitionBy(names["bucket"]).orderBy(names["guard"], F.col("doc_id").asc_nulls_first(), order, "text")
    rows = rows.select("*", *[F.lead(c).over(run).alias(fresh(f"next_{c}", docs.columns)) for c in carried])
    return rows.where(F.col(names["guard"]) == 0).drop(names["guard"], names["bucket"], order)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (last quarter replaced by the beginning
    of the next document), with the likeness of neighbours."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "fp"), ["text", "fp"], ids=docs)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
