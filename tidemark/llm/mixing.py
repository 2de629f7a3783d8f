"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sources get word targets: ``budget`` times all words, shared by weight; a target stops at
``max_repeat`` times its source's words and the excess is shared again by weight (water-filling,
solved in closed form over the sources ordered by capacity per weight).

Inside a source documents are not equally likely: a document of n words is wanted ``c`` times,
``c = min(max_repeat, level * n ** (1/4))``, so longer documents come more often, and the source's level is
such that the copies wanted make up its target (closed form over the source's distinct sizes). The
whole part of c is allocated as certain copies, the rest p is the document's inclusion probability.
Documents are ranked by (random odds) / (inclusion odds), ``(u / (1 - u)) / (p / (1 - p))``, and the smallest
ranks are taken until the words taken come nearest to the words wanted, so the sample's size is fixed.
c is rounded to 1e-9, so that a rounding error does not decide on a whole copy.

The cut in the ranking is found without sorting a source: word sums over 1024 buckets of the
rank, then over 1024 sub-buckets of the bucket that holds the cut, then over the ranks in that
sub-bucket (a millionth of the source). Documents are then kept or not by comparing with their
source's cut: no shuffle of texts, and a hot source is as parallel as any other.

u is a hash of seed and doc_id, so reruns agree. Null texts have no words; a null source is a
source of its own, last in order. Documents without words follow their rank. Rows with equal
doc_id and size in one source are taken or left together. Sources without words, and empty tables, have
target 0 and none of their documents is taken; a document without words in another source counts as one
word in its odds. Columns of ``docs`` may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, uniform, words

_FINE = 1024


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (3, 1, 2)  # by source in code point order, repeating
    budget_percent: int = 150
    max_repeat: int = 2
    seed: str = "mix"
    max_broadcast_sources: int = 100_000
    scale: int = 1_000_000_000  # copies wanted are rounded to one part of this


def _rank(u: Column, p: Column) -> Column:
    """Pareto rank q = (u / (1 - u)) / (p / (1 - p)), mapped to q / (1 + q): same order, in (0, 1]."""
    a, b = u * (1 - p), p * (1 - u)
    return a / (a + b)


def _measure(size: Column) -> Column:
    """Inclusion grows with the fourth root of a document's size (of one word at least)."""
    return F.sqrt(F.sqrt(F.greatest(size, F.lit(1)).cast("double")))


def wanted_copies(size: Column, level: Column, cfg: MixConfig = MixConfig()) -> tuple[Column, Column]:
    """(certain copies, inclusion probability of one more) of a document; a null level: ``max_repeat`` copies."""
    c = F.least(F.coalesce(level * _measure(size), F.lit(float(cfg.max_repeat))), F.lit(float(cfg.max_repeat)))
    c = F.floor(c * F.lit(float(cfg.scale)) + F.lit(0.5)) / F.lit(float(cfg.scale))
    return F.floor(c).cast("int"), c - F.floor(c)


def targets(sizes: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """Per source: source_size, target, level, wanted (words by sampling)."""
    groups = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.withColumn("words", F.col("n") * F.col("size")), "mix-sizes-of-sources")
    per = groups.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source from here on
    wheel = F.array(*[F.lit(float(w)) for w in cfg.weights])
    per = per.withColumn("weight", F.get(wheel, ((F.row_number().over(order) - 1) % len(cfg.weights)).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * cfg.max_repeat).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(cfg.budget_percent) / F.lit(100.0)
    per = per.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    whole_table = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole_table))
    per = per.withColumn("target", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("cap")))
    per = materialize(per.select("source", "source_size", "target"), "mix-sources")
    # the level of each source: its largest documents stop at max_repeat copies, the others share the rest
    by_size = Window.partitionBy("source").orderBy(F.desc("size"))  # a row for each distinct size
    larger, others = by_size.rowsBetween(Window.unboundedPreceding, -1), by_size.rowsBetween(0, Window.unboundedFollowing)
    rows = _with_source(groups, _small(per, cfg), "source", ["target"])
    rest = F.col("target") - cfg.max_repeat * F.coalesce(F.sum("words").over(larger), F.lit(0))
    rows = rows.withColumn("level", rest / F.nullif(F.sum(F.col("words") * _measure(F.col("size"))).over(others), F.lit(0.0)))
    fits = rows.where(F.col("level") * _measure(F.col("size")) < cfg.max_repeat)
    level = materialize(fits.groupBy("source").agg(F.max_by("level", "size").alias("level")), "mix-levels")
    # no size fits: every document comes max_repeat times (level null), or there is no word
    leveled = _with_source(per, _small(level, cfg), "source", ["level"])
    leveled = leveled.withColumn("level", F.when(F.col("source_size") > 0, F.col("level")).otherwise(F.lit(0.0)))
    certain = _with_source(groups, _small(materialize(leveled, "mix-levels"), cfg), "source", ["source_size", "target", "level"])
    whole = wanted_copies(F.col("size"), F.col("level"), cfg)[0]
    out = certain.groupBy("source", "source_size", "target", "level").agg(F.sum(whole * F.col("words")).alias("certain"))
    return out.select("source", "source_size", "target", "level", (F.col("target") - F.col("certain")).alias("wanted"))


def _small(df: DataFrame, cfg: MixConfig) -> DataFrame:
    """A table of a row a source, marked for broadcast when its counted size allows."""
    return F.broadcast(df) if df.count() <= cfg.max_broadcast_sources else df


def _with_source(docs: DataFrame, plan: DataFrame, source: str, columns: list[str]) -> DataFrame:
    key = fresh("plan_source", docs.columns)
    return docs.join(plan.select(F.col("source").alias(key), *columns), F.col(source).eqNullSafe(F.col(key)), "left").drop(key)


def cuts(sizes: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """``targets`` with low and cut: a document of rank v is taken if v < low or v <= cut."""
    plan = materialize(targets(sizes, cfg), "mix-targets")
    small = _small(plan, cfg)
    ranked = _with_source(sizes, small, "source", ["level", "wanted"]).withColumn("p", wanted_copies(F.col("size"), F.col("level"), cfg)[1])
    ranked = ranked.where("p > 0").withColumn("v", _rank(uniform(cfg.seed, F.col("doc_id")), F.col("p")))
    ranked = ranked.withColumn("b1", F.least(F.floor(F.col("v") * _FINE), F.lit(_FINE - 1)).cast("int"))
    ranked = ranked.withColumn("b2", F.least(F.floor(F.col("v") * _FINE * _FINE) - F.col("b1") * _FINE, F.lit(_FINE - 1)).cast("int"))

    def crossing(table: DataFrame, bucket: str, base: Column) -> DataFrame:
        """The first bucket of each source whose running sum reaches what is wanted."""
        run = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        sums = table.groupBy("source", "wanted", "base", bucket).agg(F.sum("size").alias("words")) if "base" in table.columns else table.groupBy("source", "wanted", bucket).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(run) + base)
        hit = sums.where("upto >= wanted").groupBy("source", "wanted")
        return hit.agg(F.min(bucket).alias(bucket), F.min_by(F.col("upto") - F.col("words"), bucket).alias("base"))

    first = _small(materialize(crossing(ranked, "b1", F.lit(0)), "mix-cut1"), cfg)
    at = _with_source(ranked.withColumnRenamed("b1", "bucket1"), first, "source", ["b1", "base"]).where(F.col("bucket1") == F.col("b1"))
    second = _small(materialize(crossing(at, "b2", F.col("base")), "mix-cut2"), cfg)
    inner = _with_source(at.drop("base").withColumnRenamed("b2", "bucket2"), second, "source", ["b2", "base"]).where(F.col("bucket2") == F.col("b2"))
    same = inner.groupBy("source", "wanted", "b1", "b2", "base", "v").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("take", F.col("base") + F.sum("words").over(run) - F.col("words") / 2.0 < F.col("wanted"))
    cut = same.groupBy("source").agg(
        F.max(F.when(F.col("take"), F.col("v"))).alias("cut"),
        F.max((F.col("b1") * _FINE + F.col("b2")).cast("double") / F.lit(float(_FINE * _FINE))).alias("low"),
    )
    cut = materialize(cut, "mix-cut3")
    # no crossing: all that can be taken is wanted (only by rounding), or nothing is
    joined = _with_source(plan, _small(cut, cfg), "source", ["cut", "low"])
    low = F.when(F.col("wanted") <= 0, 0.0).otherwise(F.coalesce("low", F.lit(2.0)))
    return materialize(joined.withColumn("low", low).withColumn("cut", F.coalesce("cut", F.lit(-1.0))), "mix-plan")


def copies(docs: DataFrame, plan: DataFrame, cfg: MixConfig = MixConfig(), out_col: str = "copies", size: str = "size") -> DataFrame:
    """``docs`` (with ``size``: its column of words) with the number of copies that the mix takes of each row."""
    names = {c: fresh(f"mix_{c}", docs.columns) for c in ("level", "cut", "low")}
    table = _small(plan, cfg).select("source", *[F.col(c).alias(n) for c, n in names.items()])
    joined = _with_source(docs, table, "source", list(names.values()))
    level, cut, low = (F.col(n) for n in names.values())
    whole, p = wanted_copies(F.col(size), level, cfg)
    v = _rank(uniform(cfg.seed, F.col("doc_id")), p)
    extra = F.when((p > 0) & ((v < low) | (v <= cut)), 1).otherwise(0)
    return joined.withColumn(out_col, (whole + extra).cast("int")).drop(*names.values())


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size in words), written out: texts are split once."""
    return materialize(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "mix-sizes")


def mix(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with their columns."""
    name = fresh("copies", docs.columns)
    one = fresh("copy_no", docs.columns)
    size = fresh("mix_size", docs.columns)
    counted = docs.withColumn(size, F.size(words(F.col("text"))).cast("long"))
    taken = copies(counted, cuts(sizes_of(docs), cfg), cfg, name, size)
    return taken.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(name)))).select(*docs.columns)


def mix_report(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken words."""
    sizes = sizes_of(docs)
    plan = cuts(sizes, cfg)
    report = _with_source(copies(sizes, plan, cfg), _small(plan, cfg), "source", ["source_size", "target"])
    return report.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
