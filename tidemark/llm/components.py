"""Connected components of a distributed list of links, by alternating stars.

Large star: every vertex links its larger neighbours to the smallest vertex among itself and its
neighbours. Small star: every vertex links itself and its smaller neighbours to the smallest of
them. Both keep the components; in turn they halve the lengths of paths, so that a chain of n links
takes about log n rounds, in whatever order its vertices stand, and what is left are stars around the smallest
vertices. Rounds go on until nothing changes. Every step is written to the shared folder, so lost
executors cost a stage only. Nothing is collected but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _ordered(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    least = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("m"))
    larger = edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
    return larger.join(least, "v").where(F.col("w") != F.col("m")).select(*_ordered("w", "m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where(F.col("a") != F.col("m")).select(*_ordered("a", "m"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex in ``links``; component is its smallest vertex.
    Null ends are ignored; loops, repeats and an empty table are fine."""
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    alone = links.where("a = b").select("a").distinct()
    edges = materialize(links.where("a != b").select(*_ordered("a", "b")).distinct(), "cc-links")
    before = None
    while (now := _checksum(edges)) != before:
        before = now
        edges = materialize(_small_star(materialize(_large_star(edges), "cc-large")), "cc-small")
    inner = edges.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
    heads = edges.select(F.col("a").alias("vertex")).distinct().unionByName(alone.select(F.col("a").alias("vertex"))).distinct()
    heads = heads.join(inner.select("vertex"), "vertex", "left_anti")
    return inner.unionByName(heads.select("vertex", F.col("vertex").alias("component")))
