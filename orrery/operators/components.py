"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import ready

SALTS = 64


def _cut(df: DataFrame) -> DataFrame:
    ready(df.sparkSession)
    return df.checkpoint()


def with_least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: each edge with the least ``v`` of its ``u``.

    A vertex may own a third of the edges, so they meet in salted groups; a window sees one row for
    each salt that a vertex has.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    some = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = some.select("u", "salt", F.min("m").over(Window.partitionBy("u")).alias("m"))
    return salted.join(least, ["u", "salt"]).drop("salt")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    small = with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return small.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every vertex of the edges ``u, v`` between different vertices; the component is its smallest vertex.

    Vertices are of any type that has an order. Every step is a keyed aggregation or join of edges; lineage is
    cut in each round and the driver sees two numbers a round.
    """
    now = _cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before, seen = None, sign(now)
    while before != seen:
        now = _cut(_round(now))
        before, seen = seen, sign(now)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
