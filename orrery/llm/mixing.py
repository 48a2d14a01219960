"""Mixing sources to target weights.

The words of each source are summed, and the sources share the mix by weight: a target that
would take a source more often than ``most`` times stops there, and what it leaves is shared
by weight among the others, until none is above. A source's rate is its target over its
size. Each document comes floor(rate) times, and once more if its draw, a hash of the seed, its id
and its text, lies below the rate's fraction.

DataFrame functions only. Texts are read to be counted and hashed and are not shuffled;
sources are summed before they travel, and meet their documents by a broadcast if they are few
and in salted groups if not. Targets need one row a round on the driver, whatever the
number of sources.

Edge cases: a null text has no words; null is a source, the last one; a source without
words has the target 0 and rate 0; rows that repeat an id and a text share their draw, and so
do rows without either; with a ``share`` above ``most`` every source stops at ``most``; an empty
table gives an empty result; other columns, whatever their names, are carried along by
``mix`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import SMALL_SIDE_ROWS
from ..operators.quantiles import looked_up, ranked
from .shared import cut, fresh, written

#: Fixed values of the dealt mix.
WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 42
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) of 52 bits that the seed, the id and the text settle."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``key, source_size, weight, target, rate`` of rows ``key, size``; weights go round the sources by code point, null last."""
    sums = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    placed = ranked(sums, [], [F.col("key") == "", F.col("key")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(placed.select("key", "source_size", weight.alias("weight")))
    ceiling = F.col("source_size") * F.lit(float(most))
    total, rest = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, stopped = share * (total or 0), 0.0, -1
    now, taken = 0, 0.0
    while rest and now != stopped:
        stopped, level = now, (budget - taken) / rest
        above = F.col("weight") * level > ceiling
        now, taken, rest = sources.agg(F.count_if(above), F.sum(F.when(above, ceiling).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
    wanted = F.col("weight") * F.lit(level)
    target = ceiling if not rest else F.when(wanted > ceiling, ceiling).otherwise(wanted)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("rate", rate)


def with_rates(rows: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their source's rates; a source may hold any share of them."""
    rates = rates.withColumnRenamed("key", key)
    if rates.limit(SMALL_SIDE_ROWS + 1).count() <= SMALL_SIDE_ROWS:
        return rows.join(F.broadcast(rates), key)
    return looked_up(rows, rates, [key])


def copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("int")).cast("int")


def mixture(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies``, one row for each input row."""
    number, text, source = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    narrow = docs.select(number.cast("long").alias("doc_id"), source.cast("string").alias("source"), source_key(source).alias("key"), words(text).alias("size"), draw(number, text, seed).alias("drawn"))
    narrow = written(narrow, "sizes")
    placed = with_rates(narrow, source_rates(narrow, weights, share, most), "key")
    return placed.select("doc_id", "source", "size", "source_size", "target", "rate", copies(F.col("rate"), F.col("drawn")).alias("copies"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns as they were."""
    number, text, source = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    key, often = fresh(docs, "key", "copy")
    sizes = written(docs.select(source_key(source).alias("key"), words(text).alias("size")), "sizes")
    rates = source_rates(sizes, weights, share, most).select("key", "rate")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), draw(number, text, seed).alias("drawn"), source_key(source).alias(key))
    taken = with_rates(held, rates, key).withColumn(often, copies(F.col("rate"), F.col("drawn")))
    return taken.filter(F.col(often) > 0).withColumn(often, F.explode(F.sequence(F.lit(1), F.col(often)))).select("row.*")
