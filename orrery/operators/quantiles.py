"""Exact percentiles, ranks and lookups for keys of any size: no task or buffer holds the rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import ready

SALTS = 64
#: Buckets of values that tasks may be told of.
FEW = 50_000


def key_of(keys: list[str]) -> Column:
    """The keys as one column, in which nulls are equal: rows of several grains meet by it."""
    return F.struct(*(keys or [F.lit(0).alias("all")]))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, levels: list[float], discrete: bool = False) -> DataFrame:
    """``keys, level, quantile``: interpolated (or ``discrete``) percentiles of the values that are not null.

    Distinct values are counted (a hot value is one row), dealt into ranges of ``keys, value``
    and written once. Each range's total per key gives the rank at which it begins; of a
    range only the values at the wanted ranks travel on. A task holds one range.
    """
    ready(rows.sparkSession)
    counted = rows.select(key_of(keys).alias("__key"), F.col(value).alias("__v")).filter(F.col("__v").isNotNull()).groupBy("__key", "__v").agg(F.count("*").alias("__n"))
    ranged = counted.repartitionByRange("__key", "__v").withColumn("__range", F.spark_partition_id()).checkpoint()

    totals = ranged.groupBy("__key", "__range").agg(F.sum("__n").alias("__total"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__first", F.coalesce(F.sum("__total").over(before), F.lit(0))).withColumn("__of", F.sum("__total").over(Window.partitionBy("__key")))

    place = F.greatest(F.lit(0.0), F.ceil(F.col("level") * F.col("__of")) - 1.0) if discrete else F.col("level") * (F.col("__of") - 1)
    wanted = totals.withColumn("level", F.explode(F.array(*[F.lit(float(p)) for p in levels])))
    low, part = F.floor(place), place - F.floor(place)
    ends = F.array(F.struct(low.alias("rank"), (1 - part).alias("weight")), F.struct((low + 1).alias("rank"), part.alias("weight")))
    wanted = wanted.withColumn("__e", F.explode(ends)).filter((F.col("__e.weight") > 0) & (F.col("__e.rank") >= F.col("__first")) & (F.col("__e.rank") < F.col("__first") + F.col("__total")))
    wanted = wanted.select("__key", "__range", "level", (F.col("__e.rank") - F.col("__first")).alias("__rank"), F.col("__e.weight").alias("__weight"))

    upto = F.sum("__n").over(Window.partitionBy("__key", "__range").orderBy("__v"))
    placed = ranged.join(wanted.select("__key", "__range").distinct(), ["__key", "__range"], "left_semi").withColumn("__upto", upto)
    hit = placed.join(wanted, ["__key", "__range"]).filter((F.col("__rank") >= F.col("__upto") - F.col("__n")) & (F.col("__rank") < F.col("__upto")))
    found = hit.groupBy("__key", "level").agg(F.sum(F.col("__v") * F.col("__weight")).alias("quantile"))
    return found.select(*[F.col("__key")[k].alias(k) for k in keys], "level", "quantile")


def summarised(rows: DataFrame, keys: list[str], plain: list[Column], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``keys``, the aggregates ``plain``, and for each name of ``wanted`` the exact percentile of a column at a level."""
    values: dict[str, Column] = {str(c): c for c, _ in wanted.values()}
    names = list(values)
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("what"), values[n].cast("double").alias("v")) for k, n in enumerate(names)])).alias("__s"))
    long = long.select(*keys, F.col("__s.what").alias("__what"), F.col("__s.v").alias("__v"))
    found = exact_quantiles(long, [*keys, "__what"], "__v", sorted({p for _, p in wanted.values()}))
    picked = [
        F.max(F.when((F.col("__what") == names.index(str(c))) & (F.col("level") == float(p)), F.col("quantile"))).alias(name) for name, (c, p) in wanted.items()
    ]
    base = rows.groupBy(key_of(keys).alias("__key")).agg(*plain)
    joined = base.join(found.groupBy(key_of(keys).alias("__key")).agg(*picked), "__key", "left")
    return joined.select(*[F.col("__key")[k].alias(k) for k in keys], *[c for c in joined.columns if c != "__key"])


def at_grains(rows: DataFrame, grains: list[tuple[str, ...]], keys: list[str]) -> DataFrame:
    """Each row once for each grain, with the keys that the grain lacks null, and the grain's bits in ``grain``."""
    bits = lambda g: sum((k not in g) << (len(keys) - 1 - j) for j, k in enumerate(keys))
    one = lambda g: F.struct(F.lit(bits(g)).cast("long").alias("grain"), *[(F.col(k) if k in g else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in keys])
    return rows.withColumn("__g", F.explode(F.array(*map(one, grains)))).drop(*keys).select("__g.*", "*").drop("__g")


def bucket_of(value: Column) -> Column:
    """A whole number that never falls as the double grows; values of one bucket differ by a 350th at most. NaN is last."""
    size = F.floor((F.least(F.log2(F.abs(value)), F.lit(1100.0)) + 1100) * 256)
    return F.when(F.isnan(value), F.lit(1 << 40)).when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * size).cast("long")


def grain_summary(rows: DataFrame, grains: list[tuple[str, ...]], keys: list[str], plain: list[Column], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``summarised`` at several grains of keys that take few values together: ``keys, grain``, ``plain`` and percentiles.

    A first scan counts narrow buckets of values at the finest grain, where most rows meet on the map side;
    coarser grains add up these counts, which tell in which bucket each wanted rank lies. A second
    scan takes the values of such buckets alone, a small part of the rows, to all grains: they are
    counted, dealt into ranges, and found by their rank within the bucket. No task holds a bucket's values,
    however many they are; a key's buckets, which windows pass, are bounded in number.
    """
    ready(rows.sparkSession)
    values: dict[str, Column] = {str(c): c for c, _ in wanted.values()}
    which, levels = list(values), sorted({float(p) for _, p in wanted.values()})
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("what"), values[n].cast("double").alias("v")) for k, n in enumerate(which)])).alias("__s"))
    long = long.select(*keys, F.col("__s.what").alias("__what"), F.col("__s.v").alias("__v")).filter("__v IS NOT NULL").withColumn("__bucket", bucket_of(F.col("__v")))
    fine = long.groupBy(*keys, "__what", "__bucket").agg(F.count("*").alias("__total")).checkpoint()
    group = key_of([*keys, "grain", "__what"]).alias("__key")

    def hit(totals: DataFrame, ranks: DataFrame, per: list[str], at: str) -> DataFrame:
        """``ranks`` with the part, numbered by ``at``, that they lie in, counted from where it begins."""
        before = Window.partitionBy(*per).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        begun = totals.withColumn("__first", F.coalesce(F.sum("__total").over(before), F.lit(0)))
        within = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__total"))
        return ranks.join(begun, per).filter(within).select(*per, at, "level", (F.col("__rank") - F.col("__first")).alias("__rank"), "__weight")

    buckets = at_grains(fine, grains, keys).groupBy(group, "__bucket").agg(F.sum("__total").alias("__total"))
    sizes = buckets.groupBy("__key").agg(F.sum("__total").alias("__of")).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    place = F.col("level") * (F.col("__of") - 1)
    low, part = F.floor(place), place - F.floor(place)
    ends = F.array(F.struct(low.alias("rank"), (1 - part).alias("weight")), F.struct((low + 1).alias("rank"), part.alias("weight")))
    ranks = sizes.withColumn("__e", F.explode(ends)).filter("__e.weight > 0").select("__key", "level", F.col("__e.rank").alias("__rank"), F.col("__e.weight").alias("__weight"))
    ranks = hit(buckets, ranks, ["__key"], "__bucket").checkpoint()

    near, part_of = ["__key", "__bucket"], ["__key", "__bucket", "__range"]
    some = ranks.select(F.col("__key")["__what"].alias("__what"), "__bucket").distinct()
    met = long.join(F.broadcast(some) if some.limit(FEW + 1).count() <= FEW else some, ["__what", "__bucket"], "left_semi")
    counted = at_grains(met, grains, keys).select(group, "__bucket", "__v").groupBy(*near, "__v").agg(F.count("*").alias("__n"))
    counted = counted.join(ranks.select(*near).distinct(), near, "left_semi")
    ranged = counted.repartitionByRange(*near, "__v").withColumn("__range", F.spark_partition_id()).checkpoint()
    ranks = hit(ranged.groupBy(*part_of).agg(F.sum("__n").alias("__total")), ranks, near, "__range")
    upto = F.sum("__n").over(Window.partitionBy(*part_of).orderBy("__v"))
    found = ranged.withColumn("__upto", upto).join(ranks, part_of).filter((F.col("__rank") >= F.col("__upto") - F.col("__n")) & (F.col("__rank") < F.col("__upto")))
    found = found.groupBy("__key", "level").agg(F.sum(F.col("__v") * F.col("__weight")).alias("quantile"))

    picked = [F.max(F.when((F.col("__key")["__what"] == which.index(str(c))) & (F.col("level") == float(p)), F.col("quantile"))).alias(name) for name, (c, p) in wanted.items()]
    by_group = found.groupBy(F.struct(*[F.col("__key")[k].alias(k) for k in (*keys, "grain")]).alias("__group")).agg(*picked)
    base = rows.groupingSets([[F.col(k) for k in g] for g in grains], *[F.col(k) for k in keys]).agg(F.grouping_id(*keys).cast("long").alias("grain"), *plain)
    base = base.withColumn("__group", F.struct(*keys, "grain"))
    return base.join(by_group, "__group", "left").drop("__group")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order within their key; a task holds a range of ``keys, order``."""
    ready(rows.sparkSession)
    at = [f"__o{k}" for k in range(len(order))]
    held = rows.withColumn("__key", key_of(keys)).select("*", *[c.alias(n) for n, c in zip(at, order, strict=True)])
    ranged = held.repartitionByRange("__key", *at).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__key", "__range").agg(F.count("*").alias("__n"))
    first = totals.select("__key", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__key", "__range").orderBy(*at)) - 1
    return ranged.withColumn("__within", within).join(first, ["__key", "__range"]).withColumn(name, (F.col("__first") + F.col("__within")).cast("long")).select(*rows.columns, name)


def running_counts(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Of ``keys, value, n``, one row a value: the same with the sum of ``n`` up to and with the value."""
    ready(counts.sparkSession)
    ranged = counts.withColumn("__key", key_of(keys)).repartitionByRange("__key", value).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__key", "__range").agg(F.sum("n").alias("__n"))
    first = totals.select("__key", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.sum("n").over(Window.partitionBy("__key", "__range").orderBy(value))
    return ranged.withColumn("__within", within).join(first, ["__key", "__range"]).select(*counts.columns, (F.col("__first") + F.col("__within")).alias(name))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key, where a key may hold a third of the rows.

    Rows meet their key in salted groups; a key goes to the groups that it has rows in.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int"))
    places = salted.select(*keys, "__salt").distinct().join(table, keys)
    return salted.join(places, [*keys, "__salt"]).drop("__salt")
