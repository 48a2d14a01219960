"""Samplers and schedules. Randomness is a hash of a seed and a key: the same on every run and engine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import top_k
from ..operators.quantiles import looked_up, ranked, running_counts
from ..registry import query, r6
from ..sources.views import FOLLOWED, TRACK_OBS, followed, hashed, hashed_sql, table, track_obs
from .track_metrics import BUCKETS, DYNAMIC, PATH_VISIBLE, STATIC, VERY_DYNAMIC, motion_buckets, path_visible

SCENES = "scenes AS (SELECT c_nationkey::BIGINT AS source, c_custkey AS scene, 1 + c_custkey % 6 AS views, 100 + (c_custkey * 37) % 900 AS tracks FROM customer)"


def scenes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("source"), F.col("c_custkey").alias("scene"), (1 + F.col("c_custkey") % 6).alias("views"), (100 + (F.col("c_custkey") * 37) % 900).alias("tracks")
    )


def balanced_cycles(rows: DataFrame, source: str, scene: str, cycles: int, seed: int) -> DataFrame:
    """Each cycle is a permutation of a source's scenes: ``source, cycle, offset, scene``."""
    each = rows.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cycles - 1).cast("long"))))
    order = hashed(f"cycle{seed}", F.concat_ws("-", F.col("cycle"), F.col(scene)))
    return ranked(each.select(source, "cycle", scene), [source, "cycle"], [order, F.col(scene)], "offset").select(source, "cycle", "offset", scene)


@query(f"""WITH {SCENES} SELECT source, cycle::BIGINT AS cycle, row_number() OVER (PARTITION BY source, cycle ORDER BY {hashed_sql("cycle72", "concat_ws('-', cycle, scene)")}, scene) - 1 AS "offset", scene FROM scenes, (SELECT unnest(range(2)) AS cycle)""")
def samp_balanced_cycles(spark, sf_dir):
    return balanced_cycles(scenes(spark, sf_dir), "source", "scene", 2, 72)


@query("""WITH p AS (SELECT unnest(['a', 'b', 'a', 'c']) AS source, unnest(range(4))::BIGINT AS microbatch), r AS (SELECT unnest(range(3))::BIGINT AS rank), s AS (SELECT o_orderkey AS step FROM orders)
SELECT step, microbatch, rank, source, step * 12 + row_number() OVER (PARTITION BY step, source ORDER BY microbatch, rank) - 1 AS cursor FROM s, p, r""")
def samp_step_expand(spark, sf_dir):
    """Every microbatch and rank of a step, each at its source's next cursor."""
    pattern = F.array(*map(F.lit, "abac"))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.posexplode(pattern).alias("microbatch", "source"))
    s = s.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    n = F.row_number().over(Window.partitionBy("step", "source").orderBy("microbatch", "rank")) - 1
    return s.select("step", F.col("microbatch").cast("long").alias("microbatch"), "rank", "source", (F.col("step") * 12 + n).alias("cursor"))


@query(f"""WITH {SCENES}, n AS (SELECT *, (row_number() OVER (PARTITION BY views ORDER BY {hashed_sql("batch", "scene")}, scene) - 1) AS k FROM scenes) SELECT views, k // 8 AS batch, k % 4 AS rank, scene FROM n""")
def samp_homogeneous_batches(spark, sf_dir):
    """Batches of eight scenes with one view count, two to each of four ranks."""
    return ranked(scenes(spark, sf_dir), ["views"], [hashed("batch", "scene"), F.col("scene")], "k").select("views", F.floor(F.col("k") / 8).cast("long").alias("batch"), (F.col("k") % 4).cast("long").alias("rank"), "scene")


def stratified(rows: DataFrame, bucket: str, key: str, quotas: dict[str, float], target: int, salt: str) -> DataFrame:
    """``quota * target`` rows of each bucket by hash; the target shrinks to the scarcest bucket."""
    counts = rows.groupBy(bucket).count()
    share = F.create_map(*[F.lit(x) for q in quotas.items() for x in q])[F.col(bucket)]
    fits = counts.filter(share.isNotNull()).agg(F.least(F.lit(target), F.min(F.floor(F.col("count") / share))).alias("target"))  # one row
    placed = top_k(rows.filter(F.col(bucket).isin(list(quotas))), bucket, [hashed(salt, key), F.col(key)], target)
    return placed.crossJoin(F.broadcast(fits)).filter(F.col("place") <= F.floor(share * F.col("target"))).drop("place", "target")


@query(f"""WITH {FOLLOWED}, {PATH_VISIBLE}, {BUCKETS}, share AS (SELECT unnest(['static', 'dynamic', 'very_dynamic']) AS bucket, unnest([0.5, 0.3, 0.2])::DOUBLE AS share),
c AS (SELECT bucket, count(*) AS n FROM buckets GROUP BY bucket), t AS (SELECT least(40, min(floor(n / share))) AS target FROM c JOIN share USING (bucket)),
r AS (SELECT bucket, track, row_number() OVER (PARTITION BY bucket ORDER BY {hashed_sql("strata", "track")}, track) AS place FROM buckets)
SELECT bucket, track FROM r JOIN share USING (bucket), t WHERE place <= floor(share * target)""")
def samp_stratified_quota(spark, sf_dir):
    b = motion_buckets(path_visible(followed(track_obs(spark, sf_dir))))
    return stratified(b, "bucket", "track", {"static": 0.5, "dynamic": 0.3, "very_dynamic": 0.2}, 40, "strata").select("bucket", "track")


EXCLUSIVE = f"CASE WHEN path > {VERY_DYNAMIC} THEN 'very_dynamic' WHEN path > {DYNAMIC} THEN 'dynamic' WHEN path < {STATIC} THEN 'static' ELSE 'rest' END"


@query(f"""WITH {FOLLOWED}, {PATH_VISIBLE}, b AS (SELECT track, {EXCLUSIVE} AS bucket FROM path_visible), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {hashed_sql("fill", "track")}, track) AS place FROM b),
one AS (SELECT track, bucket FROM r WHERE bucket <> 'rest' AND place <= 10), left_over AS (SELECT track, row_number() OVER (ORDER BY {hashed_sql("fill", "track")}, track) AS place FROM b ANTI JOIN one USING (track))
SELECT track, bucket FROM one UNION ALL SELECT track, 'fill' FROM left_over WHERE place <= 40 - (SELECT count(*) FROM one)""")
def samp_stratified_fill(spark, sf_dir):
    """Ten tracks of each exclusive bucket, then others until there are forty."""
    p = path_visible(followed(track_obs(spark, sf_dir)))
    b = p.select("track", F.expr(EXCLUSIVE).alias("bucket"))
    order = [hashed("fill", "track"), F.col("track")]
    one = top_k(b.filter("bucket != 'rest'"), "bucket", order, 10).select("track", "bucket")
    rest = b.join(one, "track", "left_anti").orderBy(*order).limit(40)
    missing = one.agg((40 - F.count("*")).alias("missing"))
    placed = rest.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # forty rows at most
    return one.union(placed.crossJoin(F.broadcast(missing)).filter("place <= missing").select("track", F.lit("fill").alias("bucket")))


@query(f"""WITH {FOLLOWED}, {PATH_VISIBLE}, c AS (SELECT scene, count(*) FILTER (WHERE path > {VERY_DYNAMIC}) AS very, count(*) FILTER (WHERE path > {DYNAMIC}) AS dyn FROM path_visible GROUP BY scene)
SELECT scene, least(very, 8) AS very_quota, CASE WHEN very < 8 THEN 12 + 8 - very ELSE 12 END AS dynamic_quota, dyn FROM c""")
def samp_quota_reassign(spark, sf_dir):
    """What the very dynamic tracks lack goes to the dynamic ones."""
    c = path_visible(followed(track_obs(spark, sf_dir))).groupBy("scene").agg(F.count_if(F.col("path") > VERY_DYNAMIC).alias("very"), F.count_if(F.col("path") > DYNAMIC).alias("dyn"))
    return c.select("scene", F.least("very", F.lit(8)).cast("long").alias("very_quota"), F.when(F.col("very") < 8, 20 - F.col("very")).otherwise(12).cast("long").alias("dynamic_quota"), "dyn")


@query(f"""WITH {TRACK_OBS}, v AS (SELECT track, frame, row_number() OVER (PARTITION BY track ORDER BY {hashed_sql("quarter", "event_id")}, event_id) AS place, count(*) OVER (PARTITION BY track) AS n FROM track_obs WHERE vis) SELECT track, frame FROM v WHERE place <= least(n // 4, 12)""")
def samp_quarter(spark, sf_dir):
    """A quarter of the candidates without replacement, twelve at most."""
    w = Window.partitionBy("track")
    v = track_obs(spark, sf_dir).filter("vis").withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(hashed("quarter", "event_id"), "event_id")))
    return v.filter("place <= least(n div 4, 12)").select("track", "frame")


def weighted_draws(rows: DataFrame, key: str, item: str, draws: int, salt: str) -> DataFrame:
    """``key, draw, item``: items of each key drawn with replacement, in proportion to their weight ``n``; items are unique in a key.

    Running sums go by ranges, so no task holds a key. A key's span is cut into as many slices as it has items, and a
    draw meets only the items that reach into its slice.
    """
    upto = running_counts(rows, [key], item, "hi")
    totals = rows.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("items"))
    slice_of = lambda spot: F.floor(spot * F.col("items") / F.col("total")).cast("long")
    placed = looked_up(upto, totals, [key]).filter("n > 0").withColumn("lo", F.col("hi") - F.col("n"))
    placed = placed.withColumn("slice", F.explode(F.sequence(slice_of(F.col("lo")), slice_of(F.col("hi"))))).select(key, item, "lo", "hi", "slice")
    d = totals.filter("total > 0").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    d = d.withColumn("spot", hashed(salt, F.concat_ws("-", key, "draw")) * F.col("total")).withColumn("slice", slice_of(F.col("spot"))).select(key, "draw", "spot", "slice")
    return placed.join(d, [key, "slice"]).filter("spot >= lo AND spot < hi").select(key, "draw", item)


@query(f"""WITH c AS (SELECT p_brand AS mesh, p_partkey AS face, CAST(sum(p_size * p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS hi, CAST(p_size * p_size AS BIGINT) AS area, CAST(sum(p_size * p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS total FROM part),
d AS (SELECT mesh, j, {hashed_sql("face", "concat_ws('-', mesh, j)")} * total AS spot FROM (SELECT mesh, any_value(total) AS total FROM c GROUP BY mesh), (SELECT unnest(range(20)) AS j))
SELECT d.mesh, d.j::BIGINT AS draw, face FROM d JOIN c ON c.mesh = d.mesh AND spot >= hi - area AND spot < hi""")
def samp_weighted_cdf(spark, sf_dir):
    """Faces drawn in proportion to their area."""
    area = (F.col("p_size") * F.col("p_size")).cast("long")
    faces = table(spark, sf_dir, "part").select(F.col("p_brand").alias("mesh"), F.col("p_partkey").alias("face"), area.alias("n"))
    return weighted_draws(faces, "mesh", "face", 20, "face").select("mesh", "draw", "face")


@query(f"""WITH {SCENES}, v AS (SELECT scene, views, unnest(range(6))::BIGINT AS view FROM scenes), r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY {hashed_sql("view", "concat_ws('-', scene, view)")}, view) AS place FROM v) SELECT scene, view, place FROM r WHERE place <= views""")
def samp_views(spark, sf_dir):
    """As many of six views as a scene wants, without replacement."""
    v = scenes(spark, sf_dir).select("scene", "views", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("view"))
    place = F.row_number().over(Window.partitionBy("scene").orderBy(hashed("view", F.concat_ws("-", "scene", "view")), "view")).cast("long")
    return v.withColumn("place", place).filter("place <= views").select("scene", "view", "place")


PAIRS = f"""{SCENES}, s AS (SELECT source, views, scene, tracks, scene // 60 AS block FROM scenes WHERE views <= 4), pairs AS (SELECT a.source, a.block, a.views, a.scene AS one, b.scene AS two,
    2 * greatest(a.tracks, b.tracks) - a.tracks - b.tracks AS padding, greatest(a.tracks, b.tracks) AS work FROM s a JOIN s b ON a.source = b.source AND a.views = b.views AND a.block = b.block AND a.scene < b.scene WHERE greatest(a.tracks, b.tracks) <= 960)"""


def pair_candidates(rows: DataFrame) -> DataFrame:
    """Scenes of one shape within a block of the schedule, with what pairing them costs."""
    s = rows.filter("views <= 4").withColumn("block", F.floor(F.col("scene") / 60).cast("long"))
    keys = ["source", "views", "block"]
    a = s.select(*keys, F.col("scene").alias("one"), F.col("tracks").alias("ta"))
    b = s.select(*keys, F.col("scene").alias("two"), F.col("tracks").alias("tb"))
    work = F.greatest("ta", "tb")
    return a.join(b, keys).filter((F.col("one") < F.col("two")) & (work <= 960)).select(*keys, "one", "two", (2 * work - F.col("ta") - F.col("tb")).alias("padding"), work.alias("work"))


@query(f"WITH {PAIRS} SELECT source, block, views, one, two, padding, work FROM pairs")
def sched_pair_candidates(spark, sf_dir):
    return pair_candidates(scenes(spark, sf_dir)).select("source", "block", "views", "one", "two", "padding", "work")


@query(f"WITH {PAIRS} SELECT source, block, arg_min(struct_pack(a := one, b := two).a, struct_pack(p := padding, w := work, a := one, b := two)) AS one, min(padding) AS padding FROM pairs GROUP BY source, block")
def sched_min_plan(spark, sf_dir):
    """The pair with the least padding, then work, then ids."""
    p = pair_candidates(scenes(spark, sf_dir))
    return p.groupBy("source", "block").agg(F.min_by("one", F.struct("padding", "work", "one", "two")).alias("one"), F.min("padding").alias("padding"))


def greedy(ranks: int):
    """Largest first, each shard to the rank with the least load; one source's shards at a time."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "shard"], ascending=[False, True])
        load, to = np.zeros(ranks, np.int64), []
        for size in group["bytes"]:
            k = int(load.argmin())
            load[k] += size
            to.append(k)
        return pd.DataFrame({"source": group["source"], "shard": group["shard"], "rank": np.array(to, np.int64)})

    return run


@query(f"""WITH RECURSIVE {SCENES}, s AS (SELECT source, scene // 100 AS shard, CAST(sum(tracks) AS BIGINT) AS bytes FROM scenes GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bytes DESC, shard) AS n FROM s),
walk AS (SELECT source, 0::BIGINT AS n, NULL::BIGINT AS shard, NULL::BIGINT AS rank, [0, 0, 0, 0]::BIGINT[] AS load FROM o WHERE n = 1
UNION ALL SELECT o.source, o.n, o.shard, list_position(load, list_min(load)) - 1, list_transform(range(1, 5), lambda i: load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN o.bytes ELSE 0 END) FROM walk JOIN o ON o.source = walk.source AND o.n = walk.n + 1)
SELECT source, shard, rank FROM walk WHERE n > 0""")
def sched_greedy_ranks(spark, sf_dir):
    """Sequential by nature: each source's catalogue of shards is one small group."""
    s = scenes(spark, sf_dir).groupBy("source", F.floor(F.col("scene") / 100).cast("long").alias("shard")).agg(F.sum("tracks").alias("bytes"))
    return s.groupBy("source").applyInPandas(greedy(4), "source long, shard long, rank long")


__all__ = ["r6"]
