"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, r6
from .quantiles import ranked
from ..sources.views import FOLLOWED, METRICS, SCALARS, TRACK_OBS, followed, metrics, scalars, table, track_obs


def top_k(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark limits each partition before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("place") <= k)


@query(f"WITH {SCALARS}, n AS (SELECT step, ordinal, value, row_number() OVER (PARTITION BY step ORDER BY value DESC, ordinal) AS place FROM scalars) SELECT step, ordinal, value, place FROM n WHERE place <= 4")
def sort_topk_per_step(spark, sf_dir):
    return top_k(scalars(spark, sf_dir), "step", [F.col("value").desc(), F.col("ordinal")], 4).select("step", "ordinal", "value", "place")


@query(f"""WITH {FOLLOWED}, q AS (SELECT DISTINCT scene, track, qt FROM followed), s AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY qt, track) - 1 AS place FROM q)
SELECT scene, track, place, row_number() OVER (PARTITION BY scene ORDER BY track) - 1 AS original FROM s""")
def sort_inverse_permutation(spark, sf_dir):
    """Tracks by query time, and the place that brings each back."""
    q = followed(track_obs(spark, sf_dir)).select("scene", "track", "qt").distinct()
    placed = ranked(q, ["scene"], [F.col("qt"), F.col("track")], "place")
    return ranked(placed, ["scene"], [F.col("track")], "original").select("scene", "track", "place", "original")


@query("""WITH f AS (SELECT o_orderpriority AS run, 'step-' || o_orderkey || '_metrics_avg.csv' AS path FROM orders WHERE o_orderstatus = 'F')
SELECT run, arg_max(path, CAST(regexp_extract(path, 'step-(\\d+)_metrics_avg\\.csv', 1) AS BIGINT)) AS latest FROM f GROUP BY run""")
def sort_latest_by_regex(spark, sf_dir):
    path = F.concat(F.lit("step-"), F.col("o_orderkey"), F.lit("_metrics_avg.csv"))
    step = F.regexp_extract(path, r"step-(\d+)_metrics_avg\.csv", 1).cast("long")
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("run")).agg(F.max_by(path, step).alias("latest"))


@query(f"WITH {SCALARS}, f AS (SELECT tag, min(ordinal) AS first_seen, count(*) AS rows FROM scalars GROUP BY tag) SELECT tag, rows, row_number() OVER (ORDER BY first_seen) AS place FROM f")
def sort_first_appearance(spark, sf_dir):
    """Groups in the order in which they first appear; one row a tag is left to rank."""
    f = scalars(spark, sf_dir).groupBy("tag").agg(F.min("ordinal").alias("first_seen"), F.count("*").alias("rows"))
    return f.select("tag", "rows", F.row_number().over(Window.orderBy("first_seen")).cast("long").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query(f"WITH {TRACK_OBS} SELECT track, frame, x AS value, 'truth' AS kind FROM track_obs WHERE vis UNION ALL SELECT track, frame, px, 'prediction' FROM track_obs WHERE pvis")
def set_union_all(spark, sf_dir):
    o = track_obs(spark, sf_dir)
    one = o.filter("vis").select("track", "frame", F.col("x").alias("value"), F.lit("truth").alias("kind"))
    return one.unionByName(o.filter("pvis").select("track", "frame", F.lit("prediction").alias("kind"), F.col("px").alias("value")))


@query(f"WITH {SCALARS} SELECT step FROM scalars WHERE tag = 'view' INTERSECT SELECT step FROM scalars WHERE tag = 'error'")
def set_intersect(spark, sf_dir):
    s = scalars(spark, sf_dir)
    return s.filter("tag = 'view'").select("step").intersect(s.filter("tag = 'error'").select("step"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey"))


@query(f"WITH {TRACK_OBS} SELECT DISTINCT track, view FROM track_obs")
def set_distinct(spark, sf_dir):
    return track_obs(spark, sf_dir).select("track", "view").distinct()


SPLITS = "splits AS (SELECT c_custkey AS id, c_mktsegment || '-' || (c_nationkey % 7) AS family, CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM customer)"


def splits(spark, sf_dir):
    third = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey") % 7).alias("family"),
        F.when(third == 0, "train").when(third == 1, "validation").otherwise("test").alias("split"),
    )


@query(f"WITH {SPLITS} SELECT family, count(DISTINCT split) AS splits, min(split) AS a, max(split) AS b FROM splits GROUP BY family HAVING count(DISTINCT split) > 1")
def set_disjoint_check(spark, sf_dir):
    """Families that more than one split holds; none if the splits are disjoint."""
    s = splits(spark, sf_dir).groupBy("family").agg(F.count_distinct("split").alias("splits"), F.min("split").alias("a"), F.max("split").alias("b"))
    return s.filter("splits > 1")


@query(f"""WITH {TRACK_OBS}, frames AS (SELECT DISTINCT track, view, frame // 6 AS f FROM track_obs), want AS (SELECT DISTINCT track, f FROM frames)
SELECT track, v AS view, f, 'missing' AS problem FROM (SELECT unnest([0, 1, 2])::BIGINT AS v), want WHERE NOT EXISTS (SELECT 1 FROM frames x WHERE x.track = want.track AND x.view = v AND x.f = want.f)""")
def set_frames_match(spark, sf_dir):
    """Frames that a view lacks of those that any view of its track has; none if the views match."""
    frames = track_obs(spark, sf_dir).select("track", "view", F.floor(F.col("frame") / 6).cast("long").alias("f")).distinct()
    every = frames.select("track", "f").distinct().withColumn("view", F.explode(F.array(*[F.lit(v).cast("long") for v in range(3)])))
    return every.select("track", "view", "f").subtract(frames).withColumn("problem", F.lit("missing"))


@query(f"""WITH {SPLITS}, want AS (SELECT DISTINCT family FROM splits WHERE split = 'train'), bad AS (SELECT DISTINCT family FROM splits WHERE family LIKE 'B%')
SELECT id, family FROM splits WHERE family IN (SELECT family FROM want) AND family NOT IN (SELECT family FROM bad)""")
def join_semi_anti_select(spark, sf_dir):
    """Included and not excluded families, by semi and anti join."""
    s = splits(spark, sf_dir)
    return s.join(s.filter("split = 'train'").select("family"), "family", "left_semi").join(s.filter("family LIKE 'B%'").select("family"), "family", "left_anti").select("id", "family")


@query(f"""WITH {METRICS}, p AS (SELECT dataset, sequence, metric, max(value) FILTER (WHERE method = 'original') AS original, max(value) FILTER (WHERE method = 'candidate') AS candidate FROM metrics GROUP BY ALL)
SELECT dataset, sequence, metric, round(candidate - original, 6) AS delta FROM p WHERE original IS NOT NULL AND candidate IS NOT NULL""")
def join_paired_delta(spark, sf_dir):
    """Two methods' values of the same dataset and sequence, joined and subtracted."""
    m, keys = metrics(spark, sf_dir), ["dataset", "sequence", "metric"]
    one = m.filter("method = 'original'").select(*keys, F.col("value").alias("original"))
    two = m.filter("method = 'candidate'").select(*keys, F.col("value").alias("candidate"))
    return one.join(two, keys).select(*keys, r6(F.col("candidate") - F.col("original")).alias("delta"))
