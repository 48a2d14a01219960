"""Window operators over frames, steps and shards: gates, derivatives, rolling rates, schedules.

Windows are keyed by a track, tag or scene. Where an order is global, ranks are built from
counts per key, so that no task holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, r6
from ..sources.views import FOLLOWED, SCALARS, TRACK_OBS, followed, hashed, hashed_sql, scalars, table, track_obs
from .quantiles import ranked


def by_track():
    return Window.partitionBy("track").orderBy("frame")


@query(f"WITH {TRACK_OBS} SELECT track, min(frame) FILTER (WHERE vis) AS first_visible FROM track_obs GROUP BY track")
def win_first_visible(spark, sf_dir):
    return track_obs(spark, sf_dir).groupBy("track").agg(F.min(F.when(F.col("vis"), F.col("frame"))).alias("first_visible"))


@query(f"WITH {TRACK_OBS} SELECT track, max(frame) FILTER (WHERE vis) AS last_visible FROM track_obs GROUP BY track")
def win_last_visible(spark, sf_dir):
    return track_obs(spark, sf_dir).groupBy("track").agg(F.max(F.when(F.col("vis"), F.col("frame"))).alias("last_visible"))


def query_frames(obs: DataFrame) -> DataFrame:
    """First visible frame of each track once its last visible frame is masked."""
    last = obs.groupBy("track").agg(F.max(F.when(F.col("vis"), F.col("frame"))).alias("last"))
    return obs.join(last, "track").filter("vis AND frame < last").groupBy("track").agg(F.min("frame").alias("query_frame"))


@query(f"""WITH {TRACK_OBS}, l AS (SELECT track, max(frame) FILTER (WHERE vis) AS last FROM track_obs GROUP BY track)
SELECT track, min(frame) AS query_frame FROM track_obs JOIN l USING (track) WHERE vis AND frame < last GROUP BY track""")
def win_query_frame(spark, sf_dir):
    return query_frames(track_obs(spark, sf_dir))


@query(f"WITH {TRACK_OBS} SELECT track, frame, x, y FROM track_obs WHERE frame % 5 = 0 AND vis")
def win_strided_queries(spark, sf_dir):
    return track_obs(spark, sf_dir).filter("frame % 5 = 0 AND vis").select("track", "frame", "x", "y")


def dropped_together(obs: DataFrame, at_least: int) -> DataFrame:
    """Tracks of which ``at_least`` views or more turn hidden at one step."""
    w = Window.partitionBy("track", "view").orderBy("frame")
    turned = obs.withColumn("down", F.col("vis") & ~F.lead("vis").over(w)).withColumn("step", F.floor(F.col("frame") / 6))
    each = turned.groupBy("track", "step").agg(F.count_distinct(F.when(F.col("down"), F.col("view"))).alias("views"))
    return each.groupBy("track").agg(F.bool_or(F.col("views") >= at_least).alias("rejected"))


@query(f"""WITH {TRACK_OBS}, t AS (SELECT track, view, frame, vis AND NOT lead(vis) OVER (PARTITION BY track, view ORDER BY frame) AS down FROM track_obs),
e AS (SELECT track, frame // 6 AS step, count(DISTINCT CASE WHEN down THEN view END) AS views FROM t GROUP BY ALL)
SELECT track, bool_or(views >= 3) AS rejected FROM e GROUP BY track""")
def win_simultaneous_drop(spark, sf_dir):
    return dropped_together(track_obs(spark, sf_dir), 3)


@query(f"""WITH {TRACK_OBS}, g AS (SELECT *, first_value(vis) OVER (PARTITION BY track, view ORDER BY frame) AS first_vis, row_number() OVER (PARTITION BY track, view ORDER BY frame) AS n FROM track_obs)
SELECT track, view, count(*) FILTER (WHERE CASE WHEN n <= 5 AND NOT first_vis THEN false ELSE vis END) AS seen FROM g GROUP BY track, view""")
def win_first_frame_gate(spark, sf_dir):
    """Tracks hidden in a view's first frame stay hidden there for five frames."""
    w = Window.partitionBy("track", "view").orderBy("frame")
    gated = track_obs(spark, sf_dir).withColumn("gate", (F.row_number().over(w) <= 5) & ~F.first("vis").over(w))
    return gated.groupBy("track", "view").agg(F.count_if(F.col("vis") & ~F.col("gate")).alias("seen"))


@query(f"""WITH {TRACK_OBS}, d AS (SELECT *, x - lag(x) OVER w AS v, vis AND lag(vis) OVER w AS ok1, x - 2 * lag(x) OVER w + lag(x, 2) OVER w AS a, vis AND lag(vis) OVER w AND lag(vis, 2) OVER w AS ok2,
    x - 3 * lag(x) OVER w + 3 * lag(x, 2) OVER w - lag(x, 3) OVER w AS j, vis AND lag(vis) OVER w AND lag(vis, 2) OVER w AND lag(vis, 3) OVER w AS ok3 FROM track_obs WINDOW w AS (PARTITION BY track ORDER BY frame))
SELECT track, round(avg(abs(v) * 30) FILTER (WHERE ok1), 4) AS speed, round(avg(abs(a) * 900) FILTER (WHERE ok2), 4) AS acceleration, round(avg(abs(j) * 27000) FILTER (WHERE ok3), 3) AS jerk FROM d GROUP BY track""")
def win_derivatives(spark, sf_dir):
    """Mean speed, acceleration and jerk at 30 frames a second, each over runs of visible frames."""
    lag = lambda c, k: F.lag(c, k).over(by_track())
    seen = lambda n: F.lit(True) if n < 0 else (F.col("vis") if n == 0 else lag("vis", n)) & seen(n - 1)
    d = track_obs(spark, sf_dir).select(
        "track",
        F.when(seen(1), F.abs(F.col("x") - lag("x", 1)) * 30).alias("v"),
        F.when(seen(2), F.abs(F.col("x") - 2 * lag("x", 1) + lag("x", 2)) * 900).alias("a"),
        F.when(seen(3), F.abs(F.col("x") - 3 * lag("x", 1) + 3 * lag("x", 2) - lag("x", 3)) * 27000).alias("j"),
    )
    return d.groupBy("track").agg(F.round(F.avg("v"), 4).alias("speed"), F.round(F.avg("a"), 4).alias("acceleration"), F.round(F.avg("j"), 3).alias("jerk"))


@query(f"""WITH {TRACK_OBS}, d AS (SELECT track, vis <> lag(vis) OVER (PARTITION BY track ORDER BY frame) AS flip FROM track_obs)
SELECT track, round(count(*) FILTER (WHERE flip) / nullif(count(flip), 0), 6) AS rate FROM d GROUP BY track""")
def win_transition_rate(spark, sf_dir):
    d = track_obs(spark, sf_dir).withColumn("flip", F.col("vis") != F.lag("vis").over(by_track()))
    return d.groupBy("track").agg(r6(F.try_divide(F.count_if("flip"), F.count("flip"))).alias("rate"))


def rolling_rate(rows: DataFrame, key: str, order: list[str], flag: Column, width: int) -> DataFrame:
    """Mean of a flag over the trailing ``width`` rows of a key; fewer at the start."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - width, 0)
    return rows.withColumn("rate", F.avg(flag.cast("double")).over(w))


@query(f"""WITH {TRACK_OBS} SELECT track, frame, round(avg(CAST(NOT vis AS DOUBLE)) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rate FROM track_obs""")
def win_rolling_rate(spark, sf_dir):
    return rolling_rate(track_obs(spark, sf_dir), "track", ["frame"], ~F.col("vis"), 50).select("track", "frame", r6("rate").alias("rate"))


@query(f"""WITH {SCALARS}, f AS (SELECT user_id, event_type AS tag, min(date_diff('day', TIMESTAMP '2024-01-01', ts)) AS step FROM events GROUP BY ALL), n AS (SELECT tag, step, count(*) AS fresh FROM f GROUP BY ALL)
SELECT tag, step, CAST(sum(fresh) OVER (PARTITION BY tag ORDER BY step) AS BIGINT) AS distinct_so_far FROM n""")
def win_cumulative_distinct(spark, sf_dir):
    """Distinct users so far by tag and step: each counts where it is first seen."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tag"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("step"))
    fresh = e.groupBy("user_id", "tag").agg(F.min("step").alias("step")).groupBy("tag", "step").agg(F.count("*").alias("fresh"))
    return fresh.select("tag", "step", F.sum("fresh").over(Window.partitionBy("tag").orderBy("step")).alias("distinct_so_far"))


@query(f"""WITH {TRACK_OBS}, s AS (SELECT track, frame, vis, sum(CAST(vis AS INTEGER)) OVER (PARTITION BY track ORDER BY frame) - CAST(vis AS INTEGER) AS done FROM track_obs)
SELECT track, CAST(done // 4 + 1 AS BIGINT) AS step, count(*) FILTER (WHERE vis) AS accepted, count(*) FILTER (WHERE NOT vis) AS failed FROM s GROUP BY track, CAST(done // 4 + 1 AS BIGINT)""")
def win_microbatch_steps(spark, sf_dir):
    """Every four accepted samples make a step; failures count to the step that is open."""
    done = F.sum(F.col("vis").cast("int")).over(by_track()) - F.col("vis").cast("int")
    s = track_obs(spark, sf_dir).withColumn("step", (F.floor(done / 4) + 1).cast("long"))
    return s.groupBy("track", "step").agg(F.count_if("vis").alias("accepted"), F.count_if(~F.col("vis")).alias("failed"))


def legal_starts(frames: DataFrame, length: int) -> DataFrame:
    """``track, start``: each window of ``length`` frames without an invalid frame, from ``track, frame, bad``."""
    ahead = Window.partitionBy("track").orderBy("frame").rangeBetween(0, length - 1)
    n = Window.partitionBy("track")
    found = frames.withColumn("bads", F.sum(F.col("bad").cast("int")).over(ahead)).withColumn("nf", F.max("frame").over(n) + 1)
    return found.filter((F.col("bads") == 0) & (F.col("frame") <= F.col("nf") - length)).select("track", F.col("frame").alias("start"))


@query(f"""WITH {TRACK_OBS}, n AS (SELECT track, max(frame) + 1 AS nf FROM track_obs GROUP BY track), s AS (SELECT track, unnest(range(0, greatest(0, nf - 24 + 1))) AS start FROM n)
SELECT track, start FROM s WHERE NOT EXISTS (SELECT 1 FROM track_obs o WHERE o.track = s.track AND NOT o.vis AND o.frame BETWEEN s.start AND s.start + 23)""")
def win_legal_starts(spark, sf_dir):
    return legal_starts(track_obs(spark, sf_dir).select("track", "frame", (~F.col("vis")).alias("bad")), 24)


@query(f"""WITH {FOLLOWED}, s AS (SELECT scene, min(qt) AS lo, max(nf) AS nf FROM followed GROUP BY scene), w AS (SELECT scene, unnest(range(lo, nf - 6, 6)) AS start FROM s),
q AS (SELECT DISTINCT scene, track, qt FROM followed)
SELECT w.scene, start, count(*) AS active FROM w JOIN q ON q.scene = w.scene AND qt < start + 12 GROUP BY w.scene, start""")
def win_sliding_schedule(spark, sf_dir):
    """Windows of 12 frames every 6, from the earliest query frame; tracks whose query came before a window's end are active."""
    rows = followed(track_obs(spark, sf_dir)).select("scene", "track", "qt", "nf").distinct()
    spans = rows.groupBy("scene").agg(F.min("qt").alias("lo"), F.max("nf").alias("nf")).filter("lo <= nf - 7")
    starts = spans.select("scene", F.explode(F.sequence("lo", F.col("nf") - 7, F.lit(6).cast("long"))).alias("start"))
    # Tracks enter at one window each: count entries, then sum them over the starts.
    enters = rows.join(spans, "scene").select("scene", F.greatest(F.col("lo"), F.col("lo") + 6 * F.ceil((rows.qt - 11 - F.col("lo")) / 6)).alias("start"))
    counts = starts.join(enters.groupBy("scene", "start").agg(F.count("*").alias("new")), ["scene", "start"], "full_outer")
    active = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("scene").orderBy("start"))
    return counts.withColumn("active", active).join(starts, ["scene", "start"], "left_semi").select("scene", "start", "active")


@query(f"""WITH {TRACK_OBS}, w AS (SELECT track, frame, x + k AS value, (frame // 6 - k) * 6 AS start FROM track_obs, (SELECT unnest([0, 1]) AS k) WHERE frame // 6 - k >= 0)
SELECT track, frame, round(arg_max(value, start), 6) AS value FROM w GROUP BY track, frame""")
def win_overlap_last_wins(spark, sf_dir):
    """Each frame is in two windows; the later one's value counts."""
    rows = track_obs(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("start", (F.floor(F.col("frame") / 6) - F.col("k")) * 6)
    return rows.filter("start >= 0").groupBy("track", "frame").agg(r6(F.max_by(F.col("x") + F.col("k"), "start")).alias("value"))


@query(f"""WITH {TRACK_OBS}, n AS (SELECT track, max(frame) + 1 AS nf FROM track_obs GROUP BY track), s AS (SELECT track, nf, unnest(range(0, nf, 16)) AS lo FROM n) SELECT track, lo, least(lo + 16, nf) AS hi FROM s""")
def win_chunk_ranges(spark, sf_dir):
    n = track_obs(spark, sf_dir).groupBy("track").agg((F.max("frame") + 1).alias("nf"))
    return n.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nf") - 1, F.lit(16).cast("long")))).select("track", "lo", F.least(F.col("lo") + 16, F.col("nf")).alias("hi"))


@query(f"""WITH {TRACK_OBS}, n AS (SELECT track, max(frame) + 1 AS nf FROM track_obs GROUP BY track)
SELECT track, CAST(i AS BIGINT) AS anchor, CAST(2 + floor(i * (nf - 5) / CAST(7 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS frame FROM n, (SELECT unnest(range(8)) AS i) WHERE nf >= 5""")
def win_anchor_frames(spark, sf_dir):
    """Eight anchors spread over a track's frames, a margin of two at both ends."""
    n = track_obs(spark, sf_dir).groupBy("track").agg((F.max("frame") + 1).alias("nf")).filter("nf >= 5")
    i = F.col("anchor")
    return n.withColumn("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).select("track", "anchor", (2 + F.floor(i * (F.col("nf") - 5) / F.lit(7.0) + 0.5)).cast("long").alias("frame"))


@query(f"""WITH {TRACK_OBS}, k AS (SELECT track, frame, CASE WHEN frame % 4 = 0 THEN x END AS known FROM track_obs),
b AS (SELECT *, last_value(CASE WHEN known IS NOT NULL THEN frame END IGNORE NULLS) OVER lo AS f0, last_value(known IGNORE NULLS) OVER lo AS v0, first_value(CASE WHEN known IS NOT NULL THEN frame END IGNORE NULLS) OVER hi AS f1, first_value(known IGNORE NULLS) OVER hi AS v1
    FROM k WINDOW lo AS (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track, frame, round(CASE WHEN f1 IS NULL OR f0 = f1 THEN v0 ELSE v0 + (v1 - v0) * (frame - f0) / (f1 - f0) END, 6) AS value FROM b""")
def win_interpolate(spark, sf_dir):
    """Linear between the known frames, the last known value beyond them."""
    lo = by_track().rowsBetween(Window.unboundedPreceding, 0)
    hi = by_track().rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("frame") % 4 == 0, F.col("x"))
    at = F.when(known.isNotNull(), F.col("frame"))
    b = track_obs(spark, sf_dir).select("track", "frame", F.last(at, True).over(lo).alias("f0"), F.last(known, True).over(lo).alias("v0"), F.first(at, True).over(hi).alias("f1"), F.first(known, True).over(hi).alias("v1"))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("frame") - F.col("f0")) / F.nullif(F.col("f1") - F.col("f0"), F.lit(0))
    return b.select("track", "frame", r6(F.when(F.col("f1").isNull() | (F.col("f0") == F.col("f1")), F.col("v0")).otherwise(between)).alias("value"))


@query(f"""WITH {TRACK_OBS} SELECT track, frame, max(abs(x - px)) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) < 25 AS background FROM track_obs""")
def win_max_filter(spark, sf_dir):
    """Background where the largest difference of five frames stays below a limit."""
    w = by_track().rowsBetween(-2, 2)
    return track_obs(spark, sf_dir).select("track", "frame", (F.max(F.abs(F.col("x") - F.col("px"))).over(w) < 25).alias("background"))


def cells(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy(F.floor(F.col("x") / size).cast("long").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("cy")).agg(F.min("z").alias("depth"))


def around(grid: DataFrame) -> DataFrame:
    """Each cell with the cells of its 3 x 3 neighbourhood that exist, by an equality join of shifted keys."""
    shift = grid.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = shift.select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), F.col("depth").alias("other"))
    return grid.join(near, ["cx", "cy"])


GRID = "grid AS (SELECT CAST(floor(embedding[1]::DOUBLE / 0.1::DOUBLE) AS BIGINT) AS cx, CAST(floor(embedding[2]::DOUBLE / 0.1::DOUBLE) AS BIGINT) AS cy, min(embedding[3]::DOUBLE) AS depth FROM embeddings GROUP BY ALL)"


@query(f"""WITH {GRID} SELECT g.cx, g.cy, (max(o.depth) - min(o.depth)) / greatest(abs(g.depth), 1e-6) > 2 AS edge FROM grid g JOIN grid o ON o.cx BETWEEN g.cx - 1 AND g.cx + 1 AND o.cy BETWEEN g.cy - 1 AND g.cy + 1 GROUP BY g.cx, g.cy, g.depth""")
def win_depth_edge(spark, sf_dir):
    from ..sources.views import points

    near = around(cells(points(spark, sf_dir), 0.1))
    jump = (F.max("other") - F.min("other")) / F.greatest(F.abs(F.first("depth")), F.lit(1e-6))
    return near.groupBy("cx", "cy").agg((jump > 2).alias("edge"))


@query("""SELECT c_nationkey::BIGINT AS source, c_custkey AS id, lag(c_acctbal) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS previous, c_acctbal AS value FROM customer""")
def win_previous_same_key(spark, sf_dir):
    """The last earlier record of the same source and scene."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("source"), F.col("c_custkey").alias("id"), F.lag("c_acctbal").over(w).alias("previous"), F.col("c_acctbal").alias("value"))


OFFSETS = "offs AS (SELECT l_orderkey AS shard, l_linenumber::BIGINT AS n, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS o, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey) AS BIGINT) AS size FROM lineitem)"


def offsets(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("shard"), F.col("l_linenumber").cast("long").alias("n"),
        F.sum("l_quantity").over(w.orderBy("l_linenumber")).cast("long").alias("o"), F.sum("l_quantity").over(w).cast("long").alias("size"),
    )


@query(f"WITH {OFFSETS}, p AS (SELECT *, lag(o) OVER (PARTITION BY shard ORDER BY n) AS before FROM offs) SELECT shard, bool_and(before IS NULL OR o > before) AND max(o) = max(size) AS complete FROM p GROUP BY shard")
def win_offsets_monotone(spark, sf_dir):
    """A byte store is complete if its offsets rise strictly and end at its size."""
    p = offsets(spark, sf_dir).withColumn("before", F.lag("o").over(Window.partitionBy("shard").orderBy("n")))
    return p.groupBy("shard").agg((F.bool_and(F.col("before").isNull() | (F.col("o") > F.col("before"))) & (F.max("o") == F.max("size"))).alias("complete"))


@query(f"WITH {OFFSETS} SELECT shard, n, coalesce(lead(o) OVER (PARTITION BY shard ORDER BY n), size) - o AS bytes FROM offs")
def win_offset_sizes(spark, sf_dir):
    return offsets(spark, sf_dir).select("shard", "n", (F.coalesce(F.lead("o").over(Window.partitionBy("shard").orderBy("n")), F.col("size")) - F.col("o")).alias("bytes"))


@query("SELECT l_orderkey AS shard, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AND min(l_linenumber) = 1 AS contiguous FROM lineitem GROUP BY l_orderkey")
def win_contiguous_ids(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("shard")).agg(((F.max(n) - F.min(n) + 1 == F.count("*")) & (F.min(n) == 1)).alias("contiguous"))


@query("SELECT c_nationkey::BIGINT AS source, c_custkey AS scene, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 8 AS shard FROM customer")
def win_shard_assign(spark, sf_dir):
    """Eight scenes to a shard of their source."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("source"), F.col("c_custkey").alias("scene"))
    return ranked(rows, ["source"], [F.col("scene")], "n").select("source", "scene", F.floor(F.col("n") / 8).cast("long").alias("shard"))


def global_index(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """A running index over ``key, order``, from 0, by ranges."""
    return ranked(rows, [], [F.col(key), F.col(order)], name)


@query("SELECT c_nationkey::BIGINT AS shard, c_custkey AS scene, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS sample FROM customer")
def win_global_sample_index(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("shard"), F.col("c_custkey").alias("scene"))
    return global_index(rows, "shard", "scene", "sample").select("shard", "scene", F.col("sample").cast("long").alias("sample"))


@query(f"WITH {TRACK_OBS}, s AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame) - 1 AS n FROM track_obs WHERE vis) SELECT track, frame, x FROM s WHERE n BETWEEN 4 AND 40 AND n % 3 = 1")
def win_strided_slice(spark, sf_dir):
    """Rows 4 to 40 of the visible frames, every third."""
    n = F.row_number().over(by_track()) - 1
    return track_obs(spark, sf_dir).filter("vis").withColumn("n", n).filter("n BETWEEN 4 AND 40 AND n % 3 = 1").select("track", "frame", "x")


@query(f"WITH {SCALARS}, n AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ordinal DESC) AS k FROM scalars) SELECT tag, ordinal, value FROM n WHERE k <= 60")
def win_bounded_history(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("tag").orderBy(F.col("ordinal").desc()))
    return scalars(spark, sf_dir).withColumn("k", k).filter("k <= 60").select("tag", "ordinal", "value")


@query(f"""WITH {TRACK_OBS} SELECT track, frame, last_value(CASE WHEN view = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sample FROM track_obs""")
def win_attach_last_open(spark, sf_dir):
    """Each line belongs to the last line before it that opened a sample."""
    w = by_track().rowsBetween(Window.unboundedPreceding, 0)
    return track_obs(spark, sf_dir).select("track", "frame", F.last(F.when(F.col("view") == 0, F.col("event_id")), True).over(w).alias("sample"))


__all__ = ["hashed", "hashed_sql"]
