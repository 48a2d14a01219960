"""Track metrics: trajectory errors, survival, occlusion accuracy, thresholds, Jaccard, buckets.

Errors and survival count frames from the query frame on; occlusion, threshold and Jaccard
metrics count frames after it. Comparisons are strict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import summarised
from ..registry import number, query, r6
from ..sources.views import FOLLOWED, followed, track_obs

THRESHOLDS = (5.0, 10.0, 20.0, 40.0, 80.0)
FAIL, CLOSE = 40.0, 10.0
STATIC, DYNAMIC, VERY_DYNAMIC = 1500.0, 2000.0, 2600.0


def seen_from_query() -> Column:
    return F.col("vis") & (F.col("frame") >= F.col("qt"))


def after_query() -> Column:
    return F.col("frame") > F.col("qt")


def survival(fail: float = FAIL) -> Column:
    """The share of frames until the first visible one whose prediction is too far off."""
    first = F.min(F.when(seen_from_query() & (F.col("d") > fail), F.col("frame")))
    return (F.coalesce(first, F.first("nf")) - F.first("qt")) / (F.first("nf") - F.first("qt"))


def jaccard(threshold: Column | float) -> Column:
    near = F.col("d") < threshold
    hit = F.count_if(after_query() & F.col("vis") & F.col("pvis") & near)
    truth = F.count_if(after_query() & F.col("vis"))
    false = F.count_if(after_query() & F.col("pvis") & ~(F.col("vis") & near))
    return F.try_divide(hit, truth + false)


JACCARD = "count(*) FILTER (WHERE frame > qt AND vis AND pvis AND d < {t}) / nullif(count(*) FILTER (WHERE frame > qt AND vis) + count(*) FILTER (WHERE frame > qt AND pvis AND NOT (vis AND d < {t})), 0)"


def trajectory_errors(rows: DataFrame) -> DataFrame:
    """``track, mte, ate, fde, surv, jac``: lower median, mean and last distance, survival, Jaccard."""
    d = F.when(seen_from_query(), F.col("d"))
    return rows.withColumn("dv", d).groupBy("track").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dv)").alias("mte"), F.avg("dv").alias("ate"),
        F.max_by("d", F.when(seen_from_query(), F.col("frame"))).alias("fde"), survival().alias("surv"), jaccard(CLOSE).alias("jac"),
    )


@query(f"""WITH {FOLLOWED}
SELECT track, round(quantile_disc(d, 0.5) FILTER (WHERE vis AND frame >= qt), 6) AS mte, round(avg(d) FILTER (WHERE vis AND frame >= qt), 6) AS ate,
       round(arg_max(d, frame) FILTER (WHERE vis AND frame >= qt), 6) AS fde,
       round((coalesce(min(frame) FILTER (WHERE vis AND frame >= qt AND d > {FAIL}), any_value(nf)) - any_value(qt)) / (any_value(nf) - any_value(qt)), 6) AS surv,
       round({JACCARD.format(t=CLOSE)}, 6) AS jac
FROM followed GROUP BY track""")
def trk_errors(spark, sf_dir):
    found = trajectory_errors(followed(track_obs(spark, sf_dir)))
    return found.select("track", *[r6(c).alias(c) for c in ("mte", "ate", "fde", "surv", "jac")])


@query(f"""WITH {FOLLOWED}, fails AS (
SELECT track, any_value(scene) AS scene, (coalesce(min(frame) FILTER (WHERE vis AND frame >= qt AND d > {FAIL}), any_value(nf)) - any_value(qt)) / (any_value(nf) - any_value(qt)) AS surv
FROM followed GROUP BY track)
SELECT scene, count(*) AS tracks, round(avg(surv) * 100, 6) AS survival, count(*) FILTER (WHERE surv = 1) AS survivors FROM fails GROUP BY scene""")
def trk_survival(spark, sf_dir):
    each = followed(track_obs(spark, sf_dir)).groupBy("track").agg(F.first("scene").alias("scene"), survival().alias("surv"))
    return each.groupBy("scene").agg(F.count("*").alias("tracks"), r6(F.avg("surv") * 100).alias("survival"), F.count_if(F.col("surv") == 1).alias("survivors"))


def occlusion_accuracy(rows: DataFrame, key: str) -> DataFrame:
    """Agreement of visibilities after the query frame: over all, over hidden and over visible frames."""
    same = F.col("vis") == F.col("pvis")
    share = lambda part: F.try_divide(F.count_if(after_query() & part & same), F.count_if(after_query() & part))
    return rows.groupBy(key).agg(share(F.lit(True)).alias("oa"), share(~F.col("vis")).alias("oa_hidden"), share(F.col("vis")).alias("oa_visible"))


@query(f"""WITH {FOLLOWED}
SELECT track, round(count(*) FILTER (WHERE frame > qt AND vis = pvis) / nullif(count(*) FILTER (WHERE frame > qt), 0), 6) AS oa,
       round(count(*) FILTER (WHERE frame > qt AND NOT vis AND vis = pvis) / nullif(count(*) FILTER (WHERE frame > qt AND NOT vis), 0), 6) AS oa_hidden,
       round(count(*) FILTER (WHERE frame > qt AND vis AND vis = pvis) / nullif(count(*) FILTER (WHERE frame > qt AND vis), 0), 6) AS oa_visible
FROM followed GROUP BY track""")
def trk_occlusion(spark, sf_dir):
    found = occlusion_accuracy(followed(track_obs(spark, sf_dir)), "track")
    return found.select("track", *[r6(c).alias(c) for c in ("oa", "oa_hidden", "oa_visible")])


def by_threshold(rows: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    return rows.withColumn("thr", F.explode(F.array(*[F.lit(t) for t in thresholds])))


SQL_THRESHOLDS = "(SELECT unnest([5.0, 10.0, 20.0, 40.0, 80.0])::DOUBLE AS thr)"


@query(f"""WITH {FOLLOWED}, each AS (
SELECT track, thr, count(*) FILTER (WHERE frame > qt AND vis AND d < thr) / nullif(count(*) FILTER (WHERE frame > qt AND vis), 0) AS within
FROM followed, {SQL_THRESHOLDS} GROUP BY track, thr)
SELECT track, round(avg(within), 6) AS within, round(max(within) FILTER (WHERE thr = 10), 6) AS within_10 FROM each GROUP BY track""")
def trk_within(spark, sf_dir):
    rows = by_threshold(followed(track_obs(spark, sf_dir)))
    share = F.try_divide(F.count_if(after_query() & F.col("vis") & (F.col("d") < F.col("thr"))), F.count_if(after_query() & F.col("vis")))
    each = rows.groupBy("track", "thr").agg(share.alias("within"))
    return each.groupBy("track").agg(r6(F.avg("within")).alias("within"), r6(F.max(F.when(F.col("thr") == 10, F.col("within")))).alias("within_10"))


@query(f"""WITH {FOLLOWED}, each AS (SELECT track, thr, {JACCARD.format(t="thr")} AS jac FROM followed, {SQL_THRESHOLDS} GROUP BY track, thr)
SELECT track, round(avg(jac), 6) AS aj, round(max(jac) FILTER (WHERE thr = 5), 6) AS jac_5, round(max(jac) FILTER (WHERE thr = 80), 6) AS jac_80 FROM each GROUP BY track""")
def trk_jaccard(spark, sf_dir):
    each = by_threshold(followed(track_obs(spark, sf_dir))).groupBy("track", "thr").agg(jaccard(F.col("thr")).alias("jac"))
    at = lambda t: r6(F.max(F.when(F.col("thr") == t, F.col("jac"))))
    return each.groupBy("track").agg(r6(F.avg("jac")).alias("aj"), at(5).alias("jac_5"), at(80).alias("jac_80"))


@query(f"""WITH {FOLLOWED}, total AS (SELECT count(*) FILTER (WHERE frame > qt) AS n FROM followed)
SELECT scene, thr, round(count(*) FILTER (WHERE frame > qt AND vis = pvis) / any_value(n), 6) AS oa,
       round(count(*) FILTER (WHERE frame > qt AND vis AND (px - x) ** 2 + (py - y) ** 2 < thr ** 2) / nullif(count(*) FILTER (WHERE frame > qt AND vis), 0), 6) AS within,
       round({JACCARD.format(t="thr")}, 6) AS jac
FROM followed, {SQL_THRESHOLDS}, total GROUP BY scene, thr""")
def trk_original_variant(spark, sf_dir):
    """Metrics at the grain of a whole scene; occlusion accuracy divides by the points of all scenes."""
    rows = followed(track_obs(spark, sf_dir))
    total = rows.agg(F.count_if(after_query()).alias("n"))  # one row
    near = (F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2 < F.col("thr") ** 2
    return by_threshold(rows).crossJoin(F.broadcast(total)).groupBy("scene", "thr").agg(
        r6(F.count_if(after_query() & (F.col("vis") == F.col("pvis"))) / F.first("n")).alias("oa"),
        r6(F.try_divide(F.count_if(after_query() & F.col("vis") & near), F.count_if(after_query() & F.col("vis")))).alias("within"),
        r6(jaccard(F.col("thr"))).alias("jac"),
    )


@query(f"""WITH {FOLLOWED}, home AS (SELECT track, view AS home FROM followed WHERE frame = qt),
each AS (SELECT home, track, avg(d) FILTER (WHERE vis AND frame >= qt) AS ate, {JACCARD.format(t=CLOSE)} AS jac FROM followed JOIN home USING (track) GROUP BY home, track),
views AS (SELECT home, avg(ate) * 100 AS ate, avg(jac) * 100 AS jac, count(*) AS tracks FROM each GROUP BY home)
SELECT round(avg(ate), 6) AS ate, round(avg(jac), 6) AS jac, CAST(sum(tracks) AS BIGINT) AS tracks, count(*) AS views FROM views""")
def trk_per_view_mean(spark, sf_dir):
    """A track belongs to the view of its query frame; views weigh the same."""
    rows = followed(track_obs(spark, sf_dir))
    home = rows.filter("frame = qt").select("track", F.col("view").alias("home"))
    each = rows.join(home, "track").groupBy("home", "track").agg(F.avg(F.when(seen_from_query(), F.col("d"))).alias("ate"), jaccard(CLOSE).alias("jac"))
    views = each.groupBy("home").agg((F.avg("ate") * 100).alias("ate"), (F.avg("jac") * 100).alias("jac"), F.count("*").alias("tracks"))
    return views.agg(r6(F.avg("ate")).alias("ate"), r6(F.avg("jac")).alias("jac"), F.sum("tracks").alias("tracks"), F.count("*").alias("views"))


def path_visible(rows: DataFrame) -> DataFrame:
    """Path length over the visible frames from the query on, across gaps."""
    w = Window.partitionBy("track").orderBy("frame")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    return rows.filter(seen_from_query()).withColumn("step", step).groupBy("track").agg(F.first("scene").alias("scene"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"))


PATH_VISIBLE = """path_visible AS (SELECT track, any_value(scene) AS scene, coalesce(sum(step), 0) AS path FROM (
    SELECT track, scene, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM followed WHERE vis AND frame >= qt
    WINDOW w AS (PARTITION BY track ORDER BY frame)) GROUP BY track)"""


@query(f"WITH {FOLLOWED}, {PATH_VISIBLE} SELECT track, round(path, 6) AS path FROM path_visible")
def win_path_visible(spark, sf_dir):
    return path_visible(followed(track_obs(spark, sf_dir))).select("track", r6("path").alias("path"))


def path_adjacent(rows: DataFrame, *ok: str) -> DataFrame:
    """Path length over steps between neighbouring frames that both are ``ok``."""
    w = Window.partitionBy("track").orderBy("frame")
    both = F.lit(True)
    for c in ok:
        both &= F.col(c) & F.lag(c).over(w)
    step = F.when(both & (F.col("frame") == F.lag("frame").over(w) + 1), F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2))
    return rows.withColumn("step", step).groupBy("track").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.count("step").alias("steps"))


@query(f"""WITH {FOLLOWED} SELECT track, round(coalesce(sum(step), 0), 6) AS path, count(step) AS steps FROM (
SELECT track, CASE WHEN vis AND lag(vis) OVER w THEN sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) END AS step
FROM followed WINDOW w AS (PARTITION BY track ORDER BY frame)) GROUP BY track""")
def win_path_adjacent(spark, sf_dir):
    return path_adjacent(followed(track_obs(spark, sf_dir)), "vis").select("track", r6("path").alias("path"), "steps")


def motion_buckets(paths: DataFrame, static=STATIC, dynamic=DYNAMIC, very=VERY_DYNAMIC) -> DataFrame:
    """``paths`` once for each bucket that a path falls in: buckets overlap and leave a gap."""
    path = F.col("path")
    named = F.array_compact(F.array(F.lit("any"), F.when(path < static, "static"), F.when(path > dynamic, "dynamic"), F.when(path > very, "very_dynamic")))
    return paths.withColumn("bucket", F.explode(named))


BUCKETS = f"""buckets AS (SELECT p.*, b.bucket FROM path_visible p, LATERAL (SELECT unnest(list_filter(['any', CASE WHEN path < {STATIC} THEN 'static' END,
    CASE WHEN path > {DYNAMIC} THEN 'dynamic' END, CASE WHEN path > {VERY_DYNAMIC} THEN 'very_dynamic' END], lambda v: v IS NOT NULL)) AS bucket) b)"""


@query(f"WITH {FOLLOWED}, {PATH_VISIBLE}, {BUCKETS} SELECT scene, bucket, count(*) AS tracks, round(avg(path), 6) AS mean_path FROM buckets GROUP BY scene, bucket")
def agg_motion_buckets(spark, sf_dir):
    found = motion_buckets(path_visible(followed(track_obs(spark, sf_dir))))
    return found.groupBy("scene", "bucket").agg(F.count("*").alias("tracks"), r6(F.avg("path")).alias("mean_path"))


@query(f"""WITH {FOLLOWED}, {PATH_VISIBLE}, {BUCKETS}, ates AS (SELECT track, avg(d) FILTER (WHERE vis AND frame >= qt) AS ate FROM followed GROUP BY track),
wide AS (SELECT scene, avg(ate) FILTER (WHERE bucket = 'any') AS ate_any, avg(ate) FILTER (WHERE bucket = 'static') AS ate_static, avg(ate) FILTER (WHERE bucket = 'dynamic') AS ate_dynamic,
    count(*) FILTER (WHERE bucket = 'any') AS n, count(*) FILTER (WHERE bucket = 'dynamic') AS n_dynamic FROM buckets JOIN ates USING (track) GROUP BY scene)
SELECT scene, round(ate_any, 6) AS ate_any, round(ate_static, 6) AS ate_static, round(ate_dynamic, 6) AS ate_dynamic, round((ate_static + ate_dynamic) / 2, 6) AS ate_mean, n, round(100 * n_dynamic / n, 6) AS dynamic_share FROM wide""")
def agg_bucket_summary(spark, sf_dir):
    """Results of each population, and the mean of static and dynamic where both have tracks."""
    rows = followed(track_obs(spark, sf_dir))
    ates = rows.groupBy("track").agg(F.avg(F.when(seen_from_query(), F.col("d"))).alias("ate"))
    b = motion_buckets(path_visible(rows)).join(ates, "track")
    of = lambda k: F.avg(F.when(F.col("bucket") == k, F.col("ate")))
    wide = b.groupBy("scene").agg(of("any").alias("ate_any"), of("static").alias("ate_static"), of("dynamic").alias("ate_dynamic"), F.count_if(F.col("bucket") == "any").alias("n"), F.count_if(F.col("bucket") == "dynamic").alias("nd"))
    return wide.select("scene", r6("ate_any").alias("ate_any"), r6("ate_static").alias("ate_static"), r6("ate_dynamic").alias("ate_dynamic"), r6((F.col("ate_static") + F.col("ate_dynamic")) / 2).alias("ate_mean"), "n", r6(100 * F.col("nd") / F.col("n")).alias("dynamic_share"))


@query(f"""WITH {FOLLOWED}, {PATH_VISIBLE}, short AS (SELECT track, coalesce(sum(step), 0) AS cut FROM (
    SELECT track, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM followed WHERE vis AND frame >= qt AND frame < qt + 24 WINDOW w AS (PARTITION BY track ORDER BY frame)) GROUP BY track)
SELECT scene, round(avg(path), 6) AS full_mean, round(median(path), 6) AS full_median, round(quantile_cont(path, 0.9), 6) AS full_p90, round(avg(cut), 6) AS window_mean,
    round(median(cut), 6) AS window_median, count(*) FILTER (WHERE path > {DYNAMIC} AND cut < {STATIC}) AS dynamic_but_static FROM path_visible JOIN short USING (track) GROUP BY scene""")
def agg_motion_summary(spark, sf_dir):
    """Motion of whole tracks beside that of their first window of 24 frames."""
    rows = followed(track_obs(spark, sf_dir))
    short = path_visible(rows.filter("frame < qt + 24")).select("track", F.col("path").alias("cut"))
    both = path_visible(rows).join(short, "track")
    path, cut = F.col("path"), F.col("cut")
    plain = [r6(F.avg("path")).alias("full_mean"), r6(F.avg("cut")).alias("window_mean"), F.count_if((path > DYNAMIC) & (cut < STATIC)).alias("dynamic_but_static")]
    found = summarised(both, ["scene"], plain, {"full_median": (path, 0.5), "full_p90": (path, 0.9), "window_median": (cut, 0.5)})
    return found.withColumns({c: r6(c) for c in ("full_median", "full_p90", "window_median")})


@query(f"""WITH {FOLLOWED}, steps AS (SELECT track, scene, frame, d, x, px, vis, frame - qt AS age, row_number() OVER (PARTITION BY track ORDER BY frame) - 1 AS n FROM followed WHERE frame >= qt)
SELECT scene, round(sum(power(0.8::DOUBLE, 3 - i) * l) / 4, 6) AS loss FROM (
    SELECT scene, i, sum((abs(x - px) / (i + 1)) * CAST(vis AS INTEGER)) / (1e-6::DOUBLE + sum(CAST(vis AS INTEGER))) AS l FROM steps, (SELECT unnest(range(4)) AS i) GROUP BY scene, i) GROUP BY scene""")
def agg_sequence_loss(spark, sf_dir):
    """Masked L1 of four iterations, later ones weighing more; iteration i is taken to leave 1 / (i + 1) of the error."""
    rows = followed(track_obs(spark, sf_dir)).filter("frame >= qt").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    seen = F.col("vis").cast("int")
    each = rows.groupBy("scene", "i").agg((F.sum(F.abs(F.col("x") - F.col("px")) / (F.col("i") + 1) * seen) / (F.lit(1e-6) + F.sum(seen))).alias("l"))
    return each.groupBy("scene").agg(r6(F.sum(F.pow(F.lit(0.8), 3 - F.col("i")) * F.col("l")) / 4).alias("loss"))


@query(f"""WITH {FOLLOWED}, p AS (SELECT scene, vis, CASE WHEN vis THEN 1.0 ELSE -1.0 END::DOUBLE * (10 - d) / 10 AS m FROM followed)
SELECT scene, round((avg(ln(1 + exp(-m))) FILTER (WHERE vis) + avg(ln(1 + exp(-m))) FILTER (WHERE NOT vis)) / 2, 6) AS loss FROM p GROUP BY scene""")
def agg_balanced_logistic(spark, sf_dir):
    """Logistic loss of a visibility score, visible and hidden frames weighing the same."""
    m = F.when(F.col("vis"), 1.0).otherwise(-1.0) * (10 - F.col("d")) / 10
    loss = F.log(1 + F.exp(-m))
    return followed(track_obs(spark, sf_dir)).groupBy("scene").agg(r6((F.avg(F.when(F.col("vis"), loss)) + F.avg(F.when(~F.col("vis"), loss))) / 2).alias("loss"))


@query(f"""WITH {FOLLOWED}, each AS (SELECT scene, track, avg(d) FILTER (WHERE vis AND frame >= qt) AS ate, {JACCARD.format(t=CLOSE)} AS jac FROM followed GROUP BY scene, track),
seqs AS (SELECT scene, round_even(avg(ate) * 100, 2) AS ate, round_even(avg(jac) * 100, 2) AS jac FROM each GROUP BY scene)
SELECT metric, round_even(avg(value), 2) AS value FROM (UNPIVOT seqs ON ate, jac INTO NAME metric VALUE value) GROUP BY metric""")
def agg_eval_average(spark, sf_dir):
    """Rounded per sequence, then averaged and rounded over sequences, as key and score."""
    rows = followed(track_obs(spark, sf_dir))
    each = rows.groupBy("scene", "track").agg(F.avg(F.when(seen_from_query(), F.col("d"))).alias("ate"), jaccard(CLOSE).alias("jac"))
    seqs = each.groupBy("scene").agg(F.bround(F.avg("ate") * 100, 2).alias("ate"), F.bround(F.avg("jac") * 100, 2).alias("jac"))
    return seqs.unpivot("scene", ["ate", "jac"], "metric", "value").groupBy("metric").agg(F.bround(F.avg("value"), 2).alias("value"))


@query(f"WITH {FOLLOWED} SELECT track, count(*) AS rows, count(*) FILTER (WHERE vis) AS seen FROM followed WHERE frame >= qt GROUP BY track")
def flt_after_query(spark, sf_dir):
    return followed(track_obs(spark, sf_dir)).filter("frame >= qt").groupBy("track").agg(F.count("*").alias("rows"), F.count_if("vis").alias("seen"))


@query(f"WITH {FOLLOWED} SELECT track, frame, event_id FROM followed WHERE frame > qt AND vis")
def flt_eval_points_first(spark, sf_dir):
    return followed(track_obs(spark, sf_dir)).filter("frame > qt AND vis").select("track", "frame", "event_id")


@query(f"WITH {FOLLOWED} SELECT track, frame, event_id FROM followed WHERE frame <> qt AND vis")
def flt_eval_points_strided(spark, sf_dir):
    return followed(track_obs(spark, sf_dir)).filter("frame != qt AND vis").select("track", "frame", "event_id")


__all__ = ["number", "trajectory_errors", "occlusion_accuracy", "path_visible", "path_adjacent", "motion_buckets"]
