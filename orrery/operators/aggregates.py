"""Aggregations: masked statistics, residual summaries, correlation, verdicts, pooling.

Statistics of a group are Spark aggregates with partial aggregation wherever the statistic
allows it. Percentiles of groups that may be a large part of a table come from ``quantiles``, by rank in
ranges; those of single tracks use Spark's own buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, r6
from ..sources.checkpoints import ready
from .quantiles import exact_quantiles, grain_summary, looked_up, ranked, running_counts, summarised
from ..sources.views import (
    FOLLOWED, METRICS, POINTS, RESIDUAL, SCALARS, TRACK_OBS, followed, hashed, hashed_sql, metrics, points, residual, scalars, table, track_obs,
)


def masked_mean(x: Column, mask: Column) -> Column:
    m = mask.cast("int")
    return F.sum(x * m) / (F.lit(1e-6) + F.sum(m))


@query(f"WITH {TRACK_OBS} SELECT track, round(sum(x * CAST(vis AS INTEGER)) / (1e-6::DOUBLE + sum(CAST(vis AS INTEGER))), 6) AS mean FROM track_obs GROUP BY track")
def agg_masked_mean(spark, sf_dir):
    return track_obs(spark, sf_dir).groupBy("track").agg(r6(masked_mean(F.col("x"), F.col("vis"))).alias("mean"))


@query(f"WITH {TRACK_OBS} SELECT track, view, round(median(x) FILTER (WHERE NOT vis), 6) AS median FROM track_obs GROUP BY track, view")
def agg_masked_median(spark, sf_dir):
    return track_obs(spark, sf_dir).groupBy("track", "view").agg(r6(F.median(F.when(~F.col("vis"), F.col("x")))).alias("median"))


@query(f"WITH {TRACK_OBS}, t AS (SELECT scene, track, avg(x) AS m FROM track_obs WHERE vis GROUP BY scene, track), s AS (SELECT scene, avg(m) AS m FROM t GROUP BY scene) SELECT round(avg(m), 6) AS mean, count(*) AS scenes FROM s")
def agg_two_level_mean(spark, sf_dir):
    t = track_obs(spark, sf_dir).filter("vis").groupBy("scene", "track").agg(F.avg("x").alias("m"))
    return t.groupBy("scene").agg(F.avg("m").alias("m")).agg(r6(F.avg("m")).alias("mean"), F.count("*").alias("scenes"))


@query(f"WITH {TRACK_OBS}, n AS (SELECT track, CASE WHEN vis THEN x ELSE 'NaN'::DOUBLE END AS v FROM track_obs) SELECT track, round(avg(CASE WHEN NOT isnan(v) THEN v END) * 100, 6) AS mean FROM n GROUP BY track")
def agg_nanmean(spark, sf_dir):
    v = F.when(F.col("vis"), F.col("x")).otherwise(F.lit(float("nan")))
    return track_obs(spark, sf_dir).withColumn("v", v).groupBy("track").agg(r6(F.avg(F.when(~F.isnan("v"), F.col("v"))) * 100).alias("mean"))


@query(f"WITH {TRACK_OBS} SELECT track, round(quantile_disc(x, 0.5), 6) AS median FROM track_obs GROUP BY track")
def agg_lower_median(spark, sf_dir):
    return track_obs(spark, sf_dir).groupBy("track").agg(r6(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)")).alias("median"))


@query(f"WITH {TRACK_OBS}, n AS (SELECT track, x, row_number() OVER (PARTITION BY track ORDER BY x) AS k, count(*) OVER (PARTITION BY track) AS n FROM track_obs) SELECT track, round(x, 6) AS median FROM n WHERE k = n // 2 + 1")
def agg_upper_median(spark, sf_dir):
    w = Window.partitionBy("track")
    n = track_obs(spark, sf_dir).select("track", "x", F.row_number().over(w.orderBy("x")).alias("k"), F.count("*").over(w).alias("n"))
    return n.filter("k = n div 2 + 1").select("track", r6("x").alias("median"))


def nearest_rank(rows: DataFrame, key: str, value: str, fraction: float) -> DataFrame:
    """``sorted[min(n - 1, max(0, int(n * f) - 1))]`` of each key, by ranks in ranges."""
    placed = ranked(rows.select(key, value), [key], [F.col(value)], "__k")
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    wanted = n.select(key, (F.least(F.col("__n"), F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(fraction)))) - 1).cast("long").alias("__k"))
    return placed.join(wanted, [key, "__k"]).select(key, value)


@query(f"WITH {RESIDUAL}, n AS (SELECT view, r, row_number() OVER (PARTITION BY view ORDER BY r) AS k, count(*) OVER (PARTITION BY view) AS n FROM residual) SELECT view, round(r, 6) AS p90 FROM n WHERE k = least(n, greatest(1, CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT)))")
def agg_nearest_rank(spark, sf_dir):
    return nearest_rank(residual(spark, sf_dir), "view", "r", 0.9).select("view", r6("r").alias("p90"))


LEVELS = (0.5, 0.9, 0.95, 0.99, 0.999)


def residual_summary(rows: DataFrame, keys: list[str], *grains: tuple[str, ...]) -> DataFrame:
    """Count, mean, RMSE, percentiles, largest, share within 0.05 of |r|, and signed percentiles, at ``grains`` of ``keys``."""
    a, r = F.abs("r"), F.col("r")
    plain = [
        F.count("r").alias("n"), r6(F.avg(a)).alias("mean"), r6(F.sqrt(F.avg(r * r))).alias("rmse"), r6(F.max(a)).alias("largest"), r6(F.avg((a <= 0.05).cast("double"))).alias("within"),
    ]
    names = {f"p{str(p)[2:].ljust(2, '0')}": (a, p) for p in LEVELS} | {"signed_p01": (r, 0.01), "signed_p50": (r, 0.5)}
    found = grain_summary(rows, list(grains), keys, plain, names)
    return found.select(*keys, "grain", *[c for c in ("n", "mean", "rmse", "largest", "within")], *[r6(c).alias(c) for c in names])


SUMMARY = ", ".join(
    ["count(r) AS n", "round(avg(abs(r)), 6) AS mean", "round(sqrt(avg(r * r)), 6) AS rmse"]
    + [f"round(quantile_cont(abs(r), {p}), 6) AS p{str(p)[2:].ljust(2, '0')}" for p in LEVELS]
    + ["round(max(abs(r)), 6) AS largest", "round(avg(CAST(abs(r) <= 0.05 AS DOUBLE)), 6) AS within", "round(quantile_cont(r, 0.01), 6) AS signed_p01", "round(quantile_cont(r, 0.5), 6) AS signed_p50"]
)


@query(f"WITH {RESIDUAL} SELECT layout, mode, {SUMMARY} FROM residual GROUP BY layout, mode")
def agg_residual_summary(spark, sf_dir):
    return residual_summary(residual(spark, sf_dir), ["layout", "mode"], ("layout", "mode")).drop("grain")


@query(f"WITH {RESIDUAL} SELECT layout, mode, view, CAST(grouping(layout, mode, view) AS BIGINT) AS grain, {SUMMARY} FROM residual GROUP BY GROUPING SETS ((layout, mode), (view, mode), ())")
def agg_grouping_sets_summary(spark, sf_dir):
    """The same summary at several grains, from counts at the finest one."""
    return residual_summary(residual(spark, sf_dir), ["layout", "mode", "view"], ("layout", "mode"), ("view", "mode"), ())


@query(f"WITH {RESIDUAL}, o AS (SELECT layout, view - 4 AS off, avg(abs(r)) AS v FROM residual GROUP BY layout, view) SELECT layout, arg_min(off, struct_pack(a := round(v, 6), b := abs(off), c := off)) AS best FROM o GROUP BY layout")
def agg_argmin_tiebreak(spark, sf_dir):
    """The offset of the least residual; ties go to the nearer offset, then the smaller."""
    o = residual(spark, sf_dir).groupBy("layout", (F.col("view") - 4).alias("off")).agg(F.avg(F.abs("r")).alias("v"))
    return o.groupBy("layout").agg(F.min_by("off", F.struct(F.round("v", 6), F.abs("off"), F.col("off"))).alias("best"))


@query(f"WITH {FOLLOWED} SELECT scene, count(d) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.999), 6) AS p999, round(max(d), 6) AS largest FROM followed GROUP BY scene")
def agg_distribution(spark, sf_dir):
    d = F.col("d")
    found = summarised(followed(track_obs(spark, sf_dir)), ["scene"], [F.count("d").alias("n"), r6(F.avg("d")).alias("mean"), r6(F.max("d")).alias("largest")], {"p50": (d, 0.5), "p90": (d, 0.9), "p999": (d, 0.999)})
    return found.select("scene", "n", "mean", *[r6(c).alias(c) for c in ("p50", "p90", "p999")], "largest")


@query(f"""WITH {RESIDUAL} SELECT view, mode, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS least, round(quantile_cont(r, 0.25), 6) AS q25,
round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.75), 6) AS q75, round(max(r), 6) AS largest FROM residual GROUP BY GROUPING SETS ((view), (view, mode))""")
def agg_describe(spark, sf_dir):
    r = F.col("r")
    plain = [F.count("r").alias("n"), r6(F.avg("r")).alias("mean"), r6(F.stddev_samp("r")).alias("std"), r6(F.min("r")).alias("least"), r6(F.max("r")).alias("largest")]
    found = grain_summary(residual(spark, sf_dir), [("view",), ("view", "mode")], ["view", "mode"], plain, {"q25": (r, 0.25), "q50": (r, 0.5), "q75": (r, 0.75)})
    return found.select("view", "mode", "n", "mean", "std", "least", *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "largest")


def spearman(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rank correlation of finite pairs with average ranks; groups of fewer than three pairs are left out.

    Ranks come from counts of distinct values, summed in ranges, and meet distinct pairs in
    salted groups: a value that a third of the pairs have is one row of counts. Distinct pairs
    are counted and written once, so that the input is read once.
    """
    ready(rows.sparkSession)
    ok = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).groupBy(key, x, y).agg(F.count("*").alias("n")).checkpoint()

    def ranks(c: str) -> DataFrame:
        upto = running_counts(ok.groupBy(key, c).agg(F.sum("n").alias("n")), [key], c, "upto")
        return upto.select(key, c, (F.col("upto") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    both = looked_up(looked_up(ok, ranks(x), [key, x]), ranks(y), [key, y])
    a, b, n = F.col(f"rank_{x}"), F.col(f"rank_{y}"), F.col("n")
    # Ranks of both sides have one mean, so moments about it stay small.
    middle = both.join(ok.groupBy(key).agg(((F.sum("n") + 1) / 2).alias("middle")), key).withColumns({"a": a - F.col("middle"), "b": b - F.col("middle")})
    a, b = F.col("a"), F.col("b")
    rho = F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a) * F.sum(n * b * b)))
    return middle.groupBy(key).agg(F.sum("n").alias("n"), rho.alias("rho")).filter("n >= 3")


@query("""WITH r AS (SELECT l_returnflag AS layout, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT layout, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY layout HAVING count(*) >= 3""")
def agg_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("layout"), "l_quantity", "l_extendedprice")
    return spearman(rows, "layout", "l_quantity", "l_extendedprice").select("layout", "n", r6("rho").alias("rho"))


@query(f"WITH {SCALARS} SELECT step % 10 AS scene, count(*) FILTER (WHERE NOT isnan(value)) AS n, round(median(value) FILTER (WHERE NOT isnan(value)), 6) AS median, round(quantile_cont(value, 0.9) FILTER (WHERE NOT isnan(value)), 6) AS p90 FROM scalars GROUP BY step % 10")
def agg_scene_loss_summary(spark, sf_dir):
    rows = scalars(spark, sf_dir).select((F.col("step") % 10).alias("scene"), F.when(~F.isnan("value"), F.col("value")).alias("v"))
    found = summarised(rows, ["scene"], [F.count("v").alias("n")], {"median": (F.col("v"), 0.5), "p90": (F.col("v"), 0.9)})
    return found.select("scene", "n", r6("median").alias("median"), r6("p90").alias("p90"))


@query(f"WITH {METRICS} SELECT method, dataset, round(sum(value) FILTER (WHERE metric = 'F'), 4) AS F, round(sum(value) FILTER (WHERE metric = 'O'), 4) AS O, round(sum(value) FILTER (WHERE metric = 'P'), 4) AS P FROM metrics GROUP BY method, dataset")
def agg_pivot_methods(spark, sf_dir):
    p = metrics(spark, sf_dir).groupBy("method", "dataset").pivot("metric", ["F", "O", "P"]).agg(F.sum("value"))
    return p.select("method", "dataset", *[F.round(c, 4).alias(c) for c in ("F", "O", "P")])


@query("SELECT l_orderkey AS sample, coalesce(max(l_quantity) FILTER (WHERE l_linenumber = 1), -1) AS rgb, coalesce(max(l_quantity) FILTER (WHERE l_linenumber = 2), -1) AS depth, coalesce(max(l_quantity) FILTER (WHERE l_linenumber = 7), -1) AS mask FROM lineitem GROUP BY l_orderkey")
def agg_pivot_components(spark, sf_dir):
    """Offsets by component, -1 where a component is absent."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).pivot("l_linenumber", [1, 2, 7]).agg(F.max("l_quantity"))
    return p.select("sample", *[F.coalesce(F.col(f"`{k}`"), F.lit(-1.0)).alias(c) for k, c in ((1, "rgb"), (2, "depth"), (7, "mask"))])


@query("SELECT c_nationkey::BIGINT AS source, count(*) AS observations, count(DISTINCT c_mktsegment) AS scenes, count(DISTINCT (c_mktsegment, c_custkey % 5)) AS starts, list_sort(list(DISTINCT c_custkey % 5)) AS sorted_starts FROM customer GROUP BY c_nationkey")
def agg_diversity(spark, sf_dir):
    start = F.col("c_custkey") % 5
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("source")).agg(
        F.count("*").alias("observations"), F.count_distinct("c_mktsegment").alias("scenes"), F.count_distinct("c_mktsegment", start).alias("starts"), F.sort_array(F.collect_set(start)).alias("sorted_starts")
    )


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(lower(text)) ORDER BY min(doc_id) LIMIT 200")
def agg_dedupe_first(spark, sf_dir):
    """The first of each identity, in order, until 200 are found."""
    first = table(spark, sf_dir, "documents").groupBy(F.md5(F.lower("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return first.select("doc_id", "copies").orderBy("doc_id").limit(200)


@query(f"""WITH {TRACK_OBS}, s AS (SELECT track, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM track_obs WINDOW w AS (PARTITION BY track ORDER BY frame)), m AS (SELECT track, avg(step) AS motion FROM s GROUP BY track)
SELECT CASE WHEN motion < 60 THEN 0 WHEN motion < 75 THEN 1 ELSE 2 END::BIGINT AS class, count(*) AS objects FROM m GROUP BY 1""")
def agg_object_class(spark, sf_dir):
    """Objects by their mean step length, in three classes."""
    w = Window.partitionBy("track").orderBy("frame")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    m = track_obs(spark, sf_dir).withColumn("step", step).groupBy("track").agg(F.avg("step").alias("motion"))
    return m.groupBy(F.when(F.col("motion") < 60, 0).when(F.col("motion") < 75, 1).otherwise(2).cast("long").alias("class")).agg(F.count("*").alias("objects"))


@query(f"WITH {SCALARS} SELECT tag, count(*) AS rows, count(DISTINCT step) AS steps, round(sum(value), 4) AS total, min(value) AS least, max(value) AS largest, count(*) FILTER (WHERE value > 100) AS above FROM scalars WHERE isfinite(value) GROUP BY tag")
def agg_reconcile_totals(spark, sf_dir):
    return scalars(spark, sf_dir).filter(~F.isnan("value") & (F.abs("value") < float("inf"))).groupBy("tag").agg(
        F.count("*").alias("rows"), F.count_distinct("step").alias("steps"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("largest"), F.count_if(F.col("value") > 100).alias("above")
    )


@query(f"WITH {TRACK_OBS} SELECT track, view, count(*) AS candidates, count(*) FILTER (WHERE NOT pvis) AS failures FROM track_obs GROUP BY track, view HAVING count(*) FILTER (WHERE NOT pvis) / count(*) > 0.25::DOUBLE")
def agg_majority_vote(spark, sf_dir):
    """Views whose share of failures is above a limit, strictly."""
    v = track_obs(spark, sf_dir).groupBy("track", "view").agg(F.count("*").alias("candidates"), F.count_if(~F.col("pvis")).alias("failures"))
    return v.filter(F.try_divide(F.col("failures"), F.col("candidates")) > 0.25)


@query(f"WITH {SCALARS} SELECT tag, round(count(*) / CAST(nullif(max(step) - min(step), 0) AS DOUBLE), 6) AS rows_per_step, round(sum(value) / CAST(nullif(max(step) - min(step), 0) AS DOUBLE), 6) AS value_per_step FROM scalars GROUP BY tag")
def agg_throughput(spark, sf_dir):
    span = F.max("step") - F.min("step")
    return scalars(spark, sf_dir).groupBy("tag").agg(r6(F.try_divide(F.count("*"), span)).alias("rows_per_step"), r6(F.try_divide(F.sum("value"), span)).alias("value_per_step"))


DELTAS = f"{METRICS}, deltas AS (SELECT dataset, metric, sequence, max(value) FILTER (WHERE method = 'candidate') - max(value) FILTER (WHERE method = 'original') AS delta FROM metrics GROUP BY ALL)"


def deltas(spark, sf_dir) -> DataFrame:
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    return metrics(spark, sf_dir).groupBy("dataset", "metric", "sequence").agg((of("candidate") - of("original")).alias("delta"))


def bootstrap_means(rows: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """Means of resamples with replacement, by hashing: draw j of resample b takes row hash(b, j) mod n.

    A row is drawn as often as its place is hit, so each row meets its draws by an equality join.
    """
    placed = ranked(rows, keys, [F.col("sequence")], "place")
    placed = looked_up(placed, rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    draws = placed.select(*keys, "n", F.col("place").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    drawn = draws.withColumn("place", F.floor(hashed("boot", F.concat_ws("-", "b", "j")) * F.col("n")).cast("long"))
    return drawn.drop("n").join(placed.drop("n"), [*keys, "place"]).groupBy(*keys, "b").agg(F.avg("delta").alias("mean"))


BOOT = f"""{DELTAS}, placed AS (SELECT *, row_number() OVER (PARTITION BY dataset, metric ORDER BY sequence) - 1 AS place, count(*) OVER (PARTITION BY dataset, metric) AS n FROM deltas),
draws AS (SELECT dataset, metric, b, CAST(floor({hashed_sql("boot", "concat_ws('-', b, place)")} * n) AS BIGINT) AS at FROM placed, (SELECT unnest(range(200)) AS b)),
boot AS (SELECT d.dataset, d.metric, b, avg(delta) AS mean FROM draws d JOIN placed p ON p.dataset = d.dataset AND p.metric = d.metric AND p.place = d.at GROUP BY ALL),
ci AS (SELECT dataset, metric, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot GROUP BY dataset, metric)"""


@query(f"WITH {BOOT} SELECT dataset, metric, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci")
def agg_bootstrap_ci(spark, sf_dir):
    return confidence(deltas(spark, sf_dir)).select("dataset", "metric", r6("lo").alias("lo"), r6("hi").alias("hi"))


def confidence(rows: DataFrame) -> DataFrame:
    means = bootstrap_means(rows, ["dataset", "metric"], 200)
    return means.groupBy("dataset", "metric").agg(F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))


def verdict(lo: Column, hi: Column, margin: float) -> Column:
    """Of a degradation's confidence interval."""
    return F.when(hi < margin, "non-regressed").when(lo > margin, "regressed").otherwise("inconclusive")


@query(f"""WITH {BOOT} SELECT dataset, metric, CASE WHEN round(-lo, 6) < 0.05 THEN 'non-regressed' WHEN round(-hi, 6) > 0.05 THEN 'regressed' ELSE 'inconclusive' END AS verdict,
count(*) FILTER (WHERE delta > 0) AS improved, count(*) FILTER (WHERE delta < 0) AS degraded FROM ci JOIN deltas USING (dataset, metric) GROUP BY dataset, metric, lo, hi""")
def agg_regression_verdict(spark, sf_dir):
    """Higher is better here, so a degradation is minus the delta."""
    d = deltas(spark, sf_dir)
    counts = d.groupBy("dataset", "metric").agg(F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("degraded"))
    ci = confidence(d)
    return ci.join(counts, ["dataset", "metric"]).select("dataset", "metric", verdict(r6(-F.col("hi")), r6(-F.col("lo")), 0.05).alias("verdict"), "improved", "degraded")


@query(f"""WITH {POINTS} SELECT CAST(floor((x + 1) * 4) AS BIGINT) AS gx, CAST(floor((y + 1) * 4) AS BIGINT) AS gy, CAST(floor((z + 1) * 4) AS BIGINT) AS gz, count(*) AS n, round(avg(x), 6) AS x, round(max(fvec[4]), 6) AS feature, min_by(id, id) AS head FROM points GROUP BY 1, 2, 3""")
def agg_grid_pool(spark, sf_dir):
    g = lambda c: F.floor((F.col(c) + 1) * 4).cast("long")
    p = points(spark, sf_dir).withColumns({"gx": g("x"), "gy": g("y"), "gz": g("z")})
    return p.groupBy("gx", "gy", "gz").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("x"), r6(F.max(F.element_at("fvec", 4))).alias("feature"), F.min("id").alias("head"))


@query(f"""WITH {TRACK_OBS}, p AS (SELECT track // 2 AS a, frame // 2 AS b, avg(x) AS v FROM track_obs GROUP BY 1, 2) SELECT a // 2 AS a, b // 2 AS b, round(avg(v), 6) AS v FROM p GROUP BY 1, 2""")
def agg_pool_2x2(spark, sf_dir):
    """Two levels of 2 x 2 mean pooling."""
    half = lambda c, n: F.floor(F.col(c) / 2).cast("long").alias(n)
    p = track_obs(spark, sf_dir).groupBy(half("track", "a"), half("frame", "b")).agg(F.avg("x").alias("v"))
    return p.groupBy(half("a", "c"), half("b", "d")).agg(r6(F.avg("v")).alias("v")).withColumnsRenamed({"c": "a", "d": "b"})


@query(f"""WITH {FOLLOWED}, f AS (SELECT scene, frame, sqrt(avg((x - px) ** 2)) AS rmse FROM followed GROUP BY scene, frame)
SELECT scene, round(avg(rmse), 6) AS rmse, round(max(rmse), 6) AS rmse_max, round(any_value(mae), 6) AS mae, round(any_value(med), 6) AS median_error, round(any_value(rel), 6) AS abs_rel, round(any_value(valid), 6) AS valid, round(any_value(ratio), 6) AS ratio
FROM f JOIN (SELECT scene, avg(abs(x - px)) FILTER (WHERE pvis) AS mae, median(abs(x - px)) AS med, avg(abs(x - px) / x) FILTER (WHERE x > 1) AS rel, avg(CAST(pvis AS DOUBLE)) AS valid, median(px / x) FILTER (WHERE x > 1) AS ratio FROM followed GROUP BY scene) USING (scene) GROUP BY scene""")
def agg_depth_quality(spark, sf_dir):
    """Error statistics of an estimate: valid share, MAE, median error, AbsRel, median ratio, and RMSE per frame."""
    rows = followed(track_obs(spark, sf_dir))
    e = F.abs(F.col("x") - F.col("px"))
    frames = rows.groupBy("scene", "frame").agg(F.sqrt(F.avg((F.col("x") - F.col("px")) ** 2)).alias("rmse")).groupBy("scene").agg(r6(F.avg("rmse")).alias("rmse"), r6(F.max("rmse")).alias("rmse_max"))
    far = F.col("x") > 1
    plain = [r6(F.avg(F.when(F.col("pvis"), e))).alias("mae"), r6(F.avg(F.when(far, F.try_divide(e, F.col("x"))))).alias("abs_rel"), r6(F.avg(F.col("pvis").cast("double"))).alias("valid")]
    whole = summarised(rows, ["scene"], plain, {"median_error": (e, 0.5), "ratio": (F.when(far, F.try_divide(F.col("px"), F.col("x"))), 0.5)})
    return frames.join(whole, "scene").withColumns({"median_error": r6("median_error"), "ratio": r6("ratio")})


@query(f"WITH {POINTS}, n AS (SELECT id, batch, sqrt(list_sum(list_transform(fvec, lambda v: v * v))) AS norm FROM points) SELECT batch, round(sqrt(sum(norm * norm)), 6) AS total, round(max(norm), 6) AS largest, round(avg(CAST(norm > 1 AS DOUBLE)), 6) AS clipped FROM n GROUP BY batch")
def agg_norm_clip(spark, sf_dir):
    """The norm of a gradient from its parts' norms, and the share above a clip."""
    norm = F.sqrt(F.aggregate("fvec", F.lit(0.0), lambda s, v: s + v * v))
    return points(spark, sf_dir).withColumn("norm", norm).groupBy("batch").agg(r6(F.sqrt(F.sum(F.col("norm") ** 2))).alias("total"), r6(F.max("norm")).alias("largest"), r6(F.avg((F.col("norm") > 1).cast("double"))).alias("clipped"))


@query(f"WITH {POINTS} SELECT batch, round(quantile_cont(sqrt(x * x + y * y), 0.9), 6) AS radius_p90, round(avg(z), 6) AS mean_z, round(quantile_cont(z, 0.25), 6) AS q25, round(quantile_cont(z, 0.75), 6) AS q75, round(avg(CAST(z < 0 AS DOUBLE)), 6) AS below FROM points GROUP BY batch")
def agg_scene_statistics(spark, sf_dir):
    z, radius = F.col("z"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    plain = [r6(F.avg("z")).alias("mean_z"), r6(F.avg((z < 0).cast("double"))).alias("below")]
    found = summarised(points(spark, sf_dir), ["batch"], plain, {"radius_p90": (radius, 0.9), "q25": (z, 0.25), "q75": (z, 0.75)})
    return found.select("batch", "mean_z", "below", *[r6(c).alias(c) for c in ("radius_p90", "q25", "q75")])


@query(f"""WITH {RESIDUAL}, b AS (SELECT ordinal, min_by(r, abs(r)) AS best, max(r) FILTER (WHERE view = 1) AS nearest FROM residual GROUP BY ordinal)
SELECT count(*) AS n, round(avg(abs(best)), 6) AS best_mean, round(quantile_cont(abs(best), 0.95), 6) AS best_p95, round(avg(abs(nearest)), 6) AS nearest_mean, round(max(abs(nearest)), 6) AS nearest_max FROM b""")
def agg_residual_distribution(spark, sf_dir):
    """Residuals at the nearest place and at the best of its neighbourhood."""
    b = residual(spark, sf_dir).groupBy("ordinal").agg(F.min_by("r", F.abs("r")).alias("best"), F.max(F.when(F.col("view") == 1, F.col("r"))).alias("nearest"))
    p95 = exact_quantiles(b.select(F.abs("best").alias("a")), [], "a", [0.95]).select(r6("quantile").alias("best_p95"))
    whole = b.agg(F.count("*").alias("n"), r6(F.avg(F.abs("best"))).alias("best_mean"), r6(F.avg(F.abs("nearest"))).alias("nearest_mean"), r6(F.max(F.abs("nearest"))).alias("nearest_max"))
    return whole.crossJoin(F.broadcast(p95))  # one row each


@query(f"""WITH {POINTS}, c AS (SELECT batch, avg(x) AS cx, avg(y) AS cy, quantile_cont(z, 0.12) AS floor_z FROM points GROUP BY batch), d AS (SELECT batch, quantile_disc(sqrt((x - cx) ** 2 + (y - cy) ** 2), 0.5) AS m FROM points JOIN c USING (batch) GROUP BY batch)
SELECT batch, round(cx, 6) AS cx, round(cy, 6) AS cy, round(floor_z, 6) AS floor_z, round(12 / m, 6) AS scale FROM c JOIN d USING (batch)""")
def agg_scene_normalise(spark, sf_dir):
    """Centroid, floor height and the scale that brings the median distance to 12."""
    p = points(spark, sf_dir)
    c = summarised(p, ["batch"], [F.avg("x").alias("cx"), F.avg("y").alias("cy")], {"floor_z": (F.col("z"), 0.12)})
    far = looked_up(p.select("batch", "id", "x", "y"), c, ["batch"]).withColumn("r", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))
    m = exact_quantiles(far, ["batch"], "r", [0.5], discrete=True).select("batch", F.col("quantile").alias("m"))
    return c.join(m, "batch").select("batch", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("floor_z").alias("floor_z"), r6(12 / F.col("m")).alias("scale"))


@query(f"WITH {TRACK_OBS} SELECT track, frame // 4 AS cell, round(sum((1 + frame % 4) * CAST(vis AS INTEGER) * x) / nullif(sum((1 + frame % 4) * CAST(vis AS INTEGER)), 0), 6) AS value FROM track_obs GROUP BY track, frame // 4")
def agg_validity_weighted(spark, sf_dir):
    w = (1 + F.col("frame") % 4) * F.col("vis").cast("int")
    return track_obs(spark, sf_dir).groupBy("track", F.floor(F.col("frame") / 4).cast("long").alias("cell")).agg(r6(F.try_divide(F.sum(w * F.col("x")), F.sum(w))).alias("value"))


@query(f"WITH {SCALARS}, p AS (SELECT tag, step % 7 AS pid, greatest(0, arg_max(value, ordinal) - arg_min(value, ordinal)) AS moved, max(value) AS peak FROM scalars GROUP BY ALL) SELECT tag, round(sum(moved), 6) AS moved, max(peak) AS peak FROM p GROUP BY tag")
def agg_counter_delta(spark, sf_dir):
    """What counters moved between a process's first and last sample, never below zero."""
    p = scalars(spark, sf_dir).groupBy("tag", (F.col("step") % 7).alias("pid")).agg(F.greatest(F.lit(0.0), F.max_by("value", "ordinal") - F.min_by("value", "ordinal")).alias("moved"), F.max("value").alias("peak"))
    return p.groupBy("tag").agg(r6(F.sum("moved")).alias("moved"), F.max("peak").alias("peak"))


@query(f"WITH {TRACK_OBS} SELECT view, count(*) FILTER (WHERE vis) AS ok, round(count(*) FILTER (WHERE vis) / count(*), 6) AS success, min(track) AS first_track, max(track) AS last_track, round(avg(CAST(pvis AS DOUBLE)), 6) AS visibility FROM track_obs GROUP BY view")
def agg_lane_summary(spark, sf_dir):
    return track_obs(spark, sf_dir).groupBy("view").agg(F.count_if("vis").alias("ok"), r6(F.try_divide(F.count_if("vis"), F.count("*"))).alias("success"), F.min("track").alias("first_track"), F.max("track").alias("last_track"), r6(F.avg(F.col("pvis").cast("double"))).alias("visibility"))


@query("SELECT p_brand AS sequence, count(DISTINCT p_size) AS sizes, count(DISTINCT p_type) AS types, count(DISTINCT p_size) >= 8 AND count(DISTINCT p_type) >= 3 AS covered FROM part GROUP BY p_brand")
def agg_cover_check(spark, sf_dir):
    """Whether each sequence has the parts that it must have."""
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("sequence")).agg(F.count_distinct("p_size").alias("sizes"), F.count_distinct("p_type").alias("types"))
    return c.withColumn("covered", (F.col("sizes") >= 8) & (F.col("types") >= 3))


@query(f"WITH {TRACK_OBS}, s AS (SELECT track, frame // 3 AS point, view, CASE WHEN vis THEN round(px - x, 6) ELSE -1e4 END AS score FROM track_obs) SELECT track, point, arg_max(view, struct_pack(a := score, b := -view)) AS best FROM s GROUP BY track, point")
def agg_argmax_view(spark, sf_dir):
    """The view with the best score, hidden ones last, ties to the smallest view."""
    score = F.when(F.col("vis"), F.round(F.col("px") - F.col("x"), 6)).otherwise(-1e4)
    return track_obs(spark, sf_dir).groupBy("track", F.floor(F.col("frame") / 3).cast("long").alias("point")).agg(F.max_by("view", F.struct(score, -F.col("view"))).alias("best"))


@query(f"WITH {SCALARS} SELECT tag, step, arg_max(value, ordinal) AS value FROM scalars WHERE isfinite(value) GROUP BY tag, step")
def agg_last_wins_by_step(spark, sf_dir):
    ok = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return scalars(spark, sf_dir).filter(ok).groupBy("tag", "step").agg(F.max_by("value", "ordinal").alias("value"))


@query("""WITH w AS (SELECT coalesce(CASE WHEN event_id % 4 > 0 THEN event_id % 50 END, event_id % 60) AS step, value AS loss, value * 2 AS rate, event_id FROM events), u AS (SELECT step, event_id, tag, value FROM w UNPIVOT (value FOR tag IN (loss, rate)))
SELECT tag, step, arg_max(value, event_id) AS value FROM u GROUP BY tag, step""")
def agg_unpivot_scalars(spark, sf_dir):
    """Wide history rows to one row a tag and step; the step falls back to a second column."""
    step = F.coalesce(F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 50), F.col("event_id") % 60)
    w = table(spark, sf_dir, "events").select(step.alias("step"), F.col("value").alias("loss"), (F.col("value") * 2).alias("rate"), "event_id")
    return w.unpivot(["step", "event_id"], ["loss", "rate"], "tag", "value").groupBy("tag", "step").agg(F.max_by("value", "event_id").alias("value"))


@query("SELECT regexp_extract(p_type, '^(\\w+)', 1) AS base, count(*) AS parts, list_sort(list(DISTINCT p_size::BIGINT)) AS sizes FROM part GROUP BY 1")
def agg_collapse_regex_key(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.regexp_extract("p_type", r"^(\w+)", 1).alias("base")).agg(F.count("*").alias("parts"), F.sort_array(F.collect_set(F.col("p_size").cast("long"))).alias("sizes"))


@query("SELECT c_nationkey::BIGINT AS source, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY c_nationkey")
def agg_collect_sorted(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("source")).agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))


@query(f"WITH {TRACK_OBS}, t AS (SELECT quantile_cont(x, 0.3) FILTER (WHERE vis) AS limit FROM track_obs) SELECT track, count(*) AS kept FROM track_obs, t WHERE vis AND x >= t.limit AND x > 1e-5 GROUP BY track")
def agg_percentile_threshold(spark, sf_dir):
    """Valid rows at or above a percentile of the valid ones; one number is joined back."""
    o = track_obs(spark, sf_dir).filter("vis")
    limit = exact_quantiles(o, [], "x", [0.3]).select(F.col("quantile").alias("limit"))
    return o.crossJoin(F.broadcast(limit)).filter("x >= limit AND x > 1e-5").groupBy("track").agg(F.count("*").alias("kept"))


@query(f"""WITH {POINTS}, e AS (SELECT batch, (id * 7 + k) % 97 AS pixel, x AS v FROM points, (SELECT unnest(range(4)) AS k)) SELECT batch, pixel, round(sum(v), 6) AS total, count(*) AS hits FROM e GROUP BY batch, pixel""")
def agg_scatter_add(spark, sf_dir):
    """Values added into the cells that they fall in."""
    e = points(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("pixel", (F.col("id") * 7 + F.col("k")) % 97)
    return e.groupBy("batch", "pixel").agg(r6(F.sum("x")).alias("total"), F.count("*").alias("hits"))


@query("""WITH c AS (SELECT n_regionkey::BIGINT AS rig, n_nationkey AS view, 3 * cos(n_nationkey * 0.1::DOUBLE) AS x, 3 * sin(n_nationkey * 0.1::DOUBLE) AS y, n_nationkey % 4 * 0.2::DOUBLE AS z FROM nation),
r AS (SELECT a.rig, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / (2 * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) + 0.01::DOUBLE) AS ratio FROM c a JOIN c b ON a.rig = b.rig AND a.view < b.view)
SELECT rig, round(median(ratio), 6) AS scale, count(*) AS pairs FROM r GROUP BY rig""")
def agg_baseline_scale(spark, sf_dir):
    """Median ratio of two calibrations' camera distances over the pairs of cameras of each rig, which has a few."""
    k = F.col("n_nationkey")
    c = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("rig"), k.alias("view"), (3 * F.cos(k * 0.1)).alias("x"), (3 * F.sin(k * 0.1)).alias("y"), (k % 4 * 0.2).alias("z"))
    a, b = c.alias("a"), c.alias("b")
    flat = (F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2
    ratio = F.sqrt(flat + (F.col("a.z") - F.col("b.z")) ** 2) / (2 * F.sqrt(flat) + 0.01)
    pairs = a.join(b, (F.col("a.rig") == F.col("b.rig")) & (F.col("a.view") < F.col("b.view"))).select("a.rig", ratio.alias("ratio"))
    return summarised(pairs, ["rig"], [F.count("*").alias("pairs")], {"scale": (F.col("ratio"), 0.5)}).withColumn("scale", r6("scale"))
