"""Filters, projections and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, r6
from ..sources.views import POINTS, SCALARS, TRACK_OBS, points, scalars, table, track_obs


def in_bounds(c: Column, low: float, high: float) -> Column:
    """Finite and in the half-open range."""
    return c.isNotNull() & ~F.isnan(c) & (c >= low) & (c < high)


@query(f"WITH {TRACK_OBS} SELECT track, frame FROM track_obs WHERE x IS NOT NULL AND NOT isnan(x) AND x > 0 AND px >= -0.5 AND px < 119.5 AND py >= -0.5 AND py < 79.5")
def flt_half_open_bounds(spark, sf_dir):
    ok = (F.col("x") > 0) & ~F.isnan("x") & in_bounds(F.col("px"), -0.5, 119.5) & in_bounds(F.col("py"), -0.5, 79.5)
    return track_obs(spark, sf_dir).filter(ok).select("track", "frame")


@query(f"WITH {TRACK_OBS} SELECT DISTINCT track FROM (SELECT track, view FROM track_obs GROUP BY track, view HAVING count(*) FILTER (WHERE vis) >= 20)")
def flt_min_observations(spark, sf_dir):
    return track_obs(spark, sf_dir).groupBy("track", "view").agg(F.count_if("vis").alias("n")).filter("n >= 20").select("track").distinct()


@query(f"WITH {TRACK_OBS}, n AS (SELECT track, max(frame) + 1 AS nf FROM track_obs GROUP BY track) SELECT track, bool_or(frame IN (0, nf // 2) AND vis) AS eligible FROM track_obs JOIN n USING (track) GROUP BY track")
def flt_first_or_mid(spark, sf_dir):
    """Visible in the first or the middle frame."""
    o = track_obs(spark, sf_dir)
    n = o.groupBy("track").agg((F.max("frame") + 1).alias("nf"))
    hit = ((F.col("frame") == 0) | (F.col("frame") == F.floor(F.col("nf") / 2))) & F.col("vis")
    return o.join(n, "track").groupBy("track").agg(F.bool_or(hit).alias("eligible"))


@query(f"WITH {SCALARS} SELECT ordinal, round(CASE WHEN value > 120 OR value <= 0 OR NOT isfinite(value) THEN 0 ELSE value * 0.001::DOUBLE END, 6) AS metres FROM scalars")
def prj_clamp_units(spark, sf_dir):
    """Millimetres to metres; what is too far, negative or not finite becomes 0."""
    v = F.col("value")
    bad = (v > 120) | (v <= 0) | F.isnan(v) | (F.abs(v) == float("inf"))
    return scalars(spark, sf_dir).select("ordinal", r6(F.when(bad, 0.0).otherwise(v * 0.001)).alias("metres"))


@query(f"WITH {SCALARS}, n AS (SELECT ordinal, CASE WHEN ordinal % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM scalars) SELECT ordinal, CASE WHEN isnan(v) THEN 0 ELSE v END AS v FROM n")
def prj_nan_to_zero(spark, sf_dir):
    v = F.when(F.col("ordinal") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return scalars(spark, sf_dir).select("ordinal", F.nanvl(v, F.lit(0.0)).alias("v"))


@query(f"WITH {SCALARS}, n AS (SELECT ordinal, CASE ordinal % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE value END AS v FROM scalars) SELECT ordinal, CASE WHEN isfinite(v) THEN v END AS v FROM n")
def prj_finite_or_null(spark, sf_dir):
    k = F.col("ordinal") % 7
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return scalars(spark, sf_dir).select("ordinal", F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("v"))


def with_columns_of(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``df`` as the wanted columns, by name and type; those that it lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()])


@query("SELECT c_custkey, c_acctbal, CAST(NULL AS DOUBLE) AS jaccard FROM customer")
def prj_add_missing_columns(spark, sf_dir):
    return with_columns_of(table(spark, sf_dir, "customer"), {"c_custkey": "long", "c_acctbal": "double", "jaccard": "double"})


CHECKS = {
    "quantity": ("l_quantity < 1 OR l_quantity > 45", "quantity from 1 to 45"),
    "discount": ("l_discount < 0 OR l_discount > 0.08", "discount from 0 to 0.08"),
    "price": ("l_extendedprice IS NULL OR l_extendedprice <= 0", "a price above 0"),
}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{said}' AS expected, count(*) AS failures FROM lineitem WHERE {bad}" for c, (bad, said) in CHECKS.items()))
def dq_contract_violations(spark, sf_dir):
    """How many rows break each constraint, in one pass over the table."""
    rows = table(spark, sf_dir, "lineitem").agg(*[F.count_if(F.expr(bad)).alias(c) for c, (bad, _) in CHECKS.items()])
    said = F.create_map(*[F.lit(x) for c, (_, text) in CHECKS.items() for x in (c, text)])
    return rows.unpivot([], list(CHECKS), "check", "failures").select("check", said[F.col("check")].alias("expected"), "failures")


@query(f"WITH {POINTS} SELECT id, round(x - min(x) OVER b, 6) AS shifted, round((x - min(x) OVER b) / (1e-6::DOUBLE + max(x) OVER b - min(x) OVER b), 6) AS scaled FROM points WINDOW b AS (PARTITION BY batch)")
def num_minmax(spark, sf_dir):
    """Values of a batch between 0 and 1."""
    p = points(spark, sf_dir)
    ends = p.groupBy("batch").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return p.join(ends, "batch").select("id", r6(F.col("x") - F.col("lo")).alias("shifted"), r6((F.col("x") - F.col("lo")) / (F.lit(1e-6) + F.col("hi") - F.col("lo"))).alias("scaled"))
