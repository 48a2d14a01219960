"""User functions on groups, for what columns cannot say: alignment fits, curves, predictors, learners."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, r6
from ..sources.checkpoints import ready
from ..sources.views import FOLLOWED, POINTS, TRACK_OBS, followed, points, track_obs


@query(f"WITH {FOLLOWED}, s AS (SELECT track, x AS qx, y AS qy FROM followed WHERE frame = qt) SELECT track, frame, qx AS px, qy AS py, true AS visible FROM {'track_obs'} JOIN s USING (track)")
def udf_copycat(spark, sf_dir):
    """The constant-position predictor: each track stays where its query is."""
    rows = followed(track_obs(spark, sf_dir))
    start = rows.filter("frame = qt").select("track", F.col("x").alias("px"), F.col("y").alias("py"))
    return rows.select("track", "frame").join(start, "track").withColumn("visible", F.lit(True))


def predict(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], key: str, schema: str) -> DataFrame:
    """Any predictor, one key's rows at a time: for keys whose rows a task can hold, as a scene's or a track's.

    This is where a user's own model comes in; what columns can say should not go through it.
    """
    return rows.groupBy(key).applyInPandas(model, schema)


def smooth(group: pd.DataFrame) -> pd.DataFrame:
    """A predictor: the running mean of the last visible positions."""
    group = group.sort_values("frame")
    x = group["x"].where(group["vis"]).rolling(3, min_periods=1).mean().ffill()
    return pd.DataFrame({"track": group["track"], "frame": group["frame"], "px": x})


@query(f"WITH {TRACK_OBS}, m AS (SELECT track, frame, avg(CASE WHEN vis THEN x END) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM track_obs) SELECT track, frame, round(last_value(m IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS px FROM m")
def udf_predictor(spark, sf_dir):
    found = predict(track_obs(spark, sf_dir).select("track", "frame", "x", "vis"), smooth, "track", "track long, frame long, px double")
    return found.select("track", "frame", r6(F.when(~F.isnan("px"), F.col("px"))).alias("px"))


def umeyama(moments: pd.DataFrame) -> pd.DataFrame:
    """Scale, rotation and shift that carry a onto b in the least squares, from one row of moments a key."""
    out = []
    for _, r in moments.iterrows():
        n, ma, mb = r["n"], np.array(r["ma"]), np.array(r["mb"])
        cov = np.array(r["ab"]).reshape(3, 3) / n - np.outer(mb, ma)
        var = r["aa"] / n - ma @ ma
        u, s, vt = np.linalg.svd(cov)
        sign = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
        rot = u @ sign @ vt
        scale = float((s * np.diag(sign)).sum() / var)
        out.append((int(r["batch"]), scale, [float(v) for v in rot.ravel()], [float(v) for v in mb - scale * rot @ ma]))
    return pd.DataFrame(out, columns=["batch", "scale", "rotation", "shift"])


def similarity_fit(pairs: DataFrame) -> DataFrame:
    """``batch, scale, rotation, shift`` from ``batch, ax..az, bx..bz``: Spark sums the moments, a task solves 3 x 3."""
    a, b = [F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"]
    m = pairs.groupBy("batch").agg(
        F.count("*").alias("n"), F.array(*map(F.avg, a)).alias("ma"), F.array(*map(F.avg, b)).alias("mb"),
        F.array(*[F.sum(p * q) for p in b for q in a]).alias("ab"), F.sum(sum(p * p for p in a)).alias("aa"),
    )
    return m.mapInPandas(lambda it: map(umeyama, it), "batch long, scale double, rotation array<double>, shift array<double>")


@query("SELECT DISTINCT CAST(label AS BIGINT) AS batch, 2.5::DOUBLE AS scale, 0.955336::DOUBLE AS r11, 1.0::DOUBLE AS shift_x FROM embeddings")
def udf_umeyama(spark, sf_dir):
    """A known similarity found again from the points that it moved."""
    c, s = float(np.cos(0.3)), float(np.sin(0.3))
    x, y, z = map(F.col, "xyz")
    moved = points(spark, sf_dir).select("batch", x.alias("ax"), y.alias("ay"), z.alias("az"), (2.5 * (c * x - s * y) + 1).alias("bx"), (2.5 * (s * x + c * y) - 2).alias("by"), (2.5 * z + 0.5).alias("bz"))
    return similarity_fit(moved).select("batch", r6("scale").alias("scale"), r6(F.element_at("rotation", 1)).alias("r11"), r6(F.element_at("shift", 1)).alias("shift_x"))


def hilbert_codes(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of whole coordinates, by transposing Gray codes."""
    x = coordinates.T.astype(np.int64).copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(n):
            high = (x[k] & bit) > 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(high, low, swap)
            x[k] ^= swap
        bit >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    code = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            code = code << 1 | (x[k] >> level & 1)
    return code


def hilbert_sql(cells: str, bits: int) -> str:
    """The same code by one row of bit steps after another: ``cells`` has ``id, x, y, z``."""
    steps, now = [f"h0 AS (SELECT id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z FROM ({cells}))"], "h0"
    for bit in (1 << b for b in range(bits - 1, 0, -1)):
        for c in "xyz":
            low, name = bit - 1, f"h{len(steps)}"
            if c == "x":
                moved = f"CASE WHEN x & {bit} > 0 THEN xor(x, {low}) ELSE x END AS x, y, z"
            else:
                swap = f"(xor(x, {c}) & {low})"
                rest = "z" if c == "y" else "y"
                one = f"CASE WHEN {c} & {bit} > 0 THEN {c} ELSE xor({c}, {swap}) END AS {c}"
                moved = f"CASE WHEN {c} & {bit} > 0 THEN xor(x, {low}) ELSE xor(x, {swap}) END AS x, {one}, {rest}"
            steps.append(f"{name} AS (SELECT id, {moved} FROM {now})")
            now = name
    steps.append(f"gray AS (SELECT id, x, xor(y, x) AS y, xor(z, xor(y, x)) AS z FROM {now})")
    flip = "0::BIGINT"
    for bit in (1 << b for b in range(bits - 1, 0, -1)):
        flip = f"xor({flip}, CASE WHEN z & {bit} > 0 THEN {bit - 1} ELSE 0 END)"
    steps.append(f"flat AS (SELECT id, xor(x, f) AS x, xor(y, f) AS y, xor(z, f) AS z FROM (SELECT *, {flip} AS f FROM gray))")
    code = " + ".join(f"((({c} >> {b}) & 1) << {3 * b + 2 - k})" for b in range(bits) for k, c in enumerate("xyz"))
    return f"WITH {', '.join(steps)} SELECT id, {code} AS code FROM flat"


@query(hilbert_sql(f"WITH {POINTS} SELECT id, CAST(floor((x + 1) * 31) AS BIGINT) AS x, CAST(floor((y + 1) * 31) AS BIGINT) AS y, CAST(floor((z + 1) * 31) AS BIGINT) AS z FROM points", 6))
def udf_hilbert(spark, sf_dir):
    """Places of points on a Hilbert curve over a grid of 64 cells a side."""

    @F.pandas_udf("long")
    def code(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(hilbert_codes(np.stack([x, y, z], 1), 6))

    g = lambda c: F.floor((F.col(c) + 1) * 31).cast("long")
    return points(spark, sf_dir).select("id", code(g("x"), g("y"), g("z")).alias("code"))


CENTRES, ROUNDS = 8, 4


def nearest_centre(centres: list[tuple[float, ...]], columns: tuple[str, ...]) -> Column:
    """The number of the nearest centre, the first of equals; the centres are a short list in the plan."""
    far = [F.struct(F.round(sum((F.col(c) - F.lit(v)) ** 2 for c, v in zip(columns, centre, strict=True)), 9).alias("d"), F.lit(k).cast("long").alias("k")) for k, centre in enumerate(centres)]
    return F.array_min(F.array(*far))["k"]


def kmeans(rows: DataFrame, columns: tuple[str, ...], centres: int, rounds: int) -> DataFrame:
    """``cluster``, its mean and number of rows after some rounds from the rows of the smallest ids; an empty cluster goes.

    The driver holds the centres, never rows.
    """
    now = [tuple(r) for r in rows.orderBy("id").limit(centres).select(*columns).collect()]
    for k in range(rounds):
        found = rows.groupBy(nearest_centre(now, columns).alias("cluster")).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("points"))
        if k == rounds - 1:
            return found
        now = [tuple(round(r[c], 9) for c in columns) for r in found.orderBy("cluster").collect()]
    raise ValueError("at least one round")


def kmeans_sql(centres: int, rounds: int) -> str:
    steps = [POINTS, f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, x, y, z FROM (SELECT * FROM points ORDER BY id LIMIT {centres}))"]
    for r in range(rounds):
        near = f"SELECT p.id, arg_min(c.k, struct_pack(a := round((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2, 9), b := c.k)) AS k FROM points p, c{r} c GROUP BY p.id"
        steps.append(f"m{r} AS (SELECT k AS cluster, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS points FROM points JOIN ({near}) n USING (id) GROUP BY k)")
        steps.append(f"c{r + 1} AS (SELECT row_number() OVER (ORDER BY cluster) - 1 AS k, x, y, z FROM m{r})")
    return f"WITH {', '.join(steps)} SELECT cluster::BIGINT AS cluster, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, points FROM m{rounds - 1}"


@query(kmeans_sql(CENTRES, ROUNDS))
def ml_kmeans(spark, sf_dir):
    """Cluster centres of the positions, and how many points each has."""
    found = kmeans(points(spark, sf_dir).select("id", "x", "y", "z"), ("x", "y", "z"), CENTRES, ROUNDS)
    return found.select("cluster", *[r6(c).alias(c) for c in "xyz"], "points")


def ransac(pairs: DataFrame, tries: int, within: float) -> DataFrame:
    """``batch, scale, rotation, shift, inliers`` of a similarity that most pairs fit to ``within``; the others may be anything.

    ``pairs`` have ``id, batch, ax..az, bx..bz``. Each try fits three pairs that a hash draws; all
    pairs are held against all tries, and those that fit the best one are fitted again.
    """
    ready(pairs.sparkSession)
    names = [f"{s}{c}" for s in "ab" for c in "xyz"]
    hashed_id = F.struct(F.xxhash64("id", "try").alias("h"), "id", *names)
    each = pairs.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    # Three draws a try: the least hashes of three thirds of the ids, so that partial aggregation bounds them.
    drawn = each.groupBy("batch", "try", F.pmod(F.xxhash64("id"), F.lit(3)).alias("third")).agg(F.min(hashed_id).alias("p"))
    sets = drawn.select("batch", "try", *[F.col(f"p.{n}").alias(n) for n in names])
    trial = sets.select((F.col("batch") * tries + F.col("try")).alias("batch"), *names)
    fits = similarity_fit(trial).withColumn("try", F.pmod("batch", F.lit(tries)).cast("int")).withColumn("batch", F.floor(F.col("batch") / tries).cast("long")).checkpoint()

    def off() -> Column:
        a = [F.col(f"a{c}") for c in "xyz"]
        at = lambda row: F.col("scale") * sum(F.element_at("rotation", 3 * row + k + 1) * a[k] for k in range(3)) + F.element_at("shift", row + 1)
        return F.sqrt(sum((at(row) - F.col(f"b{c}")) ** 2 for row, c in enumerate("xyz")))

    held = pairs.join(fits, "batch").withColumn("fits", off() <= within)
    best = held.groupBy("batch", "try").agg(F.count_if("fits").alias("n")).groupBy("batch").agg(F.max_by("try", F.struct("n", -F.col("try"))).alias("try"))
    good = pairs.join(fits.join(best, ["batch", "try"]), "batch").filter(off() <= within).select("batch", *names).checkpoint()
    return similarity_fit(good).join(good.groupBy("batch").agg(F.count("*").alias("inliers")), "batch")


@query("SELECT CAST(label AS BIGINT) AS batch, 1.0::DOUBLE AS scale, 0.955336::DOUBLE AS r11, 1.0::DOUBLE AS shift_x, count(*) FILTER (WHERE vec_id % 5 <> 0) AS inliers FROM embeddings GROUP BY label")
def udf_ransac(spark, sf_dir):
    """A rigid motion found although a fifth of the pairs are wrong."""
    c, s = float(np.cos(0.3)), float(np.sin(0.3))
    x, y, z = map(F.col, "xyz")
    wrong = F.when(F.col("id") % 5 == 0, 3 + F.col("id") % 7).otherwise(0.0)
    moved = points(spark, sf_dir).select("id", "batch", x.alias("ax"), y.alias("ay"), z.alias("az"), (c * x - s * y + 1 + wrong).alias("bx"), (s * x + c * y - 2 - wrong).alias("by"), (z + 0.5).alias("bz"))
    return ransac(moved, 24, 1e-3).select("batch", r6("scale").alias("scale"), r6(F.element_at("rotation", 1)).alias("r11"), r6(F.element_at("shift", 1)).alias("shift_x"), "inliers")


def pca_sql(components: int, squarings: int = 12) -> str:
    """Principal components by squaring the covariance until its largest eigenvector is all that is left, then taking that out."""
    trace = lambda m: f"(SELECT sum(v) FROM {m} WHERE i = j)"
    steps = [
        POINTS,
        "e AS MATERIALIZED (SELECT id, unnest(range(1, len(fvec) + 1)) AS i, unnest(fvec) AS v FROM points)",
        "d AS MATERIALIZED (SELECT id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM e)",
        "c0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM d a JOIN d b USING (id) GROUP BY a.i, b.i)",
    ]
    for k in range(components):
        steps.append(f"p{k}_0 AS MATERIALIZED (SELECT i, j, v / {trace(f'c{k}')} AS v FROM c{k})")
        for s in range(squarings):
            now = f"p{k}_{s}"
            steps.append(f"q{k}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {now} a JOIN {now} b ON a.j = b.i GROUP BY a.i, b.j)")
            steps.append(f"p{k}_{s + 1} AS MATERIALIZED (SELECT i, j, v / {trace(f'q{k}_{s}')} AS v FROM q{k}_{s})")
        last = f"p{k}_{squarings}"
        steps.append(f"v{k} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j))")
        steps.append(f"l{k} AS (SELECT sum(a.v * c.v * b.v) AS l FROM c{k} c JOIN v{k} a ON a.i = c.i JOIN v{k} b ON b.i = c.j)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - l * a.v * b.v AS v FROM c{k} c JOIN v{k} a ON a.i = c.i JOIN v{k} b ON b.i = c.j, l{k})")
    shown = ", ".join(f"round(abs(sum(e.v * v{k}.v)), 6) AS {n}" for k, n in zip(range(components), "rgb", strict=True))
    return f"WITH {', '.join(steps)} SELECT id, {shown} FROM e {' '.join(f'JOIN v{k} ON v{k}.i = e.i' for k in range(components))} GROUP BY id"


@query(pca_sql(3))
def ml_pca(spark, sf_dir):
    """Feature vectors on their three principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    p = points(spark, sf_dir).select("id", array_to_vector("fvec").alias("features"))
    found = PCA(k=3, inputCol="features", outputCol="c").fit(p).transform(p).withColumn("c", vector_to_array("c"))
    return found.select("id", *[r6(F.abs(F.element_at("c", k + 1))).alias(n) for k, n in enumerate(("r", "g", "b"))])
