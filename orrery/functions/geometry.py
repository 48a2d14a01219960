"""Vectors, arrays, cameras and rotations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.joins import CAMERAS, SQL_PROJECT, bounded_broadcast, cameras, cosine, project
from ..registry import query, r6
from ..sources.views import POINTS, TRACK_OBS, hashed, hashed_sql, points, table, track_obs


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


@query(f"WITH {POINTS}, h AS (SELECT batch, fvec AS head FROM points WHERE id = (SELECT min(id) FROM points p WHERE p.batch = points.batch)) SELECT id, round(list_distance(fvec, head), 6) AS d FROM points JOIN h USING (batch)")
def arr_l2(spark, sf_dir):
    """Distance of each feature vector to the first of its batch."""
    p = points(spark, sf_dir)
    head = p.groupBy("batch").agg(F.min_by("fvec", "id").alias("head"))
    return p.join(head, "batch").select("id", r6(l2(F.col("fvec"), F.col("head"))).alias("d"))


@query(f"WITH {POINTS}, h AS (SELECT batch, arg_min(fvec, id) AS head FROM points GROUP BY batch) SELECT id, round(greatest(-1, least(1, list_cosine_similarity(fvec, head))), 6) AS c FROM points JOIN h USING (batch)")
def arr_cosine(spark, sf_dir):
    p = points(spark, sf_dir)
    head = p.groupBy("batch").agg(F.min_by("fvec", "id").alias("head"))
    return p.join(head, "batch").select("id", r6(cosine(F.col("fvec"), F.col("head"))).alias("c"))


@query(f"WITH {POINTS}, h AS (SELECT batch, arg_min(fvec, id) AS head FROM points GROUP BY batch) SELECT id, CAST(g AS BIGINT) AS grp, round(list_dot_product(fvec[16 * g + 1 : 16 * g + 16], head[16 * g + 1 : 16 * g + 16]) / sqrt(16), 6) AS corr FROM points JOIN h USING (batch), (SELECT unnest(range(4)) AS g)")
def arr_grouped_corr(spark, sf_dir):
    """Dot products by channel group over the root of the group's size."""
    p = points(spark, sf_dir)
    head = p.groupBy("batch").agg(F.min_by("fvec", "id").alias("head"))
    g = F.col("grp").cast("int") * 16 + 1
    both = p.join(head, "batch").withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return both.select("id", "grp", r6(dot(F.slice("fvec", g, F.lit(16)), F.slice("head", g, F.lit(16))) / 4).alias("corr"))


@query(f"WITH {POINTS}, {CAMERAS}, p AS (SELECT id, view, {SQL_PROJECT} FROM points, cameras WHERE batch % 5 = rig) SELECT id, view, round(u, 6) AS u, round(v, 6) AS v, round(depth, 6) AS depth FROM p")
def mat_project(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("rig", F.col("batch") % 5).join(bounded_broadcast(cameras(spark, sf_dir)), "rig")
    u, v, depth = project(*map(F.col, ("x", "y", "z", "f", "angle", "back")))
    return p.select("id", "view", r6(u).alias("u"), r6(v).alias("v"), r6(depth).alias("depth"))


def unproject(u: Column, v: Column, depth: Column, f: Column, angle: Column, back: Column) -> tuple[Column, Column, Column]:
    """The point of a pixel and its depth."""
    a, b = (u - 320) * depth / f, (v - 240) * depth / f
    return F.cos(angle) * a + F.sin(angle) * b, F.cos(angle) * b - F.sin(angle) * a, depth - back


@query(f"WITH {POINTS}, {CAMERAS} SELECT id, view, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(z, 6) + 0.0::DOUBLE AS z FROM points, cameras WHERE batch % 5 = rig")
def mat_roundtrip(spark, sf_dir):
    """Projected and taken back: the points that went in."""
    p = points(spark, sf_dir).withColumn("rig", F.col("batch") % 5).join(bounded_broadcast(cameras(spark, sf_dir)), "rig")
    cam = tuple(map(F.col, ("f", "angle", "back")))
    u, v, depth = project(F.col("x"), F.col("y"), F.col("z"), *cam)
    x, y, z = unproject(u, v, depth, *cam)
    return p.select("id", "view", *[(r6(c) + 0.0).alias(n) for n, c in zip("xyz", (x, y, z), strict=True)])


@query(f"WITH {CAMERAS}, d AS (SELECT unnest(range(4))::BIGINT AS px) SELECT view, px, py, round(cos(angle) * a + sin(angle) * b, 6) AS x, round(cos(angle) * b - sin(angle) * a, 6) AS y FROM (SELECT view, angle, d.px, e.px AS py, (d.px * 160 - 320) * 2 / f AS a, (e.px * 160 - 240) * 2 / f AS b FROM cameras, d, d e)")
def mat_unproject(spark, sf_dir):
    """A pixel grid at depth 2 as points in space."""
    four = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    g = cameras(spark, sf_dir).withColumn("px", F.explode(four)).withColumn("py", F.explode(four))
    x, y, _ = unproject(F.col("px") * 160, F.col("py") * 160, F.lit(2.0), *map(F.col, ("f", "angle", "back")))
    return g.select("view", "px", "py", r6(x).alias("x"), r6(y).alias("y"))


@query(f"WITH {CAMERAS} SELECT view, round(f * 0.5, 6) AS fx, round(f * 0.25, 6) AS fy, 160.0::DOUBLE AS cx, 60.0::DOUBLE AS cy FROM cameras")
def mat_scale_k(spark, sf_dir):
    """Intrinsics of an image resized by a half and a quarter."""
    return cameras(spark, sf_dir).select("view", r6(F.col("f") * 0.5).alias("fx"), r6(F.col("f") * 0.25).alias("fy"), F.lit(160.0).alias("cx"), F.lit(60.0).alias("cy"))


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Rows of the rotation of a quaternion, which is normalised first."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


@query(f"WITH {POINTS}, q AS (SELECT id, 1 / sqrt(1 + x * x + y * y + z * z) AS w, x / sqrt(1 + x * x + y * y + z * z) AS x, y / sqrt(1 + x * x + y * y + z * z) AS y, z / sqrt(1 + x * x + y * y + z * z) AS z FROM points) SELECT id, round(1 - 2 * (y * y + z * z), 6) AS r11, round(2 * (x * y - w * z), 6) AS r12, round(2 * (y * z + w * x), 6) AS r32, round(1 - 2 * (x * x + y * y), 6) AS r33 FROM q")
def mat_quaternion(spark, sf_dir):
    r = quaternion_matrix(F.lit(1.0), F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("id", r6(r[0]).alias("r11"), r6(r[1]).alias("r12"), r6(r[7]).alias("r32"), r6(r[8]).alias("r33"))


def euler_matrix(yaw: Column, pitch: Column, roll: Column) -> list[Column]:
    """Rows of yaw about z, then pitch about y, then roll about x."""
    cy, sy, cp, sp, cr, sr = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr]


@query(f"WITH {POINTS} SELECT id, round(cos(x) * cos(y), 6) AS r11, round(cos(x) * sin(y) * sin(z) - sin(x) * cos(z), 6) AS r12, round(-sin(y), 6) AS r31, round(cos(y) * cos(z), 6) AS r33 FROM points")
def mat_euler(spark, sf_dir):
    r = euler_matrix(F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("id", r6(r[0]).alias("r11"), r6(r[1]).alias("r12"), r6(r[6]).alias("r31"), r6(r[8]).alias("r33"))


@query(f"WITH {CAMERAS} SELECT view, round(-(cos(angle) * 1 + sin(angle) * 2), 6) AS cx, round(-(-sin(angle) * 1 + cos(angle) * 2), 6) AS cy, round(-back, 6) AS cz FROM cameras")
def mat_camera_centre(spark, sf_dir):
    """Minus the transposed rotation times the translation (1, 2, back)."""
    a = F.col("angle")
    return cameras(spark, sf_dir).select("view", r6(-(F.cos(a) + F.sin(a) * 2)).alias("cx"), r6(-(F.cos(a) * 2 - F.sin(a))).alias("cy"), r6(-F.col("back")).alias("cz"))


@query(f"WITH {POINTS} SELECT id, round(2.5 * (cos(0.3::DOUBLE) * x - sin(0.3::DOUBLE) * y) + 1, 6) AS x, round(2.5 * (sin(0.3::DOUBLE) * x + cos(0.3::DOUBLE) * y) - 2, 6) AS y, round(2.5 * z + 0.5, 6) AS z FROM points")
def mat_sim3(spark, sf_dir):
    """Scaled by 2.5, turned by 0.3 about z, moved by (1, -2, 0.5)."""
    c, s = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    x, y = F.col("x"), F.col("y")
    return points(spark, sf_dir).select("id", r6(2.5 * (c * x - s * y) + 1).alias("x"), r6(2.5 * (s * x + c * y) - 2).alias("y"), r6(2.5 * F.col("z") + 0.5).alias("z"))


@query(f"WITH {POINTS}, m AS (SELECT batch, avg(x) AS mx, avg(y) AS my FROM points GROUP BY batch) SELECT id, round(x - mx, 6) AS x, round(y - my, 6) AS y FROM points JOIN m USING (batch)")
def mat_recentre(spark, sf_dir):
    """Less the mean centre of the rig."""
    p = points(spark, sf_dir)
    m = p.groupBy("batch").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return p.join(m, "batch").select("id", r6(F.col("x") - F.col("mx")).alias("x"), r6(F.col("y") - F.col("my")).alias("y"))


@query(f"WITH {TRACK_OBS}, s AS (SELECT track, frame // 64 AS part, list(frame ORDER BY frame) FILTER (WHERE vis) AS f FROM track_obs GROUP BY ALL), m AS (SELECT max(len(f)) AS n FROM s) SELECT track, part, list_resize(coalesce(f, []), n, 0) AS padded, n - len(coalesce(f, [])) AS padding FROM s, m")
def arr_pad_mask(spark, sf_dir):
    """Ragged lists padded to the longest; how much of each is padding. A list holds a part of 64 frames of a track."""
    part = F.floor(F.col("frame") / 64).cast("long").alias("part")
    s = track_obs(spark, sf_dir).groupBy("track", part).agg(F.sort_array(F.collect_list(F.when(F.col("vis"), F.col("frame")))).alias("f"))
    n = s.agg(F.max(F.size("f")).alias("n"))
    missing = F.col("n") - F.size("f")
    return s.crossJoin(F.broadcast(n)).select("track", "part", F.concat("f", F.array_repeat(F.lit(0).cast("long"), missing)).alias("padded"), missing.cast("long").alias("padding"))


@query(f"WITH {POINTS} SELECT id, list_transform([1, 5, 9], lambda i: round(fvec[i], 6)) AS picked FROM points")
def arr_gather(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.transform(F.array(*map(F.lit, (1, 5, 9))), lambda i: F.round(F.element_at("fvec", i), 6)).alias("picked"))


@query(f"WITH {POINTS} SELECT id, list_transform(fvec[3:5] || fvec[60:62], lambda v: round(v, 6)) AS joined FROM points")
def arr_concat_slice(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.transform(F.concat(F.slice("fvec", 3, 3), F.slice("fvec", 60, 3)), lambda v: F.round(v, 6)).alias("joined"))


@query(f"WITH {TRACK_OBS} SELECT track, frame // 4 AS cell, bool_or(vis) AS any_view, bool_and(vis) AS all_views, len(list_filter(list(view), lambda v: v = 1)) > 0 AS in_view_1 FROM track_obs GROUP BY track, frame // 4")
def arr_any_all(spark, sf_dir):
    cell = F.floor(F.col("frame") / 4).cast("long").alias("cell")
    return track_obs(spark, sf_dir).groupBy("track", cell).agg(F.bool_or("vis").alias("any_view"), F.bool_and("vis").alias("all_views"), F.exists(F.collect_list("view"), lambda v: v == 1).alias("in_view_1"))


@query("SELECT n_nationkey::BIGINT AS view, CAST(i AS BIGINT) AS gx, CAST(j AS BIGINT) AS gy, (i + 0.5::DOUBLE) * 8 AS px, (j + 0.5::DOUBLE) * 8 AS py FROM nation, (SELECT unnest(range(6)) AS i), (SELECT unnest(range(4)) AS j)")
def arr_grid(spark, sf_dir):
    """Pixel centres of a grid in each view."""
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("view")).withColumn("gx", seq(6)).withColumn("gy", seq(4))
    return g.withColumn("px", (F.col("gx") + 0.5) * 8).withColumn("py", (F.col("gy") + 0.5) * 8)


@query("WITH a AS (SELECT n_regionkey AS archive, list(n_nationkey) AS members FROM nation GROUP BY n_regionkey), m AS (SELECT archive, unnest(members) AS member FROM a) SELECT archive::BIGINT AS archive, count(*) AS customers FROM customer JOIN m ON member = c_nationkey GROUP BY archive")
def arr_explode_join(spark, sf_dir):
    """Member lists turned round: each member to its archive, then an equality join."""
    a = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("archive")).agg(F.collect_list("n_nationkey").alias("members"))
    m = bounded_broadcast(a.select("archive", F.explode("members").alias("c_nationkey")))
    return table(spark, sf_dir, "customer").join(m, "c_nationkey").groupBy("archive").agg(F.count("*").alias("customers"))


def camera_noise(key: str, salt: str, spread: float) -> Column:
    """A normal number that a key and a salt settle, by Box and Muller's transform of two hashes."""
    one, two = hashed(f"{salt}a", key), hashed(f"{salt}b", key)
    return F.lit(spread) * F.sqrt(-2 * F.log((one * 10000 + 1) / 10001)) * F.cos(2 * F.pi() * two)


@query(f"""WITH {CAMERAS} SELECT view, round(f + 5::DOUBLE * sqrt(-2 * ln(({hashed_sql("focala", "view")} * 10000 + 1) / 10001)) * cos(2 * pi() * {hashed_sql("focalb", "view")}), 6) AS f FROM cameras""")
def mat_camera_noise(spark, sf_dir):
    """Focal lengths with Gaussian noise of five pixels."""
    return cameras(spark, sf_dir).select("view", r6(F.col("f") + camera_noise("view", "focal", 5.0)).alias("f"))
