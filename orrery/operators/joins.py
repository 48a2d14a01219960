"""Joins: paired, priority, range, neighbourhood, nearest neighbours, pairs, cameras."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..registry import query, r6
from ..sources.views import FOLLOWED, POINTS, SCALARS, TRACK_OBS, followed, points, scalars, table, track_obs
from ..sources.checkpoints import ready
from .components import components
from .windows import around, cells

SMALL_SIDE_ROWS = 10_000
#: A block's cells along each side; its queries and references to a group; pairs that a task holds at once.
BLOCK_CELLS, BLOCK_QUERIES, BLOCK_REFS, BLOCK_PAIRS = 4, 4096, 100_000, 1_000_000
NEAR = "batch long, id long, x double, y double, z double, ref long, rx double, ry double, rz double, pairs long"


def bounded_broadcast(side: DataFrame, rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it has no more than ``rows`` rows; else as it is."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


@query(f"""WITH {SCALARS}, p AS (SELECT step, avg(value) AS v FROM scalars WHERE tag = 'signup' GROUP BY step), s AS (SELECT step, avg(value) AS v FROM scalars WHERE tag = 'error' GROUP BY step)
SELECT step, round(coalesce(p.v, s.v), 6) AS value, CASE WHEN p.v IS NULL THEN 'secondary' ELSE 'primary' END AS origin FROM p FULL JOIN s USING (step)""")
def join_full_coalesce(spark, sf_dir):
    """The primary series wins, the secondary fills what it lacks."""
    of = lambda tag, name: scalars(spark, sf_dir).filter(F.col("tag") == tag).groupBy("step").agg(F.avg("value").alias(name))
    return of("signup", "p").join(of("error", "s"), "step", "full_outer").select(
        "step", r6(F.coalesce("p", "s")).alias("value"), F.when(F.col("p").isNull(), "secondary").otherwise("primary").alias("origin")
    )


@query(f"""WITH {SCALARS}, m AS (SELECT step, tag, avg(value) AS v FROM scalars GROUP BY ALL) SELECT a.step, round((a.v + b.v + c.v) / 3, 6) AS value FROM m a JOIN m b USING (step) JOIN m c USING (step) WHERE a.tag = 'view' AND b.tag = 'click' AND c.tag = 'error'""")
def join_three_way_mean(spark, sf_dir):
    of = lambda tag, name: scalars(spark, sf_dir).filter(F.col("tag") == tag).groupBy("step").agg(F.avg("value").alias(name))
    return of("view", "a").join(of("click", "b"), "step").join(of("error", "c"), "step").select("step", r6((F.col("a") + F.col("b") + F.col("c")) / 3).alias("value"))


def unordered_pairs(rows: DataFrame, block: str, id_col: str) -> DataFrame:
    """Pairs ``a < b`` of one block's rows; the block is an equality key, so no pair of blocks meets."""
    a = rows.select(block, F.struct(*[c for c in rows.columns if c != block]).alias("a"))
    b = rows.select(block, F.struct(*[c for c in rows.columns if c != block]).alias("b"))
    return a.join(b, block).filter(F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))


RELATION = "CASE WHEN a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey THEN 'same scene' WHEN a.c_nationkey = b.c_nationkey THEN 'same source' ELSE 'different source' END"


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_custkey // 20 AS step FROM customer)
SELECT a.step, {RELATION} AS relation, count(*) AS pairs FROM c a JOIN c b ON a.step = b.step AND a.c_custkey < b.c_custkey GROUP BY ALL""")
def join_pairs_relation(spark, sf_dir):
    """Pairs of the samples of one step, by what they share."""
    return relations(spark, sf_dir).groupBy("step", "relation").agg(F.count("*").alias("pairs"))


def relations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 20).cast("long").alias("step"), "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    same = F.col("a.c_nationkey") == F.col("b.c_nationkey")
    relation = F.when(same & (F.col("a.c_mktsegment") == F.col("b.c_mktsegment")), "same scene").when(same, "same source").otherwise("different source")
    return unordered_pairs(c, "step", "c_custkey").withColumn("relation", relation)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, clamped to [-1, 1]; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm))))


COS = "greatest(-1, least(1, list_dot_product(a.f, b.f) / nullif(sqrt(list_dot_product(a.f, a.f)) * sqrt(list_dot_product(b.f, b.f)), 0)))"


@query(f"""WITH {POINTS}, p AS (SELECT id, batch, id // 25 AS step, fvec AS f FROM points)
SELECT a.batch = b.batch AS same, count(*) AS pairs, round(avg({COS}), 6) AS mean, round(min({COS}), 6) AS least FROM p a JOIN p b ON a.step = b.step AND a.id < b.id GROUP BY 1""")
def agg_relation_stats(spark, sf_dir):
    """Agreement of gradient sketches within a step, by whether they share a source."""
    p = points(spark, sf_dir).select("id", "batch", F.floor(F.col("id") / 25).alias("step"), F.col("fvec").alias("f"))
    pairs = unordered_pairs(p, "step", "id").select((F.col("a.batch") == F.col("b.batch")).alias("same"), cosine(F.col("a.f"), F.col("b.f")).alias("c"))
    return pairs.groupBy("same").agg(F.count("*").alias("pairs"), r6(F.avg("c")).alias("mean"), r6(F.min("c")).alias("least"))


@query(f"WITH {FOLLOWED}, q AS (SELECT DISTINCT track, qt, nf FROM followed), c AS (SELECT track, unnest(range(0, nf, 16)) AS lo, nf FROM q) SELECT q.track, qt, lo, least(lo + 16, c.nf) AS hi FROM q JOIN c ON q.track = c.track AND qt >= lo AND qt < lo + 16")
def join_range_chunk(spark, sf_dir):
    """A query's chunk: chunks are even, so the range join is an equality on the chunk's number."""
    q = followed(track_obs(spark, sf_dir)).select("track", "qt", "nf").distinct()
    chunks = q.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("nf") - 1) / 16).cast("int")))).select("track", "k", (F.col("k") * 16).cast("long").alias("lo"), F.least((F.col("k") + 1) * 16, F.col("nf")).cast("long").alias("hi"))
    return q.withColumn("k", F.floor(F.col("qt") / 16).cast("int")).join(chunks, ["track", "k"]).select("track", "qt", "lo", "hi")


def _near(width: float, k: int, keep_self: bool):
    """Of a block's queries and references, for each query those that may be among its ``k`` nearest within one cell, and a row with the number of pairs."""

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=[c.split()[0] for c in NEAR.split(", ")])
        if q.empty or r.empty:
            return none
        cells_of = lambda rows, names: np.floor(rows[names].to_numpy() / width).astype(np.int64)
        at, to = cells_of(q, ["x", "y", "z"]), cells_of(r, ["rx", "ry", "rz"])
        low = np.minimum(at.min(0), to.min(0)) - 1
        wide = np.maximum(at.max(0), to.max(0)) - low + 2
        code = lambda c: ((c[:, 0] - low[0]) * wide[1] + c[:, 1] - low[1]) * wide[2] + c[:, 2] - low[2]
        codes = code(to)
        order = np.argsort(codes, kind="stable")
        codes, ref, r_xyz = codes[order], r["ref"].to_numpy()[order], r[["rx", "ry", "rz"]].to_numpy()[order]
        # The three cells along z follow each other.
        mid = code(at)[:, None] + np.array([i * wide[1] * wide[2] + j * wide[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        begin, end = np.searchsorted(codes, mid - 1, "left"), np.searchsorted(codes, mid + 1, "right")
        ids, q_xyz, upto = q["id"].to_numpy(), q[["x", "y", "z"]].to_numpy(), np.cumsum((end - begin).sum(1))
        out, pairs, one = [], 0, 0
        while one < len(q):
            until = max(one + 1, int(np.searchsorted(upto, (upto[one - 1] if one else 0) + BLOCK_PAIRS, "right")))
            b, n = begin[one:until].ravel(), (end - begin)[one:until].ravel()
            who = np.repeat(np.arange(one, until), (end - begin)[one:until].sum(1))
            which = np.arange(n.sum()) + np.repeat(b - (np.cumsum(n) - n), n)
            if not keep_self:
                other = ids[who] != ref[which]
                who, which = who[other], which[other]
            d = np.sqrt(((q_xyz[who] - r_xyz[which]) ** 2).sum(1))
            by = np.lexsort((d, who))
            who, which, d = who[by], which[by], d[by]
            first = np.searchsorted(who, np.arange(one, until))
            count = np.bincount(who - one, minlength=until - one)
            kth = np.full(until - one, np.inf)
            full = count >= k
            kth[full] = d[first[full] + k - 1]
            keep = d <= kth[who - one] + 2e-9  # distances are rounded to nine decimals
            out.append((who[keep], which[keep]))
            pairs, one = pairs + len(who), until
        who, which = (np.concatenate(x) for x in zip(*out, strict=True))
        found = pd.DataFrame({"batch": q["batch"].iloc[0], "id": ids[who], **{c: q_xyz[who, j] for j, c in enumerate("xyz")}, "ref": ref[which], **{f"r{c}": r_xyz[which, j] for j, c in enumerate("xyz")}, "pairs": pd.array([None] * len(who), "Int64")})
        return pd.concat([found, pd.DataFrame({"pairs": pd.array([pairs], "Int64")})], ignore_index=True).astype({"batch": "Int64", "id": "Int64", "ref": "Int64"})

    return search


def nearest(refs: DataFrame, queries: DataFrame, k: int, keep_self: bool = True, compared: list[int] | None = None) -> DataFrame:
    """The ``k`` nearest references of each query within its batch, ties to the smaller id.

    ``refs`` and ``queries`` have ``batch, id, x, y, z``. Points lie in cells that hold about ``k`` references
    on average. A query meets the cells within one of its own, and is settled if its k-th distance is no more than
    the width that these cells cover around it for certain; the others go on with twice the width,
    until the cells cover all references. Blocks of cells are searched in arrays: a query lies in one block, and a reference goes to
    the blocks that it is near to; full blocks are dealt over salts of queries and slices of references. Pairs stay where they are made:
    only those that may be among a query's ``k`` leave. ``compared`` gets the number of pairs of each round.
    """
    ready(refs.sparkSession)
    columns = ("x", "y", "z")
    low, high = lambda c: F.min(c).alias(f"low_{c}"), lambda c: F.max(c).alias(f"high_{c}")
    box = refs.agg(F.count("*").alias("n"), F.count_distinct("batch").alias("batches")).crossJoin(
        refs.select(*columns).union(queries.select(*columns)).agg(*[f(c) for c in columns for f in (low, high)])
    ).first()  # one row each
    sides = [box[f"high_{c}"] - box[f"low_{c}"] for c in columns] if box["n"] else [0.0]
    # As wide as a cell of k references would be if they were spread evenly.
    wide = [s for s in sides if s > 0]
    size = (math.prod(wide) * k * max(1, box["batches"]) / box["n"]) ** (1 / len(wide)) if wide else 1.0
    most = max(1, math.ceil(max(sides) / size))
    cell = lambda c, width: F.floor(F.col(c) / width).cast("long")
    whole = lambda rows, names: rows.dropna(subset=["batch", *names])
    # Of references at one place the least ids come first, and no query takes more of them than it has places, and itself.
    copy = F.row_number().over(Window.partitionBy("batch", *columns).orderBy("id"))
    refs = whole(refs, columns).withColumn("copy", copy).filter(F.col("copy") <= k + 1).select("batch", F.col("id").alias("ref"), *[F.col(c).alias(f"r{c}") for c in columns]).checkpoint()
    left, settled, width = whole(queries.select("batch", "id", *columns), columns).checkpoint(), None, size
    block, key = [f"b{c}" for c in columns], ["batch", *[f"b{c}" for c in columns], "salt", "slice"]
    while True:
        last = width >= most * size
        r, q = refs, left
        for c in columns:
            of = lambda far, c=c: F.floor((cell(f"r{c}", width) + far) / BLOCK_CELLS)
            r = r.withColumn(f"b{c}", F.explode(F.array_distinct(F.array(of(-1), of(1)))))
            q = q.withColumn(f"b{c}", F.floor(cell(c, width) / BLOCK_CELLS))
        parts = lambda n, each: F.ceil(F.col(n) / each).cast("int")
        sizes = q.groupBy("batch", *block).agg(F.count("*").alias("nq")).join(r.groupBy("batch", *block).agg(F.count("*").alias("nr")), ["batch", *block])
        sizes = sizes.select("batch", *block, parts("nq", BLOCK_QUERIES).alias("salts"), parts("nr", BLOCK_REFS).alias("slices"))
        dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = q.join(sizes, ["batch", *block]).withColumn("salt", dealt("id", "salts")).withColumn("slice", each("slices")).drop("salts", "slices")
        r = r.join(sizes, ["batch", *block]).withColumn("slice", dealt("ref", "slices")).withColumn("salt", each("salts")).drop("salts", "slices")
        r = r.toDF(*r.columns)  # columns of its own, where references and queries are one table
        met = q.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(_near(width, k, keep_self), NEAR)
        seen = Observation()
        met = met.observe(seen, F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).filter("pairs IS NULL")
        d = F.round(F.sqrt(sum((F.col(c) - F.col(f"r{c}")) ** 2 for c in columns)), 9)
        place = F.row_number().over(Window.partitionBy("batch", "id").orderBy("d", "ref"))
        found = met.withColumn("d", d).withColumn("place", place.cast("long")).filter(F.col("place") <= k).select("batch", "id", "place", "ref", "d").checkpoint()
        if compared is not None:
            compared.append(seen.get["pairs"])
        if last:
            return settled.unionByName(found) if settled is not None else found
        kth = found.groupBy("batch", "id").agg(F.max("d").alias("d"), F.count("*").alias("n")).filter((F.col("n") == k) & (F.col("d") < width - 1e-8))
        done = found.join(kth.select("batch", "id"), ["batch", "id"], "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        left = left.join(kth, ["batch", "id"], "left_anti").checkpoint()
        if left.isEmpty():
            return settled
        width *= 2


KNN = "SELECT q.batch, q.id, row_number() OVER (PARTITION BY q.batch, q.id ORDER BY round(sqrt((q.x - r.x) ** 2 + (q.y - r.y) ** 2 + (q.z - r.z) ** 2), 9), r.id) AS place, r.id AS ref, round(sqrt((q.x - r.x) ** 2 + (q.y - r.y) ** 2 + (q.z - r.z) ** 2), 9) AS d FROM points q JOIN points r ON q.batch = r.batch"


@query(f"WITH {POINTS}, k AS ({KNN}) SELECT batch, id, place, ref, d FROM k WHERE place <= 16")
def knn_topk(spark, sf_dir):
    p = points(spark, sf_dir)
    return nearest(p, p, 16)


@query(f"WITH {POINTS}, k AS ({KNN} WHERE q.id <> r.id) SELECT k.id, ref, round(p.fvec[5], 6) AS feature FROM k JOIN points p ON p.id = ref WHERE place = 1")
def knn_top1(spark, sf_dir):
    """The feature of the nearest other point."""
    p = points(spark, sf_dir)
    one = nearest(p, p, 1, keep_self=False)
    return one.join(p.select(F.col("id").alias("ref"), "fvec"), "ref").select("id", "ref", r6(F.element_at("fvec", 5)).alias("feature"))


@query(f"WITH {POINTS}, k AS ({KNN} WHERE q.id <> r.id) SELECT batch, id, place, ref FROM k WHERE place <= 3")
def knn_self_excl(spark, sf_dir):
    p = points(spark, sf_dir)
    return nearest(p, p, 3, keep_self=False).select("batch", "id", "place", "ref")


@query(f"WITH {POINTS}, k AS ({KNN} WHERE r.z > 0) SELECT batch, id, place, ref FROM k WHERE place <= 4")
def knn_filtered(spark, sf_dir):
    """Invalid references go before the search."""
    p = points(spark, sf_dir)
    return nearest(p.filter("z > 0"), p, 4).select("batch", "id", "place", "ref")


CAMERAS = "cameras AS (SELECT n_nationkey::BIGINT AS view, n_regionkey::BIGINT AS rig, 400 + n_nationkey * 10.0::DOUBLE AS f, n_nationkey * 0.1::DOUBLE AS angle, 4 + n_regionkey * 0.5::DOUBLE AS back FROM nation)"


def cameras(spark, sf_dir) -> DataFrame:
    """Pinhole cameras that look along z, turned about it: one for each nation, five to a rig."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.cast("long").alias("view"), F.col("n_regionkey").cast("long").alias("rig"), (400 + k * 10.0).alias("f"), (k * 0.1).alias("angle"), (4 + F.col("n_regionkey") * 0.5).alias("back")
    )


def project(x: Column, y: Column, z: Column, f: Column, angle: Column, back: Column) -> tuple[Column, Column, Column]:
    """Pixel and depth of a point."""
    depth = z + back
    u = F.cos(angle) * x - F.sin(angle) * y
    v = F.sin(angle) * x + F.cos(angle) * y
    return f * u / depth + 320, f * v / depth + 240, depth


SQL_PROJECT = "f * (cos(angle) * x - sin(angle) * y) / (z + back) + 320 AS u, f * (sin(angle) * x + cos(angle) * y) / (z + back) + 240 AS v, z + back AS depth"


@query(f"WITH {POINTS}, {CAMERAS}, p AS (SELECT view, id, {SQL_PROJECT} FROM points, cameras WHERE batch % 5 = rig) SELECT view, count(*) AS points, count(*) FILTER (WHERE u >= 200 AND u < 440 AND v >= 150 AND v < 330) AS inside, round(avg(u), 6) AS u, round(avg(depth), 6) AS depth FROM p GROUP BY view")
def join_project_views(spark, sf_dir):
    """Every point in every view of its rig."""
    c = bounded_broadcast(cameras(spark, sf_dir))
    p = points(spark, sf_dir).withColumn("rig", F.col("batch") % 5).join(c, "rig")
    u, v, depth = project(*map(F.col, ("x", "y", "z", "f", "angle", "back")))
    p = p.select("view", u.alias("u"), v.alias("v"), depth.alias("depth"))
    inside = (F.col("u") >= 200) & (F.col("u") < 440) & (F.col("v") >= 150) & (F.col("v") < 330)
    return p.groupBy("view").agg(F.count("*").alias("points"), F.count_if(inside).alias("inside"), r6(F.avg("u")).alias("u"), r6(F.avg("depth")).alias("depth"))


GRID = "grid AS (SELECT CAST(floor(embedding[1]::DOUBLE / 0.05::DOUBLE) AS BIGINT) AS cx, CAST(floor(embedding[2]::DOUBLE / 0.05::DOUBLE) AS BIGINT) AS cy, min(embedding[3]::DOUBLE) AS depth FROM embeddings GROUP BY ALL)"


@query(f"WITH {GRID} SELECT g.cx, g.cy, round(arg_min(o.depth - g.depth + 0.05, struct_pack(a := round(abs(o.depth - g.depth + 0.05), 9), b := o.depth)), 6) AS residual FROM grid g JOIN grid o ON o.cx BETWEEN g.cx - 1 AND g.cx + 1 AND o.cy BETWEEN g.cy - 1 AND g.cy + 1 GROUP BY g.cx, g.cy")
def join_neighborhood_min(spark, sf_dir):
    """The least absolute residual of the nine cells around."""
    r = F.col("other") - F.col("depth") + 0.05
    near = around(cells(points(spark, sf_dir), 0.05))
    return near.groupBy("cx", "cy").agg(r6(F.min_by(r, F.struct(F.round(F.abs(r), 9), "other"))).alias("residual"))


@query(f"WITH {TRACK_OBS}, ok AS (SELECT track, frame // 5 AS cand FROM track_obs GROUP BY ALL HAVING count(*) FILTER (WHERE vis) = 5) SELECT o.track, o.frame FROM track_obs o SEMI JOIN ok ON ok.track = o.track AND ok.cand = o.frame // 5")
def join_all_offsets_semi(spark, sf_dir):
    """Candidates that are valid at all five offsets."""
    o = track_obs(spark, sf_dir).withColumn("cand", F.floor(F.col("frame") / 5))
    ok = o.groupBy("track", "cand").agg(F.count_if("vis").alias("n")).filter("n = 5")
    return o.join(ok, ["track", "cand"], "left_semi").select("track", "frame")


@query("SELECT s_suppkey AS id FROM supplier ANTI JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_tax > 0.07) ON l_suppkey = s_suppkey")
def join_anti_resume(spark, sf_dir):
    """Work that no complete result covers yet."""
    done = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 AND l_tax > 0.07").select(F.col("l_suppkey").alias("id"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(done, "id", "left_anti")


@query("""WITH s AS (SELECT c_nationkey::BIGINT AS source, c_custkey AS scene, 1 + c_custkey % 6 AS want FROM customer), sets AS (SELECT unnest([2, 4, 5, 8])::BIGINT AS size)
SELECT source, scene, want, min(size) FILTER (WHERE size >= want) AS size FROM s, sets GROUP BY ALL""")
def join_ceiling_lookup(spark, sf_dir):
    """The smallest supported size that is enough; the sizes are a short list in the plan."""
    sizes = F.array(*[F.lit(k).cast("long") for k in (2, 4, 5, 8)])
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("source"), F.col("c_custkey").alias("scene"), (1 + F.col("c_custkey") % 6).alias("want"))
    return s.withColumn("size", F.array_min(F.filter(sizes, lambda k: k >= F.col("want"))))


@query("""WITH e AS (SELECT 'hardware/gpu_' || (user_id % 3) || '/' || event_type AS tag, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step, value FROM events)
SELECT regexp_extract(tag, 'hardware/gpu_(\\d+)/', 1) AS gpu, step, round(max(value) FILTER (WHERE tag LIKE '%/view'), 6) AS view, round(max(value) FILTER (WHERE tag LIKE '%/click'), 6) AS click, step - min(step) OVER (PARTITION BY regexp_extract(tag, 'hardware/gpu_(\\d+)/', 1)) AS elapsed FROM e GROUP BY 1, 2""")
def join_tag_pivot(spark, sf_dir):
    """Hardware tags to one row a device and step, with the steps since the device's first."""
    tag = F.concat(F.lit("hardware/gpu_"), F.col("user_id") % 3, F.lit("/"), F.col("event_type"))
    e = table(spark, sf_dir, "events").select(tag.alias("tag"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("step"), "value")
    e = e.select(F.regexp_extract("tag", r"hardware/gpu_(\d+)/", 1).alias("gpu"), F.element_at(F.split("tag", "/"), -1).alias("field"), "step", "value")
    wide = e.groupBy("gpu", "step").pivot("field", ["view", "click"]).agg(F.max("value"))
    return wide.select("gpu", "step", r6("view").alias("view"), r6("click").alias("click"), (F.col("step") - F.min("step").over(Window.partitionBy("gpu"))).alias("elapsed"))


@query(f"""WITH {POINTS}, f AS (SELECT id AS face, id AS v0, (id * 3 + 1) % n AS v1, (id * 5 + 2) % n AS v2 FROM points, (SELECT count(*) AS n FROM points)), c AS (SELECT face, unnest([v0, v1, v2]) AS id, unnest([0.5, 0.3, 0.2])::DOUBLE AS w FROM f)
SELECT face, round(sum(w * x), 6) AS x, round(sum(w * y), 6) AS y, round(sum(w * z), 6) AS z FROM c JOIN points USING (id) GROUP BY face""")
def join_barycentric(spark, sf_dir):
    """A face's point as the weighted sum of its three corners; a face for each point."""
    p = points(spark, sf_dir).select("id", "x", "y", "z")
    f = p.select("id").crossJoin(F.broadcast(p.agg(F.count("*").alias("n"))))  # one number
    corner = lambda v, w: F.struct(v.alias("v"), F.lit(w).alias("w"))
    corners = F.array(corner(F.col("id"), 0.5), corner((F.col("id") * 3 + 1) % F.col("n"), 0.3), corner((F.col("id") * 5 + 2) % F.col("n"), 0.2))
    f = f.select(F.col("id").alias("face"), F.explode(corners).alias("c")).select("face", F.col("c.v").alias("id"), F.col("c.w").alias("w"))
    return f.join(p, "id").groupBy("face").agg(*[r6(F.sum(F.col("w") * F.col(c))).alias(c) for c in "xyz"])


@query("""WITH t AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), u AS (SELECT o_orderkey AS id, -o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT o_orderkey AS id, coalesce(t.v, u.v) AS v, t.v IS NULL AND u.v IS NULL AS missing FROM orders LEFT JOIN t ON t.id = o_orderkey LEFT JOIN u ON u.id = o_orderkey""")
def join_two_source_fallback(spark, sf_dir):
    """Metadata of the first source, else of the second, else flagged."""
    o = table(spark, sf_dir, "orders")
    t = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("t"))
    u = o.filter("o_orderstatus IN ('F', 'O')").select(F.col("o_orderkey").alias("id"), (-F.col("o_totalprice")).alias("u"))
    both = o.select(F.col("o_orderkey").alias("id")).join(t, "id", "left").join(u, "id", "left")
    return both.select("id", F.coalesce("t", "u").alias("v"), (F.col("t").isNull() & F.col("u").isNull()).alias("missing"))


@query("SELECT n_name AS archive, list_sort(list(DISTINCT c_mktsegment)) AS members, count(*) AS rows FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def join_lookup_group(spark, sf_dir):
    """Members by the archive that a lookup gives them."""
    n = bounded_broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("archive")))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey").groupBy("archive").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("members"), F.count("*").alias("rows"))


@query(f"""WITH {GRID}, s AS (SELECT cx, cy, cx + 0.3::DOUBLE AS sx, cy + 0.6::DOUBLE AS sy FROM grid), n AS (SELECT s.cx, s.cy, (CASE WHEN dx = 0 THEN 0.7 ELSE 0.3 END)::DOUBLE * (CASE WHEN dy = 0 THEN 0.4 ELSE 0.6 END)::DOUBLE AS w, g.depth FROM s, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), grid g WHERE g.cx = s.cx + dx AND g.cy = s.cy + dy)
SELECT cx, cy, round(sum(w * depth) / sum(w), 6) AS value FROM n GROUP BY cx, cy""")
def join_bilinear(spark, sf_dir):
    """Bilinear sampling from the four cells around, missing ones left out."""
    g = cells(points(spark, sf_dir), 0.05)
    parts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(wx * wy).alias("w")) for dx, wx in ((0, 0.7), (1, 0.3)) for dy, wy in ((0, 0.4), (1, 0.6))])
    s = g.select("cx", "cy", F.explode(parts).alias("p")).select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), (F.col("cx") + F.col("p.dx")).alias("cx"), (F.col("cy") + F.col("p.dy")).alias("cy"), F.col("p.w").alias("w"))
    return s.join(g, ["cx", "cy"]).groupBy("ax", "ay").agg(r6(F.sum(F.col("w") * F.col("depth")) / F.sum("w")).alias("value")).withColumnsRenamed({"ax": "cx", "ay": "cy"})


def eps_components(rows: DataFrame, eps: float) -> DataFrame:
    """``id, component``: connected components of points closer than ``eps``, by their smallest id.

    Points meet in grid cells of width eps: each goes to the cells around it, others to their
    own. A point without a close one is its own component.
    """
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    p = rows.select("id", "x", "y", "z", *[cell(c).alias(f"c{c}") for c in "xyz"])
    shift = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    q = p.withColumn("dx", shift).withColumn("dy", shift).withColumn("dz", shift)
    q = q.select(F.col("id").alias("u"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[(F.col(f"c{c}") + F.col(f"d{c}")).alias(f"c{c}") for c in "xyz"])
    d = sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz")
    edges = p.join(q, ["cx", "cy", "cz"]).filter((d <= eps * eps) & (F.col("id") > F.col("u"))).select("u", F.col("id").alias("v"))
    found = components(edges)
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(f"""WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.03::DOUBLE * 0.03::DOUBLE),
reach AS (SELECT id AS a, id AS b FROM points UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS id, min(b) AS component FROM reach GROUP BY a""")
def graph_eps_components(spark, sf_dir):
    """Near copies of points: components of the graph of close pairs."""
    return eps_components(points(spark, sf_dir), 0.03)
