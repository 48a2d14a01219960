"""Near copies of whole tracks: vectors of hundreds of numbers, of which pairs within a distance are linked.

Grid cells do not carry over to so many dimensions, but distances to a few pivots do: two vectors within eps differ by eps at most in their
distance to any pivot. Equal vectors are one to begin with. Each vector gets its distances to the pivots, and lies in a cell of those to
the first three, of width eps; only vectors of neighbouring cells meet, as ids and distances, and what
all pivots allow is fetched and compared. Within a cell, leaders take those around them first: two vectors of one leader need no
comparison of their own, so a heap of near copies costs its size and not its square.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query
from ..sources.checkpoints import ready
from ..sources.views import TRACK_OBS, hashed, hashed_sql, track_obs
from .components import components
from .quantiles import looked_up

PIVOTS, GRID, SAMPLE, LEADERS = 8, 3, 512, 3


def spread_out(vectors: np.ndarray, k: int) -> np.ndarray:
    """Pivots: each the vector furthest from those before."""
    chosen, away = [0], np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def apart(a: Column, b: Column) -> Column:
    """The squared distance of two lists of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def near_links(rows: DataFrame, eps: float, pivots: int = PIVOTS) -> DataFrame:
    """``u, v``: links between ids of ``id, vector`` whose components are those of all pairs within ``eps``; vectors have one length, ids are unique."""
    ready(rows.sparkSession)
    one = rows.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector").checkpoint()
    copies = looked_up(rows, one.withColumnRenamed("id", "u"), ["vector"]).filter("id > u").select("u", F.col("id").alias("v"))
    # A bounded sample, by hash.
    drawn = one.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(drawn):
        return copies
    at = spread_out(np.array(drawn.tolist(), np.float64), pivots)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def to_pivots(vector: pd.Series) -> pd.Series:
        v = np.array(vector.tolist(), np.float64).reshape(len(vector), at.shape[1])
        return pd.Series(list(np.stack([np.linalg.norm(v - p, axis=1) for p in at], axis=1)))

    placed = one.withColumn("d", to_pivots("vector"))
    dims = min(GRID, len(at))
    placed = placed.select("id", "vector", "d", F.array(*[F.floor(F.element_at("d", k + 1) / eps).cast("long") for k in range(dims)]).alias("cell"), F.lit(None).cast("long").alias("leader")).checkpoint()
    for _ in range(LEADERS):
        first = placed.filter("leader IS NULL").groupBy("cell").agg(F.min_by(F.struct("id", "vector"), "id").alias("first"))
        met = placed.join(first, "cell", "left")
        takes = F.col("leader").isNull() & (apart(F.col("vector"), F.col("first.vector")) <= eps * eps)
        placed = met.withColumn("leader", F.when(takes, F.col("first.id")).otherwise(F.col("leader"))).drop("first").checkpoint()
    led = placed.filter("leader < id").select(F.col("leader").alias("u"), F.col("id").alias("v"))

    # Each unordered pair of neighbouring cells once: a vector goes to its own cell and those after it.
    after = [s for s in product((-1, 0, 1), repeat=dims) if s >= (0,) * dims]
    narrow = placed.select("id", "d", "cell", "leader")
    shifts = F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in after]))
    sent = narrow.withColumn("shift", shifts).select(F.col("id").alias("u"), F.col("d").alias("du"), F.col("leader").alias("lu"), F.zip_with("cell", "shift", lambda c, s: c + s).alias("cell"), (F.aggregate("shift", F.lit(0).cast("long"), lambda s, x: s + F.abs(x)) == 0).alias("own"))
    pairs = sent.join(narrow, "cell").filter((~F.col("own") | (F.col("u") < F.col("id"))) & ~F.coalesce(F.col("lu") == F.col("leader"), F.lit(False)))
    pairs = pairs.filter(F.aggregate(F.zip_with("du", "d", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x)) <= eps * (1 + 1e-9)).select("u", F.col("id").alias("v"))
    vectors = placed.select("id", "vector")
    full = pairs.join(vectors.withColumnsRenamed({"id": "u", "vector": "a"}), "u").join(vectors.withColumnsRenamed({"id": "v", "vector": "b"}), "v")
    close = full.filter(apart(F.col("a"), F.col("b")) <= eps * eps).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return copies.union(led).union(close).distinct()


def near_copies(rows: DataFrame, eps: float) -> DataFrame:
    """``id, component``: the smallest id that chains of links reach; rows without a near copy are their own."""
    found = components(near_links(rows, eps))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


FRAMES, EPS = 24, 0.05


def annotated(spark, sf_dir) -> DataFrame:
    """Tracks of one camera as lists of their first positions, and what two more cameras say of most of them: copies, a little off or equal."""
    o = track_obs(spark, sf_dir).filter(F.col("frame") < FRAMES)
    shift = lambda c: (hashed("near", F.concat_ws("-", F.lit(c), "camera", "event_id")) - 0.5) * 0.01 * F.col("camera")
    seen = o.withColumn("camera", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).filter((F.col("camera") == 0) | (hashed("seen", F.concat_ws("-", "camera", "track")) < 0.6))
    # The second camera's copies of even tracks are equal.
    off = lambda c: F.col(c) + F.when((F.col("camera") == 1) & (F.col("track") % 2 == 0), 0.0).otherwise(shift(c))
    points = seen.select((F.col("track") * 3 + F.col("camera")).alias("id"), "frame", off("x").alias("x"), off("y").alias("y"))
    lists = points.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("p")).filter(F.size("p") == FRAMES)
    return lists.select("id", F.flatten(F.transform("p", lambda p: F.array(p.x, p.y))).alias("vector"))


_OFF = lambda c: f"{c} + CASE WHEN camera = 1 AND track % 2 = 0 THEN 0 ELSE ({hashed_sql('near', f'''concat_ws('-', '{c}', camera, event_id)''')} - 0.5::DOUBLE) * 0.01::DOUBLE * camera END"
SQL = f"""WITH RECURSIVE {TRACK_OBS}, c AS (SELECT *, unnest([0, 1, 2]) AS camera FROM track_obs WHERE frame < {FRAMES}),
s AS (SELECT track * 3 + camera AS id, frame, {_OFF('x')} AS x, {_OFF('y')} AS y FROM c WHERE camera = 0 OR {hashed_sql('seen', "concat_ws('-', camera, track)")} < 0.6::DOUBLE),
v AS (SELECT id, list(x ORDER BY frame) || list(y ORDER BY frame) AS vector FROM s GROUP BY id HAVING count(*) = {FRAMES}),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_distance(a.vector, b.vector) <= {EPS}),
reach AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS id, min(b) AS component FROM reach GROUP BY a"""


@query(SQL)
def graph_near_tracks(spark, sf_dir):
    """Tracks that several cameras have annotated, by the first of each: components of tracks that are close over all frames."""
    return near_copies(annotated(spark, sf_dir), EPS)
