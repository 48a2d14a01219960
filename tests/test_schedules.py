"""Pairing plans, stateless cursors, chunk scans, near copies of tracks, significance of correlations."""

import math
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest
from orrery.functions import chunks, student
from orrery.operators import near_tracks
from orrery.plans import cursors, pairing
from pyspark.sql import functions as F


def blocks(*rows):
    """Arrays of blocks, each of which is a list of (views, width, tracks)."""
    n = len(rows)
    full = lambda v: np.full((n, 8), v, np.int64)
    a = np.array(rows, np.int64)
    return {"views": a[:, :, 0], "frames": full(24), "height": full(384), "width": a[:, :, 1], "start": full(0), "tracks": a[:, :, 2]}


def every_plan(scenes):
    """All plans of a block, by their aims: pairs, padding, the busier rank, imbalance, groups, places."""

    def cost(g):
        v, w, most = scenes[g[0]][0], scenes[g[0]][1], max(scenes[i][2] for i in g)
        return len(g) - 1, sum(most - scenes[i][2] for i in g), v * 24 * len(g) * (384 * w + most)

    def fits(g):
        return len(g) == 1 or (scenes[g[0]][:2] == scenes[g[1]][:2] and cost(g)[2] and max(scenes[i][2] for i in g) <= {1: 1024, 2: 1024, 3: 1280, 4: 1024}.get(scenes[g[0]][0], 0))

    def split(places):
        if not places:
            yield ()
            return
        for other in (None, *places[1:]):
            g = (places[0],) if other is None else (places[0], other)
            if fits(g):
                for more in split([p for p in places if p not in g]):
                    yield (g, *more)

    for rest in combinations(range(1, 8), 3):
        zero = [0, *rest]
        for a, b in product(split(zero), split([p for p in range(8) if p not in zero])):
            costs = [[cost(g) for g in side] for side in (a, b)]
            work = [sum(c[2] for c in side) for side in costs]
            plan = tuple(tuple(sorted(side, key=lambda g: (-cost(g)[2], g))) for side in (a, b))
            yield (-sum(c[0] for s in costs for c in s), sum(c[1] for s in costs for c in s), max(work), abs(work[0] - work[1]), abs(len(a) - len(b)), *plan)


def test_plans_are_the_best_of_all(rand=np.random.default_rng(7)):
    rows = [[(int(rand.integers(1, 6)) if k % 3 else 2, 512 if k % 2 else int(rand.choice([384, 512])), int(rand.choice([100, 150, 400, 1024, 1025, 1280, 1281]))) for _ in range(8)] for k in range(24)]
    for scenes, plan in zip(rows, pairing.block_plans(blocks(*rows)), strict=True):
        assert plan == min(every_plan(scenes))[5:]


@pytest.mark.parametrize(
    ("scenes", "pairs"),
    [
        ([(2, 512, 100 + 50 * k) for k in range(8)], 4),
        ([(2, 512, 1025 if k < 2 else 512) for k in range(8)], 3),
        ([(3, 512, 1280)] * 8, 4),
        ([(5, 512, 256)] * 8, 0),
        ([(6, 512, 256)] * 8, 0),
        ([(1 if k < 4 else 2, 512, 256) for k in range(8)], 4),
        ([(1, 512, 256), (1, 512, 512)] + [(5, 512, 256)] * 6, 1),
        ([(1, 512 + k // 2, 100 if k % 2 else 900) for k in range(8)], 4),
    ],
)
def test_pairs_come_before_all_else(scenes, pairs):
    (plan,) = pairing.block_plans(blocks(scenes))
    groups = [g for side in plan for g in side]
    assert sorted(i for g in groups for i in g) == list(range(8)) and [sum(map(len, side)) for side in plan] == [4, 4]
    assert sum(len(g) - 1 for g in groups) == pairs


def test_scenes_left_over_are_planned_by_rank(spark):
    rows = [("s", k, k, 2, 24, 384, 512, 0, 100 + 10 * (k % 2)) for k in range(13)]
    df = spark.createDataFrame(rows, "source string, cursor long, scene long, views long, frames long, height long, width long, start long, tracks long").withColumn("source", F.lit(3).cast("long"))
    got = pairing.physical_plan(df).collect()
    assert sorted(r.scene for r in got) == list(range(13))
    rest = {(r.rank, r.run, r.in_group): r.scene for r in got if r.block == 1}
    assert rest == {(0, 0, 0): 8, (0, 0, 1): 10, (0, 1, 0): 9, (0, 1, 1): 11, (1, 0, 0): 12}
    assert {(r.pairs, r.padding) for r in got if r.block == 1} == {(2, 0)} and {(r.pairs, r.padding) for r in got if r.block == 0} == {(4, 0)}


def test_cursors_run_through_permutations(spark):
    counts = spark.createDataFrame([(0, 1), (1, 2), (2, 17), (3, 98), (4, 1000)], "source long, scenes long")
    df = counts.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("scenes") * 4 - 1))).drop("scenes")
    got = cursors.scheduled(df, counts, F.col("o"), 5).toPandas()
    for source, n in ((0, 1), (1, 2), (2, 17), (3, 98), (4, 1000)):
        orders = [c.sort_values("o")["scene_index"].tolist() for _, c in got[got["source"] == source].groupby("cycle")]
        assert len(orders) == 4 and all(sorted(o) == list(range(n)) for o in orders)
        if n > 10:
            assert len({tuple(o) for o in orders}) == 4 and all(abs(np.corrcoef(o, range(n))[0, 1]) < 0.6 for o in orders)
    alone = cursors.scheduled(df.filter("source = 4 AND o = 2345"), counts, F.col("o"), 5).first().scene_index
    assert alone == got[(got["source"] == 4) & (got["o"] == 2345)]["scene_index"].item()
    other = cursors.scheduled(df.filter("source = 4"), counts, F.col("o"), 6).toPandas().sort_values("o")["scene_index"].tolist()
    assert other != got[got["source"] == 4].sort_values("o")["scene_index"].tolist()


@pytest.mark.parametrize("chunk", [4, 8, 64])
def test_chunks_give_what_one_pass_gives(spark, chunk):
    r = np.random.default_rng(8)
    rows = [(t, f, float(r.normal()), bool(r.random() < 0.7)) for t, n in enumerate((1, 3, 4, 5, 8, 9, 12, 13, 16, 17, 31)) for f in range(n)]
    df = spark.createDataFrame(rows, "track long, frame long, x double, vis boolean").repartition(3)
    got = {(x.track, x.frame): x.px for x in chunks.scan_chunks(df, "track", [F.col("frame")], chunks.windowed, "track long, frame long, px double", chunk, chunks.HALF + 1).collect()}
    want = {}
    for t, part in pd.DataFrame(rows, columns=["track", "frame", "x", "vis"]).groupby("track"):
        out, _ = chunks.windowed(None, part.sort_values("frame"), len(part))
        want |= {(t, f): v for f, v in zip(out["frame"], out["px"], strict=True)}
    assert got == want and len(want) == len(rows)


def test_near_tracks_are_those_of_all_pairs(spark):
    r = np.random.default_rng(9)
    base = r.normal(0, 1, (40, 120))
    heap = base[0] + r.normal(0, 0.001, (60, 120))
    chain = base[1] + np.arange(12)[:, None] * 0.9 * np.eye(120)[5] * 0.05
    v = np.concatenate([base, base[:10], base[5:25] + r.normal(0, 0.003, (20, 120)), heap, chain])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    got = {x.id: x.component for x in near_tracks.near_copies(df, 0.05).collect()}
    close = np.linalg.norm(v[:, None] - v[None], axis=2) <= 0.05
    want = list(range(len(v)))
    for _ in range(20):
        want = [min(want[j] for j in np.flatnonzero(close[k])) for k in range(len(v))]
    assert got == dict(enumerate(want))
    assert near_tracks.near_copies(df.limit(0), 0.05).count() == 0


def t_tail(t, free):
    """Two-sided, by Simpson's rule over the angle: t = sqrt(free) tan."""
    theta = math.atan2(t, math.sqrt(free))
    x = np.linspace(theta, math.pi / 2, 200_001)
    y = np.cos(x) ** (free - 1)
    area = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-2:2].sum()) * (x[1] - x[0]) / 3
    return 2 * area * math.exp(math.lgamma((free + 1) / 2) - math.lgamma(free / 2)) / math.sqrt(math.pi)


def test_p_values(spark):
    rows = [(rho, n) for n in (3, 4, 5, 10, 11, 57, 1000, 100_000) for rho in (0.0, 0.01, -0.2, 0.5, -0.9, 0.999)] + [(1.0, 9), (-1.0, 3), (0.5, 2)]
    df = spark.createDataFrame(rows, "rho double, n long")
    got = {(x.rho, x.n): x.p for x in df.withColumn("p", student.correlation_p(F.col("rho"), F.col("n"))).collect()}
    for rho, n in rows[:-3]:
        want = t_tail(abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
        assert got[rho, n] == pytest.approx(want, rel=1e-8, abs=1e-12)
    assert got[1.0, 9] == 0 and got[-1.0, 3] == 0 and got[0.5, 2] is None
    assert got[0.5, 10] == pytest.approx(0.1411, abs=5e-5)


def test_p_values_of_many_tracks_take_steps_together(spark):
    """A batch of 20,000 rows is a few array operations a step, and the fraction stops when it has settled."""
    import time

    rng = np.random.default_rng(3)
    free, rho = rng.integers(1, 500, 20_000).astype(float), rng.uniform(-1, 1, 20_000)
    began = time.process_time()
    got = student.settled_fraction(free / 2, np.full(len(free), 0.5), 1 - rho * rho)
    assert time.process_time() - began < 5 and len(got) == 20_000
    missing = student.settled_fraction(np.array([1.0, np.nan]), np.array([0.5, 0.5]), np.array([0.25, 0.25]))
    assert np.isnan(missing[1]) and missing[0] == student.settled_fraction(np.array([1.0]), np.array([0.5]), np.array([0.25]))[0]


def test_spearman_reads_its_input_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    rows = spark.range(40).selectExpr("id % 2 g", "double(id * 7 % 40) a", "double(id * 3 % 40) b").mapInPandas(counted, "g long, a double, b double")
    assert student.spearman_test(rows, "g", "a", "b").count() == 3
    assert reads.value == 80  # once by key, once for the whole


def test_spearman_of_keys_and_of_all(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": r.integers(0, 2, 200), "a": r.normal(size=200), "b": r.normal(size=200)})
    got = {x.g: (x.n, x.rho) for x in student.spearman_test(spark.createDataFrame(pdf), "g", "a", "b").collect()}
    for g in (0, 1, None):
        part = pdf if g is None else pdf[pdf["g"] == g]
        assert got[g] == (len(part), pytest.approx(part["a"].rank().corr(part["b"].rank())))
