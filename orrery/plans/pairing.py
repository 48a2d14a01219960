"""Scenes paired into physical batches: the whole plan of each block of scenes.

A block is the scenes of one update: ``RANKS`` ranks, ``PER_RANK`` scenes each. Scenes of one
shape may share a group of two if their tracks fit the capacity for their views. Of all plans the
best one has the most pairs, then the least padding, then the least work on the busier
rank, then ranks closest in work, then in groups, then the smaller places in the block.

Blocks are small by definition and independent of each other: Spark gathers a block into one row, and a task plans
many of them at once in numpy. Pairs and padding add up over groups, whichever ranks
they are on. So the plan is found in two steps: the best groupings of each half of a block by itself (an
integer product of groups and groupings for all blocks), then, among halves whose sum is the block's optimum, the aims
that look at both ranks. What is left of a source's scenes after its last whole block is planned rank by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import ranked
from ..registry import query
from ..sources.views import table

RANKS, PER_RANK = 2, 4
BLOCK = RANKS * PER_RANK
#: The most tracks of a pair by the number of views; other numbers of views are never paired.
CAPACITY = {1: 1024, 2: 1024, 3: 1280, 4: 1024}

GROUPS = [(i,) for i in range(BLOCK)] + list(combinations(range(BLOCK), 2))
NUMBER = {g: k for k, g in enumerate(GROUPS)}


def groupings(left: tuple[int, ...]) -> list[tuple[tuple[int, ...], ...]]:
    """All ways to split places into groups of one or two."""
    if not left:
        return [()]
    head, rest = left[0], left[1:]
    alone = [((head,), *more) for more in groupings(rest)]
    return alone + [((head, other), *more) for other in rest for more in groupings(tuple(x for x in rest if x != other))]


HALVES = list(combinations(range(BLOCK), PER_RANK))
#: Rank 0 has the first scene: the other half of the splits are the same plans with the ranks exchanged.
SPLITS = [(k, HALVES.index(tuple(x for x in range(BLOCK) if x not in half))) for k, half in enumerate(HALVES) if 0 in half]
WAYS = [groupings(half) for half in HALVES]
HAS = np.zeros((len(HALVES), len(WAYS[0]), len(GROUPS)), np.int64)
for _half, _ways in enumerate(WAYS):
    for _way, _groups in enumerate(_ways):
        HAS[_half, _way, [NUMBER[g] for g in _groups]] = 1
NEVER = 1 << 40


def costs(b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pairs, padding, work`` of every group of every block; a group that may not be has ``NEVER`` as padding."""
    one = np.array([g[0] for g in GROUPS])
    two = np.array([g[-1] for g in GROUPS])
    most = np.maximum(b["tracks"][:, one], b["tracks"][:, two])
    paired = (one != two).astype(np.int64)
    size = 1 + paired
    padding = 2 * most - b["tracks"][:, one] - b["tracks"][:, two]
    frames = (b["views"] * b["frames"])[:, one]
    work = frames * size * ((b["height"] * b["width"])[:, one] + most)
    alike = np.all([b[c][:, one] == b[c][:, two] for c in ("views", "frames", "height", "width", "start")], axis=0)
    capacity = np.zeros_like(most)
    for views, tracks in CAPACITY.items():
        capacity[b["views"][:, one] == views] = tracks
    fits = (paired == 0) | (alike & (most <= capacity))
    return np.broadcast_to(paired, most.shape), np.where(fits, padding, NEVER), work


def signature(groups: tuple[tuple[int, ...], ...], work: np.ndarray) -> tuple[tuple[int, ...], ...]:
    """A rank's groups in the order in which they run: most work first, then by place."""
    return tuple(sorted(groups, key=lambda g: (-work[NUMBER[g]], g)))


Plan = tuple[tuple[tuple[int, ...], ...], ...]


def block_plans(b: dict[str, np.ndarray]) -> list[Plan]:
    """The best plan of each whole block, as each rank's groups; ``b`` holds arrays of blocks by places."""
    pairs, padding, work = costs(b)
    by_way = lambda cost: np.einsum("bg,hwg->bhw", cost, HAS, optimize=True)
    n_pairs, pads, works = by_way(pairs), by_way(padding), by_way(work)
    # Both aims in one number: a pair outweighs all padding that groups allow.
    value = np.where(pads < NEVER, n_pairs * NEVER - pads, -NEVER)
    best = value.max(axis=2)
    zero, one = np.array(SPLITS).T
    total = best[:, zero] + best[:, one]
    good = value == best[:, :, None]
    out = []
    for k in range(len(value)):
        found = []
        for s in np.flatnonzero(total[k] == total[k].max()):
            w0, w1 = np.flatnonzero(good[k, zero[s]]), np.flatnonzero(good[k, one[s]])
            a, c = (x.ravel() for x in np.meshgrid(w0, w1, indexing="ij"))
            found.append(np.stack([np.full(len(a), s), a, c, works[k, zero[s], a], works[k, one[s], c]], axis=1))
        found = np.concatenate(found)
        sizes = HAS.sum(axis=2)
        s, a, c, x, y = found.T
        aims = np.stack([np.maximum(x, y), np.abs(x - y), np.abs(sizes[zero[s], a] - sizes[one[s], c])], axis=1)
        for aim in range(aims.shape[1]):
            least = aims[:, aim] == aims[:, aim].min()
            aims, found = aims[least], found[least]
        out.append(min(tuple(signature(WAYS[h][w], work[k]) for h, w in ((zero[s], a), (one[s], c))) for s, a, c, _, _ in found.tolist()))
    return out


def rank_plan(b: dict[str, np.ndarray], k: int, places: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """The groups of one rank's scenes, which stay on it: fewest groups, then padding, work and places."""
    _, padding, work = costs({c: v[k : k + 1] for c, v in b.items()})
    total = lambda way, cost: int(sum(cost[0, NUMBER[g]] for g in way))
    ways = [w for w in groupings(places) if total(w, padding) < NEVER]
    return min(ways, key=lambda w: (len(w), total(w, padding), total(w, work), w))


SHAPE = ("views", "frames", "height", "width", "start", "tracks")
PLANNED = "source long, block long, scene long, rank long, run long, in_group long, pairs long, padding long, imbalance long"


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if batch.empty:
            continue
        n = batch["scene"].str.len().to_numpy()
        b = {c: np.array([np.pad(np.asarray(v, np.int64), (0, BLOCK - len(v))) for v in batch[c]]) for c in SHAPE}
        whole = np.flatnonzero(n == BLOCK)
        plans: dict[int, Plan] = dict(zip(whole.tolist(), block_plans({c: v[whole] for c, v in b.items()}), strict=True)) if len(whole) else {}
        for k in np.flatnonzero(n < BLOCK).tolist():
            plans[k] = tuple(rank_plan(b, k, tuple(range(r * PER_RANK, min(n[k], (r + 1) * PER_RANK)))) for r in range(RANKS))
        _, padding, work = costs(b)
        out = []
        for k, plan in plans.items():
            spent = [sum(int(work[k, NUMBER[g]]) for g in groups) for groups in plan]
            pads = sum(int(padding[k, NUMBER[g]]) for groups in plan for g in groups)
            pairs = sum(len(g) - 1 for groups in plan for g in groups)
            for rank, groups in enumerate(plan):
                for run, group in enumerate(groups):
                    out += [(batch["source"].iloc[k], batch["block"].iloc[k], batch["scene"].iloc[k][i], rank, run, at, pairs, pads, abs(spent[0] - spent[1])) for at, i in enumerate(group)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PLANNED.split(", ")])


def physical_plan(scenes: DataFrame) -> DataFrame:
    """A plan for ``source, cursor, scene`` with views, frames, height, width, start and tracks.

    Blocks are eight neighbours of a source in the order of cursors. ``rank, run, in_group`` tell where a scene runs: its rank, the place of
    its group there, and its place in the group; ``pairs, padding, imbalance`` are those of the block's plan.
    """
    placed = ranked(scenes, ["source"], [F.col("cursor"), F.col("scene")], "place").withColumn("block", F.floor(F.col("place") / BLOCK))
    blocks = placed.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("place", "scene", *SHAPE))).alias("s"))
    rows = blocks.select("source", "block", F.col("s.scene").alias("scene"), *[F.col(f"s.{c}").alias(c) for c in SHAPE])
    return rows.mapInPandas(_plan, PLANNED)


PLAN_SCENES = """plan_scenes AS (SELECT c_nationkey::BIGINT AS source, c_custkey AS cursor, c_custkey AS scene, 1 + c_custkey % 5 AS views, 24::BIGINT AS frames, 384::BIGINT AS height,
    CASE WHEN c_mktsegment < 'F' THEN 512 ELSE 384 END::BIGINT AS width, 0::BIGINT AS start, 1 + (c_custkey * 37) % 23 * 50 AS tracks FROM customer)"""


def plan_scenes(spark, sf_dir) -> DataFrame:
    k, zero = F.col("c_custkey"), F.lit(0).cast("long")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("source"), k.alias("cursor"), k.alias("scene"), (1 + k % 5).alias("views"), (zero + 24).alias("frames"), (zero + 384).alias("height"),
        F.when(F.col("c_mktsegment") < "F", 512).otherwise(384).cast("long").alias("width"), zero.alias("start"), (1 + (k * 37) % 23 * 50).alias("tracks"),
    )


#: Every plan of every block, group by group: the first place that is free, alone or with a partner, on either rank.
SQL = f"""WITH RECURSIVE {PLAN_SCENES}, placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cursor, scene) - 1 AS place FROM plan_scenes),
b AS (SELECT *, place // 8 AS block, (place % 8)::INTEGER AS i, count(*) OVER (PARTITION BY source, place // 8) AS n, CASE views WHEN 3 THEN 1280 WHEN 5 THEN 0 ELSE 1024 END AS capacity FROM placed),
g AS (SELECT source, block, n, i, NULL::INTEGER AS j, [i] AS sig, 0::BIGINT AS pad, views * frames * (height * width + tracks) AS work FROM b
    UNION ALL SELECT x.source, x.block, x.n, x.i, y.i, [x.i, y.i], abs(x.tracks - y.tracks), x.views * x.frames * 2 * (x.height * x.width + greatest(x.tracks, y.tracks))
    FROM b x JOIN b y ON x.source = y.source AND x.block = y.block AND x.i < y.i AND x.views = y.views AND x.frames = y.frames AND x.height = y.height AND x.width = y.width AND x.start = y.start
    WHERE greatest(x.tracks, y.tracks) <= x.capacity),
walk AS (SELECT source, block, n, 0 AS used, []::STRUCT(minus BIGINT, sig INTEGER[])[] AS r0, []::STRUCT(minus BIGINT, sig INTEGER[])[] AS r1, 0 AS n0, 0 AS n1, 0::BIGINT AS pad, 0::BIGINT AS w0, 0::BIGINT AS w1 FROM b WHERE i = 0
    UNION ALL SELECT w.source, w.block, w.n, w.used | (1 << g.i) | coalesce(1 << g.j, 0), CASE WHEN r = 0 THEN list_append(r0, struct_pack(minus := -g.work, sig := g.sig)) ELSE r0 END,
    CASE WHEN r = 1 THEN list_append(r1, struct_pack(minus := -g.work, sig := g.sig)) ELSE r1 END, n0 + (1 - r) * len(g.sig), n1 + r * len(g.sig), w.pad + g.pad, w0 + (1 - r) * g.work, w1 + r * g.work
    FROM walk w JOIN g ON g.source = w.source AND g.block = w.block, (SELECT unnest([0, 1]) AS r)
    WHERE w.used < (1 << w.n) - 1 AND w.used & (1 << g.i) = 0 AND (g.i = 0 OR w.used & ((1 << g.i) - 1) = (1 << g.i) - 1) AND (g.j IS NULL OR w.used & (1 << g.j) = 0)
    AND CASE WHEN w.n = 8 THEN (g.i > 0 OR r = 0) ELSE r = g.i // 4 AND (g.j IS NULL OR g.j // 4 = r) END AND n0 + (1 - r) * len(g.sig) <= 4 AND n1 + r * len(g.sig) <= 4),
done AS (SELECT *, list_transform(list_sort(r0), lambda x: x.sig) AS s0, list_transform(list_sort(r1), lambda x: x.sig) AS s1, list_transform(r0, lambda x: x.sig) AS p0, list_transform(r1, lambda x: x.sig) AS p1 FROM walk WHERE used = (1 << n) - 1),
best AS (SELECT source, block, arg_min(struct_pack(s0 := s0, s1 := s1, pad := pad, w := abs(w0 - w1)), struct_pack(a := len(r0) + len(r1), b := pad, c := greatest(w0, w1), d := abs(w0 - w1), e := abs(len(r0) - len(r1)), f := s0, g := s1)) AS p FROM done WHERE n = 8 GROUP BY source, block
    UNION ALL SELECT source, block, struct_pack(s0 := arg_min(p0, struct_pack(a := len(r0), b := q0, c := w0, d := p0)), s1 := arg_min(p1, struct_pack(a := len(r1), b := q1, c := w1, d := p1)), pad := min(struct_pack(a := len(r0), b := q0)).b + min(struct_pack(a := len(r1), b := q1)).b,
        w := abs(min(struct_pack(a := len(r0), b := q0, c := w0)).c - min(struct_pack(a := len(r1), b := q1, c := w1)).c))
    FROM (SELECT d.*, coalesce(q0, 0) AS q0, pad - coalesce(q0, 0) AS q1 FROM done d LEFT JOIN (SELECT source, block, used, n, p0 AS p, sum(q)::BIGINT AS q0 FROM (SELECT DISTINCT d.source, d.block, d.used, d.n, d.p0, g.sig, g.pad AS q FROM done d JOIN g ON d.source = g.source AND d.block = g.block AND list_contains(d.p0, g.sig) WHERE d.n < 8) GROUP BY ALL) z ON d.source = z.source AND d.block = z.block AND d.p0 = z.p WHERE d.n < 8) GROUP BY source, block),
runs AS (SELECT source, block, p, 0 AS rank, unnest(p.s0) AS sig, unnest(range(len(p.s0))) AS run FROM best UNION ALL SELECT source, block, p, 1, unnest(p.s1), unnest(range(len(p.s1))) FROM best),
each AS (SELECT source, block, p, rank, run, unnest(sig) AS i, unnest(range(len(sig))) AS in_group, FROM runs)
SELECT each.source, each.block, b.scene, rank::BIGINT AS rank, run, in_group, CAST(n - len(p.s0) - len(p.s1) AS BIGINT) AS pairs, p.pad AS padding, CAST(p.w AS BIGINT) AS imbalance
FROM each JOIN b ON b.source = each.source AND b.block = each.block AND b.i = each.i"""


@query(SQL)
def sched_physical_plan(spark, sf_dir):
    """The whole plan: which scenes share a group, on which rank, in which order."""
    return physical_plan(plan_scenes(spark, sf_dir))
