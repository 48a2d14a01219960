"""An ordered scan over chunks of each key: every chunk begins with the state in which the one before it ended.

For models that go along a track, where a track may be longer than a task can hold. Rows get their place within their key and are dealt into
chunks; a chunk also sees ``ahead`` rows of the next one. In round k the k-th chunks of all keys are worked on in
parallel, each with the state that its key had after round k - 1. Each round is written, so a lost executor costs its
own tasks. Rounds are as many as the longest key has chunks: the chunk's size weighs memory against them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import ranked
from ..registry import query, r6
from ..sources.files import scratch
from ..sources.views import TRACK_OBS, track_obs

#: Takes the state (None at first), the chunk's rows in order, and how many are the chunk's own; returns rows and the next state.
Step = Callable[[list[float] | None, pd.DataFrame, int], tuple[pd.DataFrame, list[float]]]


def scan_chunks(rows: DataFrame, key: str, order: list[Column], step: Step, schema: str, chunk: int, ahead: int = 0) -> DataFrame:
    """What ``step`` gives for every chunk of every key, in columns of ``schema``; states are lists of numbers."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "chunks")
    place, own = F.col("__place"), F.floor(F.col("__place") / chunk)
    # The first rows of a chunk are also the rows ahead of the one before.
    also = F.when((place % chunk < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = ranked(rows, [key], order, "__place").withColumn("__chunk", F.explode(also))
    dealt.write.partitionBy("__chunk").parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows")
    names = [f.name for f in T.StructType.fromDDL(schema)]
    key_type = rows.schema[key].dataType.simpleString()
    made = f"__key {key_type}, __state array<double>, {schema}"

    def work(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame(columns=["__key", "__state", *names])
        group = group.sort_values("__place")
        k = int(group["__chunk"].iloc[0])
        state = None if before.empty else list(before["__state"].iloc[0])
        out, state = step(state, group.drop(columns=["__place", "__chunk"]), int((group["__place"] < (k + 1) * chunk).sum()))
        none = [None] * len(out)
        ends = {"__key": [*none, group[key].iloc[0]], "__state": [*none, state]}
        return pd.DataFrame(ends | {n: [*out[n].tolist(), None] for n in names}, dtype=object)

    rounds = (held.agg(F.max("__chunk")).first()[0] or 0) + 1
    states = spark.createDataFrame([], f"{key} {key_type}, __state array<double>")
    for k in range(rounds):
        met = held.filter(F.col("__chunk") == k).groupBy(key).cogroup(states.groupBy(key))
        met.applyInPandas(work, made).write.parquet(f"{path}/out/round={k}")
        done = spark.read.schema(made).parquet(f"{path}/out/round={k}")
        states = done.filter("__state IS NOT NULL").select(F.col("__key").alias(key), "__state")
    return spark.read.schema(made).parquet(f"{path}/out/round=*").filter("__state IS NULL").select(*names)


WINDOW = 8
HALF = WINDOW // 2


def refine(start: np.ndarray, x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """One window's estimate: a third of the way from where it starts to what is seen."""
    return np.where(seen, (start[: len(x)] * 2 + x) / 3, start[: len(x)])


def windowed(state: list[float] | None, rows: pd.DataFrame, own: int) -> tuple[pd.DataFrame, list[float]]:
    """Windows of eight frames, every four: the first half starts from the second half of the window before, the rest from its last frame.

    A frame's estimate is that of the last window that has it.
    """
    x, seen = rows["x"].to_numpy(), rows["vis"].to_numpy(bool)
    final, said = np.full(len(rows), np.nan), np.zeros(len(rows), bool)
    for at in range(0, own, HALF):
        if state is not None and len(rows) - at <= HALF:
            break  # the window before has reached the end
        start = np.full(WINDOW, x[0]) if state is None else np.concatenate([state, np.full(HALF, state[-1])])
        estimate = refine(start, x[at : at + WINDOW], seen[at : at + WINDOW])
        goes_on = len(rows) - at - HALF > HALF
        upto = min(HALF if goes_on else WINDOW, len(estimate))
        final[at : at + upto], said[at : at + upto] = estimate[:upto], True
        state = [*estimate[HALF:], *[estimate[-1]] * (WINDOW - len(estimate))][:HALF]
    return pd.DataFrame({"track": rows["track"][said], "frame": rows["frame"][said], "px": final[said]}), [float(v) for v in state]


#: The windows of a track by recursion, each from the list of the one before.
SQL = f"""WITH RECURSIVE {TRACK_OBS}, l AS (SELECT track, list(x ORDER BY frame) AS x, list(vis ORDER BY frame) AS v, count(*) AS n FROM track_obs GROUP BY track),
w AS (SELECT track, 0::BIGINT AS k, list_transform(range(1, least(n, 8) + 1), lambda i: CASE WHEN v[i] THEN (x[1] * 2 + x[i]) / 3 ELSE x[1] END) AS e FROM l
    UNION ALL SELECT w.track, k + 1, list_transform(range(1, least(n - 4 * (k + 1), 8) + 1), lambda i: CASE WHEN v[4 * (k + 1) + i] THEN (e[least(i + 4, 8)] * 2 + x[4 * (k + 1) + i]) / 3 ELSE e[least(i + 4, 8)] END)
    FROM w JOIN l USING (track) WHERE 4 * (k + 1) < n - 4),
f AS (SELECT track, k, unnest(e) AS px, unnest(range(len(e))) AS i FROM w)
SELECT track, 4 * k + i AS frame, round(arg_max(px, k), 6) AS px FROM f GROUP BY track, 4 * k + i"""


@query(SQL)
def udf_windowed_scan(spark, sf_dir):
    """Overlapping windows along each track, in chunks of 64 frames with the state carried from chunk to chunk."""
    rows = track_obs(spark, sf_dir).select("track", "frame", "x", "vis")
    found = scan_chunks(rows, "track", [F.col("frame")], windowed, "track long, frame long, px double", chunk=64, ahead=HALF + 1)
    return found.select("track", "frame", r6("px").alias("px"))
