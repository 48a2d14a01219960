"""A schedule without a table: any cursor tells its scene by itself.

A source's cursor runs through cycles, and each cycle is a permutation of the source's scenes. The permutation is
computed: a keyed network of four rounds permutes a grid of rows and columns of about as many cells as there are scenes; a cell beyond the last
scene goes through the network again until it falls among them, which keeps it one to one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import bounded_broadcast
from ..registry import query
from ..sources.views import table

#: A prime and two multipliers that mix numbers below it.
PRIME, ONE, TWO = 2147483647, 48271, 69621
ROUNDS = 4


def mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number below the prime that both settle; all steps fit 64 bits."""
    t = (x % PRIME * ONE + key) % PRIME
    return (t * TWO + t // 65536) % PRIME


@F.pandas_udf(T.LongType())
def permuted(n: pd.Series, offset: pd.Series, seed: pd.Series, source: pd.Series, cycle: pd.Series) -> pd.Series:
    """The scene at an offset of a cycle of a source with ``n`` scenes."""
    n, at, seed, source, cycle = (c.to_numpy(np.int64).copy() for c in (n, offset, seed, source, cycle))
    rows = np.ceil(np.sqrt(n)).astype(np.int64)
    columns = -(-n // np.maximum(rows, 1))
    key = mixed(cycle, mixed(source, mixed(seed, np.ones_like(seed))))
    todo = np.arange(len(n))
    while len(todo):
        row, column = at[todo] // columns[todo], at[todo] % columns[todo]
        for r in range(ROUNDS):
            k = mixed(np.full(len(todo), r), key[todo])
            if r % 2:
                column = (column + mixed(row, k)) % columns[todo]
            else:
                row = (row + mixed(column, k)) % rows[todo]
        at[todo] = row * columns[todo] + column
        todo = todo[at[todo] >= n[todo]]
    return pd.Series(at)


def scheduled(cursors: DataFrame, counts: DataFrame, ordinal: Column, seed: int) -> DataFrame:
    """``cursors`` with ``cycle`` and ``scene_index`` of the ordinal of their source; ``counts`` are ``source, scenes``."""
    met = cursors.join(bounded_broadcast(counts.select("source", "scenes")), "source").withColumn("__ordinal", ordinal)
    met = met.withColumn("cycle", F.floor(F.col("__ordinal") / F.col("scenes")))
    index = permuted("scenes", F.col("__ordinal") % F.col("scenes"), F.lit(seed), "source", "cycle")
    return met.withColumn("scene_index", index).drop("__ordinal", "scenes")


def _mix(x: str, key: str) -> str:
    t = f"((({x})::BIGINT % {PRIME} * {ONE} + ({key})) % {PRIME})"
    return f"(({t} * {TWO} + {t} // 65536) % {PRIME})"


WORLD, SEED = 2, 1234
PASS = f"""(r1 * b + c2)::BIGINT AS cell FROM (SELECT *, (c1 + {_mix("r1", "k3")}) % b AS c2 FROM (SELECT *, (r0 + {_mix("c1", "k2")}) % a AS r1
    FROM (SELECT *, (c0 + {_mix("r0", "k1")}) % b AS c1 FROM (SELECT *, (last // b + {_mix("last % b", "k0")}) % a AS r0, last % b AS c0 FROM"""
SQL = f"""WITH RECURSIVE counts AS (SELECT c_nationkey::BIGINT AS source, count(*) AS scenes FROM customer GROUP BY c_nationkey),
c AS (SELECT o_orderkey AS step, rank, source, scenes AS n, (o_orderkey * {WORLD} + rank) // scenes AS cycle, (o_orderkey * {WORLD} + rank) % scenes AS first FROM (SELECT *, o_custkey % 25 AS source FROM orders) JOIN counts USING (source), (SELECT unnest(range({WORLD})) AS rank)),
m AS (SELECT *, {_mix("source", _mix(str(SEED), "1"))} AS k FROM c), kk AS (SELECT *, {_mix("cycle", "k")} AS key FROM m),
s AS (SELECT step, rank, source, n, cycle, first, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b, {_mix("0", "key")} AS k0, {_mix("1", "key")} AS k1, {_mix("2", "key")} AS k2, {_mix("3", "key")} AS k3 FROM kk),
w AS (SELECT step, rank, source, n, cycle, a, b, k0, k1, k2, k3, {PASS} (SELECT *, first AS last FROM s)))))
    UNION ALL SELECT step, rank, source, n, cycle, a, b, k0, k1, k2, k3, {PASS} (SELECT * EXCLUDE (cell), cell AS last FROM w WHERE cell >= n))))))
SELECT step, rank, source, cycle, cell AS scene_index FROM w WHERE cell < n"""


@query(SQL)
def samp_stateless_cursor(spark, sf_dir):
    """Each rank's scene at every step, from the step alone."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("source")).agg(F.count("*").alias("scenes"))
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), (F.col("o_custkey") % 25).alias("source"))
    steps = steps.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WORLD - 1).cast("long"))))
    return scheduled(steps, counts, F.col("step") * WORLD + F.col("rank"), SEED).select("step", "rank", "source", "cycle", "scene_index")
