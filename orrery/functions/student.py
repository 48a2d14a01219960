"""Significance of correlations, as columns: Student's t by the incomplete beta function's continued fraction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import spearman
from ..registry import query, r6
from ..sources.views import TRACK_OBS, track_obs

#: The fraction settles within far fewer steps for all that ``incomplete_beta`` gives it.
STEPS = 200
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Of positive numbers: Stirling's series eight further on, and back."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum((F.log(x + k) for k in range(1, 8)), F.log(x))


def settled_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction from its first term on, until no row changes; numerator and denominator of each step stay off zero."""
    off = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    with np.errstate(all="ignore"):
        d = 1 / off(1 - (a + b) * x / (a + 1))
        c, h = np.ones(len(d)), d
        for m in range(1, STEPS + 1):
            before = h
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for term in (even, odd):
                d, c = 1 / off(1 + term * d), off(1 + term / c)
                h = h * c * d
            if np.array_equal(h, before, equal_nan=True):
                break
    return h


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """A batch's rows take their steps together: as an expression of columns a row took milliseconds."""

    def batch(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(settled_fraction(a.to_numpy(np.float64), b.to_numpy(np.float64), x.to_numpy(np.float64)))

    return F.pandas_udf(batch, "double")(a, b, x)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised function, for positive ``a`` and ``b``; the side on which the fraction settles fast is taken."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * _fraction(a, b, x) / a
    high = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def correlation_p(rho: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation of ``n`` pairs: of Student's t with n - 2 degrees of freedom. Null below three pairs."""
    free = n.cast("double") - 2
    # t * t = free * rho * rho / (1 - rho * rho), so free / (free + t * t) is 1 - rho * rho.
    return F.when(free >= 1, incomplete_beta(free / 2, F.lit(0.5), 1 - rho * rho))


def spearman_test(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``key, n, rho, p`` for each key, and for all rows under a null key. Rows without a key count in the whole only."""
    both = rows.filter(F.col(key).isNotNull()).select(F.struct(key).alias("grain"), x, y).unionByName(rows.select(F.struct(F.lit(None).cast(rows.schema[key].dataType).alias(key)).alias("grain"), x, y))
    found = spearman(both, "grain", x, y)
    return found.select(f"grain.{key}", "n", "rho", correlation_p(F.col("rho"), F.col("n")).alias("p"))


#: Another way to the same number: the finite series for whole degrees of freedom.
SERIES = """CASE WHEN free % 2 = 0 THEN sine * list_reduce(list_prepend(struct_pack(t := 1::DOUBLE, s := 1::DOUBLE), list_transform(range(1, free // 2), lambda k: struct_pack(t := k::DOUBLE, s := 0::DOUBLE))),
        lambda acc, z: struct_pack(t := acc.t * cosine2 * (2 * z.t - 1) / (2 * z.t), s := acc.s + acc.t * cosine2 * (2 * z.t - 1) / (2 * z.t))).s
    WHEN free = 1 THEN 2 / pi() * asin(sine)
    ELSE 2 / pi() * (asin(sine) + sine * list_reduce(list_prepend(struct_pack(t := sqrt(cosine2), s := sqrt(cosine2)), list_transform(range(1, (free - 1) // 2), lambda k: struct_pack(t := k::DOUBLE, s := 0::DOUBLE))),
        lambda acc, z: struct_pack(t := acc.t * cosine2 * 2 * z.t / (2 * z.t + 1), s := acc.s + acc.t * cosine2 * 2 * z.t / (2 * z.t + 1))).s) END"""


@query(f"""WITH {TRACK_OBS}, g AS (SELECT track, x, y FROM track_obs UNION ALL SELECT NULL, x, y FROM track_obs), ok AS (SELECT * FROM g WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT track, rank() OVER (PARTITION BY track ORDER BY x) + (count(*) OVER (PARTITION BY track, x) - 1) / 2 AS a, rank() OVER (PARTITION BY track ORDER BY y) + (count(*) OVER (PARTITION BY track, y) - 1) / 2 AS b FROM ok),
c AS (SELECT track, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY track HAVING count(*) >= 3), d AS (SELECT *, n - 2 AS free, abs(rho) AS sine, 1 - rho * rho AS cosine2 FROM c)
SELECT track, n, round(rho, 6) AS rho, round(1 - ({SERIES}), 6) AS p FROM d""")
def agg_spearman_p(spark, sf_dir):
    """Rank correlation of a track's coordinates, and of all rows together, with its significance."""
    found = spearman_test(track_obs(spark, sf_dir).select("track", "x", "y"), "track", "x", "y")
    return found.select("track", "n", r6("rho").alias("rho"), r6("p").alias("p"))
