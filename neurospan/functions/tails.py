"""Tail probabilities Spark SQL lacks, as Arrow-batched column functions.

They run on already aggregated rows (one per test), so Python sees few values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from neurospan.functions.columns import as_col


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total / a


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def chi2_one_df(x: float) -> float:
    return math.nan if math.isnan(x) else math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def normal_two_sided(z: float) -> float:
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


def _vector(fn, *series: pd.Series) -> pd.Series:
    columns = [s.astype("float64").to_numpy() for s in series]
    return pd.Series(np.array([fn(*row) for row in zip(*columns, strict=True)], dtype="float64"))


def t_pvalue(t: Column | str, df: Column | str) -> Column:
    @pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        out = _vector(t_two_sided, a, b)
        return out.where(out.notna(), None)

    return p(as_col(t), as_col(df))


def chi2_pvalue(x: Column | str) -> Column:
    @pandas_udf("double")
    def p(a: pd.Series) -> pd.Series:
        out = _vector(chi2_one_df, a)
        return out.where(out.notna(), None)

    return p(as_col(x))
