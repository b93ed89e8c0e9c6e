"""The one Python function of the engine: the chi-square tail Spark has no built-in for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def chi2_tail_1df(statistic: pd.Series) -> pd.Series:
    """P(X > statistic) for one degree of freedom; used on one row per group pair or coefficient."""
    return statistic.map(lambda s: math.erfc(math.sqrt(s / 2.0)) if pd.notna(s) and s >= 0 else None)
