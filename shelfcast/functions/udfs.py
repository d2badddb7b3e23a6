"""Vectorised Python functions (the slow path, used only where no built-in
expression exists).

``norm_ppf``: inverse normal CDF of a per-row probability column (F18 with
per-row cost ratios). Arrow batches; inside a batch the stdlib inverse CDF
runs once per distinct value, so a column with few distinct ratios costs a
handful of calls per batch. A constant ratio should be folded on the driver
instead (``functions.columns.z_value``).
"""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ND = statistics.NormalDist()


def _ppf_series(p: pd.Series) -> pd.Series:
    uniq = p.dropna().unique()
    z = {v: (_ND.inv_cdf(v) if 0.0 < v < 1.0 else float("nan")) for v in uniq}
    return p.map(z).astype("float64")


norm_ppf = F.pandas_udf(_ppf_series, T.DoubleType())
