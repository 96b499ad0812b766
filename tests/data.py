"""Small made-up bars for edge cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BAR_DDL = (
    "series string, bar_ts timestamp_ntz, open double, high double, low double,"
    " close double, volume double"
)


def walk(n: int, seed: int = 0, series: str = "A", minutes: int = 5) -> pd.DataFrame:
    """Random walk with low <= open, close <= high; time has gaps."""
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 1, n).cumsum()
    open_ = close + rng.normal(0, 0.5, n)
    steps = rng.choice([1, 1, 1, 1, 7], n).cumsum()
    return pd.DataFrame(
        {
            "series": series,
            "bar_ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(steps * minutes, unit="min"),
            "open": open_,
            "high": np.maximum(open_, close) + rng.random(n),
            "low": np.minimum(open_, close) - rng.random(n),
            "close": close,
            "volume": rng.integers(0, 50, n).astype(float),
        }
    )


def to_spark(spark: SparkSession, frame: pd.DataFrame, ddl: str = BAR_DDL) -> DataFrame:
    rows = [
        tuple(None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v)
              for v in row)
        for row in frame.astype(object).itertuples(index=False)
    ]
    return spark.createDataFrame(rows, ddl)


def to_pandas(df: DataFrame, *order: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def same(left, right, tol: float = 1e-9) -> None:
    """Equal to a tolerance, with missing values in the same places."""
    a, b = (np.asarray(pd.to_numeric(pd.Series(x)), dtype=float) for x in (left, right))
    assert len(a) == len(b)
    assert (np.isnan(a) == np.isnan(b)).all(), np.where(np.isnan(a) != np.isnan(b))[0][:5]
    ok = ~np.isnan(a)
    assert np.allclose(a[ok], b[ok], rtol=tol, atol=tol)
