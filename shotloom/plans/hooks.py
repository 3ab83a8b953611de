"""User hooks: transforms per signal, per window, and predictors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_signals(samples: DataFrame, transforms: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Each signal's own column function on its values."""
    out = F.col("values")
    for signal, f in transforms.items():
        out = F.when(F.col("signal") == signal, f(F.col("values"))).otherwise(out)
    return samples.withColumn("values", out)


def map_windows(windows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """A pandas function on batches of window rows, for what columns cannot say; rows that it leaves out are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = f(b)
            if out is not None:
                yield out

    return windows.mapInPandas(run, schema)
