"""Cleaning: outlier lists, quality ratings, outlier predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def blank_outliers(samples: DataFrame, outliers: DataFrame, payload: str = "values") -> DataFrame:
    """Samples of listed (shot, signal) pairs keep their rows but lose their values."""
    flagged = outliers.select("shot_id", "signal").distinct().withColumn("_out", F.lit(True))
    return samples.join(flagged, ["shot_id", "signal"], "left").withColumn(payload, F.when(F.col("_out").isNull(), F.col(payload))).drop("_out")


def drop_outliers(samples: DataFrame, outliers: DataFrame) -> DataFrame:
    return samples.join(outliers.select("shot_id", "signal"), ["shot_id", "signal"], "left_anti")


def mask_ratings(samples: DataFrame, ratings: DataFrame, source: str, payload: str = "values") -> DataFrame:
    """Within one source, values are missing where the shot's rating at that time index is 0 (or absent); a shot without
    any rating loses the source's values altogether.  ratings: (shot_id, t_idx, rating)."""
    inside = samples.where(names.source_of(F.col("signal")) == source)
    rest = samples.where(~F.coalesce(names.source_of(F.col("signal")) == source, F.lit(False)))
    rated = inside.join(ratings.select("shot_id", "t_idx", "rating"), ["shot_id", "t_idx"], "left")
    good = F.coalesce(F.col("rating") != 0, F.lit(False))
    return rest.unionByName(rated.withColumn(payload, F.when(good, F.col(payload))).select(samples.columns))


def is_outlier(z: Column, limit: float) -> Column:
    """An unknown z is no outlier."""
    return F.coalesce(F.abs(z) > limit, F.lit(False))
