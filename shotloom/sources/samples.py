"""Scans of the sample table: one row per (shot, signal, time index), values an array of channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, values


def scan(samples: DataFrame, shots: DataFrame, signals: list[str]) -> DataFrame:
    """Samples of the given shots and signals; a pair that has none comes back once, with NULL time and values.

    The signal list is a literal predicate and the shots are a semi-join, so both reach the file scan."""
    wanted = samples.where(F.col("signal").isin(signals)).join(shots.select("shot_id").distinct(), "shot_id", "left_semi")
    wanted = wanted.withColumn("values", values.vector_to_null(F.col("values")))
    pairs = shots.select("shot_id").distinct().withColumn("signal", F.explode(F.array(*map(F.lit, dict.fromkeys(signals)))))
    return pairs.join(wanted, ["shot_id", "signal"], "left")


def source_profiles(samples: DataFrame, source: str) -> DataFrame:
    """All signals of one source."""
    return samples.where(names.source_of(F.col("signal")) == source)


def signal_values(samples: DataFrame, signal: str) -> DataFrame:
    return samples.where(F.col("signal") == signal).select("shot_id", "t_idx", "values")


def signal_times(samples: DataFrame, signal: str) -> DataFrame:
    return samples.where(F.col("signal") == signal).select("shot_id", "t_idx", "time")


def time_axis(axes: DataFrame) -> DataFrame:
    """(signal, time_axis) from (signal, pos, axis): the first axis whose name starts with time, or NULL."""
    first = F.min(F.when(F.col("axis").startswith("time"), F.struct("pos", "axis")))
    return axes.groupBy("signal").agg(first["axis"].alias("time_axis"))


def channel_names(channels: DataFrame, signal: str) -> DataFrame:
    return channels.where(F.col("signal") == signal).orderBy("channel_idx").select("channel_idx", "channel_name")
