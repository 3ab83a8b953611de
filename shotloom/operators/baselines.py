"""Role choices and trivial forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import index_range, let


def requested_signals(task_signals: DataFrame) -> DataFrame:
    """Signals of all roles, each once, in order of role and place."""
    rank = F.when(F.col("role") == "input", 0).when(F.col("role") == "actuator", 1).otherwise(2)
    first = task_signals.groupBy("signal").agg(F.min(F.struct(rank.alias("role"), F.col("pos"))).alias("at"))
    return first.orderBy("at", "signal").select("signal")


def role_subset(windows: DataFrame, side: str) -> DataFrame:
    """x: inputs and actuators; y: outputs."""
    return windows.where(F.col("role").isin("input", "actuator") if side == "x" else F.col("role") == "output")


def choose(windows: DataFrame, chosen: DataFrame) -> DataFrame:
    return windows.join(F.broadcast(chosen.select("signal").distinct()), "signal", "left_semi")


def autoregressive(task_signals: DataFrame) -> DataFrame:
    """Outputs that are inputs too, as both; no actuators; tasks without one vanish.  In output order."""
    both = task_signals.where("role = 'output'").join(task_signals.where("role = 'input'").select("task", "signal"), ["task", "signal"], "left_semi")
    return both.select("task", F.explode(F.array(F.lit("input"), F.lit("output"))).alias("role"), "pos", "signal")


def mean_choice(task_signals: DataFrame, dummy: str) -> DataFrame:
    """All outputs, one dummy input, no actuators."""
    out = task_signals.where("role = 'output'").select("task", "role", "pos", "signal")
    return out.unionByName(out.select("task").distinct().select("task", F.lit("input").alias("role"), F.lit(0).alias("pos"), F.lit(dummy).alias("signal")))


def forward_fill(series: Column) -> Column:
    """Missing entries of an array take the last value before them; leading ones stay missing.

    Each value that is there is repeated up to the place of the next one, so the work is in proportion to the array."""
    there = F.filter(F.transform(series, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    n = F.size(series)

    def fill(at: Column) -> Column:
        runs = F.transform(at, lambda i, k: F.array_repeat(F.get(series, i), F.coalesce(F.get(at, k + 1), n) - i))
        return F.concat(F.array_repeat(F.lit(None).cast("double"), F.coalesce(F.get(at, F.lit(0)), n)), F.flatten(runs))

    return let(there, fill)


def channel(values: Column, c: Column | int) -> Column:
    return F.transform(values, lambda v: F.get(v, F.lit(c) if isinstance(c, int) else c))


def last_present(values: Column, first: Column, end: Column, channels: Column, mean: Column) -> Column:
    """Per channel, the last value between two indices that is there, or else the signal's mean."""
    inside = F.slice(values, first + 1, F.greatest(F.lit(0), end - first))

    def one(c: Column) -> Column:
        newest = F.when(end > first, F.get(F.get(values, end - 1), c))  # there in most windows: the others are searched
        return F.coalesce(newest, F.try_element_at(F.filter(channel(inside, c), lambda x: x.isNotNull()), F.lit(-1)), mean)

    return F.transform(index_range(F.lit(0), channels), one)


def persistence(windows: DataFrame, meta: DataFrame, n_out: Column | int) -> DataFrame:
    """(shot_id, window_index, signal, prediction) from written windows: each channel's last input value repeated, or else the
    signal's mean."""
    rows = windows.where("role = 'input'").join(F.broadcast(meta.select("signal", "mean")), "signal", "left")
    vector = last_present(F.col("values"), F.lit(0), F.size("values"), F.size(F.get("values", F.lit(0))), F.col("mean"))
    return rows.select("shot_id", "window_index", "signal", F.array_repeat(vector, n_out).alias("prediction"))


def mean_forecast(windows: DataFrame, meta: DataFrame) -> DataFrame:
    """The signal's mean everywhere."""
    rows = windows.where("role = 'output'").join(F.broadcast(meta.select("signal", "mean")), "signal", "left")
    return rows.select("shot_id", "window_index", "signal", F.transform("values", lambda v: F.transform(v, lambda x: F.col("mean"))).alias("prediction"))
