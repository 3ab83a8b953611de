"""Windows of shots: their cuts, lengths and padding.  What happens inside a packed shot is in kernel, packing in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import any_present, sample_count


def pack(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """(shot_id, signal, t0, dt, values): values is time x channels.  meta: (signal, dt)."""
    rows = F.array_sort(F.collect_list(F.struct("t_idx", "time", "values")))
    packed = samples.where(F.col("time").isNotNull()).groupBy("shot_id", "signal").agg(rows.alias("rows"))
    packed = packed.select("shot_id", "signal", F.get("rows", F.lit(0))["time"].alias("t0"), F.transform("rows", lambda r: r["values"]).alias("values"))
    return packed.join(F.broadcast(meta.select("signal", "dt")), "signal").select("shot_id", "signal", "t0", "dt", "values")


def valid_ends(values: Column) -> tuple[Column, Column]:
    """First and last index with a channel that is there; NULL without any."""
    there = F.transform(values, any_present)
    first = F.nullif(F.array_position(there, F.lit(True)), F.lit(0).cast("long")) - 1
    last = F.size(values) - F.nullif(F.array_position(F.reverse(there), F.lit(True)), F.lit(0).cast("long"))
    return first, last


Roles = list[tuple[str, str]]  # (role, signal); role is input, actuator or output


def signals_of(roles: Roles, *wanted: str) -> list[str]:
    """The signals of some roles, each once, in order."""
    return list(dict.fromkeys(s for r, s in roles if r in wanted))


def width(meta: DataFrame) -> Column:
    """Channels of a signal: the product of its shape; one without a shape."""
    if "values_shape" not in meta.columns:
        return F.lit(1)
    return F.coalesce(F.aggregate("values_shape", F.lit(1), lambda n, k: n * k), F.lit(1))


def cut_counts(spans: DataFrame, task: dict) -> DataFrame:
    """Spans with the first cut and the number of cuts (NULL-free, 0 where the shot is too short)."""
    first = F.col("start") + F.lit(float(task["input_length"]))
    end = F.col("stop") - F.lit(float(task["delta"])) - F.lit(float(task["output_length"]))
    n = F.greatest(F.lit(0), F.ceil((end - first) / F.lit(float(task["stride"]))).cast("int"))
    return spans.withColumn("first_cut", first).withColumn("n_windows", n)


def cuts(spans: DataFrame, task: dict) -> DataFrame:
    """(shot_id, start, window_index, t_cut); too short shots have none."""
    counted = cut_counts(spans, task).where("n_windows > 0")
    out = counted.select("shot_id", "start", "first_cut", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("window_index"))
    return out.select("shot_id", "start", "window_index", cut_time(F.col("window_index"), task).alias("t_cut"))


def cut_time(window: Column, task: dict) -> Column:
    return F.col("first_cut") + window * F.lit(float(task["stride"]))


def drop_missing(windows: DataFrame, column: str) -> DataFrame:
    """Windows that a custom transform has not turned into NULL."""
    return windows.where(F.col(column).isNotNull())


def windows_per_shot(cut: DataFrame) -> DataFrame:
    return cut.groupBy("shot_id").agg(F.count("*").alias("n_windows"))


def pad(packed: DataFrame, start: Column, stop: Column, meta: DataFrame) -> DataFrame:
    """Series that reach over [start, stop], one missing sample beyond on the side that had to be padded."""
    rows = packed.join(F.broadcast(meta.select("signal", width(meta).alias("width"))), "signal")
    dt, n = F.col("dt"), F.size("values")
    last = F.col("t0") + (n - 1) * dt
    left = F.when((n > 0) & (F.col("t0") > start), F.ceil((F.col("t0") - start) / dt).cast("int") + 1).otherwise(0)
    right = F.when((n > 0) & (last < stop), F.ceil((stop - last) / dt).cast("int") + 1).otherwise(0)
    gap = F.array_repeat(F.lit(None).cast("double"), F.col("width"))
    return rows.select("shot_id", "signal", (F.col("t0") - left * dt).alias("t0"), "dt", F.concat(F.array_repeat(gap, left), F.col("values"), F.array_repeat(gap, right)).alias("values"))


def window_lengths(task_signals: DataFrame, tasks: DataFrame, meta: DataFrame) -> DataFrame:
    """Length and stride of each (task, role, signal), in seconds and in samples."""
    rows = task_signals.join(tasks, "task").join(F.broadcast(meta.select("signal", "dt")), "signal")
    seconds = F.when(F.col("role") == "input", F.col("input_length")).when(F.col("role") == "output", F.col("output_length")).otherwise(F.col("input_length") + F.col("delta") + F.col("output_length"))
    n_in, n_delta, n_out = (sample_count(F.col(c), F.col("dt")) for c in ("input_length", "delta", "output_length"))
    samples = F.when(F.col("role") == "input", n_in).when(F.col("role") == "output", n_out).otherwise(n_in + n_delta + n_out)
    return rows.select("task", "role", "signal", seconds.alias("length_s"), samples.alias("length_n"), F.col("stride").alias("stride_s"), sample_count(F.col("stride"), F.col("dt")).alias("stride_n"))
