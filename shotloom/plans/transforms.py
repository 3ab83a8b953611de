"""Which transforms a signal goes through, and their application to sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import spectra
from . import tasks

#: Steps of each family of signals, in order; spectra are made first, from packed waves.
STEPS = {"default": ["standardise"], "filled": ["standardise", "zero_fill"], "lcfs": ["standardise", "resample"], "x_point": ["clip", "standardise"], "probe": ["stft", "standardise"]}
MEMBERS = {"filled": tasks.FILLED, "lcfs": tasks.LCFS, "x_point": tasks.X_POINTS, "probe": tasks.PROBES}


def family(signal: Column, members: dict[str, list[str]] = MEMBERS) -> Column:
    out = F.lit("default")
    for name, signals in members.items():
        out = F.when(signal.isin(signals), name).otherwise(out)
    return out


def plan_table(meta: DataFrame, members: dict[str, list[str]] = MEMBERS) -> DataFrame:
    """(signal, family, steps)"""
    steps = F.create_map(*(x for k, s in STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, s)))))
    named = meta.select("signal", family(F.col("signal"), members).alias("family"))
    return named.withColumn("steps", F.element_at(steps, F.col("family")))


def apply_plan(samples: DataFrame, meta: DataFrame, members: dict[str, list[str]] = MEMBERS, scale: bool = True, fill: bool = False, points: int = 170) -> DataFrame:
    """Sample rows through their signals' plans (spectra excepted, see apply_spectra).  One scan: the families are
    branches of one expression."""
    rows = samples.join(F.broadcast(meta.select("signal", "mean", "std")), "signal", "left")
    v = F.col("values")
    scaled = lambda x: values.standardise(x, F.col("mean"), F.col("std")) if scale else x
    kind = family(F.col("signal"), members)
    out = F.when(kind == "x_point", scaled(values.clip_to_null(v))).when(kind == "lcfs", values.resample(scaled(v), points))
    if fill:
        out = out.when(kind == "filled", values.zero_fill(scaled(v)))
    return rows.withColumn("values", out.otherwise(scaled(v))).select(samples.columns)


def apply_spectra(waves: DataFrame, meta: DataFrame, members: dict[str, list[str]] = MEMBERS, scale: bool = True, support: int = 512) -> DataFrame:
    """Spectra of the waves that the plan makes spectra of, standardised with statistics of spectrum space: (shot_id, signal,
    channel, frame, time, values).  meta: (signal, mean, std) over spectra."""
    wanted = waves.where(family(F.col("signal"), members) == "probe")
    rows = spectra.stft(wanted, support).withColumnRenamed("power", "values")
    return apply_plan(rows, meta, {}) if scale else rows


def prepared(samples: DataFrame, meta: DataFrame, members: dict[str, list[str]] = MEMBERS, scale: bool = True, fill: bool = False, support: int = 512) -> DataFrame:
    """Samples as a task's windows take them: each signal through its whole plan, those of the probe family as spectra, which
    have a sampling interval and numbers of their own.  meta: dt, mean and std of what comes out."""
    probes = [s for s in members.get("probe", [])]
    columns = ["shot_id", "signal", "t_idx", "time", "values"]
    plain = apply_plan(samples.where(~F.coalesce(F.col("signal").isin(probes), F.lit(False))), meta, members, scale, fill).select(columns)
    if not probes:
        return plain
    made = spectra.spectral_samples(samples.where(F.col("signal").isin(probes)), support)
    return plain.unionByName(apply_plan(made, meta, {}, scale).select(columns))
