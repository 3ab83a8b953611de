"""End to end: from samples to windows, forecasts and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, kernel, metrics, windows
from ..operators.windows import signals_of
from . import transforms

#: A predictor takes (windows, meta, task) and gives (shot_id, window_index, signal, prediction).
Predictor = Callable[[DataFrame, DataFrame, dict], DataFrame]


@dataclass(frozen=True)
class Steady:
    """A forecast that does not change inside a window: one value per channel, from a series, the rows of the input slices and
    the signal's mean (see kernel.Vector).  It is scored where the series is, without writing windows."""

    vector: kernel.Vector
    needs_input: bool  # only outputs that are inputs too can be told


persist = Steady(kernel.last_present, True)
mean = Steady(kernel.mean_vector, False)


def packed_rows(samples: DataFrame, known: dict[str, kernel.Meta], task: dict, filled: bool | None, block: float | None) -> DataFrame:
    """Rows for the kernel: shots, or blocks of so many seconds."""
    if block is None:
        return blocks.packed(samples, signals_of(task["roles"], "input", "actuator", "output"))
    return blocks.blocked(samples, known, task, block, every_output=filled is not None)


def make_windows(samples: DataFrame, meta: DataFrame, task: dict, filled: bool | None = None, custom: Callable[[DataFrame], DataFrame] | None = None, block: float | None = None, first: int | None = None) -> DataFrame:
    """Windows of a task; ``filled`` screens them (False: sparse, True: filled, as in test mode; None: not at all); ``custom``
    maps them and may drop some; ``block`` cuts shots into blocks of so many seconds, for shots of very unequal length; ``first``
    makes only the first so many fit windows of each shot, or of each block (batching.first_windows then leaves those of the shot)."""
    known = blocks.known(meta, signals_of(task["roles"], "input", "actuator", "output"))
    out = blocks.windows(packed_rows(samples, known, task, filled, block), known, task, filled, first)
    return custom(out) if custom else out


def make_transformed(samples: DataFrame, meta: DataFrame, task: dict, members: dict[str, list[str]] = transforms.MEMBERS, scale: bool = True, fill: bool = False, support: int = 512, filled: bool | None = None, block: float | None = None) -> DataFrame:
    """Windows of a task over signals that have gone through their transform plans, spectra included."""
    rows = samples.where(F.col("signal").isin(signals_of(task["roles"], "input", "actuator", "output")))
    return make_windows(transforms.prepared(rows, meta, members, scale, fill, support), meta, task, filled, block=block)


def window_ranges(samples: DataFrame, meta: DataFrame, task: dict, filled: bool | None = None, block: float | None = None) -> DataFrame:
    """Windows of a task as index ranges, without values."""
    known = blocks.known(meta, signals_of(task["roles"], "input", "actuator", "output"))
    return blocks.run(packed_rows(samples, known, task, filled, block), known, task, filled, lambda b, w, k: kernel.ranges(b, w, task, k), blocks.RANGES)


def fit_windows(samples: DataFrame, meta: DataFrame, task: dict, filled: bool | None = False, block: float | None = None) -> DataFrame:
    """(shot_id, window_index, t_cut) of the windows that a screen lets pass."""
    known = blocks.known(meta, signals_of(task["roles"], "input", "actuator", "output"))
    return blocks.run(packed_rows(samples, known, task, filled, block), known, task, filled, lambda b, w, k: kernel.chosen(b, w, task, k), blocks.CHOSEN)


def autoregressive_task(task: dict) -> dict | None:
    """The persistence variant: outputs that are inputs too, no actuators, markovian; None if there are none."""
    both = [s for s in windows.signals_of(task["roles"], "output") if s in windows.signals_of(task["roles"], "input")]
    return task | {"task_type": "markovian", "roles": [(r, s) for r in ("input", "output") for s in both]} if both else None


def mean_task(task: dict, dummy: str) -> dict:
    """The mean variant: all outputs, one dummy input."""
    return task | {"roles": [("input", dummy), *(("output", s) for s in windows.signals_of(task["roles"], "output"))]}


def steady_metrics(rows: DataFrame, known: dict[str, kernel.Meta], task: dict, filled: bool | None, how: Steady) -> DataFrame:
    """Window metrics of a steady forecast over the fit windows of packed rows."""
    inputs, outputs = signals_of(task["roles"], "input"), signals_of(task["roles"], "output")
    told = [s for s in outputs if s in inputs or not how.needs_input]
    return metrics.from_sums(blocks.scores(rows, known, task, filled, told, how.vector))


def evaluate_packed(packed: DataFrame, known: dict[str, kernel.Meta], name: str, task: dict, how: Steady, filled: bool | None = False) -> DataFrame:
    """Window metrics of a steady forecast over shots that are packed already, perhaps with columns of more signals."""
    rows = packed.select("shot_id", *(F.col(f"`{s}`") for s in signals_of(task["roles"], "input", "actuator", "output")))
    return steady_metrics(rows, known, task, filled, how).select(F.lit(name).alias("task"), "*")


def evaluate(samples: DataFrame, meta: DataFrame, name: str, task: dict, predict: Predictor | Steady, filled: bool | None = False, block: float | None = None) -> DataFrame:
    """Window metrics of a predictor on a task; ``block`` as in make_windows."""
    if isinstance(predict, Steady):
        known = blocks.known(meta, signals_of(task["roles"], "input", "actuator", "output"))
        out = steady_metrics(packed_rows(samples, known, task, filled, block), known, task, filled, predict)
    else:
        made = make_windows(samples, meta, task, filled=filled, block=block)
        targets = made.where("role = 'output'").select("shot_id", "window_index", "signal", "values")
        out = metrics.window_metrics(targets, predict(made, meta, task))
    return out.select(F.lit(name).alias("task"), "*")
