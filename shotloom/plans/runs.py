"""A benchmark run: a baseline over many tasks, and what became of each task."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators.windows import signals_of
from ..schema import WINDOW_METRICS
from . import workspace
from .evaluation import Steady, autoregressive_task, mean, mean_task, persist, steady_metrics


AT_ONCE = 3  # tasks that run side by side


@dataclass(frozen=True)
class Baseline:
    """A steady forecast and how it rewrites a task; a task that it rewrites to None is skipped."""

    how: Steady
    rewrite: Callable[[dict], dict | None]


persistence = Baseline(persist, autoregressive_task)


def averages(dummy: str) -> Baseline:
    """The mean forecast, with ``dummy`` as the only input."""
    return Baseline(mean, lambda task: mean_task(task, dummy))


def pack_shots(samples: DataFrame, wanted: list[str]) -> DataFrame:
    """Shots packed once for many tasks and written, a column per signal: a task reads the columns of its own signals."""
    return workspace.keep(blocks.packed(samples, wanted))


def reason(e: Exception) -> str:
    """What an error says, in a line: that of the Python worker if it comes from one."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    return next((x for x in lines if re.match(r"\w*(Error|Exception): ", x)), lines[0] if lines else type(e).__name__)


def run_tasks(samples: DataFrame, meta: DataFrame, tasks: dict[str, dict], baseline: Baseline, path: str, filled: bool | None = False) -> DataFrame:
    """Write each task's window metrics to its own folder below ``path`` and return a status row per task: done, empty (no
    window is fit), skipped (the baseline has nothing to tell of it) or failed, with the reason; n_shots and n_windows count
    what was scored.  The samples are shuffled once for all tasks.  A few tasks run side by side, and
    one that fails leaves the others as they are."""
    own = (baseline.rewrite(task) for task in tasks.values())
    wanted = sorted({s for task in own if task for s in signals_of(task["roles"], "input", "actuator", "output")})
    return run_packed(pack_shots(samples, wanted) if wanted else samples, meta, tasks, baseline, path, filled)


def run_packed(packed: DataFrame, meta: DataFrame, tasks: dict[str, dict], baseline: Baseline, path: str, filled: bool | None = False) -> DataFrame:
    """run_tasks over shots that are packed already, with a column for each signal of the tasks, perhaps for more."""
    spark = packed.sparkSession
    own = {name: baseline.rewrite(task) for name, task in tasks.items()}
    todo = {name: task for name, task in own.items() if task}
    wanted = sorted({s for task in todo.values() for s in signals_of(task["roles"], "input", "actuator", "output")})
    known = blocks.known(meta, wanted) if todo else {}
    told = {name: ("skipped", "no output is an input too") for name in own if name not in todo}

    def one(name: str, task: dict) -> tuple[str, str | None]:
        shots = packed.select("shot_id", *(F.col(f"`{s}`") for s in signals_of(task["roles"], "input", "actuator", "output")))
        try:
            steady_metrics(shots, known, task, filled, baseline.how).write.mode("overwrite").parquet(f"{path}/task={name}")
        except (PySparkException, ValueError, ArithmeticError) as e:
            return "failed", reason(e)
        return "done", None

    with ThreadPoolExecutor(AT_ONCE) as pool:  # the last tasks of one job leave cores to the next
        told |= dict(zip(todo, pool.map(one, todo, todo.values()), strict=True))
    status = spark.createDataFrame([(name, *told[name]) for name in tasks], "task string, status string, reason string")
    scored = run_metrics(spark, path, [name for name in tasks if told[name][0] == "done"])
    counts = scored.groupBy("task").agg(F.count_distinct("shot_id").alias("n_shots"), F.count_distinct("shot_id", "window_index").alias("n_windows"))
    out = status.join(counts, "task", "left").na.fill(0, ["n_shots", "n_windows"])
    kind = F.when((F.col("status") == "done") & (F.col("n_windows") == 0), "empty").otherwise(F.col("status"))
    return out.select("task", kind.alias("status"), "n_shots", "n_windows", "reason")


def run_metrics(spark, path: str, names: list[str]) -> DataFrame:
    """Window metrics that run_tasks has written for some tasks."""
    if not names:
        return spark.createDataFrame([], WINDOW_METRICS)
    return spark.read.schema(WINDOW_METRICS).option("basePath", path).parquet(*(f"{path}/task={name}" for name in names))
