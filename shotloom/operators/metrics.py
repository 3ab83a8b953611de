"""Metrics of forecasts, from windows up to shots, signals, tasks and groups.

Each level weighs the items of the level below equally, so the levels are chained aggregates, not one rollup.  Squared
errors are averaged over windows only; from shots on the errors themselves are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.values import mean_of
from ..schema import METRICS


def from_sums(sums: DataFrame) -> DataFrame:
    """Window metrics from sums of errors."""
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    return sums.select("shot_id", "window_index", "feature_name", F.sqrt(mean("square")).alias("RMSE"), mean("size").alias("MAE"), F.try_divide(F.col("of") - F.col("n"), F.col("of")).alias("nan_fraction"))


def window_metrics(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """RMSE, MAE and share of missing targets of each (shot, window, feature), over channels x time.

    targets: (shot_id, window_index, signal, values); predictions: (…, prediction).  Features without either are skipped;
    a prediction of another size than its target is an error."""
    both = targets.join(predictions, ["shot_id", "window_index", "signal"])
    flat = both.select("shot_id", "window_index", F.col("signal").alias("feature_name"), F.flatten("values").alias("y"), F.flatten("prediction").alias("p"))
    d = F.when(F.size("y") == F.size("p"), F.zip_with("y", "p", lambda y, p: y - p)).otherwise(F.raise_error(F.lit("target and prediction differ in size")).cast("array<double>"))
    missing = F.size(F.filter("y", lambda x: x.isNull()))
    return flat.select(
        "shot_id", "window_index", "feature_name", F.sqrt(mean_of(d, lambda x: x * x)).alias("RMSE"), mean_of(d, F.abs).alias("MAE"),
        F.try_divide(missing.cast("double"), F.size("y").cast("double")).alias("nan_fraction"),
    )


def validate(metrics: DataFrame, columns: list[str], task: str | None = None) -> None:
    """The table must hold rows, the columns, and (if told) only that task."""
    lacking = [c for c in columns if c not in metrics.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    if metrics.isEmpty():
        raise ValueError("there are no metrics")
    if task is not None and not metrics.where(~F.col("task").eqNullSafe(F.lit(task))).isEmpty():
        raise ValueError(f"rows of another task than {task}")


def usable(windows: DataFrame) -> DataFrame:
    """Rows with both errors, as numbers."""
    out = windows.withColumns({c: names.number(F.col(c)) for c in ("RMSE", "MAE", "nan_fraction")})
    return out.where(F.col("RMSE").isNotNull() & F.col("MAE").isNotNull())


def shot_metrics(windows: DataFrame, meta: DataFrame) -> DataFrame:
    """Per (task, shot, feature): errors over its windows, also divided by the feature's deviation, and the number of
    windows (unusable ones included)."""
    keys = ["task", "shot_id", "feature_name"]
    rmse, mae, share = (names.number(F.col(c)) for c in ("RMSE", "MAE", "nan_fraction"))
    fit = rmse.isNotNull() & mae.isNotNull()
    rows = windows.groupBy(*keys).agg(
        F.count_distinct("window_index").alias("n_windows"), F.count_if(fit).alias("_n"), F.sqrt(F.avg(F.when(fit, rmse * rmse))).alias("RMSE_mean"),
        F.avg(F.when(fit, mae)).alias("MAE_mean"), F.avg(F.when(fit, share)).alias("nan_fraction_mean"),
    )
    rows = rows.where("_n > 0").join(F.broadcast(meta.select(F.col("signal").alias("feature_name"), "std")), "feature_name", "left")
    return rows.select(*keys, "n_windows", F.try_divide("RMSE_mean", "std").alias("NRMSE_mean"), F.try_divide("MAE_mean", "std").alias("NMAE_mean"), "RMSE_mean", "MAE_mean", "nan_fraction_mean")


def _spread(prefix: str = "") -> list:
    return [c for m in METRICS for c in (F.avg(f"{m}_mean").alias(f"{m}_mean"), F.coalesce(F.stddev_pop(f"{m}_mean"), F.lit(0.0)).alias(f"{m}_std_pop"))]


def signal_metrics(shots: DataFrame) -> DataFrame:
    """Per (task, feature): mean and population deviation over shots."""
    return shots.groupBy("task", "feature_name").agg(F.count_distinct("shot_id").cast("double").alias("n_shots"), *_spread())


def task_shot_metrics(shots: DataFrame) -> DataFrame:
    """Per (task, shot): mean over features."""
    return shots.groupBy("task", "shot_id").agg(*(F.avg(f"{m}_mean").alias(f"{m}_mean") for m in METRICS))


def task_rows(shots: DataFrame) -> DataFrame:
    """One row per task over its shots, named as the task."""
    return task_shot_metrics(shots).groupBy("task").agg(F.count("*").cast("double").alias("n_shots"), *_spread()).withColumn("feature_name", F.col("task"))


def task_report(shots: DataFrame) -> DataFrame:
    """Signal rows and the task's own row."""
    return signal_metrics(shots).unionByName(task_rows(shots), allowMissingColumns=True)


def split_report(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Task rows and signal rows of a report; signal rows lose their number of shots."""
    own = F.col("feature_name") == F.col("task")
    return report.where(own), report.where(~own).drop("n_shots")


def group_rows(tasks: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group of tasks: shots are added, means and deviations averaged over tasks that have both."""
    rows = tasks.join(F.broadcast(groups.select("task", "group_id")), "task")
    cells = [F.sum("n_shots").alias("n_shots")]
    for m in METRICS:
        both = F.col(f"{m}_mean").isNotNull() & F.col(f"{m}_std_pop").isNotNull()
        cells += [F.avg(F.when(both, F.col(f"{m}_{s}"))).alias(f"{m}_{s}") for s in ("mean", "std_pop")]
    return rows.groupBy("group_id").agg(*cells).withColumn("task", F.concat(F.lit("group_"), "group_id"))


def group_report(tasks: DataFrame, groups: DataFrame) -> DataFrame:
    """Each group's row and then the rows of its tasks."""
    columns = ["group_id", "task", "n_shots", *(f"{m}_{s}" for m in METRICS for s in ("mean", "std_pop"))]
    named = tasks.join(F.broadcast(groups.select("task", "group_id")), "task")
    first = group_rows(tasks, groups).select(*columns, F.lit(0).alias("level"))
    return first.unionByName(named.select(*columns, F.lit(1).alias("level")))


def summary(source: str, metrics: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Task rows from any level: task report, shot metrics or window metrics."""
    if source == "task":
        return split_report(metrics)[0]
    if source == "shots":
        return task_rows(metrics)
    if source == "windows":
        return task_rows(shot_metrics(metrics, meta))
    raise ValueError(f"unknown source {source}")
