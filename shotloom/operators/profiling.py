"""Profiles of tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def column_choice(df: DataFrame, requested: list[str]) -> tuple[list[str], list[str]]:
    """Requested columns that are there, and those that are not."""
    return [c for c in requested if c in df.columns], [c for c in requested if c not in df.columns]


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_present, n_missing, percent_present) in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(F.col(f"`{c}`")).alias(f"_{k}") for k, c in enumerate(columns)))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"_{k}").alias("n_present")) for k, c in enumerate(columns)))
    rows = counts.select("_n", F.explode(each).alias("x")).select("x.column_name", "x.n_present", (F.col("_n") - F.col("x.n_present")).alias("n_missing"), "_n")
    return rows.select("column_name", "n_present", "n_missing", names.percent(F.col("n_present"), F.col("_n")).alias("percent_present"))


def value_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The most frequent values; NULL is one of them; ties in order of the value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def normalise_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: names.squeeze_spaces(F.col(c)) for c in columns})


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def restrict(df: DataFrame, catalog: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose key is in the catalog, with some of their columns."""
    return df.join(catalog.select(key).distinct(), key, "left_semi").select(key, *columns)


def shape_inventory(windows: DataFrame) -> DataFrame:
    """Per (role, signal): windows, largest shape, values."""
    steps, channels = F.size("values"), F.size(F.get("values", F.lit(0)))
    out = windows.groupBy("role", "signal").agg(
        F.count_distinct("shot_id", "window_index").alias("n_windows"), F.max(channels).alias("channels"), F.max(steps).alias("steps"), F.sum((steps * channels).cast("long")).alias("n_values")
    )
    return out.select("role", "signal", "n_windows", names.shape_text(F.array("channels", "steps")).alias("shape"), "n_values")


def task_catalogue(tasks: DataFrame) -> DataFrame:
    return tasks.select("task", "group_id", "task_type", "input_length", "output_length", "delta", "stride").orderBy("task")
