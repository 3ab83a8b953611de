"""Readers and writers of the small tables around the samples: splits, metadata, statistics, metrics, windows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import metrics
from ..plans import workspace
from ..schema import METRICS, SIGNAL_META


def read_splits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Shot ids of train, test and val from a CSV file with boolean columns."""
    rows = spark.read.option("header", True).csv(path)
    flag = lambda c: F.lower(F.trim(F.col(c))).isin("true", "1")
    return {s: rows.where(flag(s)).select(F.col("shot_id").cast("long").alias("shot_id")) for s in ("train", "test", "val")}


def parse_mapping(text: str) -> dict:
    """YAML (or JSON) text that holds a mapping."""
    try:
        import yaml
    except ImportError:
        data = json.loads(text)
    else:
        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("the text holds no mapping")
    return data


def read_mapping(spark: SparkSession, path: str) -> dict:
    """A mapping from a YAML (or JSON) file anywhere that Spark reads."""
    return parse_mapping(spark.read.text(path, wholetext=True).first()[0])


def write_mapping(df: DataFrame, key: str, path: str) -> None:
    """A dimension (a few rows per signal or shot) as one file that holds a mapping from ``key`` to the row's other values;
    those that are missing are left out.  JSON is YAML too, so read_mapping reads it back."""
    rest = F.to_json(F.struct(*(c for c in df.columns if c != key)))
    pair = F.concat(F.to_json(F.array(F.col(key).cast("string"))), F.lit(": "), rest)
    pair = F.regexp_replace(pair, r'^\["((?:[^"\\]|\\.)*)"\]', '"$1"')
    lines = df.select(F.col(key).alias("key"), pair.alias("pair")).groupBy().agg(F.array_sort(F.collect_list(F.struct("key", "pair"))).alias("x"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("x", lambda p: p["pair"]), ",\n "), F.lit("}"))
    lines.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def signal_meta(spark: SparkSession, mapping: dict) -> DataFrame:
    rows = [(s, m.get("dt"), m.get("values_shape") and list(m["values_shape"]), m.get("mean"), m.get("std")) for s, m in mapping.items()]
    return spark.createDataFrame(rows, SIGNAL_META)


def outlier_pairs(spark: SparkSession, mapping: dict) -> DataFrame:
    return spark.createDataFrame([(int(shot), s) for shot, signals in mapping.items() for s in signals or []], "shot_id long, signal string")


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header, replacing what was there; one folder per value of ``by``."""
    out = df.write.mode("overwrite").option("header", True)
    (out.partitionBy(by) if by else out).csv(path)


LEVELS = ["windows", "shots", "signals", "tasks", "groups"]


def write_levels(windows: DataFrame, meta: DataFrame, groups: DataFrame, path: str) -> dict[str, str]:
    """Window metrics and what follows from them, a CSV table per level, each checked before it is written and read again
    for the next; folders by task, but for groups."""
    spark, out = windows.sparkSession, {level: f"{path}/{level}" for level in LEVELS}

    def put(level: str, rows: DataFrame, columns: list[str], by: str | None = "task") -> DataFrame:
        rows = workspace.keep(rows)  # checked and written without being made twice
        metrics.validate(rows, columns)
        write_csv(rows, out[level], by)
        back = spark.read.option("header", True).csv(out[level])
        return back.select(*(F.col(c).cast(t).alias(c) for c, t in rows.dtypes))

    spread = [f"{m}_{s}" for m in METRICS for s in ("mean", "std_pop")]
    rows = put("windows", windows, ["task", "shot_id", "window_index", "feature_name", *METRICS[2:]])
    shots = put("shots", metrics.shot_metrics(rows, meta), ["task", "shot_id", "feature_name", *(f"{m}_mean" for m in METRICS)])
    put("signals", metrics.signal_metrics(shots), ["task", "feature_name", *spread])
    tasks = put("tasks", metrics.task_rows(shots), ["task", *spread])
    put("groups", metrics.group_report(tasks, groups), ["group_id", "task", *spread], None)
    return out


def append_rows(df: DataFrame, path: str, columns: list[str]) -> None:
    """Append Parquet rows; the columns must be the expected ones."""
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"columns {df.columns} are not {columns}")
    df.select(*columns).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str, kind: str = "task") -> DataFrame | None:
    """A metric CSV with numbers coerced (bad text is missing); None if the file or a column is missing."""
    suffixes = {"task": ["_mean", "_std_pop"], "shots": ["_mean"], "windows": [""]}[kind]
    wanted = [m + s for m in (METRICS if kind != "windows" else METRICS[2:]) for s in suffixes]
    try:
        rows = spark.read.option("header", True).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    if not {"feature_name", *wanted} <= set(rows.columns):
        return None
    ids = [c for c in rows.columns if c not in wanted]
    return rows.select(*ids, *(names.number(F.col(c)).alias(c) for c in wanted))


def write_windows_float32(windows: DataFrame, path: str) -> None:
    """Windows for training: 32-bit values; an empty set is an error."""
    out = windows.withColumn("values", F.col("values").cast("array<array<float>>"))
    if out.isEmpty():
        raise ValueError("there are no windows")
    out.write.mode("overwrite").partitionBy("role").parquet(path)
