"""Structured Streaming forms of the metric roll-up, the appending sink and the sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_metrics(windows: DataFrame) -> DataFrame:
    """Running shot-signal sums over a stream of window metrics; finish() turns them into metrics."""
    fit = F.col("RMSE").isNotNull() & F.col("MAE").isNotNull()
    return windows.groupBy("task", "shot_id", "feature_name").agg(
        F.count_if(fit).alias("n"), F.sum(F.when(fit, F.col("RMSE") * F.col("RMSE"))).alias("se"), F.sum(F.when(fit, F.col("MAE"))).alias("ae"), F.sum(F.when(fit, F.col("nan_fraction"))).alias("gap")
    )


def finish(sums: DataFrame) -> DataFrame:
    return sums.where("n > 0").select("task", "shot_id", "feature_name", "n", F.sqrt(F.col("se") / F.col("n")).alias("RMSE_mean"), (F.col("ae") / F.col("n")).alias("MAE_mean"), (F.col("gap") / F.col("n")).alias("nan_fraction_mean"))


def updates_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each micro-batch changes below ``path``; a micro-batch that is done again replaces what it wrote."""
    return df.writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{path}/batch={k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key; updates: as written by updates_to, with column batch."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def compact(spark: SparkSession, path: str, keys: list[str], to: str) -> DataFrame:
    """The updates below ``path``, merged by key into a table of their own, so that they can be cleared."""
    latest(spark.read.parquet(path), keys).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to Parquet files, exactly once."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding(samples: DataFrame, length: str, stride: str, lateness: str, time_col: str = "ts") -> DataFrame:
    """Sliding windows over a live sample stream (shot_id, signal, ts, value): count, mean, least and largest value.
    Windows are aligned to the epoch.  Written by append_to, a window comes out once, when the watermark has passed it; its state
    then goes, and samples that come later than ``lateness`` are dropped."""
    live = samples.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)
    out = live.groupBy("shot_id", "signal", F.window(time_col, length, stride)).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select("shot_id", "signal", F.col("window.start").alias("start"), "n", "mean", "low", "high")
