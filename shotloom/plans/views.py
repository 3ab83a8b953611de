"""The library's tables as views of a star schema: events are samples, line items cells, orders shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAYS = 30
#: Signals of several channels that embeddings are read as: first number, channels, sampling interval.
CHANNELS = {"wide": (0, 4, 0.5), "pair": (4, 2, 0.5), "trio": (6, 3, 1.0)}
EVENT_SIGNALS = ["click", "error", "purchase", "signup", "view"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples: one signal per event type, one sample a day (the mean of its events), days without events missing."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("shot_id"), F.col("event_type").alias("signal"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day"), "value")
    daily = events.where(F.col("day").between(0, DAYS - 1)).groupBy("shot_id", "signal", "day").agg(F.avg("value").alias("value"))
    packed = daily.groupBy("shot_id").pivot("signal", EVENT_SIGNALS).agg(F.map_from_entries(F.collect_list(F.struct("day", "value"))))
    each = F.explode(F.create_map(*(x for s in EVENT_SIGNALS for x in (F.lit(s), F.coalesce(F.col(s), F.create_map().cast("map<int,double>"))))))
    long = packed.select("shot_id", each.alias("signal", "by_day"))
    days = F.sequence(F.lit(0), F.lit(DAYS - 1))
    rows = long.select("shot_id", "signal", F.posexplode(F.transform(days, lambda d: F.array(F.element_at("by_day", d)))).alias("t_idx", "values"))
    return rows.select("shot_id", "signal", "t_idx", F.col("t_idx").cast("double").alias("time"), "values")


def event_meta(spark: SparkSession, samples: DataFrame | None = None) -> DataFrame:
    """signal_meta: a day per sample; mean and deviation of the values that are there, if samples are given."""
    if samples is None:
        return spark.createDataFrame([(s, 1.0, [1], None, None) for s in EVENT_SIGNALS], "signal string, dt double, values_shape array<int>, mean double, std double")
    x = F.get("values", F.lit(0))
    return samples.groupBy("signal").agg(F.lit(1.0).alias("dt"), F.array(F.lit(1)).alias("values_shape"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells (shot_id, variable, value): four measures of each line item under its supplier; some tax values missing."""
    items = read(spark, sf_dir, "lineitem")
    tax = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_tax"))
    rows = items.select(F.col("l_suppkey").alias("shot_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), tax.alias("tax"))
    return rows.unpivot(["shot_id"], ["quantity", "extendedprice", "discount", "tax"], "variable", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shot_id, t_idx, vec_id, values): embeddings under their label; every seventh channel of a row missing."""
    rows = read(spark, sf_dir, "embeddings")
    values = F.transform(F.col("embedding").cast("array<double>"), lambda x, c: F.when((F.col("vec_id") + c) % 7 != 0, x))
    return rows.select(F.col("label").cast("long").alias("shot_id"), F.col("vec_id").cast("int").alias("t_idx"), "vec_id", values.alias("values"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """waves (shot_id, signal, channel, t0, dt, wave): each embedding read as a waveform."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("shot_id"), F.lit("wave").alias("signal"), F.lit(0).alias("channel"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("dt"), F.col("embedding").cast("array<double>").alias("wave"))


def order_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shot_id"), F.col("o_orderdate").alias("time"))


def scalar(values: str | Column = "values") -> Column:
    return F.get(F.col(values) if isinstance(values, str) else values, F.lit(0))


def channel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples of several channels: the embeddings of a label in order of time, every half second; every fourth channel
    value is missing, and shots whose id divides by three lack the signal trio."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("shot_id"), "vec_id", F.col("embedding").cast("array<double>").alias("x"), k.alias("k"))
    each = []
    for s, (first, n, dt) in CHANNELS.items():
        step = int(dt / 0.5)
        values = F.transform(F.slice("x", first + 1, n), lambda x, c: F.when((F.col("vec_id") + c) % 4 != 0, x))
        here = (F.col("k") % step == 0) & (F.lit(s != "trio") | (F.col("shot_id") % 3 != 0))
        each.append(F.when(here, F.struct(F.lit(s).alias("signal"), F.floor(F.col("k") / step).cast("int").alias("t_idx"), (F.floor(F.col("k") / step) * F.lit(dt)).alias("time"), values.alias("values"))))
    return rows.select("shot_id", F.explode(F.array_compact(F.array(*each))).alias("r")).select("shot_id", "r.*")


def channel_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_meta of channel_samples."""
    shapes = spark.createDataFrame([(s, dt, [n]) for s, (_, n, dt) in CHANNELS.items()], "signal string, dt double, values_shape array<int>")
    cells = channel_samples(spark, sf_dir).select("signal", F.explode("values").alias("x"))
    return shapes.join(cells.groupBy("signal").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")), "signal")


def probe_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples of a fast and a slow signal: the embeddings of a label one after the other, every entry a sample of the wave
    ``probe`` (two channels, the second in reverse order), their first entries those of ``slow``, one every 64 s."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("shot_id"), F.col("embedding").cast("array<double>").alias("x"), k.alias("k"))
    fast = rows.select("shot_id", "k", "x", F.posexplode("x").alias("c", "v"))
    at = F.col("k") * 64 + F.col("c")
    probe = fast.select("shot_id", F.lit("probe").alias("signal"), at.cast("int").alias("t_idx"), at.cast("double").alias("time"), F.array("v", F.get("x", 63 - F.col("c"))).alias("values"))
    slow = rows.select("shot_id", F.lit("slow").alias("signal"), F.col("k").cast("int").alias("t_idx"), (F.col("k") * 64).cast("double").alias("time"), F.array(F.get("x", F.lit(0))).alias("values"))
    return probe.unionByName(slow)
