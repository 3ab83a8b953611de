"""Catalog queries: which shots, sources and signals there are."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_shots(paths: DataFrame, column: str = "path") -> DataFrame:
    """Shot ids, ascending, from store names that end in <digits>.zarr."""
    stem = F.regexp_extract(column, r"([^/]+)\.zarr/?$", 1)
    return paths.select(stem.alias("stem")).where(F.col("stem").rlike("^[0-9]+$")).select(F.col("stem").cast("long").alias("shot_id")).distinct().orderBy("shot_id")


def sources_per_shot(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("shot_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def signals_per_shot(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("shot_id").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def signals_exist(catalog: DataFrame, requested: list[str]) -> DataFrame:
    """(signal, found) for each requested name, in order of request."""
    spark = catalog.sparkSession
    asked = spark.createDataFrame(list(enumerate(dict.fromkeys(requested))), "pos int, signal string")
    there = catalog.where(F.col("signal").isin(requested)).select("signal").distinct().withColumn("found", F.lit(True))
    return asked.join(there, "signal", "left").select("signal", F.coalesce("found", F.lit(False)).alias("found"), "pos").orderBy("pos").drop("pos")


def shots_with_all(catalog: DataFrame, required: list[str]) -> DataFrame:
    """Shots that have every required signal, from (shot_id, signal) rows."""
    if not required:
        raise ValueError("no signal is required")
    have = catalog.where(F.col("signal").isin(required)).groupBy("shot_id").agg(F.count_distinct("signal").alias("n"))
    return have.where(F.col("n") == len(set(required))).select("shot_id")


def shots_with_all_wide(availability: DataFrame, required: list[str]) -> DataFrame:
    """The same from a table with a boolean column per signal."""
    if not required:
        raise ValueError("no signal is required")
    return availability.where(reduce(lambda a, b: a & b, (F.col(f"`{c}`") for c in required))).select("shot_id")


def valid_shot_ids(ids: DataFrame, column: str = "shot_id") -> DataFrame:
    """Ids that are whole numbers or strings of digits, as longs."""
    return ids.where(F.col(column).cast("string").rlike("^[0-9]+$")).select(F.col(column).cast("string").cast("long").alias("shot_id"))


def invalid_shot_ids(ids: DataFrame, column: str = "shot_id") -> DataFrame:
    return ids.where(~F.coalesce(F.col(column).cast("string").rlike("^[0-9]+$"), F.lit(False))).select(F.col(column).alias("shot_id"))


def missing_pairs(catalog: DataFrame, required: list[str]) -> DataFrame:
    """(shot_id, signal): required signals that a shot of the catalog lacks."""
    wanted = catalog.select("shot_id").distinct().withColumn("signal", F.explode(F.array(*map(F.lit, dict.fromkeys(required)))))
    return wanted.exceptAll(catalog.select("shot_id", "signal").distinct())


# ---------------------------------------------------------------- availability as bitmaps: 32,768 shot ids in 4 KB

BITS = 8 * 4096  # fixed value: ids of a bucket, as Spark's bitmap functions divide them


def bitmaps(catalog: DataFrame) -> DataFrame:
    """(signal, bucket, shots): the shots of each signal, from (shot_id, signal) rows; repeated rows and null ids do not matter.

    Sets are built before the shuffle, so what is shuffled grows with signals and buckets, not with rows."""
    at = catalog.where(F.col("shot_id").isNotNull()).select("signal", F.bitmap_bucket_number("shot_id").alias("bucket"), F.bitmap_bit_position("shot_id").alias("at"))
    return at.groupBy("signal", "bucket").agg(F.bitmap_construct_agg("at").alias("shots"))


def _members(bucket: Column, byte: Callable[[Column], Column]) -> Column:
    """The ids of a bucket whose bit is set, from its bytes."""
    first = F.when(bucket > 0, (bucket - 1) * BITS + 1).otherwise(bucket * BITS)
    step = F.when(bucket > 0, 1).otherwise(-1)
    ids = lambda at, b: F.transform(F.filter(F.array(*map(F.lit, range(8))), lambda k: F.get(F.array(*(F.lit(1 << i) for i in range(8))), k).bitwiseAND(b) != 0), lambda k: first + step * (8 * at + k))
    full = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS // 8 - 1)), lambda at: F.struct(at.alias("at"), byte(at).alias("b"))), lambda x: x["b"] != 0)
    return F.flatten(F.transform(full, lambda x: ids(x["at"], x["b"])))


def _byte(bitmap: Column) -> Callable[[Column], Column]:
    return lambda at: F.conv(F.hex(F.substr(bitmap, at + 1, F.lit(1))), 16, 10).cast("int")


def signal_counts(sets: DataFrame) -> DataFrame:
    """(signal, n_shots) from bitmaps()."""
    return sets.groupBy("signal").agg(F.sum(F.bitmap_count("shots")).alias("n_shots"))


def having_all(sets: DataFrame, required: list[str]) -> DataFrame:
    """Shots that every required signal's set holds; a bucket in which a signal has no set has none."""
    if not required:
        raise ValueError("no signal is required")
    both = sets.where(F.col("signal").isin(required)).groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("shots").alias("shots"))
    return both.where(F.col("n") == len(set(required))).select(F.explode(_members(F.col("bucket"), _byte(F.col("shots")))).alias("shot_id"))


def lacking(sets: DataFrame, required: list[str]) -> DataFrame:
    """(shot_id, signal): required signals whose set lacks a shot that some signal's set holds."""
    every = sets.groupBy("bucket").agg(F.bitmap_or_agg("shots").alias("every"))
    asked = every.withColumn("signal", F.explode(F.array(*map(F.lit, dict.fromkeys(required)))))
    here = asked.join(sets.where(F.col("signal").isin(required)), ["signal", "bucket"], "left")
    rest = lambda at: _byte(F.col("every"))(at).bitwiseAND(F.bitwise_not(F.coalesce(_byte(F.col("shots"))(at), F.lit(0))))
    return here.select(F.explode(_members(F.col("bucket"), rest)).alias("shot_id"), "signal")
