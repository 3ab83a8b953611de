"""Shuffling and batching of windows for training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .splits import global_rank, range_rank, seeded


def shuffle(windows: DataFrame, seed: int = 42) -> DataFrame:
    """Windows in a seeded order, as column shuffle_rank (0-based)."""
    keys = windows.select("shot_id", "window_index").distinct()
    key = seeded(F.concat_ws("-", "shot_id", "window_index"), seed)
    ranked = global_rank(keys, [key, F.col("shot_id"), F.col("window_index")], F.substring(key, 1, 4))
    return ranked.select("shot_id", "window_index", F.col("_rank").cast("long").alias("shuffle_rank"))


BUFFER = 512
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))


def draws(seed: int, part: int, first: int, n: int) -> np.ndarray:
    """The first-th to (first + n)-th 64-bit numbers of a part: each a mix of seed, part and its own place, so that any of
    them can be made without those before (the public splitmix64 function)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) * _MIX[0][1] + np.uint64(part) * _MIX[1][1] + (np.arange(first, first + n, dtype=np.uint64) + np.uint64(1)) * _STEP
        for shift, factor in _MIX:
            z = (z ^ (z >> shift)) * factor
        return z ^ (z >> np.uint64(31))


def shuffle_buffer(windows: DataFrame, parts: int, size: int = BUFFER, seed: int = 42) -> DataFrame:
    """Windows (any rows with shot_id and window_index) with ``part`` and ``position``, in the order of a bounded buffer.

    Shots are dealt to parts by a hash of their id, and a part's windows come by shot and window.  The buffer holds ``size`` of
    them: each further window takes the place of one drawn at random, which goes out; at the end the rest goes out in random
    order.  The generator counts instead of keeping a state, so the order depends on seed, part and input order alone, whatever
    the batches, and a task that is run again gives the same one.  A task holds a buffer and a batch of rows."""
    rows = windows.withColumn("part", F.pmod(F.xxhash64("shot_id"), F.lit(parts)).cast("int"))
    dealt = rows.repartition("part").sortWithinPartitions("part", "shot_id", "window_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # rows that wait, those of the buffer's places first
        part, taken, sent = -1, 0, 0

        def out(rows: pa.RecordBatch, order: list[int]) -> pa.RecordBatch:
            nonlocal sent
            sent += len(order)
            position = pa.array(np.arange(sent - len(order), sent), pa.int64())
            chosen = rows.take(pa.array(order, pa.int64()))
            return pa.record_batch([*chosen.columns, position], names=[*rows.schema.names, "position"])

        def rest() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held is not None and held.num_rows:
                keys = draws(seed, part, 1 << 40, held.num_rows)
                yield out(held, np.argsort(keys, kind="stable").tolist())
            held = None

        for b in batches:
            of = b.column(b.schema.get_field_index("part")).to_numpy()
            for a, z in zip(edges := np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), [*edges[1:], len(of)], strict=True) if len(of) else ():
                if of[a] != part:
                    yield from rest()
                    part, taken, sent = int(of[a]), 0, 0
                new = b.slice(a, z - a)
                both = new if held is None else pa.Table.from_batches([held, new]).combine_chunks().to_batches()[0]
                n = 0 if held is None else held.num_rows
                places, order = list(range(n)), []
                fill = min(size - n, new.num_rows)
                places += range(n, n + fill)
                for row, j in zip(range(n + fill, both.num_rows), (draws(seed, part, taken, new.num_rows - fill) % np.uint64(size)).tolist(), strict=True):
                    order.append(places[j])
                    places[j] = row
                taken += len(order)
                held = both.take(pa.array(places, pa.int64()))
                if order:
                    yield out(both, order)
        yield from rest()

    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, StructField("position", LongType())]))


def batch_ids(windows: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """(shot_id, window_index, batch_id): batches of ``size`` windows, the last one partial; by shot or shuffled."""
    if seed is not None:
        ranked = shuffle(windows, seed)
    else:
        keys = windows.select("shot_id", "window_index").distinct()
        ranked = range_rank(keys, ["shot_id", "window_index"]).withColumnRenamed("_rank", "shuffle_rank")
    return ranked.select("shot_id", "window_index", F.floor(F.col("shuffle_rank") / size).alias("batch_id"))


def batches(windows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per (batch, role, signal): the windows' values stacked, 32-bit."""
    rows = windows.join(ids, ["shot_id", "window_index"])
    stack = F.array_sort(F.collect_list(F.struct("shot_id", "window_index", "values")))
    out = rows.groupBy("batch_id", "role", "signal").agg(stack.alias("rows"))
    return out.select("batch_id", "role", "signal", F.transform("rows", lambda r: r["shot_id"]).alias("shot_ids"), F.transform("rows", lambda r: r["values"]).cast("array<array<array<float>>>").alias("values"))


def float32(windows: DataFrame) -> DataFrame:
    return windows.withColumn("values", F.col("values").cast("array<array<float>>"))


def per_partition_order(windows: DataFrame, seed: int = 42) -> DataFrame:
    """A shuffle for training at scale: a seeded deal to partitions and a seeded order inside each; no global rank."""
    key = seeded(F.concat_ws("-", "shot_id", "window_index"), seed)
    return windows.repartition(key).sortWithinPartitions(key)


def first_windows(windows: DataFrame, n: int) -> DataFrame:
    """The first windows of each shot, from one pass over the windows; rows without a shot or a number are left out."""
    w = Window.partitionBy("shot_id").orderBy("window_index")
    numbered = windows.where(F.col("shot_id").isNotNull() & F.col("window_index").isNotNull())
    return numbered.withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= n).drop("_k")
