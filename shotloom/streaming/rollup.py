"""Reports that are kept up to date by a stream of window metrics: shots, signals and tasks as keyed state.

Windows are added up inside each Arrow batch, then go to their task and one of ``buckets`` buckets of shots.  There the state holds
the sums of every shot (a map of ``pieces``, each with some shots, so that a micro-batch reads and writes many shots at once) and the
running moments of every signal and of the task (a map by signal): a window that comes in takes its shot's old metrics out of the
moments and puts the new ones in.  Reports read the moments from the state
store, one row per signal and bucket, however many shots there are.

Moments are sums of values and squares in twice the precision of a double, so that what was put in can be taken out again."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import names
from ..operators.metrics import group_report
from ..plans import workspace
from ..schema import METRICS

BUCKETS = 64
PIECES = 256  # of a bucket's shots: a micro-batch reads and writes each piece once that it touches
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = ["n", "se", "ae", "gap", "gaps"]
CHANGED = "task string, bucket int, own boolean, feature_name string, n_shots long, counts array<long>, means array<double>, spreads array<double>"


def partial(windows: DataFrame, meta: DataFrame, buckets: int = BUCKETS, pieces: int = PIECES) -> DataFrame:
    """(task, bucket, piece, shot_id, feature_name, std, n, se, ae, gap, gaps): sums over the usable windows of each Arrow batch."""
    rmse, mae, share = (names.number(F.col(c)) for c in ("RMSE", "MAE", "nan_fraction"))
    rows = windows.select("task", "shot_id", "feature_name", (rmse * rmse).alias("se"), mae.alias("ae"), share.alias("gap"))
    rows = rows.where(F.col("se").isNotNull() & F.col("ae").isNotNull())
    rows = rows.join(F.broadcast(meta.select(F.col("signal").alias("feature_name"), "std")), "feature_name", "left")  # signals: a fixed number
    keys = ["task", "bucket", "piece", "shot_id", "feature_name"]
    part = lambda h, n: F.pmod(h, F.lit(n)).cast("int")
    places = part(F.xxhash64("shot_id"), buckets).alias("bucket"), part(F.xxhash64("shot_id", F.lit("piece")), pieces).alias("piece")
    rows = rows.select("task", *places, "shot_id", "feature_name", "std", F.lit(1.0).alias("n"), "se", "ae", F.coalesce("gap", F.lit(0.0)).alias("gap"), F.when(F.col("gap").isNotNull(), 1.0).otherwise(0.0).alias("gaps"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.groupby(keys, dropna=False, sort=False, as_index=False).agg({"std": "first", **dict.fromkeys(SUMS, "sum")})

    return rows.mapInPandas(add, "task string, bucket int, piece int, shot_id long, feature_name string, std double, n double, se double, ae double, gap double, gaps double")


def _plus(high: float, low: float, x: float, x_low: float = 0.0) -> tuple[float, float]:
    s = high + x
    part = s - high
    low += (high - (s - part)) + (x - part) + x_low
    out = s + low
    return out, low - (out - s)


def _metrics(sums: list[float]) -> list[float | None]:
    """A shot's metrics of one signal, in the order of METRICS."""
    n, se, ae, gap, gaps, std = sums
    rmse, mae = math.sqrt(se / n), ae / n
    scaled = std == std and std != 0
    return [rmse / std if scaled else None, mae / std if scaled else None, rmse, mae, gap / gaps if gaps else None]


def _over_signals(rows: list[list[float | None]]) -> list[float | None]:
    columns = ([v for v in column if v is not None] for column in zip(*rows, strict=True))
    return [math.fsum(c) / len(c) if c else None for c in columns]


class _Moments:
    """How many shots have a value, and the sums of values and squares, for each metric."""

    def __init__(self, n_shots: int = 0, sums: list[float] | None = None) -> None:
        self.n_shots = n_shots
        self.sums = list(sums) if sums else [0.0] * (5 * len(METRICS))

    def change(self, row: list[float | None] | None, sign: int, counted: bool = True) -> None:
        if row is None:
            return
        self.n_shots += sign * counted
        for k, x in enumerate(row):
            if x is None:
                continue
            n, high, low, square, square_low = self.sums[5 * k : 5 * k + 5]
            q = x * x
            self.sums[5 * k : 5 * k + 5] = [n + sign, *_plus(high, low, sign * x), *_plus(square, square_low, sign * q, sign * math.fma(x, x, -q) if math.isfinite(q) else 0.0)]

    def finished(self) -> tuple[list[int], list[float], list[float]]:
        """Counts, means, and sums of squares about the mean."""
        counts, means, spreads = [], [], []
        for k in range(len(METRICS)):
            n, *parts = self.sums[5 * k : 5 * k + 5]
            counts.append(int(n))
            if not n or not all(map(math.isfinite, parts)):
                means.append(math.nan if n else 0.0)
                spreads.append(math.nan if n else 0.0)
                continue
            high, low, square, square_low = map(Fraction, parts)
            means.append(float((high + low) / int(n)))
            spreads.append(max(0.0, float(square + square_low - (high + low) ** 2 / int(n))))
        return counts, means, spreads


class RollUp(StatefulProcessor):
    """State of one task and bucket; gives the moments of the signals that a micro-batch changes."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shots = handle.getMapState("shots", "piece int", "shot_ids array<long>, features array<array<string>>, sums array<array<array<double>>>, seen array<long>", self.ttl_ms)
        self.totals = handle.getMapState("totals", "own boolean, feature_name string", "n_shots long, sums array<double>, counts array<long>, means array<double>, spreads array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh: dict[int, dict[int | None, dict[str | None, list[float]]]] = {}
        for frame in rows:
            for piece, shot, feature, std, *sums in frame[["piece", "shot_id", "feature_name", "std", *SUMS]].itertuples(index=False):
                mine = fresh.setdefault(int(piece), {}).setdefault(None if pd.isna(shot) else int(shot), {}).setdefault(None if feature is None or feature != feature else feature, [0.0] * 5 + [float(std)])
                for k, v in enumerate(sums):
                    mine[k] += float(v)
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0
        moments: dict[tuple[bool, str | None], _Moments] = {}

        def of(own: bool, feature: str | None) -> _Moments:
            if (own, feature) not in moments:
                known = self.totals.getValue((own, feature))
                moments[own, feature] = _Moments(int(known[0]), known[1]) if known is not None else _Moments()
            return moments[own, feature]

        some = self.shots.exists()  # without any shot there is none to look up
        for piece, shots in fresh.items():
            known = self.shots.getValue((piece,)) if some else None
            entries = zip(*known, strict=True) if known is not None else ()
            piece_held = {shot: (features, sums, seen) for shot, features, sums, seen in entries if self.ttl_ms is None or seen + self.ttl_ms > now}
            for shot, features in shots.items():
                held = {f: list(s) for f, s in zip(*piece_held[shot][:2], strict=True)} if shot in piece_held else {}
                before = {f: _metrics(s) for f, s in held.items()}
                for f, sums in features.items():
                    held[f] = [a + b for a, b in zip(held[f][:5], sums[:5], strict=True)] + [sums[5]] if f in held else sums
                after = {f: _metrics(held[f]) if f in features else before[f] for f in held}
                for f in features:
                    of(False, f).change(before.get(f), -1, shot is not None)
                    of(False, f).change(after[f], 1, shot is not None)
                of(True, None).change(_over_signals([before[f] for f in sorted(before, key=str)]) if before else None, -1)
                of(True, None).change(_over_signals([after[f] for f in sorted(after, key=str)]), 1)
                piece_held[shot] = (list(held), list(held.values()), now)
            self.shots.updateValue((piece,), (list(piece_held), *map(list, zip(*piece_held.values(), strict=True))))
        out = []
        for (own, feature), m in moments.items():
            counts, means, spreads = m.finished()
            self.totals.updateValue((own, feature), (m.n_shots, m.sums, counts, means, spreads))
            out.append((key[0], key[1], own, feature, m.n_shots, counts, means, spreads))
        yield pd.DataFrame(out, columns=["task", "bucket", "own", "feature_name", "n_shots", "counts", "means", "spreads"])

    def close(self) -> None:
        pass


def rolled_up(windows: DataFrame, meta: DataFrame, buckets: int = BUCKETS, ttl_ms: int | None = None, pieces: int = PIECES) -> DataFrame:
    """A stream of window metrics as a stream of the moments that it changes.

    Windows without RMSE or MAE are left out; a row that comes twice counts twice; null signals and shots are values of their own, but
    a null shot is not counted in n_shots of a signal, as in the batch report; other columns are not read.  ``buckets``, ``pieces`` and ``meta`` must stay the same while a checkpoint lives.  With ``ttl_ms`` the sums of a
    shot go when no window has come for so long: its metrics stay in the moments, and a window that comes later begins a new shot."""
    grouped = partial(windows, meta, buckets, pieces).groupBy("task", "bucket")
    return grouped.transformWithStateInPandas(RollUp(ttl_ms), CHANGED, "Update", "None" if ttl_ms is None else "ProcessingTime")


def start(changed: DataFrame, checkpoint: str, every: str | None = None, parts: int = BUCKETS) -> StreamingQuery:
    """Take in what has come since the last start; the state below ``checkpoint`` is the result.  With ``every`` (a trigger interval)
    the stream goes on until it is stopped; streams with a time to live need that, since they have micro-batches without data.
    The first start lays the state out in ``parts`` partitions at most: each costs a worker and a store in every micro-batch."""
    conf = changed.sparkSession.conf
    partitions = "spark.sql.shuffle.partitions"
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, partitions: str(min(parts, int(conf.get(partitions))))}
    before = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        out = changed.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)


def state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable after the last finished micro-batch: ``shots`` (a row per task and shot) or ``totals``.  Before the first one
    there is none, and Spark raises an error."""
    rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).select("key.*", "user_map_key.*", "user_map_value.*")
    if variable != "shots":
        return rows
    each = F.arrays_zip(F.col("shot_ids").alias("shot_id"), "features", "sums", "seen")
    return rows.select("task", "bucket", "piece", F.inline(each))


def _pooled(rows: DataFrame, k: int, metric: str) -> DataFrame:
    """Mean and deviation of the k-th metric over buckets; column p: one entry a bucket."""
    at = lambda x, c: F.get(x[c], F.lit(k))
    over = lambda zero, f: F.aggregate("p", F.lit(zero), lambda acc, x: acc + f(x))
    rows = rows.withColumn("_n", over(0.0, lambda x: at(x, "counts"))).withColumn(f"{metric}_mean", F.try_divide(over(0.0, lambda x: at(x, "counts") * at(x, "means")), F.col("_n")))
    away = lambda x: at(x, "means") - F.col(f"{metric}_mean")
    left = over(0.0, lambda x: at(x, "spreads") + at(x, "counts") * F.coalesce(away(x) * away(x), F.lit(0.0)))
    return rows.withColumn(f"{metric}_std_pop", F.coalesce(F.sqrt(F.try_divide(left, F.col("_n"))), F.lit(0.0))).drop("_n")


def report(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Signal rows and the rows of the tasks themselves (own), as metrics.task_report gives them."""
    parts = state(spark, checkpoint, "totals").withColumn("feature_name", F.when(F.col("own"), F.col("task")).otherwise(F.col("feature_name")))
    rows = parts.groupBy("task", "own", "feature_name").agg(F.sum("n_shots").cast("double").alias("n_shots"), F.collect_list(F.struct("counts", "means", "spreads")).alias("p"))
    for k, m in enumerate(METRICS):
        rows = _pooled(rows, k, m)
    return rows.drop("p")


def live_group_report(spark: SparkSession, checkpoint: str, groups: DataFrame) -> DataFrame:
    """Each group's row and those of its tasks, from the state."""
    return group_report(workspace.keep(report(spark, checkpoint).where("own")), groups)  # a row per task, read twice
