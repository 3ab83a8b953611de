"""Packing samples for the kernel: a row per shot, or per block of a shot's time, with a column per signal.

One shuffle by shot (or by shot and block) packs all signals.  A shot that is much longer than others is one row and one task
unless it is cut into blocks: each block holds the windows whose cut falls into it, the samples of its time, and a halo of one
window on both sides; what a block needs of the rest of the shot (where it starts, how many samples there are, the edge samples
that stand for indices outside a series) is carried to it from sums per signal, so no join moves samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import any_present
from . import kernel
from .kernel import Block, Meta, Series
from .windows import cut_counts, width

SAMPLE = "struct<t_idx:int,time:double,values:array<double>>"
SAMPLES_AT_ONCE = 300_000  # samples of rows that the kernel takes together, about


def known(meta: DataFrame, wanted: list[str]) -> dict[str, Meta]:
    """dt, width and mean of signals: a row for each signal that a task names."""
    mean = F.col("mean").cast("double") if "mean" in meta.columns else F.lit(None).cast("double")
    rows = meta.where(F.col("signal").isin(wanted)).select("signal", F.col("dt").cast("double").alias("dt"), width(meta).alias("width"), mean.alias("mean")).collect()
    return {r["signal"]: Meta(r["dt"], r["width"], math.nan if r["mean"] is None else r["mean"]) for r in rows}


def _columns(wanted: list[str]) -> list:
    one = F.struct(F.col("t_idx").cast("int").alias("t_idx"), F.col("time").cast("double").alias("time"), F.col("values").cast("array<double>").alias("values"))
    return [F.collect_list(F.when(F.col("signal") == s, one)).alias(s) for s in wanted]


def packed(samples: DataFrame, wanted: list[str]) -> DataFrame:
    """(shot_id, a column per signal): the samples of each shot, in no order."""
    return samples.where(F.col("signal").isin(wanted) & F.col("time").isNotNull()).groupBy("shot_id").agg(*_columns(wanted))


def unpacked(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The samples (shot_id, signal, t_idx, time, values) of packed shots."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(f"`{s}`").alias("rows")) for s in wanted)))
    return rows.select("shot_id", each.alias("one")).select("shot_id", "one.signal", F.inline("one.rows"))


def reach(task: dict, meta: dict[str, Meta]) -> float:
    """Seconds that a window reaches to either side of its cut, and two samples of the slowest signal more."""
    before = max(float(task["input_length"]), -float(task["delta"]))
    after = float(task["delta"]) + float(task["output_length"])
    return max(before, after) + 2 * max(m.dt for m in meta.values())


def block_length(seconds: float, task: dict, meta: dict[str, Meta]) -> tuple[float, int]:
    """(bucket, buckets of a block): the halo is a bucket on each side, so a block has whole ones."""
    bucket = reach(task, meta)
    return bucket, max(1, math.ceil(seconds / bucket))


def shot_spans(samples: DataFrame, meta: dict[str, Meta], task: dict, every_output: bool = False, carry: bool = False) -> DataFrame:
    """(shot_id, start, stop): from the first valid input or actuator sample to the last valid output sample, from least and
    largest sample numbers alone; shots where one of them is unknown are left out, and in test mode (``every_output``) those
    that lack an output.  Samples must be numbered without gaps.  ``carry`` adds info: of each signal its first time, its
    sample numbers, and its edge samples."""
    wanted, told, read = (kernel.names(task, *r) for r in (("input", "actuator", "output"), ("output",), ("input", "actuator")))
    rows = samples.where(F.col("signal").isin(wanted) & F.col("time").isNotNull())
    at = F.when(F.coalesce(any_present(F.col("values")), F.lit(False)), F.col("t_idx"))
    edges = [F.min_by("values", "t_idx").alias("head"), F.max_by("values", "t_idx").alias("tail")] if carry else []
    sums = rows.groupBy("shot_id", "signal").agg(F.min("time").alias("t0"), F.min("t_idx").alias("i0"), F.max("t_idx").alias("i1"), F.count("*").alias("n"), F.min(at).alias("f"), F.max(at).alias("l"), *edges)
    dt = F.element_at(F.create_map(*(x for s, m in meta.items() for x in (F.lit(s), F.lit(m.dt)))), F.col("signal"))
    gapless = F.when(F.col("n") == F.col("i1") - F.col("i0") + 1, F.col("t0")).otherwise(F.raise_error(F.lit("samples must be numbered without gaps")).cast("double"))
    first, last = (gapless + (F.col(c) - F.col("i0")) * dt for c in ("f", "l"))
    info = [F.collect_list(F.struct("signal", "t0", "i0", "i1", "n", "head", "tail")).alias("info")] if carry else []
    spans = sums.groupBy("shot_id").agg(F.min(F.when(F.col("signal").isin(read), first)).alias("start"), F.max(F.when(F.col("signal").isin(told), last)).alias("stop"), F.count_if(F.col("signal").isin(told)).alias("_told"), *info)
    if every_output:
        spans = spans.where(F.col("_told") == len(told))
    return spans.where(F.col("start").isNotNull() & F.col("stop").isNotNull()).drop("_told")


def blocked(samples: DataFrame, meta: dict[str, Meta], task: dict, seconds: float, every_output: bool = False) -> DataFrame:
    """(shot_id, block, start, first_cut, n_windows, info, a column per signal): shots in blocks of about so many seconds.

    Samples must be numbered without gaps (t_idx), and their times may depart from dt by less than a bucket: both are checked
    where the samples are used.  A growing window needs the shot from its start on, so non-markovian tasks cannot be cut."""
    if task["task_type"] == "non_markovian":
        raise ValueError("growing windows reach back to the start of their shot: it cannot be cut into blocks")
    wanted = kernel.names(task, "input", "actuator", "output")
    bucket, many = block_length(seconds, task, meta)
    length = bucket * many
    rows = samples.where(F.col("signal").isin(wanted) & F.col("time").isNotNull()).select("shot_id", "signal", F.col("t_idx").cast("int").alias("t_idx"), "time", "values")
    spans = cut_counts(shot_spans(rows, meta, task, every_output, carry=True), task).where("n_windows > 0")
    of = lambda w: F.floor((F.col("first_cut") + w * F.lit(float(task["stride"]))) / F.lit(length))
    marks = spans.select("shot_id", F.explode(F.sequence(of(F.lit(0)), of(F.col("n_windows") - 1))).alias("block"), "start", "first_cut", "n_windows", "info")
    own = F.floor(F.col("time") / F.lit(bucket))
    home, place = F.floor(own / many), F.pmod(own, F.lit(many))
    places = F.array_compact(F.array(home, F.when(place == 0, home - 1), F.when(place == many - 1, home + 1)))
    spread = rows.withColumn("block", F.explode(places))
    both = spread.unionByName(marks, allowMissingColumns=True)
    carried = [F.first(c, ignorenulls=True).alias(c) for c in ("start", "first_cut", "n_windows", "info")]
    out = both.groupBy("shot_id", "block").agg(*carried, *_columns(wanted))
    return out.where(F.col("info").isNotNull()).withColumn("block_length", F.lit(length))


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)  # no lists may have no offsets


class _Samples:
    """A column of packed samples: of each row the samples by t_idx, and how many channels they have (-1 without any vector)."""

    def __init__(self, column: pa.ListArray):
        self.at = _offsets(column)
        self.n = np.diff(self.at)
        inside = column.values.slice(self.at[0], self.at[-1] - self.at[0])
        self.at = self.at - self.at[0]
        t_idx, time, vectors = (inside.field(k) for k in range(3))
        self.t_idx, self.time = t_idx.to_numpy(), time.to_numpy()
        row = np.repeat(np.arange(len(self.n)), self.n)
        offsets = _offsets(vectors)
        size, self.there = np.diff(offsets), ~np.asarray(vectors.is_null())
        self.first = offsets[:-1] - offsets[0]
        self.flat = vectors.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(float)
        if ((np.diff(self.t_idx) <= 0) & (np.diff(row) == 0)).any():
            order = np.lexsort((self.t_idx, row))
            self.t_idx, self.time, self.there, self.first, size = (x[order] for x in (self.t_idx, self.time, self.there, self.first, size))
        self.channels = np.full(len(self.n), -1)
        self.channels[row[self.there]] = size[self.there]
        if (self.channels[row] != size)[self.there].any():
            raise ValueError("samples of a signal differ in channels")

    def values(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Samples x channels of some rows, NaN where missing."""
        at = np.repeat(self.at[rows] - np.cumsum(self.n[rows]) + self.n[rows], self.n[rows]) + np.arange(self.n[rows].sum())
        out, there = np.full((len(at), width), np.nan), self.there[at]
        out[there] = self.flat[self.first[at[there]][:, None] + np.arange(width)]
        return out


def _parts(batch: pa.RecordBatch, wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of rows that hold about so many samples together; a row of more is a slice of its own."""
    upto = np.cumsum(sum(np.diff(_offsets(batch.column(s))).astype(np.int64) for s in wanted) + np.zeros(batch.num_rows, np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SAMPLES_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def _alike(columns: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows that agree in all columns."""
    kinds, kind = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)
    for j in range(len(kinds)):
        yield np.flatnonzero(kind.ravel() == j)


def _shots(batch: pa.RecordBatch, wanted: list[str], meta: dict[str, Meta], task: dict, every_output: bool) -> Iterator[Block]:
    """Whole shots, those together whose signals have the same channels."""
    shot, samples = batch.column("shot_id").cast(pa.int64()), {s: _Samples(batch.column(s)) for s in wanted}
    lacking = np.full(batch.num_rows, -1)
    width = {s: np.where(x.n > 0, np.where(x.channels < 0, meta[s].width, x.channels), -1) if s in meta else lacking for s, x in samples.items()}
    for rows in _alike([lacking, *width.values()]):
        series: dict[str, Series | None] = {}
        for s, x in samples.items():
            wide = int(width[s][rows[0]])
            series[s] = Series(x.time[x.at[rows]], meta[s].dt, x.values(rows, wide), own=x.n[rows]) if wide >= 0 else None
        block = kernel.whole(shot.take(pa.array(rows)), series, task, every_output)
        if block is not None:
            yield block


def _blocks(batch: pa.RecordBatch, wanted: list[str], meta: dict[str, Meta], task: dict) -> Iterator[Block]:
    """Blocks of shots, those together whose signals have the same channels."""
    shot, samples = batch.column("shot_id").cast(pa.int64()), {s: _Samples(batch.column(s)) for s in wanted}
    carried = batch.column("info")
    at = _offsets(carried)
    told = carried.values.slice(at[0], at[-1] - at[0])
    row, fields = np.repeat(np.arange(len(at) - 1), np.diff(at)), {told.type.field(j).name: told.field(j) for j in range(told.type.num_fields)}
    of = np.asarray(fields["signal"].to_numpy(zero_copy_only=False), object)
    info, edges, width = {}, {}, {}
    for s, x in samples.items():
        mine = np.flatnonzero(of == s)
        here = np.zeros(batch.num_rows, bool)
        here[row[mine]] = True
        info[s] = {c: _spread(fields[c].take(pa.array(mine)).to_numpy(zero_copy_only=False), row[mine], batch.num_rows) for c in ("t0", "i0", "i1", "n")}
        i0, i1, n = (info[s][c].astype(np.int64) for c in ("i0", "i1", "n"))
        some = x.n > 0
        first, last = (np.append(x.t_idx, 0)[np.where(some, k, -1)].astype(np.int64) for k in (x.at[:-1], x.at[1:] - 1))
        if (here & ((n != i1 - i0 + 1) | (some & (x.n != last - first + 1)))).any():
            raise ValueError("samples of a shot in blocks must be numbered without gaps")
        info[s]["base"] = np.where(some, first - i0, 1)
        edges[s] = [_Vectors(fields[c].take(pa.array(mine)), row[mine], batch.num_rows) for c in ("head", "tail")]
        wide = np.where(x.channels >= 0, x.channels, np.where(edges[s][0].size >= 0, edges[s][0].size, edges[s][1].size))
        width[s] = np.where(here, np.where(wide < 0, meta[s].width if s in meta else 0, wide), -1)
    number, start, first_cut, n_windows, length = (batch.column(c).to_numpy() for c in ("block", "start", "first_cut", "n_windows", "block_length"))
    stride = float(task["stride"])
    near = [np.maximum(0, (number * length - first_cut) // stride - 1).astype(np.int64), np.minimum(n_windows, (((number + 1) * length - first_cut) // stride + 3).astype(np.int64))]
    lo, hi = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    for k, w in Block(shot, {}, start, first_cut, *near).windows():
        mine = np.floor(kernel.cut_times(Block(shot, {}, start, first_cut, lo, hi), w, task, k) / length[k]) == number[k]
        k, w = k[mine], w[mine]
        first = np.flatnonzero(np.r_[True, np.diff(k) > 0]) if len(k) else k
        lo[k[first]] = w[first]
        hi[k[first]] = w[first] + np.diff(np.r_[first, len(k)])
    for rows in _alike([np.full(batch.num_rows, -1), *width.values()]):
        rows = rows[hi[rows] > lo[rows]]
        if not len(rows):
            continue
        series: dict[str, Series | None] = {}
        for s, x in samples.items():
            wide = int(width[s][rows[0]])
            if wide < 0:
                series[s] = None
                continue
            i = {c: v[rows] for c, v in info[s].items()}
            head, tail = (e.values(rows, wide) for e in edges[s])
            series[s] = Series(i["t0"], meta[s].dt, x.values(rows, wide), i["n"].astype(np.int64), i["base"], head, tail, own=x.n[rows])
        yield Block(shot.take(pa.array(rows)), series, start[rows], first_cut[rows], lo[rows], hi[rows])


def _spread(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Values at their rows, zero elsewhere."""
    out = np.zeros(n, values.dtype)
    out[row] = values
    return out


class _Vectors:
    """A vector or none for some of n rows; size -1 for none."""

    def __init__(self, vectors: pa.ListArray, row: np.ndarray, n: int):
        at = _offsets(vectors)
        there = ~np.asarray(vectors.is_null())
        self.size, self.first = _spread(np.where(there, np.diff(at), -1) + 1, row, n) - 1, _spread(at[:-1] - at[0], row, n)
        self.flat = vectors.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(float)

    def values(self, rows: np.ndarray, width: int) -> np.ndarray:
        out, there = np.full((len(rows), width), np.nan), self.size[rows] >= 0
        if (self.size[rows][there] != width).any():
            raise ValueError("samples of a signal differ in channels")
        out[there] = self.flat[self.first[rows[there]][:, None] + np.arange(width)]
        return out


def _leading(k: np.ndarray, first: int) -> np.ndarray:
    """Which entries are among the first of their row; the entries of a row lie together."""
    at = np.arange(len(k))
    return at - np.maximum.accumulate(np.where(np.r_[True, np.diff(k) != 0][: len(k)], at, 0)) < first


def run(rows: DataFrame, meta: dict[str, Meta], task: dict, filled: bool | None, emit: Callable[[Block, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, first: int | None = None) -> DataFrame:
    """``emit`` (block, windows, their rows in the block) on the fit windows of packed rows, many rows at once; ``first``: on so many
    of each row only, those with the least numbers."""
    wanted, every_output = kernel.names(task, "input", "actuator", "output"), filled is not None
    cut = "block" in rows.columns

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, wanted):
                for block in _blocks(part, wanted, meta, task) if cut else _shots(part, wanted, meta, task, every_output):
                    for k, w in block.windows():
                        fine = kernel.is_fit(block, w, task, filled, k)
                        k, w = k[fine], w[fine]
                        if first is not None:
                            k, w = (x[_leading(k, first)] for x in (k, w))
                        if len(w):
                            yield from emit(block, w, k)

    return rows.mapInArrow(over, schema)


SCORES = "shot_id long, window_index int, feature_name string, square double, size double, n double, of double"
CHOSEN = "shot_id long, window_index int, t_cut double"
RANGES = "shot_id long, window_index int, t_cut double, role string, signal string, lo int, hi int"
WINDOWS = "shot_id long, window_index int, t_cut double, role string, signal string, lo int, values array<array<double>>, time array<double>"


def scores(rows: DataFrame, meta: dict[str, Meta], task: dict, filled: bool | None, told: list[str], vector: kernel.Vector) -> DataFrame:
    return run(rows, meta, task, filled, lambda block, w, k: kernel.score(block, w, task, meta, told, vector, k), SCORES)


def windows(rows: DataFrame, meta: dict[str, Meta], task: dict, filled: bool | None, first: int | None = None) -> DataFrame:
    return run(rows, meta, task, filled, lambda block, w, k: kernel.written(block, w, task, meta, k), WINDOWS, first)
