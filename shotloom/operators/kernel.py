"""What a task does with packed rows: shots, or blocks of their time.

The work is columnar: all windows of many rows at once, in numpy, so that short shots cost no Python each.  A series keeps running counts of the samples that are there,
so a window is screened by two look-ups, and running sums of its values and of their squares by channel.  The sum of absolute
errors of a steady forecast p over a range is p (less - more) - sum of less + sum of more; counts and sums of what is less
come from a wavelet matrix (one level per bit of the values' ranks, running counts and sums at each), so that no part of the
cost of a window depends on its length.  Only rows of few samples add up the values of each window, which is quicker there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

AT_ONCE = 1_000_000  # (window, channel) pairs that are scored together
WINDOWS_AT_ONCE = 50_000  # windows of rows that are handled together, about; a row's windows stay together
VALUES_AT_ONCE = 2_000_000  # values of a batch of written windows, or added up together, about
SHORT, REPEATS = 2048, 64  # samples of a row, and how often its windows repeat them, up to which their values are added up


class Moments:
    """Range sums over the rows of a matrix (time x channels, NaN where missing): of values, squares and absolute distances."""

    def __init__(self, x: np.ndarray):
        self.rows, self.width = x.shape
        flat = np.ascontiguousarray(x.T).ravel()
        there = ~np.isnan(flat)
        self.at = np.r_[0, np.cumsum(there)]  # place of a (channel, row) among the values that are there
        self.off = self.at[:: self.rows] if self.rows else np.zeros(self.width + 1, np.int64)
        self.size = np.diff(self.off)
        self.of = np.repeat(np.arange(self.width), self.size)
        v = flat[there]
        self.centre = np.bincount(self.of, v, self.width) / np.maximum(self.size, 1)
        self.v = v - self.centre[self.of]
        wide = self.v.astype(np.longdouble)
        self.sums, self.squares = (np.r_[np.longdouble(0), np.cumsum(w)] for w in (wide, wide * wide))

    @cached_property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each bit of the ranks, from the highest: running counts and sums of the values whose bit is 0; below it the values
        lie by that bit inside their channel."""
        order = np.lexsort((self.v, self.of))
        self.ordered = self.v[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - self.off[self.of]
        v, out = self.v, []
        start = self.off[self.of]
        for bit in range(int(self.size.max(initial=0) - 1).bit_length() - 1, -1, -1):
            one = rank >> bit & 1
            zeros, sums = np.r_[0, np.cumsum(1 - one)], np.r_[0.0, np.cumsum(np.where(one, 0.0, v))]
            out.append((zeros, sums))
            seen = zeros[:-1] - zeros[start]
            to = start + np.where(one, (zeros[self.off[1:]] - zeros[self.off[:-1]])[self.of] + np.arange(len(v)) - start - seen, seen)
            rank, v = _scatter(rank, to), _scatter(v, to)
        return out

    def _less(self, c: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the values of channels c at places [a, b) whose rank is below t."""
        count, total, bits = np.zeros(len(a), np.int64), np.zeros(len(a)), len(self.levels)
        every = t >= 1 << bits
        count[every], total[every] = (b - a)[every], (self.sums[b] - self.sums[a]).astype(float)[every]
        start = self.off[c]
        for k, (zeros, sums) in enumerate(self.levels):
            one = (t >> bits - 1 - k & 1).astype(bool) & ~every
            za, zb, zs = zeros[a], zeros[b], zeros[start]
            count += np.where(one, zb - za, 0)
            total += np.where(one, sums[b] - sums[a], 0.0)
            first = (zeros[self.off[1:]] - zeros[self.off[:-1]])[c] + start
            a, b = np.where(one, first + a - start - za + zs, start + za - zs), np.where(one, first + b - start - zb + zs, start + zb - zs)
        return count, total

    def errors(self, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of (x - p)^2 and |x - p| over rows [a, b), and the number of values, of each window and channel; p: windows x
        channels, NaN for no forecast."""
        n, c = len(a), np.tile(np.arange(self.width), len(a))
        a, b = (self.at[c * self.rows + np.repeat(x, self.width)] for x in (a, np.maximum(a, b)))
        p = p.ravel() - self.centre[c]
        told = ~np.isnan(p)
        p = np.where(told, p, 0.0)
        count = np.where(told, b - a, 0)
        s1, s2 = self.sums[b] - self.sums[a], self.squares[b] - self.squares[a]
        self.levels  # noqa: B018  makes the ordered values
        t = np.empty(len(c), np.int64)
        for k in range(self.width):
            t[k :: self.width] = np.searchsorted(self.ordered[self.off[k] : self.off[k + 1]], p[k :: self.width])
        less, low = self._less(c, a, b, t)
        size = np.maximum(p * less - low + (s1.astype(float) - low) - p * (b - a - less), 0.0)
        square = (s2 - 2 * p * s1 + (b - a) * p.astype(np.longdouble) ** 2).astype(float)
        square = np.clip(square, size * size / np.maximum(b - a, 1), size * size)  # as far as rounding goes: between the bounds that sums of errors set
        return tuple(np.where(told, x, 0.0).reshape(n, self.width) for x in (square, size)) + (count.reshape(n, self.width),)


def _scatter(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[to] = x
    return out


class Series:
    """Samples of a signal in some rows (shots, or blocks of them), one row after the other: of each row samples [base, base + own)
    of a series of n samples that starts at t0, and its edge samples, which stand for all indices outside it.  ``k`` tells the rows
    of windows; scalars make one row."""

    def __init__(self, t0: float | np.ndarray, dt: float, values: np.ndarray, n: int | np.ndarray | None = None, base: int | np.ndarray = 0, head: np.ndarray | None = None, tail: np.ndarray | None = None, own: np.ndarray | None = None):
        self.t0, self.dt, self.width = np.atleast_1d(t0), dt, values.shape[1]
        self.own = np.array([len(values)]) if own is None else own
        self.base = np.broadcast_to(base, self.own.shape)
        self.n = self.own if n is None else np.atleast_1d(n)
        self.whole = n is None
        if self.whole:
            self.before, self.off, self.rows = np.zeros(len(self.own), bool), np.r_[0, np.cumsum(self.own)], values
            self.head, self.tail = values[self.off[:-1]], values[self.off[1:] - 1]
        else:
            self.head, self.tail = (np.broadcast_to(x, (len(self.own), self.width)) for x in (head, tail))
            self.before, after = self.base > 0, self.base + self.own < self.n
            self.off = np.r_[0, np.cumsum(self.before + self.own + after)]
            self.rows = np.empty((self.off[-1], self.width))
            self.rows[np.repeat(self.off[:-1] + self.before - np.cumsum(self.own) + self.own, self.own) + np.arange(len(values))] = values
            self.rows[self.off[:-1][self.before]], self.rows[self.off[1:][after] - 1] = self.head[self.before], self.tail[after]
        there = ~np.isnan(self.rows)
        self.seen, self.full = (np.r_[0, np.cumsum(x)] for x in (there.any(axis=1), there.all(axis=1) & (self.width > 0)))
        self.there = there
        self._moments: dict[int, Moments] = {}

    def moments(self, row: int) -> Moments:
        if row not in self._moments:
            self._moments[row] = Moments(self.rows[self.off[row] : self.off[row + 1]])
        return self._moments[row]

    @cached_property
    def newest(self) -> np.ndarray:
        """For each sample and channel, the last sample up to it that has a value (of a row before, if its own has none); -1 for none."""
        return np.maximum.accumulate(np.where(self.there, np.arange(len(self.rows))[:, None], -1), axis=0)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the times of the first and the last sample with a channel that is there; NaN without any."""
        at = np.r_[np.flatnonzero(np.diff(self.seen)), 0]
        upto = self.seen[self.off]
        none = upto[1:] == upto[:-1]
        return tuple(np.where(none, np.nan, self.t0 + (at[x] - self.off[:-1]) * self.dt) for x in (upto[:-1], upto[1:] - 1))

    def index(self, t: np.ndarray, k: np.ndarray | int = 0) -> np.ndarray:
        return np.rint((t - self.t0[k]) / self.dt).astype(np.int64)

    def _held(self, fine: np.ndarray) -> None:
        if not fine.all():
            raise ValueError("a window needs samples beyond its block: times depart from dt by more than a bucket")

    def place(self, i: np.ndarray, k: np.ndarray | int = 0) -> np.ndarray:
        """Places of sample indices; those outside the series take its edges."""
        i = np.clip(i, 0, self.n[k] - 1)
        if self.whole:
            return i + self.off[k]
        base = self.base[k]
        inside = (i >= base) & (i < base + self.own[k])
        self._held(inside | (i == 0) | (i == self.n[k] - 1))
        return np.where(inside, self.off[k] + i - base + self.before[k], np.where(i == 0, self.off[k], self.off[1:][k] - 1))

    def span(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places [a, b) of the slices [lo, hi) without what repeats."""
        a, b = np.clip(lo, 0, self.n[k] - 1), np.clip(hi - 1, 0, self.n[k] - 1) + 1
        self._held((b - a <= 1) | ((a >= self.base[k]) & (b <= self.base[k] + self.own[k])))
        return self.place(a, k), self.place(b - 1, k) + 1

    def _sums(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """Sums of (x - p)^2 and |x - p| over places [a, b) and the number of values, by channel.  In rows of few samples whose
        windows repeat each of them a bounded number of times the values themselves are added up, all rows at once; other rows
        have their running sums."""
        out = [np.zeros((len(a), self.width)) for _ in range(3)]
        length = np.diff(self.off)
        plain = ((length <= SHORT) & (np.bincount(k, b - a, len(length)) <= REPEATS * length))[k]
        some = np.flatnonzero(plain & (b > a))
        upto = np.cumsum((b - a)[some] * max(1, self.width))
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + VALUES_AT_ONCE, "right")))
            w = some[at:to]
            n = (b - a)[w]
            first = np.cumsum(n) - n
            error = np.ascontiguousarray((self.rows[np.repeat(a[w] - first, n) + np.arange(n.sum())] - np.repeat(p[w], n, axis=0)).T)
            there = ~np.isnan(error)
            error[~there] = 0.0
            for x, y in zip(out, (error * error, np.abs(error), there.astype(float)), strict=True):
                x[w] = np.add.reduceat(y, first, axis=1).T
            at = to
        step = max(1, AT_ONCE // max(1, self.width))
        for row in np.unique(k[~plain]).tolist():
            mine = np.flatnonzero(k == row)
            for w in (mine[j : j + step] for j in range(0, len(mine), step)):
                for x, y in zip(out, self.moments(row).errors(a[w] - self.off[row], b[w] - self.off[row], p[w]), strict=True):
                    x[w] = y
        return out

    def errors(self, first: np.ndarray, end: np.ndarray, p: np.ndarray, k: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of squared and absolute errors of steady forecasts p over [first, end), number of values there and of all."""
        if p.shape[1] != self.width:
            raise ValueError("target and forecast differ in channels")
        k = np.broadcast_to(k, first.shape)
        n, base = self.n[k], self.base[k]
        end = np.maximum(first, end)
        lo, hi = np.clip(first, 0, n), np.clip(end, 0, n)
        some = hi > lo
        a, b = self.place(lo, k), self.place(np.maximum(hi - 1, lo), k) + 1
        self._held(~some | ((lo >= base) & (hi <= base + self.own[k])) | (hi - lo == 1))
        square, size, count = self._sums(a, np.where(some, b, a), p, k)
        for times, edge in ((np.maximum(0, np.minimum(end, 0) - first), self.head), (np.maximum(0, end - np.maximum(first, n)), self.tail)):
            if not times.any():
                continue
            d = np.abs(edge[k] - p) * (times > 0)[:, None]
            told = ~np.isnan(d) & (times > 0)[:, None]
            d = np.where(told, d, 0.0)
            square, size, count = square + times[:, None] * d * d, size + times[:, None] * d, count + times[:, None] * told
        return square.sum(axis=1), size.sum(axis=1), count.sum(axis=1).astype(float), (end - first) * float(self.width)


@dataclass(frozen=True)
class Meta:
    """What is known of a signal without its samples."""

    dt: float
    width: int
    mean: float


@dataclass
class Block:
    """Series of some rows (None if these rows lack one), and of each row its shot and its windows from ``lo`` to before ``hi``;
    scalars make one row."""

    shot_id: pa.Array | int
    series: dict[str, Series | None]
    start: np.ndarray | float
    first_cut: np.ndarray | float
    lo: np.ndarray | int
    hi: np.ndarray | int

    def __post_init__(self) -> None:
        if not isinstance(self.shot_id, pa.Array):
            self.shot_id = pa.array([self.shot_id], pa.int64())
        self.start, self.first_cut, self.lo, self.hi = map(np.atleast_1d, (self.start, self.first_cut, self.lo, self.hi))

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, windows): all windows, whole rows of them together, about so many at once."""
        n = np.maximum(self.hi - self.lo, 0)
        upto = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WINDOWS_AT_ONCE, "right")))
            k = np.repeat(np.arange(at, to), n[at:to])
            if len(k):
                yield k, np.arange(len(k)) - np.repeat(upto[at:to] - n[at:to] - (upto[at - 1] if at else 0) - self.lo[at:to], n[at:to])
            at = to

    def shots(self, k: np.ndarray) -> pa.Array:
        return self.shot_id.take(pa.array(k))


def counted(length: float, dt: float) -> int:
    return int(np.rint(length / dt))


def names(task: dict, *roles: str) -> list[str]:
    return list(dict.fromkeys(s for r, s in task["roles"] if r in roles))


def whole(shot_id: pa.Array, series: dict[str, Series | None], task: dict, every_output: bool) -> Block | None:
    """Shots that are not cut into blocks; None if their range is missing.  A shot without valid samples has no windows."""
    told = names(task, "output")
    if every_output and any(series[s] is None for s in told):
        return None
    ends = lambda some: [series[s].ends() for s in some if series[s] is not None]
    read, out = ends(names(task, "input", "actuator")), ends(told)
    if not read or not out:
        return None
    start, stop = np.fmin.reduce([a for a, _ in read]), np.fmax.reduce([b for _, b in out])
    first = start + float(task["input_length"])
    end = stop - float(task["delta"]) - float(task["output_length"])
    n = np.maximum(0, np.ceil(np.nan_to_num((end - first) / float(task["stride"])))).astype(np.int64)
    return Block(shot_id, series, start, first, np.zeros(len(n), np.int64), n)


def cut_times(block: Block, w: np.ndarray, task: dict, k: np.ndarray | int = 0) -> np.ndarray:
    return block.first_cut[k] + w * float(task["stride"])


def bounds(role: str, t: np.ndarray, s: Series, block: Block, task: dict, k: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First index and end of a role's slices; a non-markovian task reads from the start of the shot on."""
    n_in, n_delta, n_out = (counted(float(task[x]), s.dt) for x in ("input_length", "delta", "output_length"))
    cut = s.index(t, k)
    if role == "output":
        out = s.index(t + float(task["delta"]), k)
        return out, out + n_out
    lo = np.broadcast_to(s.index(block.start[k], k), cut.shape) if task["task_type"] == "non_markovian" else cut - n_in
    return lo, cut + n_delta + n_out if role == "actuator" else cut


def fit(block: Block, task: dict, filled: bool | None) -> np.ndarray:
    """Windows of all rows of a block that are fit for use."""
    return np.concatenate([np.zeros(0, np.int64), *(w[is_fit(block, w, task, filled, k)] for k, w in block.windows())])


def is_fit(block: Block, w: np.ndarray, task: dict, filled: bool | None, k: np.ndarray | int = 0) -> np.ndarray:
    """Whether windows w of rows k are fit for use.

    Sparse (False): some input or actuator signal has data, and so has every output.  Filled (True): the same with no missing
    value at all in the signals that count.  None: all windows.  A role without signals, and a signal that the shot lacks, count
    as missing."""
    if filled is None:
        return np.ones(len(w), bool)
    t = cut_times(block, w, task, k)

    def unfit(role: str, signal: str) -> np.ndarray:
        s = block.series[signal]
        if s is None:
            return np.ones(len(w), bool)
        lo, hi = bounds(role, t, s, block, task, k)
        a, b = s.span(lo, np.maximum(hi, lo + 1), k)
        return (hi > lo) & (s.full[b] - s.full[a] < b - a) if filled else (hi <= lo) | (s.seen[b] - s.seen[a] == 0)

    read = [unfit(r, s) for r, s in task["roles"] if r != "output"]
    told = [unfit(r, s) for r, s in task["roles"] if r == "output"]
    return ~np.logical_and.reduce([np.ones(len(w), bool), *read]) & ~np.logical_or.reduce([np.zeros(len(w), bool), *told])


#: A steady forecast: (series, first and end rows of the input slices, mean) to windows x channels.
Vector = Callable[[Series, np.ndarray, np.ndarray, float], np.ndarray]


def last_present(s: Series, a: np.ndarray, b: np.ndarray, mean: float) -> np.ndarray:
    """Per channel, the last value of rows [a, b) that is there, or else the signal's mean."""
    at = np.where((b > a)[:, None], s.newest[np.maximum(b - 1, 0)], -1)
    return np.where(at >= a[:, None], np.take_along_axis(s.rows, np.maximum(at, 0), axis=0), mean)


def mean_vector(s: Series, a: np.ndarray, b: np.ndarray, mean: float) -> np.ndarray:
    return np.full((len(a), s.width), mean)


def score(block: Block, w: np.ndarray, task: dict, meta: dict[str, Meta], told: list[str], vector: Vector, k: np.ndarray | int = 0) -> Iterator[pa.RecordBatch]:
    """(shot_id, window_index, feature_name, square, size, n, of) of a steady forecast."""
    k = np.broadcast_to(k, w.shape)
    t, shots = cut_times(block, w, task, k), block.shots(k)
    for signal in told:
        s, m = block.series[signal], meta[signal]
        if s is None:
            zero = np.zeros(len(w))
            sums = (zero, zero, zero, np.full(len(w), float(max(0, counted(float(task["output_length"]), m.dt)) * m.width)))
        else:
            lo, hi = bounds("input", t, s, block, task, k)
            a, b = s.span(lo, np.maximum(hi, lo + 1), k) if vector is not mean_vector else (np.zeros(len(w), np.int64),) * 2
            sums = s.errors(*bounds("output", t, s, block, task, k), vector(s, a, np.where(hi > lo, b, a), m.mean), k)
        yield pa.record_batch([shots, pa.array(w.astype(np.int32)), pa.repeat(signal, len(w)), *(pa.array(x) for x in sums)], names=["shot_id", "window_index", "feature_name", "square", "size", "n", "of"])


def chosen(block: Block, w: np.ndarray, task: dict, k: np.ndarray | int = 0) -> Iterator[pa.RecordBatch]:
    """(shot_id, window_index, t_cut)"""
    k = np.broadcast_to(k, w.shape)
    yield pa.record_batch([block.shots(k), pa.array(w.astype(np.int32)), pa.array(cut_times(block, w, task, k))], names=["shot_id", "window_index", "t_cut"])


def ranges(block: Block, w: np.ndarray, task: dict, k: np.ndarray | int = 0) -> Iterator[pa.RecordBatch]:
    """(shot_id, window_index, t_cut, role, signal, lo, hi): windows as index ranges; a signal that the shot lacks has none."""
    k = np.broadcast_to(k, w.shape)
    t, shots = cut_times(block, w, task, k), block.shots(k)
    for role, signal in task["roles"]:
        s = block.series[signal]
        lo, hi = (pa.array(x, pa.int32()) for x in bounds(role, t, s, block, task, k)) if s is not None else (pa.nulls(len(w), pa.int32()),) * 2
        yield pa.record_batch([shots, pa.array(w.astype(np.int32)), pa.array(t), pa.repeat(role, len(w)), pa.repeat(signal, len(w)), lo, hi], names=["shot_id", "window_index", "t_cut", "role", "signal", "lo", "hi"])


def _lists(flat: np.ndarray, lengths: np.ndarray, width: int | None = None) -> pa.Array:
    """Lists of so many entries each, or of so many vectors of a width; NaN becomes null.  One buffer holds all values."""
    data = pa.array(flat, mask=np.isnan(flat))
    if width is not None:
        data = pa.ListArray.from_arrays(pa.array(np.arange(lengths.sum() + 1) * width, pa.int32()), data)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), data)


def written(block: Block, w: np.ndarray, task: dict, meta: dict[str, Meta], k: np.ndarray | int = 0) -> Iterator[pa.RecordBatch]:
    """(shot_id, window_index, t_cut, role, signal, lo, values, time) of each role's slice of each signal: offsets into one
    buffer of values a batch, which holds each slice once.  A signal that the shot lacks gives missing vectors of nominal length."""
    k = np.broadcast_to(k, w.shape)
    t, shots = cut_times(block, w, task, k), block.shots(k)
    for role, signal in task["roles"]:
        s, m = block.series[signal], meta[signal]
        if s is not None:
            lo, hi = bounds(role, t, s, block, task, k)
            length, width = np.maximum(hi - lo, 0), s.width
        else:
            n_in, n_delta, n_out = (counted(float(task[x]), m.dt) for x in ("input_length", "delta", "output_length"))
            lo, width = np.zeros(len(w), np.int64), m.width
            length = np.full(len(w), max(0, {"output": n_out, "actuator": n_in + n_delta + n_out}.get(role, n_in)))
        upto = np.cumsum(length * max(1, width))
        at = 0
        while at < len(w):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + VALUES_AT_ONCE, "right")))
            n, total = length[at:to], int(length[at:to].sum())
            if s is None:
                values, time = np.full(total * width, np.nan), _lists(np.zeros(0), np.zeros(len(n), np.int64))
            else:
                row = np.repeat(k[at:to], n)
                i = np.repeat(lo[at:to] - np.cumsum(n) + n, n) + np.arange(total)
                values, time = s.rows[s.place(i, row)].ravel(), _lists(s.t0[row] + np.clip(i, 0, s.n[row] - 1) * s.dt, n)
            first = pa.array(lo[at:to], pa.int32()) if s is not None else pa.nulls(len(n), pa.int32())
            yield pa.record_batch(
                [shots.slice(at, to - at), pa.array(w[at:to].astype(np.int32)), pa.array(t[at:to]), pa.repeat(role, len(n)), pa.repeat(signal, len(n)), first, _lists(values, n, width), time],
                names=["shot_id", "window_index", "t_cut", "role", "signal", "lo", "values", "time"],
            )
            at = to
