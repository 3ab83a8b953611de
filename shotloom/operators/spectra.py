"""Short-time power spectra of waveforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT_ONCE = 1_000_000  # samples that are transformed together, about


def power_frames(x: np.ndarray, support: int) -> np.ndarray:
    """(frames, support / 2): squared magnitude of the Fourier transform of each full frame under a Hann window that is
    zero at both ends; frames do not overlap, and a tail shorter than a frame is dropped."""
    n = len(x) // support
    if not n:
        return np.empty((0, support // 2))
    window = (1 - np.cos(np.linspace(0, 2 * np.pi, support))) / 2
    return np.abs(np.fft.fft(x[: n * support].reshape(n, support) * window, axis=1)[:, : support // 2]) ** 2


def _spectra(frames: np.ndarray, support: int) -> np.ndarray:
    return power_frames(frames.ravel(), support)


def _power_lists(power: np.ndarray) -> pa.Array:
    """A list per row; NaN becomes null."""
    flat = power.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(power) + 1) * power.shape[1], pa.int32()), pa.array(flat, mask=np.isnan(flat)))


def stft(waves: DataFrame, support: int = 512) -> DataFrame:
    """(shot_id, signal, channel, frame, time, power) of waves (shot_id, signal, channel, t0, dt, wave array<double>).

    A frame's time is that of its last sample.  A missing value makes its frame missing.  The frames of all waves of a batch
    are transformed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wave = b.column(5)
            begin, flat = wave.offsets.to_numpy(), wave.values.to_numpy(zero_copy_only=False).astype(float)
            n = np.where(np.asarray(wave.is_null()), 0, np.diff(begin)) // support
            row = np.repeat(np.arange(len(n)), n)
            frame = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            t0, dt = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            for k in range(0, len(row), step := max(1, AT_ONCE // support)):
                r, f = row[k : k + step], frame[k : k + step]
                x = flat[(begin[r] + f * support)[:, None] + np.arange(support)]
                ids = [b.column(c).take(pa.array(r)) for c in range(3)]
                yield pa.record_batch([*ids, pa.array(f, pa.int32()), pa.array(t0[r] + ((f + 1) * support - 1) * dt[r]), _power_lists(_spectra(x, support))], names=["shot_id", "signal", "channel", "frame", "time", "power"])

    slim = waves.select("shot_id", "signal", F.col("channel").cast("int").alias("channel"), "t0", "dt", "wave")
    return slim.mapInArrow(run, "shot_id long, signal string, channel int, frame int, time double, power array<double>")


def spectral_samples(samples: DataFrame, support: int = 512) -> DataFrame:
    """Samples of spectra from samples of waves: (shot_id, signal, t_idx, time, values), t_idx being the frame, time that of its
    last sample, values channels x bins, one channel after the other.

    Samples are numbered from 0 without gaps; each full frame is a group of its own, so a long wave is never a row or a task.
    A missing value makes its channel's frame missing."""
    one = F.struct("t_idx", "time", "values")
    frames = samples.groupBy("shot_id", "signal", F.floor(F.col("t_idx") / support).cast("int").alias("frame")).agg(F.array_sort(F.collect_list(one)).alias("rows")).where(F.size("rows") == support)
    wide = F.array_max(F.transform("rows", lambda r: F.size(r["values"])))
    gap = F.transform(F.sequence(F.lit(1), F.col("channels")), lambda i: F.lit(None).cast("double"))
    even = frames.withColumn("channels", wide).where("channels > 0").withColumn("x", F.flatten(F.transform("rows", lambda r: F.coalesce(r["values"], gap))))
    slim = even.select("shot_id", "signal", "frame", F.try_element_at("rows", F.lit(-1))["time"].alias("time"), "channels", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, flat = b.column(5).offsets.to_numpy(), b.column(5).values.to_numpy(zero_copy_only=False).astype(float)
            channels = b.column(4).to_numpy()
            if (np.diff(begin) != channels * support).any():
                raise ValueError("samples of a signal differ in channels")
            for c in np.unique(channels).tolist():
                rows = np.flatnonzero(channels == c)
                for k in range(0, len(rows), step := max(1, AT_ONCE // (support * c))):
                    r = rows[k : k + step]
                    x = flat[begin[r][:, None] + np.arange(support * c)].reshape(-1, support, c).transpose(0, 2, 1)
                    power = _spectra(np.ascontiguousarray(x), support).reshape(len(r), -1)
                    yield pa.record_batch([*(b.column(i).take(pa.array(r)) for i in range(4)), _power_lists(power)], names=["shot_id", "signal", "t_idx", "time", "values"])

    return slim.mapInArrow(run, "shot_id long, signal string, t_idx int, time double, values array<double>")
