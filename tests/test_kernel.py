"""Scoring and cutting inside packed rows: against plain sums, and shots in blocks against whole ones."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import blocks, kernel
from shotloom.plans import evaluation

META = "signal string, dt double, values_shape array<int>, mean double, std double"
SAMPLES = "shot_id long, signal string, t_idx int, time double, values array<double>"


@pytest.mark.parametrize("rows,channels", [(1, 1), (2, 3), (7, 1), (64, 2), (65, 3), (200, 4)])
@pytest.mark.parametrize("ties", [False, True])
def test_range_sums(rows, channels, ties):
    r = np.random.default_rng(rows)
    some = lambda n: (np.round if ties else np.asarray)(r.standard_normal((n, channels)) * 3 + 1000)
    x, p = some(rows), some(150)
    x[r.random(x.shape) < 0.3] = np.nan
    p[r.random(p.shape) < 0.1] = np.nan
    first = r.integers(-20, rows + 20, 150)
    end = first + r.integers(0, 40, 150)
    got = kernel.Series(0.0, 1.0, x).errors(first, end, p)
    for k in range(150):
        d = x[np.clip(np.arange(first[k], end[k]), 0, rows - 1)] - p[k]
        assert [g[k] for g in got] == pytest.approx([np.nansum(d * d), np.nansum(abs(d)), (~np.isnan(d)).sum(), d.size], abs=1e-9)


def test_equal_values_have_no_error():
    s = kernel.Series(0.0, 1.0, np.full((500, 2), 1234.5678))
    square, size, n, of = s.errors(np.arange(100), np.arange(100) + 50, np.full((100, 2), 1234.5678))
    assert not square.any() and not size.any() and (n == 100).all() and (of == 100).all()


def test_cost_of_a_window_does_not_grow_with_its_length():
    r = np.random.default_rng(0)
    s = kernel.Series(0.0, 1.0, r.standard_normal((20_000, 8)))
    first, p = np.arange(2000) * 9, np.zeros((2000, 8))
    s.errors(first[:1], first[:1] + 1, p[:1])

    def cpu(length):
        began = time.process_time()
        s.errors(first, first + length, p)
        return time.process_time() - began

    assert min(cpu(1000) for _ in range(5)) < 2 * min(cpu(50) for _ in range(5)) + 0.02


def shots(spark, seed=4):
    """Three shots of two signals, of one and two channels and unequal rates; the first is a hundred times as long; one signal
    ends early, one shot lacks it."""
    r = np.random.default_rng(seed)
    rows = []
    for shot, seconds in ((1, 400.0), (2, 4.0), (3, 4.0)):
        for signal, dt, channels, t0 in (("a", 0.1, 2, 0.0), ("b", 0.25, 1, 0.5)):
            if (shot, signal) == (3, "b"):
                continue
            n = int((seconds if signal == "a" else seconds * 0.8) / dt)
            for i in range(n):
                rows.append((shot, signal, i, t0 + i * dt + r.uniform(-0.2, 0.2) * dt * (i > 0), [None if r.random() < 0.3 else float(x) for x in r.standard_normal(channels)]))
    return spark.createDataFrame(rows, SAMPLES).repartition(4), spark.createDataFrame([("a", 0.1, [2], 0.5, 1.0), ("b", 0.25, [1], -0.5, 1.0)], META)


TASK = {"task_type": "markovian", "input_length": 1.0, "output_length": 0.5, "delta": 0.0, "stride": 0.1, "roles": [("input", "a"), ("input", "b"), ("actuator", "b"), ("output", "a"), ("output", "b")]}


@pytest.mark.parametrize("seconds", [0.5, 3.0, 50.0])
@pytest.mark.parametrize("task", [TASK, TASK | {"delta": -0.5}, TASK | {"delta": 1.5, "output_length": 2.0}])
def test_blocks_give_the_windows_of_whole_shots(spark, seconds, task):
    data, meta = shots(spark)
    if seconds == 3.0:
        whole, cut = (sorted(map(str, evaluation.make_windows(data, meta, task, None, block=b).where("shot_id > 1 or window_index % 50 < 3").collect())) for b in (None, seconds))
        assert whole == cut and len(whole) > 300
    whole, cut = (sorted(map(tuple, evaluation.window_ranges(data, meta, task, False, block=b).collect())) for b in (None, seconds))
    assert whole == cut and len(whole) > 1000
    whole, cut = ({(r.shot_id, r.window_index, r.feature_name): (r.RMSE, r.MAE, r.nan_fraction) for r in evaluation.evaluate(data, meta, "t", task, evaluation.persist, block=b).collect()} for b in (None, seconds))
    assert whole.keys() == cut.keys() and len(whole) > 1000
    for k, v in whole.items():
        assert cut[k] == pytest.approx(v, abs=1e-9, nan_ok=True) if None not in v else cut[k] == v


def test_a_long_shot_is_many_rows(spark):
    data, meta = shots(spark)
    known = blocks.known(meta, ["a", "b"])
    rows = blocks.blocked(data, known, TASK, 5.0).select("shot_id", "block", *(F.size(s).alias(s) for s in ("a", "b"))).collect()
    long = [r for r in rows if r.shot_id == 1]
    assert len(long) > 50 and max(r.a for r in rows) < 110
    assert sum(r.a for r in long) < 1.6 * 4000  # halos repeat a part of the samples only
    with pytest.raises(ValueError, match="growing"):
        blocks.blocked(data, known, TASK | {"task_type": "non_markovian"}, 5.0)
    with pytest.raises(Exception, match="without gaps"):
        evaluation.fit_windows(data.where("not (shot_id = 1 and t_idx = 77)"), meta, TASK, block=5.0).collect()


def test_times_far_from_their_number_are_an_error(spark):
    rows = [(1, "a", i, i * 0.1 if i < 50 else 40.0 + i * 0.1, [1.0, 2.0]) for i in range(100)]
    meta = spark.createDataFrame([("a", 0.1, [2], 0.5, 1.0)], META)
    with pytest.raises(Exception, match="beyond its block"):
        evaluation.fit_windows(spark.createDataFrame(rows, SAMPLES), meta, TASK | {"roles": [("input", "a"), ("output", "a")]}, block=2.0).collect()


def test_no_samples(spark):
    data, meta = shots(spark)
    for b in (None, 5.0):
        assert evaluation.make_windows(data.limit(0), meta, TASK, block=b).count() == 0
        assert evaluation.evaluate(data.where("signal = 'b'"), meta, "t", TASK, evaluation.mean, block=b).count() == 0  # an output is missing
    bare = data.withColumn("values", F.lit(None).cast("array<double>"))
    assert evaluation.make_windows(bare, meta, TASK).count() == 0
