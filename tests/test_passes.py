"""Operators that take several passes or keep a bounded buffer, against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import batching, spectra, stats
from shotloom.plans import transforms


def cells(spark, groups):
    rows = [(shot, v, None if x is None else float(x)) for (shot, v), xs in groups.items() for x in xs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "shot_id long, variable string, value double").repartition(3)


def groups_of_all_kinds():
    r = random.Random(3)
    return {
        (1, "normal"): [r.gauss(0, 1) for _ in range(1001)], (1, "even"): [r.gauss(5, 1) for _ in range(400)], (2, "ties"): [r.choice([1, 2, 2, 3]) for _ in range(500)], (2, "same"): [7] * 300,
        (3, "wide"): [r.choice([-1, 1]) * 10 ** r.uniform(-300, 308) for _ in range(501)], (3, "one"): [4], (4, "two"): [1, 2], (4, "far"): [0] * 100 + [1e300], (5, "gaps"): [None, 3, None, 1, 2, 9],
        (6, "none"): [None, None], (7, "ends"): [-1.7e308, 1.7e308, 1.7e308],
    }


@pytest.mark.parametrize("buckets,few", [(16, 20), (1024, 10_000)])
def test_medians_by_selection(spark, buckets, few):
    every = {k: v for k, v in groups_of_all_kinds().items() if few > 20 or k[1] != "wide"}
    data = cells(spark, every)
    sizes = data.groupBy("shot_id", "variable").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    got = {(r.shot_id, r.variable): r.median for r in stats.selected_medians(data, sizes, buckets, few).collect()}
    want = {k: statistics.median(x for x in v if x is not None) for k, v in every.items() if any(x is not None for x in v)}
    assert got == pytest.approx(want)


def test_large_groups_are_selected(spark):
    every = groups_of_all_kinds()
    data = cells(spark, every)
    plain, chosen = (sorted(stats.shot_stats(data, held=h).collect()) for h in (10**6, 50))
    assert len(plain) == len(every)
    for a, b in zip(plain, chosen, strict=True):
        assert a[:-1] == pytest.approx(b[:-1], nan_ok=True) if None not in a else a == b
        assert b.median == (pytest.approx(a.median) if a.median is not None else None)
    plan = stats.shot_stats(data, held=50)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan
    assert stats.shot_stats(data.limit(0)).count() == 0


def wave_rows(spark, lengths, support):
    r = np.random.default_rng(2)
    waves = {(shot, s): [[None if r.random() < 0.002 else float(x) for x in r.standard_normal(c)] for _ in range(n)] for (shot, s, c), n in lengths.items()}
    rows = [(shot, s, i, 0.5 * i, v) for (shot, s), vs in waves.items() for i, v in enumerate(vs)]
    return waves, spark.createDataFrame(rows, "shot_id long, signal string, t_idx int, time double, values array<double>").repartition(4)


def test_spectra_of_samples(spark):
    support = 32
    waves, data = wave_rows(spark, {(1, "p", 2): 100, (1, "q", 1): 64, (2, "p", 2): 31, (3, "p", 3): 500}, support)
    got = {(r.shot_id, r.signal, r.t_idx): r for r in spectra.spectral_samples(data, support).collect()}
    assert {k[:2] for k in got} == {(1, "p"), (1, "q"), (3, "p")} and len(got) == 3 + 2 + 15
    for (shot, s, k), row in got.items():
        x = np.array(waves[shot, s], float)
        want = np.concatenate([spectra.power_frames(x[k * support : (k + 1) * support, c], support)[0] for c in range(x.shape[1])])
        assert row.time == 0.5 * ((k + 1) * support - 1)
        assert [v is None for v in row["values"]] == np.isnan(want).tolist()
        assert np.array([v for v in row["values"] if v is not None]) == pytest.approx(want[~np.isnan(want)])


def test_spectra_of_many_waves(spark, monkeypatch):
    monkeypatch.setattr(spectra, "AT_ONCE", 100)
    r = np.random.default_rng(5)
    waves = [(k, "w", 0, 1.0, 0.25, None if k == 3 else [float(x) for x in r.standard_normal(int(r.integers(0, 90)))]) for k in range(40)]
    df = spark.createDataFrame(waves, "shot_id long, signal string, channel int, t0 double, dt double, wave array<double>")
    got = {(x.shot_id, x.frame): (x.time, x.power) for x in spectra.stft(df, 16).collect()}
    want = {(w[0], k): (1.0 + (k * 16 + 15) * 0.25, p) for w in waves if w[5] for k, p in enumerate(spectra.power_frames(np.array(w[5]), 16))}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_every_family_is_prepared(spark):
    rows = [(1, s, i, float(i), v) for s, v in (("plain", [3.0]), ("x", [5.0]), ("f", [None, 4.0]), ("l", [1.0, None, 3.0]), ("p", [1.0])) for i in range(8)]
    data = spark.createDataFrame(rows, "shot_id long, signal string, t_idx int, time double, values array<double>")
    meta = spark.createDataFrame([(s, 1.0, 2.0) for s in "plain x f l p".split()[0:5]], "signal string, mean double, std double")
    out = transforms.prepared(data, meta, {"x_point": ["x"], "filled": ["f"], "lcfs": ["l"], "probe": ["p"]}, fill=True, support=4)
    first = {r.signal: r["values"] for r in out.where("t_idx = 1").collect()}
    assert first["plain"] == [1.0] and first["x"] == [None] and first["f"] == [0.0, 1.5] and len(first["l"]) == 170 and first["p"] == pytest.approx([(2.25 - 1) / 2, (1.125 - 1) / 2])
    assert out.where("signal = 'p'").count() == 2


def plain_buffer(keys, part, size, seed):
    """The order of one part's windows, one at a time."""
    buffer, out, step = [], [], 0
    for key in keys:
        if len(buffer) < size:
            buffer.append(key)
            continue
        j = int(batching.draws(seed, part, step, 1)[0]) % size
        out.append(buffer[j])
        buffer[j] = key
        step += 1
    keys = [int(batching.draws(seed, part, (1 << 40) + k, 1)[0]) for k in range(len(buffer))]
    return out + [buffer[k] for k in sorted(range(len(buffer)), key=lambda k: keys[k])]


@pytest.mark.parametrize("size,batch", [(5, 3), (16, 1000), (64, 7), (1000, 50)])
def test_shuffle_buffer(spark, size, batch):
    data = spark.range(40).select(F.col("id").alias("shot_id"), F.explode(F.sequence(F.lit(0), (F.col("id") % 9).cast("int"))).alias("window_index"), F.array("id").alias("payload")).repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = batching.shuffle_buffer(data, 3, size, seed=9).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(rows) == data.count() and all(r.payload == [r.shot_id] for r in rows)
    for part in {r.part for r in rows}:
        mine = [r for r in rows if r.part == part]
        got = [(r.shot_id, r.window_index) for r in sorted(mine, key=lambda r: r.position)]
        assert sorted(r.position for r in mine) == list(range(len(mine)))
        assert got == plain_buffer(sorted(got), part, size, 9)
        assert got != sorted(got)


def test_draws_are_even():
    x = batching.draws(1, 2, 0, 64_000) % np.uint64(64)
    counts = np.bincount(x.astype(int), minlength=64)
    assert 850 < counts.min() and counts.max() < 1150
    assert (batching.draws(1, 2, 100, 5) == batching.draws(1, 2, 0, 200)[100:105]).all() and (batching.draws(1, 3, 0, 9) != batching.draws(1, 2, 0, 9)).any()


def test_rank_by_range_partitions(spark):
    from shotloom.operators import splits

    rows = [(k % 7, k) for k in range(500)] + [(None, 1000 + k) for k in range(20)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "time int, shot_id long").repartition(3)
    got = {r.shot_id: r._rank for r in splits.range_rank(df, ["time", "shot_id"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {shot: k for k, (_, shot) in enumerate(want)}
    assert splits.range_rank(df.limit(0), ["time", "shot_id"]).count() == 0
    one = splits.split_temporal(spark.range(100).selectExpr("id AS shot_id", "timestamp'2024-01-01' AS time"))
    assert {r.shot_id: r.split for r in one.collect()} == {k: "train" if k < 80 else "val" if k < 90 else "test" for k in range(100)}
