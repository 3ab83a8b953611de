"""Baselines over many tasks: all task definitions, skipped, empty and failing ones."""

import numpy as np
from pyspark.sql import functions as F

from shotloom.functions import values
from shotloom.plans import evaluation, runs, tasks

META = "signal string, dt double, values_shape array<int>, mean double, std double"
SAMPLES = "shot_id long, signal string, t_idx int, time double, values array<double>"


def steady_shot(spark, signals, n, dt, missing=()):
    """Two shots whose signals stay at one value each; the second lacks some signals."""
    rows = [(shot, s, i, i * dt, [float(k)]) for shot in (1, 2) for k, s in enumerate(signals) if shot == 1 or s not in missing for i in range(n)]
    meta = spark.createDataFrame([(s, dt, [1], -1.0, 1.0) for s in signals], META)
    return spark.createDataFrame(rows, SAMPLES), meta


def test_all_tasks(spark, tmp_path):
    every = {name: tasks.task_parameters(name) for name in tasks.ROLES}
    signals = sorted({s for t in every.values() for _, s in t["roles"]})
    data, meta = steady_shot(spark, signals, 60, 0.005, missing=["summary-ip"])
    status = {r.task: r for r in runs.run_tasks(data, meta, every, runs.persistence, str(tmp_path)).collect()}
    assert set(status) == set(every)
    done = {t for t, r in status.items() if r.status == "done"}
    assert done == {"2-1", "3-1", "3-2", "4-1", "4-2", "4-4", "4-5"}
    assert all(r.status == "skipped" and r.n_windows == 0 and r.reason for t, r in status.items() if t not in done)
    assert {t: status[t].n_shots for t in done} == {t: 1 if t in ("2-1", "4-4") else 2 for t in done}  # outputs that a shot lacks
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"task={t}" for t in done)
    rows = runs.run_metrics(spark, str(tmp_path), sorted(done))
    assert rows.where("RMSE <> 0 or MAE <> 0 or nan_fraction <> 0 or RMSE is null").count() == 0
    assert {r.task: r.n for r in rows.groupBy("task").agg(F.count_distinct("feature_name").alias("n")).collect()} == {"2-1": 3, "3-1": 2, "3-2": 3, "4-1": 2, "4-2": 2, "4-4": 1, "4-5": 2}


TASK = {"task_type": "markovian", "input_length": 2.0, "output_length": 1.0, "delta": 0.0, "stride": 1.0, "roles": [("input", "x"), ("output", "x"), ("output", "y")]}


def test_a_failing_task_leaves_the_others(spark, tmp_path):
    data, meta = steady_shot(spark, ["x", "y", "z"], 8, 1.0)
    wide = evaluation.Steady(lambda s, a, b, mean: np.full((len(a), 1 if s.n == 8 else 2), mean), False)
    longer = spark.createDataFrame([(1, "z", 8, 8.0, [0.0])], SAMPLES)
    work = {"a": TASK, "b": TASK | {"roles": [("input", "z"), ("output", "z")]}, "c": TASK | {"output_length": 50.0}}
    got = {r.task: r for r in runs.run_tasks(data.unionAll(longer), meta, work, runs.Baseline(wide, lambda t: t), str(tmp_path)).collect()}
    assert {t: r.status for t, r in got.items()} == {"a": "done", "b": "failed", "c": "empty"}
    # cuts at 2, 3, 4 and 5 of each shot: the last output ends before the last sample
    assert got["a"].n_windows == 8 and got["a"].n_shots == 2 and got["b"].n_windows == 0 and "differ in channels" in got["b"].reason
    assert runs.run_metrics(spark, str(tmp_path), ["a"]).count() == 16


def test_nothing_to_run(spark, tmp_path):
    data, meta = steady_shot(spark, ["x"], 3, 1.0)
    skipped = {"a": TASK | {"roles": [("input", "x"), ("output", "y")]}}
    assert [(r.status, r.n_shots) for r in runs.run_tasks(data, meta, skipped, runs.persistence, str(tmp_path)).collect()] == [("skipped", 0)]
    assert runs.run_tasks(data, meta, {}, runs.persistence, str(tmp_path)).count() == 0
    empty = runs.run_tasks(data.limit(0), meta, {"a": TASK}, runs.averages("x"), str(tmp_path))
    assert [r.status for r in empty.collect()] == ["empty"]


def test_transpose(spark):
    turned = lambda v: spark.sql(f"select {v} as v").select(values.transpose(F.col("v"))).first()[0]
    assert turned("array(array(1.0D, null), array(2.0D, 3.0D), array(4.0D, 5.0D))") == [[1.0, 2.0, 4.0], [None, 3.0, 5.0]]
    assert turned("cast(array() as array<array<double>>)") == []
