"""The roll-up kept as state: equal to the batch report after every start, its state counted, values taken out without a trace."""

import math
import random
import time
from fractions import Fraction

import pytest

from shotloom.operators import metrics
from shotloom.streaming import rollup

NAN = float("nan")
SCHEMA = "task string, shot_id long, window_index int, feature_name string, RMSE double, MAE double, nan_fraction double, extra string"


def make(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        rmse = rng.choice([None, NAN, 0.1, 1e6 + rng.random(), rng.random()])
        yield rng.choice("ab"), rng.choice([1, 2, 3, 400, None]), i, rng.choice("xyz"), rmse, rng.random(), rng.choice([None, 0.25, rng.random()]), "e"


def same(spark, mark, rows, meta):
    columns = ["task", "feature_name", "n_shots", *(f"{m}_{s}" for m in metrics.METRICS for s in ("mean", "std_pop"))]
    key = lambda row: row[:2]
    got = sorted((tuple(r) for r in rollup.report(spark, mark).select(*columns).collect()), key=key)
    want = sorted((tuple(r) for r in metrics.task_report(metrics.shot_metrics(rows, meta)).select(*columns).collect()), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert [x is None for x in g] == [x is None for x in w]
        assert [x for x in g[2:] if x is not None] == pytest.approx([x for x in w[2:] if x is not None], rel=1e-9, abs=1e-9)


def test_restarted_stream_gives_the_batch_report(spark, tmp_path):
    meta = spark.createDataFrame([("x", 2.0), ("y", 0.0)], "signal string, std double")  # y: no deviation; z: not known
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for part in range(3):
        spark.createDataFrame(list(make(part, 60)), SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        rollup.start(rollup.rolled_up(stream, meta, buckets=3), mark).awaitTermination()
        same(spark, mark, spark.read.parquet(source), meta)
    rows = spark.read.parquet(source)
    shots = metrics.shot_metrics(rows, meta).select("task", "shot_id").distinct().count()
    assert rollup.state(spark, mark, "shots").count() == shots
    assert rollup.state(spark, mark, "totals").count() <= 2 * 3 * 4  # tasks, buckets, signals and the task itself
    groups = spark.createDataFrame([("a", 1), ("b", 1)], "task string, group_id int")
    assert {(r.level, r.task) for r in rollup.live_group_report(spark, mark, groups).collect()} == {(0, "group_1"), (1, "a"), (1, "b")}


def test_state_with_time_to_live(spark, tmp_path):
    meta = spark.createDataFrame([("x", 2.0)], "signal string, std double")
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    row = lambda k: spark.createDataFrame([("a", 1, k, "x", 1.0, 1.0, 0.0, "")], SCHEMA).coalesce(1)
    for k in range(2):
        row(k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        running = rollup.start(rollup.rolled_up(stream, meta, 2, ttl_ms=1), mark, "1 second")
        end = time.monotonic() + 60
        while time.monotonic() < end and not any(p.numInputRows for p in running.recentProgress):
            time.sleep(0.2)
        running.stop()
    assert [r.n_shots for r in rollup.report(spark, mark).where("own").collect()] == [2]  # the shot was gone when its second window came


def test_values_are_taken_out_without_a_trace():
    rng = random.Random(1)
    m = rollup._Moments()
    held = {}
    for _ in range(3000):
        shot = rng.randrange(20)
        row = [None, rng.choice([1e8, 1e-3]) * rng.random(), 0.1, 1e9 + rng.random(), rng.random()]
        m.change(held.get(shot), -1)
        m.change(row, 1)
        held[shot] = row
    counts, means, spreads = m.finished()
    assert m.n_shots == 20 and counts == [0, 20, 20, 20, 20] and means[0] == spreads[0] == 0
    for k in range(1, 5):
        x = [Fraction(r[k]) for r in held.values()]
        mean = sum(x) / 20
        assert means[k] == pytest.approx(float(mean), rel=1e-14)
        assert spreads[k] == pytest.approx(float(sum((v - mean) ** 2 for v in x)), rel=1e-9, abs=1e-20)
    assert spreads[2] <= 1e-30
    m.change([None, math.inf, 1.0, 1.0, 1.0], 1)
    assert math.isnan(m.finished()[1][1]) and m.finished()[0][1] == 21


def test_many_shots_share_an_entry_of_the_state(spark, tmp_path):
    meta = spark.createDataFrame([("x", 2.0)], "signal string, std double")
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for part in range(2):
        rows = [("a", shot, part, "x", float(shot), 1.0, 0.0, "") for shot in range(300)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        rollup.start(rollup.rolled_up(stream, meta, buckets=2, pieces=3), mark, parts=2).awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    raw = spark.read.format("statestore").option("stateVarName", "shots").load(mark)
    assert raw.count() <= 2 * 3 and set(r.partition_id for r in raw.select("partition_id").collect()) <= {0, 1}
    shots = rollup.state(spark, mark, "shots").collect()
    assert sorted(r.shot_id for r in shots) == list(range(300)) and all(r.features == ["x"] and r.sums[0][:2] == [2.0, 2.0 * r.shot_id**2] for r in shots)
    same(spark, mark, spark.read.parquet(source), meta)
