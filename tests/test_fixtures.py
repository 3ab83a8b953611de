"""Small cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.functions import names, values
from shotloom.operators import baselines, batching, blocks, clean, kernel, metrics, pca, profiling, spectra, splits, stats, windows
from shotloom.plans import evaluation, hooks, tasks, transforms
from shotloom.sources import catalog, samples, tables
from shotloom.streaming import live

NAN = float("nan")


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def cells(spark):
    rows = [(1, "a", x) for x in (0.0, 0.0, 2.0, 2.0)] + [(2, "a", x) for x in (4.0, 4.0, None, None)]
    return spark.createDataFrame(rows, "shot_id long, variable string, value double")


def test_pooled_stats(spark):
    s = stats.shot_stats(cells(spark))
    pool = stats.pooled(s)
    row = pool.first()
    assert row.global_mean == pytest.approx(2) and row.global_variance == pytest.approx(16 / 6)
    z = {r.shot_id: r.z for r in stats.zscores(s, pool).collect()}
    assert z[1] == pytest.approx(-0.612372, abs=1e-6) and z[2] == pytest.approx(1.224745, abs=1e-6)
    assert stats.outlier_counts(stats.zscores(s, pool), 1.0).first() == (1, 1, 1)


def test_unknown_z_is_kept(spark):
    rows = cells(spark).union(spark.createDataFrame([(3, "a", None)], "shot_id long, variable string, value double"))
    s = stats.shot_stats(rows)
    third = [r for r in stats.zscores(s, stats.pooled(s)).collect() if r.shot_id == 3][0]
    assert third.mean is None and third.z is None
    df = spark.createDataFrame([(None,), (7.0,), (-7.0,), (6.0,)], "z double")
    assert [r[0] for r in df.select(clean.is_outlier(F.col("z"), 6)).collect()] == [False, True, True, False]
    two = stats.two_stage(s, 6.0).first()
    assert two.mean == pytest.approx(2) and two.std == pytest.approx(math.sqrt(16 / 6))


def test_exact_median(spark):
    df = spark.createDataFrame([(1, "a", x) for x in (1.0, 2.0, 3.0, 10.0)], "shot_id long, variable string, value double")
    assert stats.shot_stats(df).first()["median"] == 2.5


def test_value_functions(spark):
    v = "v array<double>"
    at = lambda col, row: one(spark, v, (row,), col)[0]
    assert at(values.clip_to_null(F.col("v")), [2.0, 2.1, -2.0, -3.0]) == [2.0, None, -2.0, None]
    assert at(values.zero_fill(F.col("v")), [1.0, None]) == [1.0, 0.0]
    assert at(values.zero_fill(F.col("v")), [None, None]) == [None, None]
    assert at(values.resample(F.col("v")), [0.0, None, 10.0]) == pytest.approx([i * 10 / 169 for i in range(170)])
    assert at(values.resample(F.col("v"), 3), [None, None]) == [None] * 3
    assert at(values.resample(F.col("v"), 3), [5.0]) == [5.0] * 3
    assert at(values.impute_mean(F.col("v")), [1.0, None, 3.0]) == [1.0, 2.0, 3.0]
    assert at(values.impute_mean(F.col("v")), [None]) == [None]
    assert at(values.vector_to_null(F.col("v")), [NAN, 1.0]) == [None, 1.0]
    assert at(values.standardise(F.col("v"), F.lit(1.0), F.lit(0.0)), [2.0]) == [None]
    assert at(baselines.forward_fill(F.col("v")), [None, 1.0, None, 3.0, None]) == [None, 1.0, 1.0, 3.0, 3.0]
    assert math.isnan(one(spark, "x double", (None,), values.to_nan(F.col("x")))[0])


def test_compose_stops_at_null(spark):
    step = values.compose(lambda x: F.when(x > 0, x), lambda x: F.coalesce(x, F.lit(9.0)))
    assert one(spark, "x double", (-1.0,), step(F.col("x")))[0] is None
    assert one(spark, "x double", (1.0,), step(F.col("x")))[0] == 1.0


def test_half_even_counts(spark):
    assert one(spark, "l double, d double", (5.0, 2.0), values.sample_count(F.col("l"), F.col("d")))[0] == 2
    assert one(spark, "l double, d double", (7.0, 2.0), values.sample_count(F.col("l"), F.col("d")))[0] == 4


def test_stft():
    assert spectra.power_frames(np.array([1.0] * 5), 4) == pytest.approx(np.array([[2.25, 1.125]]))
    assert spectra.power_frames(np.ones(3), 4).shape == (0, 2)


def test_stft_frames(spark):
    df = spark.createDataFrame([(1, "s", 0, 0.0, 1.0, [1.0] * 5), (2, "s", 0, 0.0, 1.0, [1.0] * 3), (3, "s", 0, 0.0, 1.0, None), (4, "s", 0, 0.0, 1.0, [None] * 4)], "shot_id long, signal string, channel int, t0 double, dt double, wave array<double>")
    rows = {r.shot_id: r for r in spectra.stft(df, 4).collect()}
    assert set(rows) == {1, 4}
    assert rows[1].time == 3.0 and rows[1].power == pytest.approx([2.25, 1.125]) and rows[4].power == [None, None]


TASK = {"task_type": "markovian", "input_length": 3.0, "output_length": 2.0, "delta": 0.0, "stride": 1.0, "roles": [("input", "x"), ("output", "y")]}


def series(spark):
    x = [None if i in (0, 3) else 10.0 + i for i in range(10)]
    y = [float(i) if i < 9 else None for i in range(10)]
    rows = [(1, s, i, float(i), [v]) for s, vs in (("x", x), ("y", y)) for i, v in enumerate(vs)]
    meta = spark.createDataFrame([("x", 1.0, [1], 5.0, 1.0), ("y", 1.0, [1], 7.0, 2.0), ("q", 1.0, [1], 0.0, 1.0)], "signal string, dt double, values_shape array<int>, mean double, std double")
    return spark.createDataFrame(rows, "shot_id long, signal string, t_idx int, time double, values array<double>"), meta


def made(spark, task=TASK, **how):
    rows = evaluation.make_windows(*series(spark), task, **how).orderBy("window_index", "role", "signal").collect()
    return {(r.window_index, r.role): [v[0] for v in r["values"]] for r in rows}


def test_range_and_cuts(spark):
    data, meta = series(spark)
    known = blocks.known(meta, ["x", "y", "q"])
    span = blocks.shot_spans(data, known, TASK)
    assert tuple(span.select("shot_id", "start", "stop").first()) == (1, 1.0, 8.0)
    assert [(r.window_index, r.t_cut) for r in windows.cuts(span, TASK).orderBy("window_index").collect()] == [(0, 4.0), (1, 5.0)]
    assert windows.cuts(span, TASK | {"input_length": 5.0, "output_length": 3.0}).count() == 0
    assert blocks.shot_spans(data, known, TASK, every_output=True).count() == 1
    more = TASK | {"roles": [*TASK["roles"], ("output", "q")]}
    assert blocks.shot_spans(data, known, more, every_output=True).count() == 0
    assert evaluation.fit_windows(data, meta, more).count() == 0 and evaluation.fit_windows(data, meta, TASK, None).count() == 2
    with pytest.raises(Exception, match="without gaps"):
        blocks.shot_spans(data.where("t_idx <> 5"), known, TASK).collect()


def test_windows(spark):
    got = made(spark)
    assert got == {(0, "input"): [11, 12, None], (1, "input"): [12, None, 14], (0, "output"): [4, 5], (1, "output"): [5, 6]}
    grown = made(spark, TASK | {"task_type": "non_markovian"})
    assert grown[(0, "input")] == [11, 12, None] and grown[(1, "input")] == [11, 12, None, 14]
    with_actuator = made(spark, TASK | {"roles": [*TASK["roles"], ("actuator", "x")]})
    assert with_actuator[(0, "actuator")] == [11, 12, None, 14, 15]


def test_missing_signal_has_nominal_length(spark):
    got = made(spark, TASK | {"roles": [*TASK["roles"], ("actuator", "q")], "task_type": "non_markovian"})
    assert got[(1, "actuator")] == [None] * 5


def test_clipping():
    y = kernel.Series(0.0, 1.0, np.arange(9.0)[:, None])
    block = kernel.Block(1, {"y": y}, 0.0, 2.0, 0, 1)
    out = next(kernel.written(block, np.array([0]), TASK | {"roles": [("input", "y")]}, {"y": kernel.Meta(1.0, 1, 0.0)})).to_pydict()
    assert out["values"] == [[[0.0], [0.0], [1.0]]] and out["time"] == [[0.0, 0.0, 1.0]] and out["lo"] == [-1]


def test_pad(spark):
    df = spark.createDataFrame([(1, "s", 2.0, 1.0, [[2.0], [3.0], [4.0]])], "shot_id long, signal string, t0 double, dt double, values array<array<double>>")
    meta = spark.createDataFrame([("s", [1])], "signal string, values_shape array<int>")
    out = windows.pad(df, F.lit(0.5), F.lit(5.0), meta).first()
    assert out.t0 == -1.0 and [v[0] for v in out["values"]] == [None, None, None, 2, 3, 4, None, None]


def screens(rows, filled=False):
    """Whether the one window of two input samples and two output samples is fit; slices as (role, signal, values)."""
    missing = lambda n: [[None]] * n
    series_ = {s: kernel.Series(0.0, 1.0, np.array(missing(2) + v if role == "output" else v + missing(2), float)) for role, s, v in rows}
    block = kernel.Block(1, series_, 0.0, 2.0, 0, 1)
    return len(kernel.fit(block, TASK | {"input_length": 2.0, "stride": 10.0, "roles": [(r, s) for r, s, _ in rows]}, filled)) > 0


def test_screens():
    gone, part, full = [[None], [None]], [[None], [1.0]], [[1.0], [1.0]]
    assert not screens([("input", "a", gone), ("output", "y", full)])
    assert not screens([("input", "a", part), ("output", "y", gone)])
    assert screens([("input", "a", gone), ("actuator", "b", part), ("output", "y", part)])
    assert screens([("input", "a", gone), ("input", "b", full), ("output", "y", part)])
    assert not screens([("input", "a", part), ("output", "y", full)], True)
    assert not screens([("input", "a", full), ("output", "y", part)], True)
    assert screens([("input", "a", full), ("output", "y", full)], True)


def test_persistence_and_mean(spark):
    data, meta = series(spark)
    out = evaluation.make_windows(data, meta, TASK)
    got = {r.window_index: r.prediction for r in baselines.persistence(out, meta, 2).collect()}
    assert got == {0: [[12.0], [12.0]], 1: [[14.0], [14.0]]}
    empty = out.withColumn("values", F.transform("values", lambda v: F.array(F.lit(None).cast("double"))))
    assert baselines.persistence(empty, meta, 2).first().prediction == [[5.0], [5.0]]
    assert baselines.mean_forecast(out, meta).first().prediction == [[7.0], [7.0]]


def channels(spark, values, shape):
    rows = [(1, "v", i, 0.5 * i, v) for i, v in enumerate(values)]
    meta = spark.createDataFrame([("v", 0.5, shape, 7.0, 1.0)], "signal string, dt double, values_shape array<int>, mean double, std double")
    return spark.createDataFrame(rows, "shot_id long, signal string, t_idx int, time double, values array<double>"), meta


VECTOR_TASK = {"task_type": "markovian", "input_length": 1.0, "output_length": 1.0, "delta": 0.0, "stride": 0.5, "roles": [("input", "v"), ("output", "v")]}


def test_channels_are_forecast_each(spark):
    data, meta = channels(spark, [[1.0, 100.0]] * 10, [2])
    rows = evaluation.evaluate(data, meta, "t", VECTOR_TASK, evaluation.persist).collect()
    assert len(rows) > 3 and all((r.RMSE, r.MAE, r.nan_fraction) == (0.0, 0.0, 0.0) for r in rows)
    # a missing channel takes its own last value, or else the mean
    data, meta = channels(spark, [[1.0, None], [None, None], [3.0, 4.0], [None, 6.0]], [2])
    task = VECTOR_TASK | {"stride": 10.0, "output_length": 0.4}
    row = evaluation.evaluate(data, meta, "t", task, evaluation.persist).first()
    assert (row.RMSE, row.MAE, row.nan_fraction) == (pytest.approx(math.sqrt((4 + 9) / 2)), 2.5, 0.0)  # forecast [1, 7], target [3, 4]


def test_written_and_steady_forecasts_agree(spark):
    rng = np.random.default_rng(3)
    data, meta = channels(spark, [[None if rng.random() < 0.4 else float(x) for x in v] for v in rng.standard_normal((40, 3))], [3])
    written = lambda made, meta, task: baselines.persistence(made, meta, 2)
    a, b = (evaluation.evaluate(data, meta, "t", VECTOR_TASK, p).orderBy("window_index").collect() for p in (evaluation.persist, written))
    assert len(a) == len(b) > 20
    for x, y in zip(a, b, strict=True):
        assert x.window_index == y.window_index and (x.RMSE, x.MAE, x.nan_fraction) == pytest.approx((y.RMSE, y.MAE, y.nan_fraction))


def test_sizes_must_match(spark):
    data, meta = channels(spark, [[1.0, 2.0]] * 5 + [[1.0]] * 5, [2])
    with pytest.raises(Exception, match="differ in channels"):
        evaluation.evaluate(data, meta, "t", VECTOR_TASK, evaluation.persist).collect()
    y = spark.createDataFrame([(1, 0, "f", [[4.0, 5.0]])], "shot_id long, window_index int, signal string, values array<array<double>>")
    p = spark.createDataFrame([(1, 0, "f", [[4.0]])], "shot_id long, window_index int, signal string, prediction array<array<double>>")
    with pytest.raises(Exception, match="differ in size"):
        metrics.window_metrics(y, p).collect()


def test_missing_signal_has_its_width(spark):
    data, meta = channels(spark, [[1.0, 2.0]] * 10, [2])
    meta = meta.unionByName(spark.createDataFrame([("w", 0.5, [3, 2], 0.0, 1.0)], meta.schema))
    made_ = evaluation.make_windows(data, meta, VECTOR_TASK | {"roles": [*VECTOR_TASK["roles"], ("actuator", "w")]})
    assert made_.where("signal = 'w'").first()["values"] == [[None] * 6] * 4


def test_late_samples_are_dropped(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "shot_id long, signal string, ts timestamp, value double"
    for k, (n, v) in enumerate([(1, 1.0), (50, 2.0), (51, 2.5), (2, 100.0), (200, 3.0)]):
        spark.createDataFrame([(1, "s", day(n), v)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.append_to(live.sliding(stream, "1 day", "1 day", "1 day"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    rows = {r.low: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {1.0: 1, 2.0: 1, 2.5: 1}  # the late 100 is dropped, the last window is still open


def test_window_metrics(spark):
    y = spark.createDataFrame([(1, 0, "f", [[4.0], [5.0], [None]])], "shot_id long, window_index int, signal string, values array<array<double>>")
    p = spark.createDataFrame([(1, 0, "f", [[6.0]] * 3), (1, 0, "g", [[1.0]])], "shot_id long, window_index int, signal string, prediction array<array<double>>")
    row = metrics.window_metrics(y, p).first()
    assert (row.RMSE, row.MAE, row.nan_fraction) == pytest.approx((math.sqrt(2.5), 1.5, 1 / 3))


WM = "task string, shot_id long, window_index int, feature_name string, RMSE double, MAE double, nan_fraction double"


def std(spark, value):
    return spark.createDataFrame([("f", value)], "signal string, std double")


def test_shot_roll_up(spark):
    df = spark.createDataFrame([("t", 1, 0, "f", 3.0, 1.0, 0.0), ("t", 1, 1, "f", 4.0, 3.0, 0.0), ("t", 1, 2, "f", None, NAN, 0.0)], WM)
    row = metrics.shot_metrics(df, std(spark, 2.0)).first()
    assert row.n_windows == 3 and row.RMSE_mean == pytest.approx(math.sqrt(12.5)) and row.MAE_mean == 2
    assert metrics.usable(df).count() == 2


def test_signal_roll_up(spark):
    df = spark.createDataFrame([("t", 1, 0, "f", 2.0, 1.0, 0.0), ("t", 2, 0, "f", 4.0, 3.0, 0.0)], WM)
    row = metrics.signal_metrics(metrics.shot_metrics(df, std(spark, 2.0))).first()
    assert (row.RMSE_mean, row.RMSE_std_pop, row.NRMSE_mean, row.NRMSE_std_pop, row.n_shots) == (3, 1, 1.5, 0.5, 2)
    one_shot = metrics.signal_metrics(metrics.shot_metrics(df.where("shot_id = 1"), std(spark, 0.0))).first()
    assert one_shot.RMSE_std_pop == 0 and one_shot.NRMSE_mean is None and one_shot.NRMSE_std_pop == 0


def test_group_roll_up(spark):
    cols = "task string, n_shots double, " + ", ".join(f"{m}_{s} double" for m in metrics.METRICS for s in ("mean", "std_pop"))
    df = spark.createDataFrame([("a", 5.0, *[1.0, 0.2] * 5), ("b", 7.0, *[3.0, None] * 5)], cols)
    groups = spark.createDataFrame([("a", 1), ("b", 1)], "task string, group_id int")
    row = metrics.group_rows(df, groups).first()
    assert (row.task, row.n_shots, row.RMSE_mean, row.RMSE_std_pop) == ("group_1", 12, 1, 0.2)
    assert [r.task for r in metrics.group_report(df, groups).orderBy("group_id", "level", "task").collect()] == ["group_1", "a", "b"]


def test_validation(spark):
    df = spark.createDataFrame([("t", 1, 0, "f", 2.0, 1.0, 0.0)], WM)
    metrics.validate(df, ["RMSE"], "t")
    for bad in (lambda: metrics.validate(df.limit(0), ["RMSE"]), lambda: metrics.validate(df, ["x"]), lambda: metrics.validate(df, ["RMSE"], "u"), lambda: metrics.summary("x", df)):
        with pytest.raises(ValueError):
            bad()


def roles(spark):
    return spark.createDataFrame([("t", "input", i, s) for i, s in enumerate("abc")] + [("t", "output", i, s) for i, s in enumerate("cda")] + [("t", "actuator", 0, "z"), ("u", "input", 0, "a"), ("u", "output", 0, "b")], "task string, role string, pos int, signal string")


def test_role_choices(spark):
    both = baselines.autoregressive(roles(spark))
    assert [r.signal for r in both.where("role = 'output'").orderBy("pos").collect()] == ["c", "a"] and both.where("task = 'u'").count() == 0
    assert evaluation.autoregressive_task(TASK) is None
    assert [r.signal for r in baselines.requested_signals(roles(spark).where("task = 't'")).collect()] == ["a", "b", "c", "z", "d"]
    mean = baselines.mean_choice(roles(spark), "m")
    assert {(r.task, r.role, r.signal) for r in mean.where("task = 'u'").collect()} == {("u", "input", "m"), ("u", "output", "b")}


def test_outlier_union(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b")], "shot_id long, signal string")
    b = spark.createDataFrame([(1, "b"), (2, "c")], "shot_id long, signal string")
    assert {r.shot_id: r.signals for r in stats.outlier_list(stats.outlier_union(a, b)).collect()} == {1: ["a", "b"], 2: ["c"]}


def test_flags(spark):
    df = spark.createDataFrame([(1, True, True, False, None), (2, False, False, False, False), (3, False, False, True, False)], "shot_id long, " + ", ".join(f"{f} boolean" for f in tasks.FLAGS))
    got = {r.shot_id: r.signals for r in stats.outlier_list(stats.flags_to_outliers(df, tasks.FLAGS)).collect()}
    assert got == {1: ["thomson_scattering-n_e", "thomson_scattering-t_e"], 3: ["soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper"]}


def test_split_sizes(spark):
    shots = spark.range(25).withColumnRenamed("id", "shot_id")
    sizes = {r.split: r.n_shots for r in splits.split_fractions(splits.split_random(shots)).collect()}
    assert sizes == {"train": 21, "val": 2, "test": 2}
    folds = [r["count"] for r in splits.folds(shots, 4).groupBy("fold").count().orderBy("fold").collect()]
    assert folds == [7, 6, 6, 6]


def test_head_per_split(spark):
    df = spark.createDataFrame([(i, s) for s in ("train", "val", "test") for i in range(20)], "shot_id long, split string")
    count = lambda out: {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert count(splits.head_per_split(df, 10, {"train": 3})) == {"train": 3, "val": 10, "test": 10}
    assert count(splits.head_per_split(df, 0, {"val": 2})) == {"train": 20, "val": 2, "test": 20}
    assert count(splits.head_per_split(df, None, seed=1)) == {"train": 20, "val": 20, "test": 20}


def test_availability(spark):
    cat = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "shot_id long, signal string")
    assert [r.shot_id for r in catalog.shots_with_all(cat, ["a", "b", "b"]).collect()] == [2]
    wide = spark.createDataFrame([(1, True, False), (2, True, True), (3, None, True)], "shot_id long, a boolean, b boolean")
    assert [r.shot_id for r in catalog.shots_with_all_wide(wide, ["a", "b"]).collect()] == [2]
    for f in (catalog.shots_with_all, catalog.shots_with_all_wide):
        with pytest.raises(ValueError):
            f(wide, [])


def test_shot_ids(spark):
    ids = spark.createDataFrame([("12",), ("x1",), (None,), ("-3",)], "shot_id string")
    assert [r.shot_id for r in catalog.valid_shot_ids(ids).collect()] == [12]
    assert {r.shot_id for r in catalog.invalid_shot_ids(ids).collect()} == {"x1", None, "-3"}
    paths = spark.createDataFrame([("a/30.zarr",), ("b/7.zarr/",), ("a/30.zarr",), ("a/x.zarr",), ("a/3.txt",)], "path string")
    assert [r.shot_id for r in catalog.list_shots(paths).collect()] == [7, 30]


def test_rating_mask(spark):
    s = spark.createDataFrame([(1, "eq-p", i, float(i), [5.0 + i]) for i in range(3)] + [(2, "eq-p", 0, 0.0, [1.0]), (2, "mag-b", 0, 0.0, [2.0])], "shot_id long, signal string, t_idx int, time double, values array<double>")
    ratings = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1)], "shot_id long, t_idx int, rating int")
    got = {(r.shot_id, r.signal, r.t_idx): r["values"] for r in clean.mask_ratings(s, ratings, "eq").collect()}
    assert got == {(1, "eq-p", 0): [5.0], (1, "eq-p", 1): None, (1, "eq-p", 2): [7.0], (2, "eq-p", 0): None, (2, "mag-b", 0): [2.0]}


def test_scan_keeps_missing_pairs(spark):
    s = spark.createDataFrame([(1, "a", 0, 0.0, [NAN])], "shot_id long, signal string, t_idx int, time double, values array<double>")
    shots = spark.createDataFrame([(1,), (2,)], "shot_id long")
    got = {(r.shot_id, r.signal): r["values"] for r in samples.scan(s, shots, ["a", "b", "a"]).collect()}
    assert got == {(1, "a"): [None], (1, "b"): None, (2, "a"): None, (2, "b"): None}


def test_axes_and_channels(spark):
    axes = spark.createDataFrame([("a", 0, "channel"), ("a", 1, "time_saddle"), ("a", 2, "time"), ("b", 0, "radius")], "signal string, pos int, axis string")
    assert {r.signal: r.time_axis for r in samples.time_axis(axes).collect()} == {"a": "time_saddle", "b": None}
    channels = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 0, "z")], "signal string, channel_idx int, channel_name string")
    assert [r.channel_name for r in samples.channel_names(channels, "a").collect()] == ["x", "y"]


def test_names(spark):
    at = lambda col, row="": one(spark, "s string", (row,), col)[0]
    assert at(names.squeeze_spaces(F.col("s")), " a\t\n b ") == "a b"
    assert at(names.last_number(F.col("s")), "run12/shot_30421_v2") == 2 and at(names.last_number(F.col("s")), "x") is None
    assert at(names.from_path(F.col("s")), "a/b") == "a-b" and at(names.from_path(F.col("s")), "ab") is None
    assert at(names.shape_text(F.array(F.lit(5), F.lit(100)))) == "5x100"
    assert at(names.number(F.col("s")), "bad") is None and at(names.number(F.col("s")), "nan") is None and at(names.number(F.col("s")), "2.5") == 2.5
    assert (at(names.source_of(F.col("s")), "mag-b-c"), at(names.name_of(F.col("s")), "mag-b-c")) == ("mag", "b-c")


def test_transform_plan(spark):
    data = spark.createDataFrame([(1, s, 0, 0.0, [1.0, None, 3.0]) for s in ("d", "f", "l", "x")], "shot_id long, signal string, t_idx int, time double, values array<double>")
    meta = spark.createDataFrame([(s, 1.0, 2.0) for s in "dflx"], "signal string, mean double, std double")
    members = {"filled": ["f"], "lcfs": ["l"], "x_point": ["x"], "probe": []}
    got = {r.signal: r["values"] for r in transforms.apply_plan(data, meta, members, fill=True, points=3).collect()}
    assert got == {"d": [0.0, None, 1.0], "f": [0.0, 0.0, 1.0], "l": [0.0, 0.5, 1.0], "x": [0.0, None, None]}
    steps = {r.signal: r.steps for r in transforms.plan_table(meta, members).collect()}
    assert steps["x"] == ["clip", "standardise"] and steps["l"] == ["standardise", "resample"]


def test_tasks(spark):
    assert tasks.task_table(spark).count() == 14
    rows = tasks.task_signal_table(spark)
    assert {(r.task, r.role): r["count"] for r in rows.where("task = '4-2'").groupBy("task", "role").count().collect()} == {("4-2", "input"): 16, ("4-2", "actuator"): 4, ("4-2", "output"): 2}
    meta = spark.createDataFrame([("summary-ip", 0.00025)], "signal string, dt double")
    got = {(r.task, r.role): r.length_n for r in windows.window_lengths(rows, tasks.task_table(spark), meta).collect()}
    assert got[("2-1", "input")] == 20 and got[("2-1", "output")] == 100
    assert profiling.task_catalogue(tasks.task_table(spark)).first().task == "1-1"
    assert tasks.task_parameters("3-3")["task_type"] == "non_markovian"
    with pytest.raises(ValueError):
        tasks.task_from_mapping({"input_length": 1, "output_length": 1, "delta": 0, "stride": 1, "task_type": "other"})


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (2, None, "x")], "k int, s string, t string")
    assert profiling.column_choice(df, ["t", "u"]) == (["t"], ["u"])
    assert {r.column_name: (r.n_present, r.n_missing, r.percent_present) for r in profiling.coverage(df, ["s", "t"]).collect()} == {"s": (2, 1, 66.67), "t": (1, 2, 33.33)}
    assert [tuple(r) for r in profiling.value_counts(df, "s").collect()] == [("a", 2), (None, 1)]
    assert sorted(r.k for r in profiling.keep_first(df, ["k"], ["s"]).collect()) == [1, 2]


def test_batches(spark):
    df = spark.createDataFrame([(s, w, "input", "x", [[float(w)]]) for s in (1, 2) for w in range(3)], "shot_id long, window_index int, role string, signal string, values array<array<double>>")
    out = batching.batches(df, batching.batch_ids(df, 4)).orderBy("batch_id").collect()
    assert [len(r.shot_ids) for r in out] == [4, 2] and out[0].shot_ids == [1, 1, 1, 2]
    assert sorted(r.shuffle_rank for r in batching.shuffle(df, 1).collect()) == list(range(6))


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 6)) + 5
    df = spark.createDataFrame([(1, i, [float(v) for v in row]) for i, row in enumerate(x)], "shot_id long, t_idx int, values array<double>")
    rows = pca.stack(df)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    got = pca.explained_variance(pca.fit(rows, 3)[1], spark).orderBy("component").collect()
    assert [r.ratio for r in got] == pytest.approx((s / s.sum())[:3].tolist()) and got[-1].cumulative == pytest.approx(1)
    assert max(r.error for r in pca.reconstruction_error(rows, 3).collect()) < 1e-6
    back = {r.t_idx: r.restored for r in pca.reconstruct(rows, 3).collect()}
    assert np.allclose([back[i] for i in range(60)], x)


@pytest.mark.parametrize(("n", "d", "spread"), [(400, 120, 0.0), (40, 120, 0.0), (300, 9, 0.0), (400, 150, 0.02)])
def test_block_pca(spark, n, d, spread):
    """Flat and steep spectra, more channels than rows, fewer channels than a block; restarts after three blocks."""
    x = np.random.default_rng(1).standard_normal((n, d)) * np.exp(-spread * np.arange(d)) + 3
    rows = spark.createDataFrame([(1, i, [float(v) for v in row]) for i, row in enumerate(x)], "shot_id long, t_idx int, values array<double>").repartition(3).persist()
    found = pca.block_fit(rows, 4, blocks=3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert found.ratios == pytest.approx((s**2 / (s**2).sum())[:4], rel=1e-9)
    assert np.abs(np.einsum("ij,ji->i", vt[:4], found.axes)) == pytest.approx(np.ones(4), abs=1e-6)
    assert np.allclose(found.axes.T @ found.axes, np.eye(4), atol=1e-10) and np.allclose(found.mean, x.mean(0))


def test_block_pca_without_variance(spark):
    rows = lambda data: spark.createDataFrame([(1, i, v) for i, v in enumerate(data)], "shot_id long, t_idx int, values array<double>")
    assert pca.block_fit(rows([])).ratios.tolist() == []
    assert pca.block_fit(rows([[1.0, 2.0]])).ratios.tolist() == [0, 0]
    assert pca.block_fit(rows([[1.0, 2.0]] * 5), 1).ratios.tolist() == [0]
    one = pca.block_fit(rows([[float(i), 1.0, 2.0 * i] for i in range(9)]), 2)
    assert one.ratios == pytest.approx([1, 0], abs=1e-12) and np.abs(one.axes[:, 0]) == pytest.approx(np.array([1, 0, 2]) / 5**0.5)
    with pytest.raises(ValueError, match="not settled"):
        pca.block_fit(rows(np.random.default_rng(0).standard_normal((60, 50)).tolist()), 2, blocks=2, most_passes=4)


def test_hooks(spark):
    df = spark.createDataFrame([(1, 0), (1, 1)], "shot_id long, window_index int")
    assert hooks.map_windows(df, lambda p: p[p.window_index == 1], "shot_id long, window_index int").count() == 1
    assert hooks.map_windows(df, lambda p: None, "shot_id long, window_index int").count() == 0


def test_tables(spark, tmp_path):
    path = str(tmp_path / "m.yaml")
    with open(path, "w") as f:
        f.write('{"12": ["a", "b"], "13": []}')
    mapping = tables.read_mapping(spark, path)
    assert {tuple(r) for r in tables.outlier_pairs(spark, mapping).collect()} == {(12, "a"), (12, "b")}
    with pytest.raises(ValueError):
        tables.parse_mapping("[1]")
    meta = tables.signal_meta(spark, {"a": {"dt": 0.1, "values_shape": [3], "mean": 1.0, "std": 2.0}, "b": {}})
    assert meta.where("signal = 'b'").first().std is None
    odd = meta.unionByName(tables.signal_meta(spark, {'q"u\\o': {"dt": 1.0}}))
    tables.write_mapping(odd, "signal", str(tmp_path / "meta"))
    back = tables.read_mapping(spark, str(tmp_path / "meta"))
    assert back == {"a": {"dt": 0.1, "values_shape": [3], "mean": 1.0, "std": 2.0}, "b": {}, 'q"u\\o': {"dt": 1.0}}
    assert tables.read_metrics(spark, str(tmp_path / "none")) is None
    tables.write_csv(spark.createDataFrame([("f", 1.0)], "feature_name string, RMSE_mean double"), str(tmp_path / "half"))
    assert tables.read_metrics(spark, str(tmp_path / "half"), "shots") is None
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(ValueError):
        tables.append_rows(df, str(tmp_path / "rows"), ["x"])
    made_ = spark.createDataFrame([], "role string, values array<array<double>>")
    with pytest.raises(ValueError):
        tables.write_windows_float32(made_, str(tmp_path / "w"))


def test_bitmaps_of_shots(spark):
    ids = {"a": [0, 1, 2, 32768, 32769, 65536, 10**9, -5], "b": [0, 2, 32768, 10**9, 7, -5, -40000], "c": []}
    rows = [(i, s) for s, all_ in ids.items() for i in all_ * 2] + [(None, "a"), (99, "d")]
    sets = catalog.bitmaps(spark.createDataFrame(rows, "shot_id long, signal string"))
    assert {r.shot_id for r in catalog.having_all(sets, ["a", "b", "b"]).collect()} == {*ids["a"]} & {*ids["b"]}
    assert catalog.having_all(sets, ["a", "c"]).collect() == []
    assert {r.signal: r.n_shots for r in catalog.signal_counts(sets).collect()} == {"a": 8, "b": 7, "d": 1}
    every = {*ids["a"], *ids["b"], 99}
    got = sorted(tuple(r) for r in catalog.lacking(sets, ["a", "c"]).collect())
    assert got == sorted([(i, "a") for i in every - {*ids["a"]}] + [(i, "c") for i in every])
    none = catalog.bitmaps(spark.createDataFrame([], "shot_id long, signal string"))
    assert catalog.having_all(none, ["a"]).collect() == catalog.lacking(none, ["a"]).collect() == []
