"""Many packed rows at once: the same as one at a time, and few calls for many short shots."""

import numpy as np
import pyarrow as pa
import pytest
from test_kernel import META, SAMPLES, TASK, shots

from shotloom.operators import blocks, kernel


def results(batch, step, known, task, how):
    """What the kernel gives for the rows of a batch, ``step`` of them together."""
    wanted, out = kernel.names(task, "input", "actuator", "output"), []
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        for block in blocks._blocks(part, wanted, known, task) if "block" in batch.schema.names else blocks._shots(part, wanted, known, task, False):
            for k, w in block.windows():
                fine = kernel.is_fit(block, w, task, False, k)
                if fine.any():
                    out += [r for b in how(block, w[fine], k[fine]) for r in b.to_pylist()]
    return sorted(out, key=lambda r: [str(r[c]) for c in ("shot_id", "window_index", *(("role", "signal") if "role" in r else ("feature_name",)))])


@pytest.mark.parametrize("task", [TASK, TASK | {"task_type": "non_markovian"}, TASK | {"delta": -0.5}])
@pytest.mark.parametrize("seconds", [None, 5.0])
def test_rows_together_and_alone(spark, task, seconds, monkeypatch):
    if seconds and task["task_type"] == "non_markovian":
        return
    data, meta = shots(spark)
    task = task | {"stride": 0.5}
    if task["task_type"] == "non_markovian":  # windows grow with their shot
        data = data.where("shot_id > 1 or t_idx < 200")
    known = blocks.known(meta, ["a", "b"])
    rows = blocks.packed(data, ["a", "b"]) if seconds is None else blocks.blocked(data, known, task, seconds)
    batch = pa.Table.combine_chunks(rows.toArrow()).to_batches()[0]
    score = lambda b, w, k: kernel.score(b, w, task, known, ["a", "b"], kernel.last_present, k)
    for how in (score, lambda b, w, k: kernel.written(b, w, task, known, k)):
        together, alone = (results(batch, n, known, task, how) for n in (batch.num_rows, 1))
        assert str(together) == str(alone) and len(together) > 50
    plain = results(batch, batch.num_rows, known, task, score)
    monkeypatch.setattr(kernel, "SHORT", 0)  # running sums for every row
    summed = results(batch, batch.num_rows, known, task, score)
    for a, b in zip(plain, summed, strict=True):
        assert a["shot_id"] == b["shot_id"] and a["window_index"] == b["window_index"]
        assert [a[c] for c in ("square", "size", "n", "of")] == pytest.approx([b[c] for c in ("square", "size", "n", "of")], abs=1e-9)


def test_running_sums_of_a_few_samples(monkeypatch):
    monkeypatch.setattr(kernel, "SHORT", 0)
    r = np.random.default_rng(1)
    own = np.array([1, 40, 7])
    x = r.standard_normal((48, 2)) * np.repeat([1e6, 1.0, 1e-3], own)[:, None]
    x[r.random(x.shape) < 0.3] = np.nan
    s, at = kernel.Series(np.zeros(3), 1.0, x, own=own), np.r_[0, np.cumsum(own)]
    k, first, p = r.integers(0, 3, 200), r.integers(-5, 45, 200), r.standard_normal((200, 2))
    got = s.errors(first, first + 6, p, k)
    for j in range(200):
        mine = x[at[k[j]] : at[k[j] + 1]]
        d = mine[np.clip(np.arange(first[j], first[j] + 6), 0, len(mine) - 1)] - p[j]
        assert [g[j] for g in got] == pytest.approx([np.nansum(d * d), np.nansum(abs(d)), (~np.isnan(d)).sum(), d.size], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("seconds", [None, 10.0])
def test_short_shots_share_a_call(spark, seconds):
    rows = [(shot, "a", i, float(i), [float(i * shot)]) for shot in range(300) for i in range(30)]
    data, meta = spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([("a", 1.0, [1], 0.0, 1.0)], META)
    task = TASK | {"input_length": 5.0, "output_length": 2.0, "stride": 1.0, "roles": [("input", "a"), ("output", "a")]}
    known = blocks.known(meta, ["a"])
    packed = blocks.packed(data, ["a"]) if seconds is None else blocks.blocked(data, known, task, seconds)
    count = lambda block, w, *k: iter([pa.record_batch([pa.array([len(w)], pa.int64())], names=["n"])])
    calls = [r.n for r in blocks.run(packed, known, task, False, count, "n long").collect()]
    assert sum(calls) == 300 * 22 and len(calls) <= 8


def test_channels_that_differ_between_shots(spark):
    rows = [(shot, "a", i, float(i), [1.0 * i] * (1 + shot % 2)) for shot in range(6) for i in range(12)]
    meta = {"a": kernel.Meta(1.0, 1, 0.5)}
    task = TASK | {"input_length": 3.0, "output_length": 2.0, "stride": 1.0, "roles": [("input", "a"), ("output", "a")]}
    made = blocks.windows(blocks.packed(spark.createDataFrame(rows, SAMPLES), ["a"]), meta, task, False).collect()
    assert len(made) == 6 * 6 * 2 and all(len(v) == 1 + r.shot_id % 2 for r in made for v in r["values"])
