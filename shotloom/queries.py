"""Registered queries: each operator on the test tables, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import names, values
from .operators import baselines, batching, blocks, clean, metrics, pca, profiling, spectra, splits, stats, windows
from .plans import evaluation, hooks, runs, transforms, views, workspace
from .sources import catalog, tables
from .sources import samples as scans
from .streaming import live, rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(x: Column | str) -> Column:
    """Results have the precision of 32-bit numbers, like the training data: the order in which a sum is taken decides
    later digits."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, 9).cast("float").cast("double")


# ---------------------------------------------------------------- statistics

MEAS = """meas AS (SELECT l_suppkey AS shot_id, u.variable, u.value FROM lineitem, LATERAL (VALUES ('quantity', l_quantity), ('extendedprice', l_extendedprice),
 ('discount', l_discount), ('tax', CASE WHEN l_orderkey % 11 <> 0 THEN l_tax END)) u(variable, value))"""
STATS = MEAS + """, stats AS (SELECT shot_id, variable, count(*) AS n_dim_shot, count(*) - count(value) AS n_nans_shot, avg(value) AS mean, var_pop(value) AS variance,
 min(value) AS min, max(value) AS max, median(value) AS median FROM meas GROUP BY ALL)"""
POOL = STATS + """, pool AS (SELECT variable, sum((n_dim_shot - n_nans_shot) * mean) / sum(n_dim_shot - n_nans_shot) AS g FROM stats GROUP BY 1),
 pool2 AS (SELECT variable, any_value(g) AS g, sum((n_dim_shot - n_nans_shot) * (variance + (mean - g) ** 2)) / sum(n_dim_shot - n_nans_shot) AS v FROM stats JOIN pool USING (variable) GROUP BY 1),
 z AS (SELECT s.*, (mean - g) / nullif(sqrt(v), 0) AS z FROM stats s LEFT JOIN pool2 USING (variable))"""
STAGE2 = POOL + """, kept AS (SELECT * FROM z WHERE NOT coalesce(abs(z) > 0.05, false)),
 k1 AS (SELECT variable, sum((n_dim_shot - n_nans_shot) * mean) / sum(n_dim_shot - n_nans_shot) AS g FROM kept GROUP BY 1),
 k2 AS (SELECT variable, any_value(g) AS mean, sqrt(sum((n_dim_shot - n_nans_shot) * (variance + (kept.mean - g) ** 2)) / sum(n_dim_shot - n_nans_shot)) AS std FROM kept JOIN k1 USING (variable) GROUP BY 1)"""
ZOUT = STAGE2 + """, zout AS (SELECT s.shot_id, s.variable AS signal FROM stats s JOIN k2 USING (variable) WHERE abs((s.mean - k2.mean) / nullif(k2.std, 0)) > 0.08)"""
FLAGGED = {"flag_a": ["quantity", "tax"], "flag_b": ["discount"]}
MANUAL = """manual AS (SELECT DISTINCT s_suppkey AS shot_id, unnest(CASE WHEN s_suppkey % 10 = 3 THEN ['quantity', 'tax'] ELSE [] END || CASE WHEN s_suppkey % 15 = 3 THEN ['discount'] ELSE [] END) AS signal FROM supplier)"""


def _stats(spark, d, median=False):
    return stats.shot_stats(views.order_cells(spark, d), median)


def _zout(spark, d):
    s = _stats(spark, d)
    return stats.outlier_pairs(s, stats.two_stage(s, 0.05), 0.08)


def _manual(spark, d):
    flags = views.read(spark, d, "supplier").select(F.col("s_suppkey").alias("shot_id"), (F.col("s_suppkey") % 10 == 3).alias("flag_a"), (F.col("s_suppkey") % 15 == 3).alias("flag_b"))
    return stats.flags_to_outliers(flags, FLAGGED)


@query(f"WITH {STATS} SELECT shot_id, variable, n_dim_shot, n_nans_shot, CAST(CAST(round(mean, 9) AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(round(variance, 9) AS FLOAT) AS DOUBLE) AS variance, min, max, CAST(CAST(round(median, 9) AS FLOAT) AS DOUBLE) AS median FROM stats")
def shot_signal_stats(spark, d):
    return _stats(spark, d, True).select("shot_id", "variable", "n_dim_shot", "n_nans_shot", r("mean").alias("mean"), r("variance").alias("variance"), "min", "max", r("median").alias("median"))


@query(f"WITH {STATS} SELECT shot_id, variable, CAST(CAST(round(median, 9) AS FLOAT) AS DOUBLE) AS median FROM stats")
def selected_medians(spark, d):
    """Medians of all groups by the passes that count, as for groups too large for an aggregate; of a hundred cells each the
    last ones are put in order."""
    cells = views.order_cells(spark, d)
    sizes = cells.groupBy("shot_id", "variable").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return stats.selected_medians(cells, workspace.keep(sizes), few=100).select("shot_id", "variable", r("median").alias("median"))


@query(f"WITH {POOL} SELECT variable, CAST(CAST(round(g, 9) AS FLOAT) AS DOUBLE) AS global_mean, CAST(CAST(round(v, 9) AS FLOAT) AS DOUBLE) AS global_variance FROM pool2")
def pooled_stats(spark, d):
    return stats.pooled(_stats(spark, d)).select("variable", r("global_mean").alias("global_mean"), r("global_variance").alias("global_variance"))


@query(f"WITH {POOL} SELECT shot_id, variable, CAST(CAST(round(z, 9) AS FLOAT) AS DOUBLE) AS z FROM z")
def shot_zscores(spark, d):
    s = _stats(spark, d)
    return stats.zscores(s, stats.pooled(s)).select("shot_id", "variable", r("z").alias("z"))


@query(f"WITH {STAGE2} SELECT variable, CAST(CAST(round(mean, 9) AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(round(std, 9) AS FLOAT) AS DOUBLE) AS std FROM k2")
def pooled_stats_two_stage(spark, d):
    return stats.two_stage(_stats(spark, d), 0.05).select("variable", r("mean").alias("mean"), r("std").alias("std"))


@query(f"WITH {ZOUT} SELECT * FROM zout")
def zscore_outliers(spark, d):
    return _zout(spark, d)


@query(f"WITH {POOL} SELECT count_if(coalesce(abs(z) > 0.05, false)) AS n_outliers, count(DISTINCT CASE WHEN abs(z) > 0.05 THEN variable END) AS n_variables, count(DISTINCT CASE WHEN abs(z) > 0.05 THEN shot_id END) AS n_shots FROM z")
def outlier_counts(spark, d):
    s = _stats(spark, d)
    return stats.outlier_counts(stats.zscores(s, stats.pooled(s)), 0.05)


@query(f"WITH {ZOUT}, {MANUAL}, every AS (SELECT * FROM zout UNION SELECT * FROM manual) SELECT shot_id, string_agg(signal, ',' ORDER BY signal) AS signals FROM every GROUP BY 1")
def outlier_union(spark, d):
    both = stats.outlier_union(_zout(spark, d), _manual(spark, d))
    return stats.outlier_list(both).select("shot_id", F.array_join("signals", ",").alias("signals"))


@query(f"WITH {MANUAL} SELECT * FROM manual")
def manual_outliers(spark, d):
    return _manual(spark, d)


# ---------------------------------------------------------------- scans, cleaning, catalog

SIG = """daily AS (SELECT user_id AS shot_id, event_type AS signal, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t_idx, avg(value) AS value FROM events GROUP BY ALL),
 grid AS (SELECT shot_id, signal, t_idx FROM (SELECT DISTINCT user_id AS shot_id FROM events), (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS signal), (SELECT unnest(generate_series(0, 29)) AS t_idx)),
 sig AS (SELECT shot_id, signal, CAST(t_idx AS INTEGER) AS t_idx, CAST(t_idx AS DOUBLE) AS time, value FROM grid LEFT JOIN daily USING (shot_id, signal, t_idx))"""


def _sig(spark, d):
    return views.event_samples(spark, d)


@query(f"""WITH {SIG}, shots AS (SELECT DISTINCT shot_id FROM sig), pairs AS (SELECT shot_id, signal FROM shots, (SELECT unnest(['view', 'click', 'absent']) AS signal))
 SELECT shot_id, signal, t_idx, CASE WHEN shot_id % 5 = 0 AND signal = 'view' THEN NULL ELSE CAST(CAST(round(value, 9) AS FLOAT) AS DOUBLE) END AS value FROM pairs LEFT JOIN sig USING (shot_id, signal)""")
def outlier_blanked_scan(spark, d):
    sig = _sig(spark, d)
    shots = sig.select("shot_id").distinct()
    out = scans.scan(sig, shots, ["view", "click", "absent"])
    bad = shots.where("shot_id % 5 = 0").withColumn("signal", F.lit("view"))
    return clean.blank_outliers(out, bad).select("shot_id", "signal", "t_idx", r(views.scalar()).alias("value"))


@query(f"WITH {SIG} SELECT shot_id, signal, count(value) AS n FROM sig WHERE NOT (shot_id % 5 = 0 AND signal = 'view') GROUP BY ALL")
def outlier_dropped_scan(spark, d):
    sig = _sig(spark, d)
    bad = sig.select("shot_id").distinct().where("shot_id % 5 = 0").withColumn("signal", F.lit("view"))
    return clean.drop_outliers(sig, bad).groupBy("shot_id", "signal").agg(F.count(views.scalar()).alias("n"))


@query(f"""WITH {SIG}, ratings AS (SELECT shot_id, t_idx, CASE WHEN value < 20 THEN 0 ELSE 1 END AS rating FROM sig WHERE signal = 'signup' AND value IS NOT NULL AND shot_id % 4 <> 0)
 SELECT shot_id, signal, t_idx, CASE WHEN signal <> 'view' OR coalesce(rating, 0) <> 0 THEN CAST(CAST(round(value, 9) AS FLOAT) AS DOUBLE) END AS value FROM sig LEFT JOIN ratings USING (shot_id, t_idx) WHERE signal IN ('view', 'click')""")
def rating_mask(spark, d):
    sig = _sig(spark, d)
    x = views.scalar()
    ratings = sig.where("signal = 'signup' and shot_id % 4 <> 0").where(x.isNotNull()).select("shot_id", "t_idx", F.when(x < 20, 0).otherwise(1).alias("rating"))
    return clean.mask_ratings(sig.where("signal in ('view', 'click')"), ratings, "view").select("shot_id", "signal", "t_idx", r(x).alias("value"))


CATALOG = "cat AS (SELECT DISTINCT user_id AS shot_id, CASE WHEN event_type IN ('view', 'click') THEN 'web' ELSE 'app' END AS source, CASE WHEN value < 2 THEN event_type || '_low' ELSE event_type END AS name FROM events), catalog_ AS (SELECT *, source || '-' || name AS signal FROM cat)"


def _catalog(spark, d):
    ev = views.read(spark, d, "events")
    source = F.when(F.col("event_type").isin("view", "click"), "web").otherwise("app")
    rows = ev.select(F.col("user_id").alias("shot_id"), source.alias("source"), F.when(F.col("value") < 2, F.concat("event_type", F.lit("_low"))).otherwise(F.col("event_type")).alias("name")).distinct()
    return rows.withColumn("signal", names.qualified(F.col("source"), F.col("name")))


@query(f"WITH {CATALOG} SELECT shot_id, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM catalog_ GROUP BY 1")
def catalog_signals_per_shot(spark, d):
    return catalog.signals_per_shot(_catalog(spark, d)).select("shot_id", F.array_join("signals", ",").alias("signals"))


@query(f"WITH {CATALOG} SELECT shot_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM catalog_ GROUP BY 1")
def catalog_sources_per_shot(spark, d):
    return catalog.sources_per_shot(_catalog(spark, d)).select("shot_id", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {CATALOG} SELECT u.signal, u.signal IN (SELECT signal FROM catalog_) AS found FROM (SELECT unnest(['web-view', 'app-view', 'app-error']) AS signal) u")
def signal_exists(spark, d):
    return catalog.signals_exist(_catalog(spark, d), ["web-view", "app-view", "app-error"])


@query(f"WITH {CATALOG} SELECT shot_id FROM catalog_ WHERE signal IN ('web-view', 'web-click_low', 'app-error') GROUP BY 1 HAVING count(DISTINCT signal) = 3")
def shots_with_all_signals(spark, d):
    return catalog.shots_with_all(_catalog(spark, d), ["web-view", "web-click_low", "app-error"])


@query(f"WITH {CATALOG} SELECT shot_id FROM catalog_ WHERE signal IN ('web-view', 'app-purchase_low') GROUP BY 1 HAVING count(DISTINCT signal) = 2")
def shots_with_all_signals_wide(spark, d):
    wide = _catalog(spark, d).groupBy("shot_id").pivot("signal", ["web-view", "app-purchase_low"]).agg(F.count("name") > 0).na.fill(False)
    return catalog.shots_with_all_wide(wide, ["web-view", "app-purchase_low"])


@query(f"WITH {CATALOG} SELECT shot_id FROM catalog_ WHERE signal IN ('web-view', 'web-click', 'app-error') GROUP BY 1 HAVING count(DISTINCT signal) = 3")
def shots_having_all_bitmaps(spark, d):
    return catalog.having_all(catalog.bitmaps(_catalog(spark, d)), ["web-view", "web-click", "app-error"])


@query(f"WITH {CATALOG} SELECT signal, CAST(count(DISTINCT shot_id) AS BIGINT) AS n_shots FROM catalog_ GROUP BY 1")
def signal_shot_counts(spark, d):
    return catalog.signal_counts(catalog.bitmaps(_catalog(spark, d)))


@query(f"WITH {CATALOG} SELECT shot_id, signal FROM (SELECT DISTINCT shot_id FROM catalog_), (SELECT unnest(['web-view', 'app-error_low', 'app-none']) AS signal) EXCEPT SELECT shot_id, signal FROM catalog_")
def signals_lacking_bitmaps(spark, d):
    return catalog.lacking(catalog.bitmaps(_catalog(spark, d)), ["web-view", "app-error_low", "app-none"])


@query("""SELECT signal, CASE WHEN signal IS NOT NULL THEN split_part(signal, '-', 1) END AS source, regexp_replace(signal, '^[^-]*-', '') AS name, count(*) AS n
 FROM (SELECT CASE WHEN contains(p, '/') THEN replace(p, '/', '-') END AS signal FROM (SELECT CASE WHEN user_id % 7 <> 0 THEN 'events/' END || event_type AS a, event_type AS b, coalesce(a, b) AS p FROM events)) GROUP BY ALL""")
def signals_from_paths(spark, d):
    """Names inside a store: group/name is a signal, a name without a group is none."""
    path = F.concat(F.when(F.col("user_id") % 7 != 0, "events/").otherwise(""), "event_type")
    signal = names.from_path(path)
    return views.read(spark, d, "events").select(signal.alias("signal"), names.source_of(signal).alias("source"), names.name_of(signal).alias("name")).groupBy("signal", "source", "name").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey AS shot_id FROM customer WHERE c_custkey % 3 <> 0")
def list_shots(spark, d):
    keys = views.read(spark, d, "customer").select("c_custkey")
    path = F.concat(F.lit("level2/"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(""), F.col("c_custkey"), F.lit(".zarr"))
    return catalog.list_shots(keys.select(path.alias("path")))


@query("SELECT c_custkey AS shot_id FROM customer WHERE c_custkey % 4 <> 0")
def valid_shot_ids(spark, d):
    keys = views.read(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 4 == 0, "-").otherwise(""), F.col("c_custkey")).alias("shot_id"))
    return catalog.valid_shot_ids(keys)


# ---------------------------------------------------------------- sampling interval

ORDERED = "ord AS (SELECT shot_id, row_number() OVER (ORDER BY shot_id DESC) AS pos FROM (SELECT DISTINCT user_id AS shot_id FROM events)), there AS (SELECT * FROM daily)"
FIRST = f"WITH {SIG}, {ORDERED}, firsts AS (SELECT signal, arg_min(shot_id, pos) AS shot_id FROM there JOIN ord USING (shot_id) GROUP BY 1), steps AS (SELECT d.signal, d.shot_id, CAST(t_idx - lag(t_idx) OVER (PARTITION BY d.signal, d.shot_id ORDER BY t_idx) AS DOUBLE) AS step FROM daily d JOIN firsts f ON d.signal = f.signal AND d.shot_id = f.shot_id)"


def _present(spark, d):
    sig = _sig(spark, d).where(views.scalar().isNotNull())
    return sig, sig.select("shot_id", (-F.col("shot_id")).alias("pos")).distinct()


@query(FIRST + " SELECT signal, round(median(step), 6) AS dt FROM steps GROUP BY 1")
def signal_dt(spark, d):
    return stats.signal_dt(*_present(spark, d))


@query(FIRST + " SELECT signal, shot_id, round(median(step), 6) AS dt, CAST(1 AS INTEGER) AS n_channels FROM steps GROUP BY 1, 2")
def first_shot_meta(spark, d):
    return stats.first_shot_meta(*_present(spark, d))


@query(f"WITH {SIG} SELECT shot_id, signal, t_idx, time - lag(time) OVER (PARTITION BY shot_id, signal ORDER BY t_idx) AS step FROM sig WHERE value IS NOT NULL")
def time_steps(spark, d):
    return stats.time_steps(_present(spark, d)[0]).select("shot_id", "signal", "t_idx", "step")


# ---------------------------------------------------------------- transforms

META = "meta AS (SELECT signal, avg(value) AS mean, stddev_pop(value) AS std FROM sig GROUP BY 1)"
VEC = "vec AS (SELECT CAST(label AS BIGINT) AS shot_id, vec_id, generate_subscripts(embedding, 1) - 1 AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), vecn AS (SELECT shot_id, vec_id, c, CASE WHEN (vec_id + c) % 7 <> 0 THEN x END AS x FROM vec)"


def _cells(df: DataFrame, column: str = "values") -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("c", "x")).select("vec_id", "c", r("x").alias("x"))


@query(f"WITH {SIG}, {META} SELECT shot_id, signal, t_idx, CAST(CAST(round((value - mean) / nullif(std, 0), 9) AS FLOAT) AS DOUBLE) AS value FROM sig JOIN meta USING (signal)")
def standardise(spark, d):
    sig = _sig(spark, d)
    out = transforms.apply_plan(sig, views.event_meta(spark, sig), {})
    return out.select("shot_id", "signal", "t_idx", r(views.scalar()).alias("value"))


@query(f"WITH {VEC} SELECT vec_id, CAST(c AS INTEGER) AS c, CAST(CAST(round(CASE WHEN abs(20 * x) <= 2 THEN 20 * x END, 9) AS FLOAT) AS DOUBLE) AS x FROM vecn")
def clip_to_null(spark, d):
    v = views.vectors(spark, d).withColumn("values", F.transform("values", lambda x: 20 * x))
    return _cells(v.withColumn("values", values.clip_to_null(F.col("values"))))


@query(f"WITH {VEC} SELECT vec_id, CAST(c AS INTEGER) AS c, CAST(CAST(round(CASE WHEN vec_id % 10 = 0 THEN NULL ELSE coalesce(x, 0) END, 9) AS FLOAT) AS DOUBLE) AS x FROM vecn")
def zero_fill_profile(spark, d):
    v = views.vectors(spark, d).withColumn("values", F.when(F.col("vec_id") % 10 == 0, F.transform("values", lambda x: F.lit(None).cast("double"))).otherwise(F.col("values")))
    return _cells(v.withColumn("values", values.zero_fill(F.col("values"))))


@query(f"WITH {VEC}, m AS (SELECT vec_id, avg(x) AS m FROM vecn GROUP BY 1) SELECT vec_id, CAST(c AS INTEGER) AS c, CAST(CAST(round(coalesce(x, m), 9) AS FLOAT) AS DOUBLE) AS x FROM vecn JOIN m USING (vec_id)")
def impute_channel_mean(spark, d):
    v = views.vectors(spark, d)
    return _cells(v.withColumn("values", values.impute_mean(F.col("values"))))


@query(f"""WITH {VEC}, seen AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY c) - 1 AS k, count(*) OVER (PARTITION BY vec_id) AS n, x FROM vecn WHERE x IS NOT NULL),
 pts AS (SELECT vec_id, i, i * (n - 1) / CAST(169 AS DOUBLE) AS p FROM (SELECT DISTINCT vec_id, n FROM seen), (SELECT unnest(generate_series(0, 169)) AS i))
 SELECT vec_id, CAST(i AS INTEGER) AS c, CAST(CAST(round(a.x + (p - floor(p)) * (b.x - a.x), 9) AS FLOAT) AS DOUBLE) AS x FROM pts JOIN seen a ON a.vec_id = pts.vec_id AND a.k = CAST(floor(p) AS BIGINT) JOIN seen b ON b.vec_id = pts.vec_id AND b.k = CAST(ceil(p) AS BIGINT)""".replace("SELECT vec_id, CAST(i", "SELECT pts.vec_id, CAST(i"))
def resample_170(spark, d):
    v = views.vectors(spark, d)
    return _cells(v.withColumn("values", values.resample(F.col("values"))))


@query("""WITH w AS (SELECT vec_id AS shot_id, generate_subscripts(embedding, 1) - 1 AS t, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), f AS (SELECT shot_id, t // 16 AS frame, t % 16 AS n, x * (1 - cos(2 * pi() * (t % 16) / 15)) / 2 AS y FROM w),
 dft AS (SELECT shot_id, frame, k, sum(y * cos(2 * pi() * k * n / 16)) AS re, sum(y * sin(2 * pi() * k * n / 16)) AS im FROM f, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY ALL)
 SELECT shot_id, CAST(frame AS INTEGER) AS frame, CAST(frame * 16 + 15 AS DOUBLE) AS time, CAST(k AS INTEGER) AS bin, CAST(CAST(round(re * re + im * im, 9) AS FLOAT) AS DOUBLE) AS power FROM dft""")
def stft_power(spark, d):
    out = spectra.stft(views.waves(spark, d), 16)
    return out.select("shot_id", "frame", "time", F.posexplode("power").alias("bin", "power")).withColumn("power", r("power"))


MEMBERS = {"x_point": ["view"], "filled": ["click"], "lcfs": [], "probe": []}


@query(f"""WITH {SIG}, {META} SELECT shot_id, signal, t_idx, CAST(CAST(round((CASE WHEN signal = 'view' AND abs(value) > 2 THEN NULL ELSE value END - mean) / nullif(std, 0), 9) AS FLOAT) AS DOUBLE) AS value FROM sig JOIN meta USING (signal)""")
def transform_plan(spark, d):
    sig = _sig(spark, d)
    out = transforms.apply_plan(sig, views.event_meta(spark, sig), MEMBERS, fill=True)
    return out.select("shot_id", "signal", "t_idx", r(views.scalar()).alias("value"))


# ---------------------------------------------------------------- windows

ROLE_LIST = [("input", "view"), ("input", "click"), ("actuator", "signup"), ("output", "purchase"), ("output", "error")]
FORECAST = {"task_type": "markovian", "input_length": 5.0, "output_length": 2.0, "delta": 0.0, "stride": 1.0, "roles": ROLE_LIST}
HISTORY = FORECAST | {"task_type": "non_markovian"}
RECONSTRUCT = FORECAST | {"output_length": 5.0, "delta": -5.0}
SHORT = FORECAST | {"input_length": 1.0, "output_length": 1.0}
AUTO = FORECAST | {"roles": [("input", "view"), ("input", "purchase"), ("output", "purchase"), ("output", "error")]}


def _window_sql(task: dict) -> str:
    """CTEs of ranges, cuts and window rows (one per value) for a task on the event samples."""
    n_in, n_out, delta = (int(task[k]) for k in ("input_length", "output_length", "delta"))
    roles = ", ".join(f"('{a}', '{s}')" for a, s in task["roles"])
    inside = ", ".join(f"'{s}'" for a, s in task["roles"] if a != "output")
    outside = ", ".join(f"'{s}'" for a, s in task["roles"] if a == "output")
    lo_in = "CAST(start AS BIGINT)" if task["task_type"] == "non_markovian" else f"e - {n_in}"
    return f"""{SIG}, roles AS (SELECT * FROM (VALUES {roles}) v(role, signal)),
 spans AS (SELECT shot_id, min(CASE WHEN signal IN ({inside}) AND value IS NOT NULL THEN time END) AS start, max(CASE WHEN signal IN ({outside}) AND value IS NOT NULL THEN time END) AS stop FROM sig GROUP BY 1 HAVING start IS NOT NULL AND stop IS NOT NULL),
 counts AS (SELECT *, CAST(greatest(0, ceil((stop - {delta} - {n_out} - (start + {n_in})) / 1.0)) AS INTEGER) AS n_windows FROM spans),
 cuts AS (SELECT shot_id, start, window_index, start + {n_in} + window_index AS t_cut FROM (SELECT *, CAST(unnest(generate_series(0, n_windows - 1)) AS INTEGER) AS window_index FROM counts)),
 bounds AS (SELECT *, CASE role WHEN 'output' THEN e + {delta} ELSE {lo_in} END AS lo, CASE role WHEN 'output' THEN e + {delta} + {n_out} WHEN 'actuator' THEN e + {delta} + {n_out} ELSE e END AS hi FROM (SELECT *, CAST(t_cut AS BIGINT) AS e FROM cuts, roles)),
 idx AS (SELECT shot_id, window_index, t_cut, role, signal, lo, unnest(generate_series(lo, hi - 1)) AS i FROM bounds),
 win AS (SELECT idx.shot_id, window_index, t_cut, role, idx.signal, CAST(i - lo AS INTEGER) AS pos, value FROM idx JOIN sig ON sig.shot_id = idx.shot_id AND sig.signal = idx.signal AND sig.t_idx = least(greatest(i, 0), 29))"""


def _screen_sql(flag: str) -> str:
    return f"""flags AS (SELECT shot_id, window_index, role, signal, {flag} AS bad FROM win GROUP BY ALL),
 fit AS (SELECT shot_id, window_index FROM flags GROUP BY ALL HAVING NOT (coalesce(bool_and(bad) FILTER (role = 'input'), true) AND coalesce(bool_and(bad) FILTER (role = 'actuator'), true)) AND NOT coalesce(bool_or(bad) FILTER (role = 'output'), false))"""


SPARSE, FILLED = _screen_sql("count(value) = 0"), _screen_sql("count(value) < count(*)")


def _spans(spark, d):
    known = blocks.known(views.event_meta(spark), windows.signals_of(ROLE_LIST, "input", "actuator", "output"))
    return blocks.shot_spans(_sig(spark, d), known, FORECAST)


def _made(spark, d, task, filled=None, first=None):
    return evaluation.make_windows(_sig(spark, d), views.event_meta(spark), task, filled=filled, first=first)


def _rows(made: DataFrame) -> DataFrame:
    rows = made.select("shot_id", "window_index", "t_cut", "role", "signal", F.posexplode("values").alias("pos", "v"))
    return rows.select("shot_id", "window_index", "t_cut", "role", "signal", "pos", r(views.scalar("v")).alias("value"))


ROW_SQL = " SELECT shot_id, window_index, t_cut, role, signal, pos, CAST(CAST(round(value, 9) AS FLOAT) AS DOUBLE) AS value FROM win"


@query(f"WITH {_window_sql(FORECAST)} SELECT * FROM spans")
def shot_time_range(spark, d):
    return _spans(spark, d).select("shot_id", "start", "stop")


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, window_index, t_cut FROM cuts")
def window_cuts(spark, d):
    return windows.cuts(_spans(spark, d), FORECAST).select("shot_id", "window_index", "t_cut")


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, n_windows FROM counts")
def window_counts(spark, d):
    return windows.cut_counts(_spans(spark, d), FORECAST).select("shot_id", "n_windows")


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, count(*) AS n_windows FROM cuts GROUP BY 1")
def windows_per_shot(spark, d):
    return windows.windows_per_shot(windows.cuts(_spans(spark, d), FORECAST))


@query(f"WITH {_window_sql(FORECAST)}" + ROW_SQL)
def windows_markovian(spark, d):
    return _rows(_made(spark, d, FORECAST))


@query(f"WITH {_window_sql(FORECAST)}" + ROW_SQL)
def windows_in_blocks(spark, d):
    """Shots in blocks of ten days with a halo of a week: the same windows, each block a row of its own."""
    return _rows(evaluation.make_windows(_sig(spark, d), views.event_meta(spark), FORECAST, block=10.0))


@query(f"WITH {_window_sql(HISTORY)}" + ROW_SQL)
def windows_history(spark, d):
    return _rows(_made(spark, d, HISTORY))


@query(f"WITH {_window_sql(RECONSTRUCT)}" + ROW_SQL + " WHERE role <> 'input'")
def windows_actuator(spark, d):
    return _rows(_made(spark, d, RECONSTRUCT).where("role <> 'input'"))


@query(f"WITH {_window_sql(FORECAST)}, {SPARSE} SELECT * FROM fit")
def window_screen_sparse(spark, d):
    return evaluation.fit_windows(_sig(spark, d), views.event_meta(spark), FORECAST).select("shot_id", "window_index")


@query(f"WITH {_window_sql(SHORT)}, {FILLED} SELECT * FROM fit")
def window_screen_filled(spark, d):
    return evaluation.fit_windows(_sig(spark, d), views.event_meta(spark), SHORT, True).select("shot_id", "window_index")


@query(f"""WITH {SIG}, own AS (SELECT shot_id, signal, min(t_idx) AS a, max(t_idx) AS b FROM sig WHERE value IS NOT NULL GROUP BY ALL)
 SELECT shot_id, signal, CAST(a - CASE WHEN a > 2 THEN a - 2 + 1 ELSE 0 END AS DOUBLE) AS t0, CAST(b - a + 1 + CASE WHEN a > 2 THEN a - 2 + 1 ELSE 0 END + CASE WHEN b < 27 THEN 27 - b + 1 ELSE 0 END AS INTEGER) AS n FROM own""")
def window_pad(spark, d):
    meta = views.event_meta(spark)
    sig = windows.pack(_sig(spark, d), meta)
    first, last = windows.valid_ends(F.col("values"))
    own = sig.withColumn("a", first).withColumn("b", last).where("a is not null")
    own = own.select("shot_id", "signal", F.col("a").cast("double").alias("t0"), "dt", F.slice("values", F.col("a").cast("int") + 1, (F.col("b") - F.col("a") + 1).cast("int")).alias("values"))
    return windows.pad(own, F.lit(2.0), F.lit(27.0), meta).select("shot_id", "signal", "t0", F.size("values").alias("n"))


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, window_index, signal, pos, CAST(CAST(round(last_value(value IGNORE NULLS) OVER (PARTITION BY shot_id, window_index, signal ORDER BY pos ROWS UNBOUNDED PRECEDING), 9) AS FLOAT) AS DOUBLE) AS value FROM win WHERE role = 'input'")
def ffill_in_window(spark, d):
    made = _made(spark, d, FORECAST).where("role = 'input'")
    filled = baselines.forward_fill(baselines.channel(F.col("values"), 0))
    return made.select("shot_id", "window_index", "signal", F.posexplode(filled).alias("pos", "value")).withColumn("value", r("value"))


# ---------------------------------------------------------------- forecasts and metrics

AUTO_ONLY = evaluation.autoregressive_task(AUTO)
MEAN_ONLY = evaluation.mean_task(FORECAST, "view")
ERRORS = """ wm AS (SELECT shot_id, window_index, signal AS feature_name, sqrt(avg((value - p) ** 2)) AS RMSE, avg(abs(value - p)) AS MAE, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS nan_fraction FROM win JOIN fit USING (shot_id, window_index) JOIN pred USING (shot_id, window_index, signal) WHERE role = 'output' GROUP BY ALL)"""


def _persist_sql(task: dict) -> str:
    return f"WITH {_window_sql(task)}, {META}, {SPARSE}, pred AS (SELECT shot_id, window_index, signal, coalesce(arg_max(value, pos) FILTER (value IS NOT NULL), any_value(mean)) AS p FROM win JOIN meta USING (signal) WHERE role = 'input' GROUP BY ALL), {ERRORS}"


def _mean_sql(task: dict) -> str:
    return f"WITH {_window_sql(task)}, {META}, {SPARSE}, pred AS (SELECT DISTINCT shot_id, window_index, signal, mean AS p FROM win JOIN meta USING (signal) WHERE role = 'output'), {ERRORS}"


WM_PERSIST, WM_MEAN = _persist_sql(AUTO_ONLY), _mean_sql(MEAN_ONLY)
WM_ROWS = " SELECT 'forecast' AS task, shot_id, window_index, feature_name, CAST(CAST(round(RMSE, 9) AS FLOAT) AS DOUBLE) AS RMSE, CAST(CAST(round(MAE, 9) AS FLOAT) AS DOUBLE) AS MAE, CAST(CAST(round(nan_fraction, 9) AS FLOAT) AS DOUBLE) AS nan_fraction FROM wm"
#: From window metrics w to shots, their deviations, signals and tasks.
SHOT_LEVEL = f"""{SIG}, {META},
 shots AS (SELECT task, shot_id, feature_name, count(DISTINCT window_index) AS n_windows, sqrt(avg(RMSE ** 2) FILTER (RMSE IS NOT NULL AND MAE IS NOT NULL)) AS RMSE_mean, avg(MAE) FILTER (RMSE IS NOT NULL AND MAE IS NOT NULL) AS MAE_mean, avg(nan_fraction) FILTER (RMSE IS NOT NULL AND MAE IS NOT NULL) AS nan_fraction_mean FROM w GROUP BY ALL HAVING count(RMSE + MAE) > 0),
 sm AS (SELECT shots.*, RMSE_mean / nullif(std, 0) AS NRMSE_mean, MAE_mean / nullif(std, 0) AS NMAE_mean FROM shots LEFT JOIN meta ON meta.signal = feature_name)"""
#: Two tasks of group 1 and one of group 2: persistence and mean forecasts.
BOTH = f"""WITH a AS ({WM_PERSIST} SELECT 'persist' AS task, * FROM wm), b AS ({WM_MEAN} SELECT 'mean' AS task, * FROM wm), w AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 'late' AS task, shot_id, window_index, feature_name, RMSE, MAE, nan_fraction FROM b WHERE window_index >= 5), {SHOT_LEVEL}"""
NAMES = ["NRMSE", "NMAE", "RMSE", "MAE", "nan_fraction"]
SPREAD_SQL = ", ".join(f"avg({m}_mean) AS {m}_mean, coalesce(stddev_pop({m}_mean), 0) AS {m}_std_pop" for m in NAMES)
ROUND_SQL = ", ".join(f"CAST(CAST(round({m}_{s}, 9) AS FLOAT) AS DOUBLE) AS {m}_{s}" for m in NAMES for s in ("mean", "std_pop"))
TASK_LEVEL = f"""signals AS (SELECT task, feature_name, CAST(count(DISTINCT shot_id) AS DOUBLE) AS n_shots, {SPREAD_SQL} FROM sm GROUP BY ALL),
 ts AS (SELECT task, shot_id, {', '.join(f'avg({m}_mean) AS {m}_mean' for m in NAMES)} FROM sm GROUP BY ALL), tasks AS (SELECT task, CAST(count(*) AS DOUBLE) AS n_shots, {SPREAD_SQL} FROM ts GROUP BY ALL)"""
REPORT = f"{BOTH}, {TASK_LEVEL}, groups AS (SELECT * FROM (VALUES ('persist', 1), ('mean', 1), ('late', 2)) v(task, group_id))"
GROUP_COLUMNS = ", ".join(f"avg(CASE WHEN {m}_mean IS NOT NULL AND {m}_std_pop IS NOT NULL THEN {m}_{s} END) AS {m}_{s}" for m in NAMES for s in ("mean", "std_pop"))
GROUP_ROWS = f""", joined AS (SELECT * FROM tasks JOIN groups USING (task)), g AS (SELECT group_id, 'group_' || group_id AS task, sum(n_shots) AS n_shots, {GROUP_COLUMNS}, 0 AS level FROM joined GROUP BY group_id)
 SELECT group_id, task, n_shots, level, {ROUND_SQL} FROM (SELECT * FROM g UNION ALL BY NAME SELECT *, 1 AS level FROM joined)"""


def _persisted(spark, d):
    sig = _sig(spark, d)
    return evaluation.evaluate(sig, views.event_meta(spark, sig), "persist", AUTO_ONLY, evaluation.persist)


def _averaged(spark, d):
    sig = _sig(spark, d)
    return evaluation.evaluate(sig, views.event_meta(spark, sig), "mean", MEAN_ONLY, evaluation.mean)


def _metric_rows(df: DataFrame) -> DataFrame:
    return df.select(F.lit("forecast").alias("task"), "shot_id", "window_index", "feature_name", *(r(c).alias(c) for c in ("RMSE", "MAE", "nan_fraction")))


def _packed(spark, d):
    """Shots packed and written once, whatever the number of forecasts, and what is known of their signals."""
    packed = runs.pack_shots(_sig(spark, d), views.EVENT_SIGNALS)
    return packed, workspace.keep(views.event_meta(spark, blocks.unpacked(packed, views.EVENT_SIGNALS)))


def _forecasts(spark, d):
    """Window metrics of the three tasks, and what is known of the signals."""
    tasks = F.when(F.col("window_index") >= 5, F.array(F.lit("mean"), F.lit("late"))).otherwise(F.array(F.lit("mean")))
    packed, meta = _packed(spark, d)
    known = blocks.known(meta, views.EVENT_SIGNALS)
    persisted = evaluation.evaluate_packed(packed, known, "persist", AUTO_ONLY, evaluation.persist)
    averaged = evaluation.evaluate_packed(packed, known, "mean", MEAN_ONLY, evaluation.mean)
    return persisted.unionByName(averaged.withColumn("task", F.explode(tasks))), meta


def _shots(spark, d):
    every, meta = _forecasts(spark, d)
    return workspace.keep(metrics.shot_metrics(every, meta))  # a few rows per shot, which reports read twice


def _groups(spark):
    return spark.createDataFrame([("persist", 1), ("mean", 1), ("late", 2)], "task string, group_id int")


def _rounded(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(*ids, *(r(f"{m}_{s}").alias(f"{m}_{s}") for m in NAMES for s in ("mean", "std_pop")))


@query(WM_PERSIST + WM_ROWS)
def window_metrics_persistence(spark, d):
    return _metric_rows(_persisted(spark, d))


@query(WM_MEAN + WM_ROWS)
def window_metrics_mean(spark, d):
    return _metric_rows(_averaged(spark, d))


@query(BOTH + " SELECT task, shot_id, feature_name, n_windows, " + ", ".join(f"CAST(CAST(round({m}_mean, 9) AS FLOAT) AS DOUBLE) AS {m}_mean" for m in NAMES) + " FROM sm")
def shot_metrics(spark, d):
    return _shots(spark, d).select("task", "shot_id", "feature_name", "n_windows", *(r(f"{m}_mean").alias(f"{m}_mean") for m in NAMES))


@query(REPORT + f" SELECT task, feature_name, n_shots, {ROUND_SQL} FROM signals")
def signal_metrics(spark, d):
    return _rounded(metrics.signal_metrics(_shots(spark, d)), "task", "feature_name", "n_shots")


@query(REPORT + " SELECT task, shot_id, " + ", ".join(f"CAST(CAST(round({m}_mean, 9) AS FLOAT) AS DOUBLE) AS {m}_mean" for m in NAMES) + " FROM ts")
def task_shot_metrics(spark, d):
    return metrics.task_shot_metrics(_shots(spark, d)).select("task", "shot_id", *(r(f"{m}_mean").alias(f"{m}_mean") for m in NAMES))


@query(REPORT + f" SELECT task, feature_name, n_shots, {ROUND_SQL} FROM (SELECT * FROM signals UNION ALL BY NAME SELECT *, task AS feature_name FROM tasks)")
def task_report(spark, d):
    return _rounded(metrics.task_report(_shots(spark, d)), "task", "feature_name", "n_shots")


@query(REPORT + f" SELECT task, feature_name, {ROUND_SQL} FROM signals")
def report_signal_rows(spark, d):
    return _rounded(metrics.split_report(metrics.task_report(_shots(spark, d)))[1], "task", "feature_name")


@query(REPORT + GROUP_ROWS)
def group_report(spark, d):
    tasks = metrics.summary("task", metrics.task_report(_shots(spark, d)))
    return _rounded(metrics.group_report(tasks, _groups(spark)), "group_id", "task", "n_shots", "level")


# ---------------------------------------------------------------- runs over several tasks

RUN_TASKS = {
    "1-1": AUTO,
    "1-2": FORECAST,  # no output is an input: persistence skips it
    "2-1": AUTO | {"input_length": 3.0, "output_length": 1.0, "roles": [("input", "view"), ("input", "error"), ("output", "error"), ("output", "view")]},
    "2-2": AUTO | {"output_length": 60.0},  # longer than any shot: no windows
}
EVERY_TASK = ", ".join(f"'{name}'" for name in RUN_TASKS)


def _run_sql(sql: Callable[[dict], str], rewrite: Callable[[dict], dict | None]) -> str:
    """The window metrics of all tasks that are not skipped, as the CTE w."""
    own = {name: rewrite(task) for name, task in RUN_TASKS.items()}
    return "WITH w AS (" + " UNION ALL ".join(f"SELECT '{name}' AS task, * FROM ({sql(task)} SELECT * FROM wm)" for name, task in own.items() if task) + ")"


def _run(spark, d, baseline):
    (packed, meta), path = _packed(spark, d), workspace.folder(spark)
    return runs.run_packed(packed, meta, RUN_TASKS, baseline, path), path, meta


@query(_run_sql(_persist_sql, evaluation.autoregressive_task) + f""" SELECT u.task, CASE WHEN u.task = '1-2' THEN 'skipped' WHEN count(w.shot_id) = 0 THEN 'empty' ELSE 'done' END AS status, count(DISTINCT w.shot_id) AS n_shots,
 count(DISTINCT (w.shot_id, w.window_index)) FILTER (w.shot_id IS NOT NULL) AS n_windows FROM (SELECT unnest([{EVERY_TASK}]) AS task) u LEFT JOIN w USING (task) GROUP BY 1""")
def task_run_status(spark, d):
    return _run(spark, d, runs.persistence)[0].drop("reason")


@query(_run_sql(_mean_sql, lambda task: evaluation.mean_task(task, "view")) + f", {SHOT_LEVEL}, {TASK_LEVEL}, groups AS (SELECT task, CAST(left(task, 1) AS INTEGER) AS group_id FROM tasks)" + GROUP_ROWS)
def task_run_report(spark, d):
    _, path, meta = _run(spark, d, runs.averages("view"))
    shots = workspace.keep(metrics.shot_metrics(runs.run_metrics(spark, path, list(RUN_TASKS)), meta))
    groups = spark.createDataFrame([(name, int(name[0])) for name in RUN_TASKS], "task string, group_id int")
    return _rounded(metrics.group_report(metrics.task_rows(shots), groups), "group_id", "task", "n_shots", "level")


# ---------------------------------------------------------------- splits and batches

ORDER = "ord AS (SELECT o_orderkey AS shot_id, o_orderdate AS time, row_number() OVER (ORDER BY md5(o_orderkey || '-42'), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), split AS (SELECT shot_id, time, CASE WHEN k < floor(n * 0.1) THEN 'val' WHEN k < 2 * floor(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM ord)"


def _split(spark, d):
    return splits.split_random(views.order_shots(spark, d))


@query(f"WITH {ORDER} SELECT shot_id, split FROM split")
def split_random(spark, d):
    return _split(spark, d)


@query(f"WITH {ORDER}, f AS (SELECT shot_id, ntile(5) OVER (ORDER BY md5(shot_id || '-42'), shot_id) AS fold FROM split WHERE split <> 'test') SELECT shot_id, split = 'test' AS test, " + ", ".join(f"coalesce(fold <> {i}, false) AS fold_{i}_train, coalesce(fold = {i}, false) AS fold_{i}_val" for i in range(1, 6)) + " FROM split LEFT JOIN f USING (shot_id)")
def split_kfold(spark, d):
    return splits.kfold_flags(_split(spark, d))


@query(f"WITH {ORDER}, ranked AS (SELECT shot_id, split, row_number() OVER (PARTITION BY split ORDER BY shot_id) AS k FROM split) SELECT shot_id, split FROM ranked WHERE k <= CASE split WHEN 'train' THEN 3 ELSE 10 END")
def split_head_n(spark, d):
    return splits.head_per_split(_split(spark, d), 10, {"train": 3})


@query("WITH o AS (SELECT o_orderkey AS shot_id, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) / CAST(count(*) OVER () AS DOUBLE) AS place FROM orders) SELECT shot_id, CASE WHEN place < 0.8 THEN 'train' WHEN place < CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o")
def split_temporal(spark, d):
    return splits.split_temporal(views.order_shots(spark, d))


@query(f"WITH {ORDER} SELECT split, count(DISTINCT shot_id) AS n_shots, round(count(DISTINCT shot_id) / CAST(any_value(n) AS DOUBLE), 6) AS fraction FROM split JOIN ord USING (shot_id) GROUP BY 1")
def split_fractions(spark, d):
    return splits.split_fractions(_split(spark, d))


@query(f"WITH {ORDER} SELECT shot_id FROM split")
def split_concatenated(spark, d):
    s = _split(spark, d)
    return splits.all_shots(*(s.where(F.col("split") == x) for x in ("train", "test", "val")))


SHUFFLED = f"WITH {_window_sql(FORECAST)}, sh AS (SELECT shot_id, window_index, row_number() OVER (ORDER BY md5(shot_id || '-' || window_index || '-42'), shot_id, window_index) - 1 AS shuffle_rank FROM cuts)"


def _cut(spark, d):
    return windows.cuts(_spans(spark, d), FORECAST)


@query(SHUFFLED + " SELECT * FROM sh")
def window_shuffle(spark, d):
    return batching.shuffle(_cut(spark, d))


@query()
def window_shuffle_buffer(spark, d):
    """Windows as index ranges in the order of a buffer of 512 places, in eight parts; held against plain Python in test_passes."""
    cut = evaluation.fit_windows(_sig(spark, d), views.event_meta(spark), FORECAST, None)
    return batching.shuffle_buffer(cut, 8).select("shot_id", "window_index", "part", "position")


@query(SHUFFLED + " SELECT shot_id, window_index, CAST(shuffle_rank // 64 AS BIGINT) AS batch_id FROM sh")
def window_batch_ids(spark, d):
    return batching.batch_ids(_cut(spark, d), 64, 42)


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, window_index, CAST((row_number() OVER (ORDER BY shot_id, window_index) - 1) // 64 AS BIGINT) AS batch_id FROM cuts")
def window_batch_ids_by_shot(spark, d):
    return batching.batch_ids(_cut(spark, d), 64)


@query(SHUFFLED + " SELECT CAST(shuffle_rank // 64 AS BIGINT) AS batch_id, role, signal, count(*) AS n_values, count(value) AS n_present FROM win JOIN sh USING (shot_id, window_index) GROUP BY ALL")
def window_batches(spark, d):
    sig, meta = _sig(spark, d), views.event_meta(spark)
    cut = evaluation.fit_windows(sig, meta, FORECAST, None)  # batches are dealt without the windows' values
    out = batching.batches(evaluation.make_windows(sig, meta, FORECAST), batching.batch_ids(cut, 64, 42))
    flat = F.flatten(F.flatten("values"))
    return out.select("batch_id", "role", "signal", F.size(flat).cast("long").alias("n_values"), F.size(F.filter(flat, lambda x: x.isNotNull())).cast("long").alias("n_present"))


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, window_index, role, signal, CAST(CAST(round(CAST(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)) AS DOUBLE), 9) AS FLOAT) AS DOUBLE) AS total FROM win GROUP BY ALL")
def windows_float32(spark, d):
    made = batching.float32(_made(spark, d, FORECAST))
    seen = F.filter(F.flatten("values"), lambda x: x.isNotNull())
    total = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, x: a + x))
    return made.select("shot_id", "window_index", "role", "signal", r(total).alias("total"))


# ---------------------------------------------------------------- profiles

@query("SELECT column_name, n_present, n - n_present AS n_missing, round(100.0 * n_present / nullif(n, 0), 2) AS percent_present FROM (SELECT count(*) AS n, count(quality) AS a, count(toxic) AS b, count(d.doc_id) AS c FROM documents d LEFT JOIN labels l USING (doc_id)) t, LATERAL (VALUES ('quality', a), ('toxic', b), ('doc_id', c)) v(column_name, n_present)")
def column_coverage(spark, d):
    rows = views.read(spark, d, "documents").select("doc_id").join(views.read(spark, d, "labels"), "doc_id", "left")
    have, _ = profiling.column_choice(rows, ["quality", "toxic", "doc_id", "shot_objective"])
    return profiling.coverage(rows, have)


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def value_counts(spark, d):
    return profiling.value_counts(views.read(spark, d, "documents"), "source")


@query(r"SELECT text, min(doc_id) AS doc_id FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM documents) GROUP BY 1")
def text_normalise_dedup(spark, d):
    rows = profiling.normalise_text(views.read(spark, d, "documents").select("doc_id", "text"), ["text"])
    return profiling.keep_first(rows, ["text"], ["doc_id"]).select("text", "doc_id")


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def catalog_restricted_rows(spark, d):
    return profiling.restrict(views.read(spark, d, "documents"), views.read(spark, d, "labels"), "doc_id", ["source", "n_chars"])


@query(r"SELECT page_id, TRY_CAST(regexp_extract_all(url, '(\d+)')[-1] AS BIGINT) AS number FROM pages")
def last_number_in_path(spark, d):
    return views.read(spark, d, "pages").select("page_id", names.last_number(F.col("url")).alias("number"))


@query(f"WITH {_window_sql(FORECAST)} SELECT role, signal, count(DISTINCT (shot_id, window_index)) AS n_windows, '1x' || (max(pos) + 1) AS shape, count(*) AS n_values FROM win GROUP BY ALL")
def shape_inventory(spark, d):
    return profiling.shape_inventory(_made(spark, d, FORECAST))


COVARIANCE = f"""{VEC}, m AS (SELECT vec_id, avg(x) AS m FROM vecn GROUP BY 1), imputed AS (SELECT shot_id, vec_id, c, coalesce(x, m) AS x FROM vecn JOIN m USING (vec_id)),
 cen AS MATERIALIZED (SELECT shot_id, vec_id, c, x - avg(x) OVER (PARTITION BY c) AS x FROM imputed),
 cov0 AS MATERIALIZED (SELECT a.c AS i, b.c AS j, sum(a.x * b.x) / (count(*) - 1) AS v FROM cen a JOIN cen b USING (vec_id) GROUP BY ALL)"""


def _component_sql(k: int) -> str:
    """Eigenpairs eig(component, lambda, i, v) of cov0: power iteration whose powers come from squaring, then deflation."""
    parts = []
    for c in range(1, k + 1):
        parts.append(f"""power{c}(step, i, j, v) AS (SELECT 0, i, j, v / (SELECT sum(v) FROM cov{c - 1} WHERE i = j) FROM cov{c - 1}
 UNION ALL SELECT a.step + 1, a.i, b.i, sum(a.v * b.v) / any_value(t.s) FROM power{c} a JOIN power{c} b ON a.j = b.j, (SELECT sum(v * v) AS s FROM power{c}) t WHERE a.step < 18 GROUP BY a.step, a.i, b.i),
 last{c} AS MATERIALIZED (SELECT i, j, v FROM power{c} WHERE step = 18), vec{c} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM last{c} WHERE j = (SELECT arg_max(i, v) FROM last{c} WHERE i = j)),
 val{c} AS MATERIALIZED (SELECT sum(a.v * m.v * b.v) AS l FROM cov{c - 1} m JOIN vec{c} a ON a.i = m.i JOIN vec{c} b ON b.i = m.j),
 cov{c} AS MATERIALIZED (SELECT m.i, m.j, m.v - l * a.v * b.v AS v FROM cov{c - 1} m JOIN vec{c} a ON a.i = m.i JOIN vec{c} b ON b.i = m.j, val{c})""")
    eig = " UNION ALL ".join(f"SELECT {c} AS component, l, i, v FROM vec{c}, val{c}" for c in range(1, k + 1))
    return ",\n ".join([*parts, f"eig AS ({eig})"])


COMPONENTS = f"""WITH RECURSIVE {COVARIANCE},
 {_component_sql(5)}, ratios AS (SELECT component, any_value(l) / (SELECT sum(v) FROM cov0 WHERE i = j) AS ratio FROM eig GROUP BY 1)"""
RATIOS = COMPONENTS + " SELECT component, CAST(CAST(round(ratio, 9) AS FLOAT) AS DOUBLE) AS ratio, CAST(CAST(round(sum(ratio) OVER (ORDER BY component), 9) AS FLOAT) AS DOUBLE) AS cumulative FROM ratios"


@query(RATIOS)
def pca_variance(spark, d):
    rows = pca.stack(views.vectors(spark, d))
    return pca.explained_variance(pca.fit(rows)[1], spark).select("component", r("ratio").alias("ratio"), r("cumulative").alias("cumulative"))


@query(RATIOS)
def pca_block_variance(spark, d):
    """The same shares from passes over the rows, without a covariance matrix."""
    found = pca.block_fit(workspace.keep(pca.stack(views.vectors(spark, d))))
    return pca.variance_table(spark, found.ratios).select("component", r("ratio").alias("ratio"), r("cumulative").alias("cumulative"))


@query(COMPONENTS + """, score AS (SELECT vec_id, component, sum(x * v) AS s FROM cen JOIN eig ON i = c GROUP BY ALL), kept AS (SELECT vec_id, sum(s * s) AS s2 FROM score GROUP BY 1)
 SELECT shot_id, CAST(vec_id AS INTEGER) AS t_idx, CAST(CAST(round(sqrt(greatest(0, sum(x * x) - any_value(s2)) / count(*)), 9) AS FLOAT) AS DOUBLE) AS error FROM cen JOIN kept USING (vec_id) GROUP BY shot_id, vec_id""")
def pca_reconstruct_error(spark, d):
    return pca.reconstruction_error(pca.stack(views.vectors(spark, d))).select("shot_id", "t_idx", r("error").alias("error"))


# ---------------------------------------------------------------- access, hooks, sources and sinks, streams


@query(f"WITH {CATALOG} SELECT shot_id, signal FROM catalog_ WHERE source = 'web'")
def source_profile(spark, d):
    return scans.source_profiles(_catalog(spark, d), "web").select("shot_id", "signal")


@query(f"WITH {SIG} SELECT shot_id, t_idx, CAST(CAST(round(value, 9) AS FLOAT) AS DOUBLE) AS value FROM sig WHERE signal = 'error'")
def signal_values(spark, d):
    return scans.signal_values(_sig(spark, d), "error").select("shot_id", "t_idx", r(views.scalar()).alias("value"))


@query(f"WITH {SIG} SELECT shot_id, t_idx, time FROM sig WHERE signal = 'error'")
def signal_times(spark, d):
    return scans.signal_times(_sig(spark, d), "error")


@query(f"WITH {SIG} SELECT shot_id, signal, count(*) AS n, count(value) AS n_present FROM sig GROUP BY ALL")
def nan_ingest(spark, d):
    noisy = _sig(spark, d).withColumn("values", F.transform("values", values.to_nan))
    x = F.get(values.vector_to_null(F.col("values")), F.lit(0))
    return noisy.groupBy("shot_id", "signal").agg(F.count("*").alias("n"), F.count(x).alias("n_present"))


@query(f"WITH {_window_sql(FORECAST)} SELECT role, signal, count(*) AS n_values FROM win WHERE role <> 'output' GROUP BY ALL")
def window_role_subset(spark, d):
    return baselines.role_subset(_made(spark, d, FORECAST), "x").groupBy("role", "signal").agg(F.sum(F.size("values")).alias("n_values"))


@query(f"WITH {_window_sql(AUTO)} SELECT role, signal, count(*) AS n_values FROM win WHERE signal IN ('purchase', 'view') GROUP BY ALL")
def window_chosen_signals(spark, d):
    chosen = spark.createDataFrame([("purchase",), ("view",)], "signal string")
    return baselines.choose(_made(spark, d, AUTO), chosen).groupBy("role", "signal").agg(F.sum(F.size("values")).alias("n_values"))


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, window_index, signal, CAST(CAST(round(sum(value), 9) AS FLOAT) AS DOUBLE) AS total FROM win WHERE role = 'input' GROUP BY ALL HAVING count(value) >= 2")
def window_hook(spark, d):
    def total(pdf):
        flat = [[x for v in rows for x in v if x is not None and x == x] for rows in pdf["values"]]
        out = pdf[["shot_id", "window_index", "signal"]].assign(total=[sum(x) if len(x) >= 2 else None for x in flat])
        return out[out["total"].notna()]

    made = _made(spark, d, FORECAST).where("role = 'input'").select("shot_id", "window_index", "signal", "values")
    out = hooks.map_windows(made, total, "shot_id long, window_index int, signal string, total double")
    return windows.drop_missing(out, "total").withColumn("total", r("total"))


@query(f"WITH {SIG} SELECT shot_id, signal, t_idx, CAST(CAST(round(CASE signal WHEN 'view' THEN 2 * value WHEN 'click' THEN CASE WHEN abs(value) <= 10 THEN value END ELSE value END, 9) AS FLOAT) AS DOUBLE) AS value FROM sig")
def signal_hook(spark, d):
    out = hooks.map_signals(_sig(spark, d), {"view": lambda v: F.transform(v, lambda x: 2 * x), "click": lambda v: values.clip_to_null(v, 10.0)})
    return out.select("shot_id", "signal", "t_idx", r(views.scalar()).alias("value"))


@query(f"WITH {_window_sql(AUTO_ONLY)}, {SPARSE}, pred AS (SELECT shot_id, window_index, signal, coalesce(arg_min(value, pos) FILTER (value IS NOT NULL), 0) AS p FROM win WHERE role = 'input' GROUP BY ALL), {ERRORS}" + WM_ROWS)
def predictor_hook(spark, d):
    def first_value(made, meta, task):
        seen = F.filter(baselines.channel(F.col("values"), 0), lambda x: x.isNotNull())
        return made.where("role = 'input'").select("shot_id", "window_index", "signal", F.array_repeat(F.array(F.coalesce(F.get(seen, F.lit(0)), F.lit(0.0))), int(task["output_length"])).alias("prediction"))

    sig = _sig(spark, d)
    return _metric_rows(evaluation.evaluate(sig, views.event_meta(spark), "first", AUTO_ONLY, first_value))


@query(REPORT + f" SELECT task, feature_name, n_shots, {ROUND_SQL} FROM (SELECT *, task AS feature_name FROM tasks WHERE task = 'persist')")
def summary_from_windows(spark, d):
    meta = views.event_meta(spark, _sig(spark, d))
    return _rounded(metrics.summary("windows", _persisted(spark, d), meta), "task", "feature_name", "n_shots")


@query(REPORT + f" SELECT task, n_shots, {ROUND_SQL} FROM tasks")
def summary_from_shots_csv(spark, d):
    path = workspace.folder(spark)
    tables.write_csv(_shots(spark, d), path, "task")
    return _rounded(metrics.summary("shots", tables.read_metrics(spark, path, "shots")), "task", "n_shots")


@query(f"WITH {STATS} SELECT variable, count(*) AS n, CAST(CAST(round(sum(mean), 9) AS FLOAT) AS DOUBLE) AS total FROM stats GROUP BY 1")
def shot_stats_csv(spark, d):
    path = workspace.folder(spark)
    tables.write_csv(_stats(spark, d, True), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("variable").agg(F.count("*").alias("n"), r(F.sum(names.number(F.col("mean")))).alias("total"))


@query(f"WITH {ORDER} SELECT split, count(*) AS n FROM split GROUP BY 1")
def split_csv(spark, d):
    path = workspace.folder(spark)
    tables.write_csv(splits.split_flags(_split(spark, d)), path)
    parts = [df.select(F.lit(s).alias("split")) for s, df in tables.read_splits(spark, path).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {_window_sql(FORECAST)} SELECT role, count(*) AS n_values, count(value) AS n_present FROM win GROUP BY ALL")
def windows_written(spark, d):
    path = workspace.folder(spark)
    tables.write_windows_float32(_made(spark, d, FORECAST), path)
    flat = F.flatten("values")
    return spark.read.parquet(path).groupBy("role").agg(F.sum(F.size(flat)).alias("n_values"), F.sum(F.size(F.filter(flat, lambda x: x.isNotNull()))).alias("n_present"))


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, window_index, t_cut, role, signal, pos, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM win")
def windows_written_values(spark, d):
    """Windows written for training and read again, value by value."""
    path = workspace.folder(spark)
    tables.write_windows_float32(_made(spark, d, FORECAST), path)
    rows = spark.read.parquet(path).select("shot_id", "window_index", "t_cut", "role", "signal", F.posexplode("values").alias("pos", "v"))
    return rows.select("shot_id", "window_index", "t_cut", "role", "signal", "pos", views.scalar("v").cast("double").alias("value"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def append_sink(spark, d):
    path, rows = workspace.folder(spark), views.read(spark, d, "events").select("event_id", "event_type")
    for part in (0, 1):
        tables.append_rows(rows.where(F.col("event_id") % 2 == part), path, ["event_type", "event_id"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_window_sql(FORECAST)} SELECT shot_id, window_index, signal FROM (SELECT DISTINCT shot_id, window_index, signal FROM win) WHERE window_index < 2")
def first_windows(spark, d):
    return batching.first_windows(_made(spark, d, FORECAST, first=2), 2).select("shot_id", "window_index", "signal")


@query("SELECT o_orderkey AS shot_id, o_orderpriority AS priority, md5(o_orderkey || '-0-42') AS key, true AS in_order FROM orders")
def window_partition_order(spark, d):
    """Each partition's rows as they lie: no row's key is less than that of the row before it."""
    rows = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("shot_id"), F.lit(0).alias("window_index"), F.col("o_orderpriority").alias("priority"))
    placed = batching.per_partition_order(rows).select("shot_id", "priority", splits.seeded(F.concat_ws("-", "shot_id", "window_index"), 42).alias("key"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("key").over(Window.partitionBy("p").orderBy("at"))
    return placed.select("shot_id", "priority", "key", F.coalesce(F.col("key") >= before, F.lit(True)).alias("in_order"))


@query(WM_PERSIST + " SELECT 'persist' AS task, shot_id, feature_name, count(RMSE) AS n, CAST(CAST(round(sqrt(avg(RMSE ** 2)), 9) AS FLOAT) AS DOUBLE) AS RMSE_mean, CAST(CAST(round(avg(MAE), 9) AS FLOAT) AS DOUBLE) AS MAE_mean, CAST(CAST(round(avg(nan_fraction), 9) AS FLOAT) AS DOUBLE) AS nan_fraction_mean FROM wm WHERE RMSE IS NOT NULL AND MAE IS NOT NULL GROUP BY ALL")
def stream_metric_rollup(spark, d):
    source, out, mark = (workspace.folder(spark) for _ in range(3))
    batch = _persisted(spark, d)
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 4).parquet(source)
    live.updates_to(live.running_metrics(stream), out, mark).awaitTermination()
    done = live.finish(live.compact(spark, out, ["task", "shot_id", "feature_name"], workspace.folder(spark)))
    return done.select("task", "shot_id", "feature_name", "n", *(r(c).alias(c) for c in ("RMSE_mean", "MAE_mean", "nan_fraction_mean")))


def _rolled_up(spark, d):
    """Windows of two forecasts as a stream of files that is stopped after the first half and started again."""
    source, mark = workspace.folder(spark), workspace.folder(spark)
    every, meta = _forecasts(spark, d)
    every = workspace.keep(every)
    for half in (0, 1):
        every.where(F.pmod(F.xxhash64("shot_id", "window_index"), F.lit(2)) == half).write.mode("append").parquet(source)
        stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 64).parquet(source)
        rollup.start(rollup.rolled_up(stream, meta), mark).awaitTermination()
    return mark


@query(REPORT + f" SELECT task, feature_name, n_shots, {ROUND_SQL} FROM (SELECT * FROM signals UNION ALL BY NAME SELECT *, task AS feature_name FROM tasks)")
def stream_task_report(spark, d):
    return _rounded(rollup.report(spark, _rolled_up(spark, d)), "task", "feature_name", "n_shots")


@query(REPORT + GROUP_ROWS)
def stream_group_report(spark, d):
    return _rounded(rollup.live_group_report(spark, _rolled_up(spark, d), _groups(spark)), "group_id", "task", "n_shots", "level")


def _event_stream(spark, d, close=False):
    """The events as a stream of files; with ``close`` a last one far in the future, which lets the watermark pass the rest."""
    source = workspace.folder(spark)
    rows = views.read(spark, d, "events").select(F.col("user_id").alias("shot_id"), F.col("event_type").alias("signal"), "ts", "value")
    rows.write.parquet(source)
    if close:
        rows.limit(1).select(F.lit(-1).cast("long").alias("shot_id"), "signal", F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"), "value").write.mode("append").parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


@query("SELECT user_id AS shot_id, event_type AS signal, count(*) AS n, CAST(CAST(round(sum(value), 9) AS FLOAT) AS DOUBLE) AS total FROM events GROUP BY ALL")
def stream_append(spark, d):
    out, mark = workspace.folder(spark), workspace.folder(spark)
    live.append_to(_event_stream(spark, d), out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("shot_id", "signal").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query("""SELECT user_id AS shot_id, event_type AS signal, CAST(ts AS DATE) - CAST(k AS INTEGER) AS start, count(value) AS n, CAST(CAST(round(avg(value), 9) AS FLOAT) AS DOUBLE) AS mean, min(value) AS low, max(value) AS high
 FROM events, (SELECT unnest(generate_series(0, 2)) AS k) GROUP BY ALL""")
def stream_sliding(spark, d):
    out, mark = workspace.folder(spark), workspace.folder(spark)
    live.append_to(live.sliding(_event_stream(spark, d, close=True), "3 days", "1 day", "40 days"), out, mark).awaitTermination()
    return spark.read.parquet(out).select("shot_id", "signal", F.to_date("start").alias("start"), "n", r("mean").alias("mean"), "low", "high")


# ---------------------------------------------------------------- roles and dimensions from the data

ROLES = """seen AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS task, CASE WHEN ts < TIMESTAMP '2024-01-06' THEN 'input' ELSE 'output' END AS role, event_type AS signal FROM events),
 roles AS (SELECT *, CAST(row_number() OVER (PARTITION BY task, role ORDER BY signal) - 1 AS INTEGER) AS pos FROM seen)"""


def _roles(spark, d):
    """Each user as a task: what they do in the first five days are inputs, what they do later outputs."""
    ev = views.read(spark, d, "events")
    role = F.when(F.col("ts") < F.lit("2024-01-06").cast("timestamp_ntz"), "input").otherwise("output")
    rows = ev.groupBy(F.col("user_id").cast("string").alias("task"), role.alias("role")).agg(F.array_sort(F.collect_set("event_type")).alias("signals"))
    return rows.select("task", "role", F.posexplode("signals").alias("pos", "signal"))


@query(f"WITH {ROLES} SELECT task, r.role, o.pos, signal FROM roles o JOIN roles i USING (task, signal), (SELECT unnest(['input', 'output']) AS role) r WHERE o.role = 'output' AND i.role = 'input'")
def autoregressive_roles(spark, d):
    return baselines.autoregressive(_roles(spark, d))


@query(f"WITH {ROLES} SELECT task, role, pos, signal FROM roles WHERE role = 'output' UNION ALL SELECT DISTINCT task, 'input', 0, 'view' FROM roles WHERE role = 'output'")
def mean_roles(spark, d):
    return baselines.mean_choice(_roles(spark, d), "view")


@query(f"WITH {ROLES} SELECT DISTINCT signal FROM roles")
def requested_signals(spark, d):
    return baselines.requested_signals(_roles(spark, d))


@query(f"""WITH {ROLES}, lengths AS (SELECT task, CAST(2 + CAST(task AS BIGINT) % 4 AS DOUBLE) AS input_length, 2.5 AS output_length FROM (SELECT DISTINCT task FROM roles))
 SELECT task, role, signal, CAST(CASE role WHEN 'input' THEN input_length ELSE output_length END AS DOUBLE) AS length_s, CAST(round_even(CASE role WHEN 'input' THEN input_length ELSE output_length END, 0) AS INTEGER) AS length_n FROM roles JOIN lengths USING (task)""")
def task_window_lengths(spark, d):
    rows = _roles(spark, d)
    every = rows.select("task").distinct().select(
        "task", (F.lit(2) + F.col("task").cast("long") % 4).cast("double").alias("input_length"), F.lit(2.5).cast("double").alias("output_length"), F.lit(0.0).alias("delta"), F.lit(1.0).alias("stride")
    )
    return windows.window_lengths(rows, every, views.event_meta(spark)).select("task", "role", "signal", "length_s", "length_n")


@query(f"WITH {CATALOG} SELECT shot_id, signal FROM (SELECT DISTINCT shot_id FROM catalog_), (SELECT unnest(['web-view', 'app-error_low', 'app-none']) AS signal) EXCEPT SELECT shot_id, signal FROM catalog_")
def missing_signals(spark, d):
    return catalog.missing_pairs(_catalog(spark, d), ["web-view", "app-error_low", "app-none"])


@query("SELECT CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS INTEGER) AS channel_idx, 'line ' || l_linenumber AS channel_name FROM (SELECT DISTINCT l_linenumber FROM lineitem WHERE l_returnflag = 'R')")
def channel_names(spark, d):
    lines = views.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("signal"), (F.col("l_linenumber") - 1).alias("channel_idx"), F.concat(F.lit("line "), F.col("l_linenumber")).alias("channel_name")).distinct()
    return scans.channel_names(lines, "R")


@query("SELECT user_id AS signal, min(CASE WHEN event_type IN ('view', 'signup') THEN 'time_' || event_type END) FILTER (WHERE event_id = first_id) AS time_axis FROM (SELECT *, min(CASE WHEN event_type IN ('view', 'signup') THEN event_id END) OVER (PARTITION BY user_id) AS first_id FROM events) GROUP BY 1")
def time_axis(spark, d):
    ev = views.read(spark, d, "events")
    axis = F.when(F.col("event_type").isin("view", "signup"), F.concat(F.lit("time_"), F.col("event_type"))).otherwise(F.col("event_type"))
    return scans.time_axis(ev.select(F.col("user_id").alias("signal"), F.col("event_id").alias("pos"), axis.alias("axis")))


@query(f"WITH {STATS} SELECT shot_id, variable, n_dim_shot FROM stats ORDER BY shot_id, variable LIMIT 50")
def shot_stats_head(spark, d):
    return _stats(spark, d).orderBy("shot_id", "variable").select("shot_id", "variable", "n_dim_shot").limit(50)


# ---------------------------------------------------------------- several channels

CHANNEL_ROLES = [("input", "wide"), ("input", "pair"), ("actuator", "trio"), ("output", "wide"), ("output", "pair")]
CHANNEL_TASK = {"task_type": "markovian", "input_length": 2.0, "output_length": 1.0, "delta": 0.0, "stride": 1.0, "roles": CHANNEL_ROLES}
CHANNEL_MEAN = CHANNEL_TASK | {"roles": [("input", "wide"), ("output", "wide"), ("output", "pair")]}
CHANNEL_AUTO = evaluation.autoregressive_task(CHANNEL_TASK)
SHAPES = ", ".join(f"('{s}', {lo}, {n}, {dt})" for s, (lo, n, dt) in views.CHANNELS.items())


def _channel_sql(task: dict, test_mode: bool) -> str:
    """CTEs of the channel samples and of a task's windows (one row per window, time and channel)."""
    roles = ", ".join(f"('{a}', '{s}')" for a, s in task["roles"])
    read = ", ".join(f"'{s}'" for a, s in task["roles"] if a != "output")
    told = ", ".join(f"'{s}'" for a, s in task["roles"] if a == "output")
    lacking = f"AND shot_id IN (SELECT shot_id FROM cells WHERE signal IN ({told}) GROUP BY 1 HAVING count(DISTINCT signal) = (SELECT count(DISTINCT s) FROM (SELECT unnest([{told}]) AS s)))" if test_mode else ""
    return f"""shapes AS (SELECT * FROM (VALUES {SHAPES}) v(signal, first, width, dt)),
 vec AS (SELECT CAST(label AS BIGINT) AS shot_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, embedding FROM embeddings),
 rows AS (SELECT shot_id, vec_id, k, signal, dt, first, width, k // CAST(dt / 0.5 AS BIGINT) AS t_idx, embedding FROM vec, shapes WHERE k % CAST(dt / 0.5 AS BIGINT) = 0 AND NOT (signal = 'trio' AND shot_id % 3 = 0)),
 cells AS (SELECT shot_id, signal, t_idx, t_idx * dt AS time, c, CASE WHEN (vec_id + c) % 4 <> 0 THEN CAST(embedding[first + c + 1] AS DOUBLE) END AS x FROM rows, (SELECT unnest(generate_series(0, 3)) AS c) WHERE c < width),
 lens AS (SELECT shot_id, signal, max(t_idx) + 1 AS n FROM cells GROUP BY ALL),
 meta AS (SELECT signal, avg(x) AS mean, stddev_pop(x) AS std FROM cells GROUP BY 1), roles AS (SELECT * FROM (VALUES {roles}) v(role, signal)),
 spans AS (SELECT shot_id, min(CASE WHEN signal IN ({read}) THEN time END) AS start, max(CASE WHEN signal IN ({told}) THEN time END) AS stop FROM cells WHERE x IS NOT NULL {lacking} GROUP BY 1 HAVING start IS NOT NULL AND stop IS NOT NULL),
 cuts AS (SELECT shot_id, CAST(window_index AS INTEGER) AS window_index, CAST(start + 2.0 + window_index AS DOUBLE) AS t_cut FROM (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil(stop - 1.0 - (start + 2.0))) AS BIGINT) - 1)) AS window_index FROM spans)),
 edges AS (SELECT *, CAST(round_even(t_cut / dt, 0) AS BIGINT) AS e, CAST(round_even(2.0 / dt, 0) AS BIGINT) AS n_in, CAST(round_even(1.0 / dt, 0) AS BIGINT) AS n_out FROM cuts, roles JOIN shapes USING (signal)),
 ranges AS (SELECT *, CASE role WHEN 'output' THEN e ELSE e - n_in END AS lo, CASE role WHEN 'input' THEN e ELSE e + n_out END AS hi FROM edges),
 idx AS (SELECT *, unnest(generate_series(lo, hi - 1)) AS i FROM ranges),
 win AS (SELECT idx.shot_id, window_index, t_cut, role, idx.signal, CAST(i - lo AS INTEGER) AS pos, CAST(ch.c AS INTEGER) AS c, x AS value FROM idx JOIN (SELECT unnest(generate_series(0, 3)) AS c) ch ON ch.c < width LEFT JOIN lens ON lens.shot_id = idx.shot_id AND lens.signal = idx.signal
  LEFT JOIN cells ON cells.shot_id = idx.shot_id AND cells.signal = idx.signal AND cells.c = ch.c AND cells.t_idx = least(greatest(i, 0), n - 1))"""


def _channels(spark, d):
    return views.channel_samples(spark, d), views.channel_meta(spark, d)


CHANNEL_ERRORS = f"""{SPARSE}, wm AS (SELECT win.shot_id, win.window_index, win.signal AS feature_name, sqrt(avg((value - p) ** 2)) AS RMSE, avg(abs(value - p)) AS MAE, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS nan_fraction
 FROM win JOIN fit USING (shot_id, window_index) JOIN pred ON pred.shot_id = win.shot_id AND pred.window_index = win.window_index AND pred.signal = win.signal AND pred.c = win.c WHERE role = 'output' GROUP BY ALL)"""


@query(f"WITH {_channel_sql(CHANNEL_TASK, False)} SELECT shot_id, window_index, t_cut, role, signal, pos, c, CAST(CAST(round(value, 9) AS FLOAT) AS DOUBLE) AS value FROM win")
def channel_windows(spark, d):
    made = evaluation.make_windows(*_channels(spark, d), CHANNEL_TASK)
    rows = made.select("shot_id", "window_index", "t_cut", "role", "signal", F.posexplode("values").alias("pos", "v"))
    return rows.select("shot_id", "window_index", "t_cut", "role", "signal", "pos", F.posexplode("v").alias("c", "value")).withColumn("value", r("value"))


@query(f"WITH {_channel_sql(CHANNEL_AUTO, True)}, pred AS (SELECT shot_id, window_index, signal, c, coalesce(arg_max(value, pos) FILTER (value IS NOT NULL), any_value(mean)) AS p FROM win JOIN meta USING (signal) WHERE role = 'input' GROUP BY ALL), {CHANNEL_ERRORS}" + WM_ROWS)
def channel_metrics_persistence(spark, d):
    return _metric_rows(evaluation.evaluate(*_channels(spark, d), "channels", CHANNEL_AUTO, evaluation.persist))


@query(ORACLES["channel_metrics_persistence"])
def channel_metrics_in_blocks(spark, d):
    """Scores of shots in blocks of eight seconds."""
    return _metric_rows(evaluation.evaluate(*_channels(spark, d), "channels", CHANNEL_AUTO, evaluation.persist, block=8.0))


@query(f"WITH {_channel_sql(CHANNEL_MEAN, True)}, pred AS (SELECT DISTINCT shot_id, window_index, signal, c, mean AS p FROM win JOIN meta USING (signal) WHERE role = 'output'), {CHANNEL_ERRORS}" + WM_ROWS)
def channel_metrics_mean(spark, d):
    return _metric_rows(evaluation.evaluate(*_channels(spark, d), "channels", CHANNEL_MEAN, evaluation.mean))


@query(f"WITH {_channel_sql(CHANNEL_TASK, True)}, {SPARSE} SELECT shot_id, window_index, role, signal, CASE WHEN have THEN lo END AS lo, CASE WHEN have THEN hi END AS hi FROM (SELECT *, NOT (signal = 'trio' AND shot_id % 3 = 0) AS have FROM ranges) JOIN fit USING (shot_id, window_index)")
def channel_window_ranges(spark, d):
    """Windows as index ranges; a signal that the shot lacks has none."""
    out = evaluation.window_ranges(*_channels(spark, d), CHANNEL_TASK, False)
    return out.select("shot_id", "window_index", "role", "signal", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query(f"WITH {_channel_sql(CHANNEL_TASK, False)} SELECT shot_id, window_index, role, signal, c, count(value) AS n_present, CAST(CAST(round(arg_max(value, pos) FILTER (value IS NOT NULL), 9) AS FLOAT) AS DOUBLE) AS newest FROM win GROUP BY ALL")
def channel_major(spark, d):
    """Windows with their axes turned: a row per channel, its times in order."""
    made = evaluation.make_windows(*_channels(spark, d), CHANNEL_TASK)
    rows = made.select("shot_id", "window_index", "role", "signal", F.posexplode(values.transpose(F.col("values"))).alias("c", "v"))
    there = F.filter("v", lambda x: x.isNotNull())
    return rows.select("shot_id", "window_index", "role", "signal", "c", F.size(there).cast("long").alias("n_present"), r(F.try_element_at(there, F.lit(-1))).alias("newest"))


PROBE_TASK = {"task_type": "markovian", "input_length": 1024.0, "output_length": 128.0, "delta": 0.0, "stride": 256.0, "roles": [("input", "probe"), ("output", "slow")]}


@query("""WITH vec AS (SELECT CAST(label AS BIGINT) AS shot_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, embedding FROM embeddings),
 wave AS (SELECT shot_id, k * 64 + j AS t, ch, CAST(embedding[CASE ch WHEN 0 THEN j + 1 ELSE 64 - j END] AS DOUBLE) AS x FROM vec, (SELECT unnest(generate_series(0, 63)) AS j), (SELECT unnest([0, 1]) AS ch)),
 f AS (SELECT shot_id, ch, t // 512 AS frame, t % 512 AS n, x * (1 - cos(2 * pi() * (t % 512) / 511)) / 2 AS y FROM wave QUALIFY count(*) OVER (PARTITION BY shot_id, ch, t // 512) = 512),
 dft AS (SELECT shot_id, ch, frame, b, sum(y * cos(2 * pi() * ((b * n) % 512) / 512)) AS re, sum(y * sin(2 * pi() * ((b * n) % 512) / 512)) AS im FROM f, (SELECT unnest(generate_series(0, 255)) AS b) GROUP BY ALL),
 raw AS (SELECT shot_id, 'probe' AS signal, frame AS t_idx, frame * 512 + 511.0 AS time, CAST(ch * 256 + b AS INTEGER) AS c, re * re + im * im AS x FROM dft UNION ALL SELECT shot_id, 'slow', k, k * 64.0, 0, CAST(embedding[1] AS DOUBLE) FROM vec),
 meta AS (SELECT signal, avg(x) AS mean, stddev_pop(x) AS std FROM raw GROUP BY 1), cells AS (SELECT shot_id, signal, t_idx, time, c, (x - mean) / std AS x FROM raw JOIN meta USING (signal)),
 ends AS (SELECT shot_id, signal, min(time) AS t0, max(time) AS t1, max(t_idx) + 1 AS n FROM cells GROUP BY ALL),
 cuts AS (SELECT shot_id, unnest(generate_series(0, CAST(greatest(0, ceil((stop - 128.0 - start - 1024.0) / 256.0)) AS BIGINT) - 1)) AS w, start + 1024.0 + 256.0 * w AS t_cut FROM (SELECT p.shot_id, p.t0 AS start, s.t1 AS stop FROM ends p JOIN ends s ON p.shot_id = s.shot_id AND p.signal = 'probe' AND s.signal = 'slow')),
 idx AS (SELECT c.shot_id, w, t_cut, signal, n, CAST(round_even((t_cut - t0) / CASE signal WHEN 'probe' THEN 512.0 ELSE 64.0 END, 0) AS BIGINT) AS e, pos FROM cuts c JOIN ends USING (shot_id), (SELECT unnest([0, 1]) AS pos))
 SELECT i.shot_id, CAST(w AS INTEGER) AS window_index, t_cut, CASE i.signal WHEN 'probe' THEN 'input' ELSE 'output' END AS role, i.signal, CAST(pos AS INTEGER) AS pos, c, round(x, 6) + 0.0 AS value
 FROM idx i JOIN cells ON cells.shot_id = i.shot_id AND cells.signal = i.signal AND cells.t_idx = least(greatest(CASE i.signal WHEN 'probe' THEN e - 2 ELSE e END + pos, 0), n - 1)""")
def windows_of_spectra(spark, d):
    """A fast signal's spectra (support 512) as inputs beside a slow output, through their transform plans."""
    samples, members = views.probe_samples(spark, d), {"probe": ["probe"]}
    plain = spark.createDataFrame([("probe", 512.0, [2, 256], None, None), ("slow", 64.0, [1], None, None)], "signal string, dt double, values_shape array<int>, mean double, std double")
    cells = transforms.prepared(samples, plain, members, scale=False).select("signal", F.explode("values").alias("x"))
    meta = plain.drop("mean", "std").join(cells.groupBy("signal").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")), "signal")
    made = evaluation.make_transformed(samples, meta, PROBE_TASK, members)
    rows = made.select("shot_id", "window_index", "t_cut", "role", "signal", F.posexplode("values").alias("pos", "v"))
    return rows.select("shot_id", "window_index", "t_cut", "role", "signal", "pos", F.posexplode("v").alias("c", "value")).withColumn("value", F.round("value", 6) + 0.0)


# ---------------------------------------------------------------- sinks, dimensions and plans on whole tables


@query(f"WITH {_window_sql(FORECAST)}, {SPARSE}, odd AS (SELECT DISTINCT shot_id FROM sig WHERE shot_id % 3 <> 0) SELECT shot_id, window_index FROM fit SEMI JOIN odd USING (shot_id)")
def windows_test_mode(spark, d):
    """Shots that lack the samples of an output give no windows in test mode."""
    sig = _sig(spark, d).where("not (shot_id % 3 = 0 and signal = 'error')")
    return evaluation.fit_windows(sig, views.event_meta(spark), FORECAST).select("shot_id", "window_index")


@query(REPORT + """, joined AS (SELECT * FROM tasks JOIN groups USING (task)) SELECT 'windows' AS level, count(*) AS n FROM w UNION ALL SELECT 'shots', count(*) FROM sm UNION ALL SELECT 'signals', count(*) FROM signals
 UNION ALL SELECT 'tasks', count(*) FROM tasks UNION ALL SELECT 'groups', (SELECT count(*) FROM joined) + (SELECT count(DISTINCT group_id) FROM joined)""")
def metric_levels_csv(spark, d):
    every, meta = _forecasts(spark, d)
    paths = tables.write_levels(every, meta, _groups(spark), workspace.folder(spark))
    parts = [spark.read.option("header", True).csv(path).agg(F.lit(level).alias("level"), F.count("*").alias("n")) for level, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {SIG}, {META} SELECT signal, 1.0::DOUBLE AS dt, CAST(CAST(round(mean, 9) AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(round(std, 9) AS FLOAT) AS DOUBLE) AS std FROM meta")
def yaml_signal_meta(spark, d):
    path = workspace.folder(spark)
    tables.write_mapping(views.event_meta(spark, _sig(spark, d)), "signal", path)
    return tables.signal_meta(spark, tables.read_mapping(spark, path)).select("signal", "dt", r("mean").alias("mean"), r("std").alias("std"))


@query(f"WITH {ZOUT} SELECT shot_id, signal FROM zout")
def yaml_outliers(spark, d):
    path = workspace.folder(spark)
    lists = stats.outlier_list(_zout(spark, d)).select("shot_id", F.col("signals").alias("list"))
    tables.write_mapping(lists, "shot_id", path)
    return tables.outlier_pairs(spark, {k: v["list"] for k, v in tables.read_mapping(spark, path).items()})


@query(f"WITH {ORDER} SELECT shot_id, time FROM split WHERE split = 'val'")
def split_members(spark, d):
    return splits.members(views.order_shots(spark, d), _split(spark, d), "val")


@query("SELECT CAST(user_id AS VARCHAR) AS task, CAST(user_id % 4 + 1 AS INTEGER) AS group_id, CASE WHEN user_id % 4 > 1 THEN 'non_markovian' ELSE 'markovian' END AS task_type, CAST(count(DISTINCT event_type) AS DOUBLE) AS input_length FROM events GROUP BY user_id")
def task_catalogue(spark, d):
    ev = views.read(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").cast("double").alias("input_length"))
    rows = ev.select(
        F.col("user_id").cast("string").alias("task"), (F.col("user_id") % 4 + 1).cast("int").alias("group_id"), F.when(F.col("user_id") % 4 > 1, "non_markovian").otherwise("markovian").alias("task_type"),
        "input_length", F.lit(1.0).alias("output_length"), F.lit(0.0).alias("delta"), F.lit(1.0).alias("stride"),
    )
    return profiling.task_catalogue(rows).select("task", "group_id", "task_type", "input_length")


@query(f"WITH {VEC} SELECT vec_id, CAST(c AS INTEGER) AS c, CAST(CAST(round(CASE WHEN vec_id % 10 = 0 THEN NULL WHEN abs(20 * x) <= 2 THEN 20 * x ELSE 0 END, 9) AS FLOAT) AS DOUBLE) AS x FROM vecn WHERE vec_id % 10 <> 0")
def compose_transform(spark, d):
    """Steps in order; a vector that the first step turns into NULL stays NULL."""
    steps = values.compose(lambda v: F.when(F.col("vec_id") % 10 != 0, F.transform(v, lambda x: 20 * x)), values.clip_to_null, lambda v: F.transform(v, lambda x: F.coalesce(x, F.lit(0.0))))
    return _cells(views.vectors(spark, d).withColumn("values", steps(F.col("values"))))


@query("""WITH w AS (SELECT vec_id AS shot_id, generate_subscripts(embedding, 1) - 1 AS t, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), f AS (SELECT shot_id, t // 16 AS frame, t % 16 AS n, x * (1 - cos(2 * pi() * (t % 16) / 15)) / 2 AS y FROM w),
 dft AS (SELECT shot_id, frame, k, sum(y * cos(2 * pi() * k * n / 16)) AS re, sum(y * sin(2 * pi() * k * n / 16)) AS im FROM f, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY ALL), p AS (SELECT *, re * re + im * im AS power FROM dft),
 m AS (SELECT avg(power) AS mean, stddev_pop(power) AS std FROM p) SELECT shot_id, CAST(frame AS INTEGER) AS frame, CAST(k AS INTEGER) AS bin, round((power - mean) / std, 5) AS x FROM p, m""")
def stft_plan(spark, d):
    """Spectra inside the transform plan: made first, then standardised with statistics of spectrum space."""
    waves, members = views.waves(spark, d), {"probe": ["wave"]}
    spectrum = workspace.keep(transforms.apply_spectra(waves, None, members, scale=False, support=16))
    meta = spectrum.select("signal", F.explode("values").alias("x")).groupBy("signal").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    out = transforms.apply_spectra(waves, meta, members, support=16)
    return out.select("shot_id", "frame", F.posexplode("values").alias("bin", "x")).withColumn("x", F.round("x", 5))


@query(f"WITH {VEC}, m AS (SELECT vec_id, avg(x) AS m FROM vecn GROUP BY 1) SELECT vecn.shot_id, CAST(vec_id AS INTEGER) AS t_idx, CAST(c AS INTEGER) AS c, CAST(CAST(round(coalesce(x, m), 9) AS FLOAT) AS DOUBLE) AS x FROM vecn JOIN m USING (vec_id)")
def pca_stack(spark, d):
    return pca.stack(views.vectors(spark, d)).select("shot_id", "t_idx", F.posexplode("values").alias("c", "x")).withColumn("x", r("x"))


@query(f"WITH {VEC}, m AS (SELECT vec_id, avg(x) AS m FROM vecn GROUP BY 1) SELECT vecn.shot_id, CAST(vec_id AS INTEGER) AS t_idx, CAST(c AS INTEGER) AS c, round(coalesce(x, m), 4) AS x FROM vecn JOIN m USING (vec_id)")
def pca_round_trip(spark, d):
    """All components together restore the rows."""
    back = pca.reconstruct(pca.stack(views.vectors(spark, d)), 64)
    return back.select("shot_id", "t_idx", F.posexplode("restored").alias("c", "x")).withColumn("x", F.round("x", 4))


@query(f"WITH {VEC}, m AS (SELECT vec_id, avg(x) AS m FROM vecn GROUP BY 1), full_ AS (SELECT vec_id, c, coalesce(x, m) AS x FROM vecn JOIN m USING (vec_id)) SELECT round(sum(v), 6) AS trace, 64::BIGINT AS components, 1.0::DOUBLE AS ratio FROM (SELECT c, var_samp(x) AS v FROM full_ GROUP BY 1)")
def pca_trace(spark, d):
    """The variances of all components add up to those of the channels."""
    return pca.trace(pca.stack(views.vectors(spark, d)), 64).select(F.round("trace", 6).alias("trace"), "components", F.round("ratio", 6).alias("ratio"))
