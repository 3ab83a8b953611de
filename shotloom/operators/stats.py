"""Statistics per shot, pooled over shots, and the outlier lists that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import workspace
from .clean import is_outlier


HELD = 1_000_000  # cells of a (shot, variable) whose counted values an aggregate may hold
BUCKETS, FEW = 1024, 10_000
LEAST_PARTS = 16  # of a range, unless there are fewer buckets


def shot_stats(cells: DataFrame, median: bool = True, held: int = HELD) -> DataFrame:
    """Statistics of each (shot, variable) over cells (shot_id, variable, value); missing cells count only as such.

    All are combined before the shuffle.  The exact median of a group is an aggregate over its counted values, but for groups
    of over ``held`` cells (a thousandth of all cells, if that is more: a thousand groups at most), whose median is selected
    by passes that count.  Leave the median out where it is not needed."""
    x, keys = F.col("value"), ["shot_id", "variable"]
    sums = [F.count("*").alias("n_dim_shot"), F.count_if(x.isNull()).alias("n_nans_shot"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max")]
    if not median:
        return cells.groupBy(*keys).agg(*sums)
    sizes = cells.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    large = sizes.where(F.col("n") > held)
    if large.isEmpty():
        return cells.groupBy(*keys).agg(*sums, F.median(x).alias("median"))
    edge = max(held, sizes.agg(F.sum("n")).first()[0] // 1000)
    large = workspace.keep(sizes.where(F.col("n") > edge))
    small = cells.join(F.broadcast(large.select(*keys)), keys, "left_anti")  # a thousand groups at most
    middle = small.groupBy(*keys).agg(F.median(x).alias("median")).unionByName(selected_medians(cells, large))
    return cells.groupBy(*keys).agg(*sums).join(middle, keys, "left")


def parts_of(n: Column, buckets: int, few: int) -> Column:
    """Equal parts of a range of n cells: four for every ``few`` cells."""
    return F.least(F.lit(buckets), F.greatest(F.lit(LEAST_PARTS), F.ceil(n / few) * 4))


def selected_medians(cells: DataFrame, groups: DataFrame, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(shot_id, variable, median), exact, of a small table of groups (shot_id, variable, n, lo, hi), by distributed selection.

    Of each group one or two ranks are sought.  A pass counts the cells between lo and hi by equal parts of that range; the parts
    that hold a rank, down to their least and largest cell, are the next ranges: one if both ranks lie in it.  lo and hi lie in
    different parts, so ranges shrink until they hold one value or ``few`` cells, which are then put in order: after two or three
    passes for most data.  A range has some parts for every ``few`` of its cells, ``buckets`` at most, so that counts are far fewer
    than the cells.  No pass but the last moves cells."""
    x, keys = F.col("value"), ["shot_id", "variable"]
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    columns = [*keys, "ranks", "n", "lo", "hi"]
    state = workspace.keep(groups.where("n > 0").withColumn("ranks", ranks).select(columns))
    wide = (F.col("lo") < F.col("hi")) & (F.col("n") > few)
    while not (rest := state.where(wide)).isEmpty():
        ranges = rest.withColumn("parts", parts_of(F.col("n"), buckets, few))
        part = F.least(F.col("parts") - 1, F.floor((x / 2 - F.col("from") / 2) / (F.col("to") / 2 - F.col("from") / 2) * F.col("parts")))
        bounds = ranges.select(*keys, F.col("lo").alias("from"), F.col("hi").alias("to"), "parts")
        inside = cells.join(F.broadcast(bounds), keys).where(x.between(F.col("from"), F.col("to")))  # two ranges a group at most
        counts = inside.groupBy(*keys, "from", "to", part.alias("part")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "from", "to").orderBy("part"))  # over the parts of a range
        sought = ranges.select(*keys, F.col("lo").alias("from"), F.col("hi").alias("to"), "ranks")
        placed = counts.withColumn("before", upto - F.col("n")).join(F.broadcast(sought), [*keys, "from", "to"])
        here = F.transform(F.filter("ranks", lambda k: (k > F.col("before")) & (k <= F.col("before") + F.col("n"))), lambda k: k - F.col("before"))
        narrowed = placed.withColumn("ranks", here).where(F.size("ranks") > 0).select(columns)
        state = workspace.keep(state.where(~wide).unionByName(narrowed))
    left = state.where("lo < hi").select(*keys, "ranks", F.col("lo").alias("from"), F.col("hi").alias("to"))
    inside = cells.join(F.broadcast(left), keys).where(x.between(F.col("from"), F.col("to")))
    ordered = inside.groupBy(*keys, "from").agg(F.array_sort(F.collect_list(x)).alias("few"), F.first("ranks").alias("ranks"))
    found = ordered.select(*keys, F.explode(F.transform("ranks", lambda k: F.element_at("few", k.cast("int")))).alias("at"))
    single = state.where("lo = hi").select(*keys, F.explode(F.transform("ranks", lambda k: F.col("lo"))).alias("at"))
    return single.unionByName(found).groupBy(*keys).agg(F.avg("at").alias("median"))


def pooled(stats: DataFrame) -> DataFrame:
    """Mean and population variance of all cells of a variable, from the statistics of its shots.

    One pass: the sums of w, w*mean and w*(variance + mean^2) give both; shifted by the variable's largest mean, so that
    a mean far from zero costs no digits."""
    shifted = stats.withColumn("w", (F.col("n_dim_shot") - F.col("n_nans_shot")).cast("double"))
    shift = shifted.groupBy("variable").agg(F.max("mean").alias("shift"))
    d = F.col("mean") - F.col("shift")
    sums = shifted.join(F.broadcast(shift), "variable").groupBy("variable").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * d).alias("s1"), F.sum(F.col("w") * (F.col("variance") + d * d)).alias("s2"), F.max("shift").alias("shift")
    )
    mean = F.try_divide("s1", "w")
    return sums.select("variable", (F.col("shift") + mean).alias("global_mean"), F.greatest(F.lit(0.0), F.try_divide("s2", "w") - mean * mean).alias("global_variance"))


def zscores(stats: DataFrame, pool: DataFrame) -> DataFrame:
    """Each shot's mean against the pooled cells; NULL if either is unknown."""
    out = stats.join(F.broadcast(pool), "variable", "left")
    return out.withColumn("z", F.try_divide(F.col("mean") - F.col("global_mean"), F.sqrt("global_variance")))


def two_stage(stats: DataFrame, limit: float = 6.0) -> DataFrame:
    """Pooled mean and standard deviation, without the shots that stand out of the first pooling."""
    kept = zscores(stats, pooled(stats)).where(~is_outlier(F.col("z"), limit)).select(stats.columns)
    return pooled(kept).select("variable", F.col("global_mean").alias("mean"), F.sqrt("global_variance").alias("std"))


def outlier_pairs(stats: DataFrame, reference: DataFrame, limit: float = 12.0) -> DataFrame:
    """(shot_id, signal) whose mean is more than ``limit`` deviations off.  reference: (variable, mean, std)."""
    pool = reference.select("variable", F.col("mean").alias("global_mean"), F.pow("std", F.lit(2.0)).alias("global_variance"))
    return zscores(stats, pool).where(is_outlier(F.col("z"), limit)).select("shot_id", F.col("variable").alias("signal"))


def outlier_list(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("shot_id").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def outlier_union(*pairs: DataFrame) -> DataFrame:
    out = pairs[0].select("shot_id", "signal")
    for p in pairs[1:]:
        out = out.unionByName(p.select("shot_id", "signal"))
    return out.distinct()


def flags_to_outliers(flags: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """(shot_id, signal) pairs from boolean flag columns, each of which stands for a list of signals."""
    names = [F.when(F.col(f"`{flag}`"), F.array(*map(F.lit, signals))).otherwise(F.array().cast("array<string>")) for flag, signals in mapping.items()]
    return flags.select("shot_id", F.explode(F.array_distinct(F.concat(*names))).alias("signal"))


def outlier_counts(z: DataFrame, limit: float) -> DataFrame:
    hit = is_outlier(F.col("z"), limit)
    return z.agg(F.count_if(hit).alias("n_outliers"), F.count_distinct(F.when(hit, F.col("variable"))).alias("n_variables"), F.count_distinct(F.when(hit, F.col("shot_id"))).alias("n_shots"))


def time_steps(samples: DataFrame) -> DataFrame:
    w = Window.partitionBy("shot_id", "signal").orderBy("t_idx")
    return samples.withColumn("step", F.col("time") - F.lag("time").over(w))


def first_shots(samples: DataFrame, order: DataFrame) -> DataFrame:
    """(signal, shot_id): the first shot in the given order (shot_id, pos) that has a sample of the signal."""
    there = samples.select("signal", "shot_id").distinct().join(order, "shot_id")
    return there.groupBy("signal").agg(F.min(F.struct("pos", "shot_id"))["shot_id"].alias("shot_id"))


def signal_dt(samples: DataFrame, order: DataFrame) -> DataFrame:
    """Sampling interval of each signal: the median step of its first shot, to six digits."""
    first = samples.join(F.broadcast(first_shots(samples, order)), ["signal", "shot_id"], "left_semi")
    return time_steps(first).groupBy("signal").agg(F.round(F.median("step"), 6).alias("dt"))


def first_shot_meta(samples: DataFrame, order: DataFrame) -> DataFrame:
    """(signal, shot_id, dt, n_channels) of each signal's first shot."""
    first = samples.join(F.broadcast(first_shots(samples, order)), ["signal", "shot_id"], "left_semi")
    return time_steps(first).groupBy("signal", "shot_id").agg(F.round(F.median("step"), 6).alias("dt"), F.max(F.size("values")).alias("n_channels"))
