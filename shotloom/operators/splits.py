"""Train, validation and test splits, folds, and reproducible orders.

A seeded order is that of md5(id-seed): the same on any engine and for any partitioning.  Ranks over all shots use the
hash's leading digits as buckets, so that no single task has to order the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import workspace

def seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def global_rank(df: DataFrame, order: list[Column], bucket: Column) -> DataFrame:
    """``df`` with _rank (0-based) under ``order``; ``bucket`` is a coarse key that never decreases along it."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets, not the rows
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(sizes, "_bucket").withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def range_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with _rank (0-based) by the columns ``order``, which must tell all rows apart.

    Rows go to range partitions, are sorted there and written once, each numbered inside its partition; a row per partition then
    says how many come before it.  So no window and no task sees more than a partition's rows."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = workspace.keep(dealt.withColumn("_id", F.monotonically_increasing_id()))  # partition and place; written, as another run may draw other ranges
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over partitions
    offsets = sizes.select("_part", before.alias("_before"))
    rows = numbered.withColumns({"_part": part, "_place": place})
    return rows.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + F.col("_place")).drop("_id", "_part", "_place", "_before")


def seeded_rank(shots: DataFrame, seed: int, id_col: str = "shot_id") -> DataFrame:
    key = seeded(F.col(id_col), seed)
    return global_rank(shots, [key, F.col(id_col)], F.substring(key, 1, 4))


def split_random(shots: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """(shot_id, split): floor(n * fraction) shots each for val and test, the rest for train; sizes are exact."""
    size = F.floor(F.col("_n") * fraction)
    n = shots.agg(F.count("*").alias("_n"))
    ranked = seeded_rank(shots.select("shot_id"), seed).join(F.broadcast(n))  # one row
    split = F.when(F.col("_rank") < size, "val").when(F.col("_rank") < 2 * size, "test").otherwise("train")
    return ranked.select("shot_id", split.alias("split"))


def folds(shots: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(shot_id, fold): k folds whose sizes differ by one at most, the larger ones first."""
    n = shots.agg(F.count("*").alias("_n"))
    ranked = seeded_rank(shots.select("shot_id"), seed).join(F.broadcast(n))  # one row
    big, small = F.col("_n") % k, F.floor(F.col("_n") / k)
    edge = big * (small + 1)
    fold = F.when(F.col("_rank") < edge, F.floor(F.try_divide(F.col("_rank"), small + 1))).otherwise(big + F.floor(F.try_divide(F.col("_rank") - edge, small)))
    return ranked.select("shot_id", (fold + 1).cast("int").alias("fold"))


def kfold_flags(splits: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(shot_id, test, fold_i_train, fold_i_val): folds over train and val; the test shots are shared.  splits: (shot_id, split)."""
    made = folds(splits.where("split <> 'test'"), k, seed)
    rows = splits.select("shot_id", (F.col("split") == "test").alias("test")).join(made, "shot_id", "left")
    flags = [c for i in range(1, k + 1) for c in (F.coalesce(F.col("fold") != i, F.lit(False)).alias(f"fold_{i}_train"), F.coalesce(F.col("fold") == i, F.lit(False)).alias(f"fold_{i}_val"))]
    return rows.select("shot_id", "test", *flags)


def members(rows: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Rows of the shots that belong to a split."""
    return rows.join(splits.where(F.col("split") == split).select("shot_id"), "shot_id", "left_semi")


def head_per_split(splits: DataFrame, most: int | None = None, per_split: dict[str, int] | None = None, seed: int | None = None, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """The first shots of each named split, by id or in a seeded order; a split's own limit wins; none or <= 0 means all.

    Each split is a limit of its own, so a task keeps as many rows as are wanted and never sorts a whole split."""
    order = [seeded(F.col("shot_id"), seed), F.col("shot_id")] if seed is not None else [F.col("shot_id")]
    parts = []
    for name in names:
        rows, own = splits.where(F.col("split") == name), (per_split or {}).get(name)
        limit = most if own is None else own
        parts.append(rows.orderBy(*order).limit(limit) if limit and limit > 0 else rows)
    return reduce(DataFrame.unionByName, parts)


def split_temporal(shots: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(shot_id, split) by time: the earliest for train, the latest for test.  shots: (shot_id, time).  Shots of one time are
    ordered by id, so a campaign that fills a day is cut like any other."""
    n = shots.agg(F.count("*").alias("_n"))
    ranked = range_rank(shots.select("shot_id", "time"), ["time", "shot_id"]).join(F.broadcast(n))  # one row
    at = F.col("_rank") / F.col("_n")
    return ranked.select("shot_id", F.when(at < train, "train").when(at < train + val, "val").otherwise("test").alias("split"))


def split_fractions(splits: DataFrame) -> DataFrame:
    """Shots and share of each split."""
    sizes = splits.groupBy("split").agg(F.count_distinct("shot_id").alias("n_shots"))
    total = sizes.agg(F.sum("n_shots").alias("_n"))
    return sizes.join(F.broadcast(total)).select("split", "n_shots", F.round(F.try_divide("n_shots", "_n"), 6).alias("fraction"))  # one row


def split_flags(splits: DataFrame) -> DataFrame:
    return splits.select("shot_id", *((F.col("split") == s).alias(s) for s in ("train", "val", "test")))


def all_shots(*parts: DataFrame) -> DataFrame:
    """Train, test and val lists one after the other."""
    out = parts[0].select("shot_id")
    for p in parts[1:]:
        out = out.unionAll(p.select("shot_id"))
    return out
