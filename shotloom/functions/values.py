"""Column functions on values, channel vectors and packed series.  Missing values are NULL inside the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: inside a lambda, an expression would be computed anew for each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def to_null(x: Column) -> Column:
    """NaN becomes NULL: Spark's aggregates skip only NULL."""
    return F.when(~F.isnan(x), x)


def to_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))


def vector_to_null(v: Column) -> Column:
    return F.transform(v, to_null)


def sample_count(length: Column | float, dt: Column) -> Column:
    """Number of samples in a length of time, rounded half to even."""
    length = F.lit(float(length)) if isinstance(length, (int, float)) else length
    return F.rint(F.try_divide(length, dt)).cast("int")


def index_range(lo: Column, hi: Column) -> Column:
    """lo, lo + 1, ... hi - 1; empty if hi <= lo (sequence would count down)."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))


def standardise(v: Column, mean: Column, std: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x - mean, std))


def clip_to_null(v: Column, limit: float = 2.0) -> Column:
    """Values outside [-limit, limit] are not physical and become missing."""
    return F.transform(v, lambda x: F.when(F.abs(x) <= limit, x))


def zero_fill(v: Column) -> Column:
    """Missing channels become 0, unless every channel is missing."""
    return F.when(F.forall(v, lambda x: x.isNull()), v).otherwise(F.transform(v, lambda x: F.coalesce(x, F.lit(0.0))))


def impute_mean(v: Column) -> Column:
    """Missing channels become the mean of the others at the same time."""
    return let(mean_of(v), lambda mean: F.transform(v, lambda x: F.coalesce(x, mean)))


def resample(v: Column, n: int = 170) -> Column:
    """n points by linear interpolation over the values that are there; all missing stays missing."""

    def points(seen: Column) -> Column:
        def point(i: Column) -> Column:
            at = i * (F.size(seen) - 1) / F.lit(float(n - 1))
            lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
            return F.get(seen, lo) + (at - lo) * (F.get(seen, hi) - F.get(seen, lo))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)

    return let(F.filter(v, lambda x: x.isNotNull()), points)


def transpose(v: Column) -> Column:
    """Time x channels to channels x time, or back."""
    return F.transform(index_range(F.lit(0), F.size(F.get(v, F.lit(0)))), lambda c: F.transform(v, lambda row: F.get(row, c)))


def any_present(v: Column) -> Column:
    """A time is valid if one of its channels is there."""
    return F.exists(v, lambda x: x.isNotNull())


def mean_of(values: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    """Mean of f(x) over the values that are there; NULL without any."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    step = lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["s"] + f(x)).alias("s"), (a["n"] + 1.0).alias("n")))
    return F.aggregate(values, start, step, lambda a: F.try_divide(a["s"], a["n"]))


def compose(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Steps in order; a NULL stays NULL through all of them."""

    def run(x: Column) -> Column:
        for step in steps:
            x = F.when(x.isNotNull(), step(x))
        return x

    return run
