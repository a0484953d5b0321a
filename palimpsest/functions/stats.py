"""Statistics: exact quantiles, distributions, fits. Nothing gathers a group of unbounded size in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds (bytes, exclusive) of the size classes of files.
SIZE_BUCKETS = (("small", 1_000), ("medium", 10_000), ("large", 100_000))


def size_bucket(n: Column) -> Column:
    out = None
    for name, bound in SIZE_BUCKETS:
        out = F.when(n < bound, name) if out is None else out.when(n < bound, name)
    return out.otherwise("xlarge")


def log2_bucket(n: Column) -> Column:
    """Bucket b holds [2**b, 2**(b + 1))."""
    return (F.length(F.bin(n)) - 1).cast("int")


def safe_percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


#: Ranges that a group of any size is cut into.
RANGES = 64


def in_ranges(df: DataFrame, by: list[str], value: str, of: DataFrame | None = None, n: int = RANGES) -> DataFrame:
    """df with _part, the range (from 0) of each row's value, by bounds that cut the values of its group (in `of`, or df) into n parts of about equal size.

    The bounds of a group are n numbers at most, found by sketches, so groups of any scale are cut alike; equal values of a group share a range.
    """
    bounds = (of or df).groupBy(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by))).agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], F.lit(1000)))).alias("_bounds"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_b{i}"))
    part = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(value).cast("double"))), F.lit(0))
    return df.join(bounds, same, "left").withColumn("_part", part).select(*df.columns, "_part")


def _offsets(dealt: DataFrame, by: list[str], size: Column) -> DataFrame:
    """(_p, _by..., _before, _total): of each range of a group, what lies before it, and the whole group."""
    sizes = dealt.groupBy("_part", *by).agg(size.alias("_size"))
    upto = Window.partitionBy(*by).orderBy("_part")
    return sizes.select(
        F.col("_part").alias("_p"),
        *(F.col(c).alias(f"_{c}") for c in by),
        (F.sum("_size").over(upto) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*by)).alias("_total"),
    )


def _placed(dealt: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    met = F.col("_part") == F.col("_p")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return dealt.join(offsets, met)


def ranked(df: DataFrame, by: list[str], value: str, ties: list[str] = (), rank: str = "rank", count: str = "n") -> DataFrame:
    """df with the rank (from 1) of each row's value within its group, and the group's size.

    A group is ranked in RANGES ranges of its values, each on its own; the sizes of the ranges before one, a few
    numbers, are added. So a group of any size spreads over many tasks, as far as its values differ.
    """
    dealt = in_ranges(df, by, value)
    local = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *by).orderBy(value, *ties)))
    placed = _placed(local, _offsets(dealt, by, F.count("*")), by)
    return placed.select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(rank), F.col("_total").cast("long").alias(count))


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], linear: bool = False) -> DataFrame:
    """(by..., one column for each quantile) exactly: the nearest value, or the linear interpolation of the two nearest.

    Equal values are counted first, and counts are summed up by ranges of values as in ranked().
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    dealt = in_ranges(counted, by, value, df)
    own = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = _placed(dealt.withColumn("_upto", F.sum("_n").over(own)), _offsets(dealt, by, F.sum("_n")), by)
    placed = placed.withColumn("_hi", F.col("_upto") + F.col("_before") - 1).withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    out = []
    for name, q in qs.items():
        at = F.lit(q) * (F.col("_total") - 1)
        pick = lambda k: F.max(F.when((F.col("_lo") <= k) & (k <= F.col("_hi")), F.col(value).cast("double")))
        if linear:
            low, high = pick(F.floor(at)), pick(F.ceil(at))
            out.append((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(name))
        else:
            out.append(pick(F.floor(at + 0.5)).alias(name))
    return placed.groupBy(*by).agg(*out)


def variation(values: Column) -> Column:
    """Coefficient of variation in percent of an array of two and more numbers with a mean above zero; null otherwise."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.when((n >= 2) & (mean > 0), 100 * F.sqrt(var) / mean)


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, biased skew, p50, p90, p99 (linear) and maximum."""
    v = F.col(value).cast("double")
    base = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.skewness(v).alias("skew"), F.max(v).alias("max")
    )
    return base.join(quantiles(df.withColumn(value, v), by, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, linear=True), by) if by else base.crossJoin(
        quantiles(df.withColumn(value, v), by, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, linear=True)
    )


def log_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin (from 0) of a value on a logarithmic scale; values beyond the ends fall into the end bins."""
    import math

    width = (math.log10(high) - math.log10(low)) / bins
    return F.least(F.greatest(F.floor((F.log10(value) - math.log10(low)) / width), F.lit(0)), F.lit(bins - 1)).cast("int")


def lognormal(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, mu, sigma): the lognormal distribution with its lower end at zero that fits the values above zero best."""
    x = F.ln(F.col(value).cast("double"))
    return df.where(F.col(value) > 0).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"))


def active(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the number columns that are not zero everywhere, in their order."""
    sums = df.agg(*(F.max(F.coalesce(F.abs(F.col(c)), F.lit(0)) > 0).alias(c) for c in columns)).first()
    return [c for c in columns if sums[c]]


def in_order(names: Column, order: list[str]) -> Column:
    """A key that sorts names as they stand in `order`, others behind them."""
    at = F.array_position(F.array(*map(F.lit, order)), names)
    return F.when(at > 0, at).otherwise(len(order) + 1)
