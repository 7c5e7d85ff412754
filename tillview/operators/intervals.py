"""Joins of points with the intervals they lie in, without comparing every point with every interval.

Points and intervals meet in bins, which follow the order of the points: sampled quantiles cut coarse bins with about as many points
each, and equal steps cut each of these into fine ones. A point has one bin, an interval goes to all bins it meets; how fine bins
may be follows from the number of copies that makes. A bin with too many points is dealt into parts, and its intervals go to each
part. Within a bin the condition itself is tested, so that bins decide the cost and never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.session import stage

COARSE = 64  # quantile bins
FINEST = 10  # doublings, twice as many each time, that fine bins may go to
COPIES = 4  # of an interval, on average
BIN_ROWS = 50_000  # points of a bin before it is dealt into parts


def _coarse(x: Column, bounds: list[float], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted ``bounds`` are below ``x``, by halving."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x > F.lit(bounds[mid]), _coarse(x, bounds, mid + 1, high)).otherwise(_coarse(x, bounds, low, mid))


def _placed(df: DataFrame, name: str, bounds: list[float], column: str) -> DataFrame:
    """``df`` with ``name``: the coarse bin of a column and how far up in it the value lies, from 0 to 1."""
    x = F.col(column).cast("double")
    df = df.withColumn(name, _coarse(x, bounds))
    edges = F.array(*[F.lit(b) for b in bounds])
    low, high = F.try_element_at(edges, F.greatest(F.col(name), F.lit(1))), F.try_element_at(edges, F.col(name) + 1)
    up = F.when((F.col(name) > 0) & (high > low), F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return df.withColumn(name, F.struct(F.col(name).cast("long").alias("coarse"), up.alias("up")))


def _bin(name: str, fine: int) -> Column:
    """The number of the fine bin; never falls as the value rises."""
    return F.col(f"{name}.coarse") * fine + F.least(F.floor(F.col(f"{name}.up") * fine), F.lit(fine - 1)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, bin_rows: int = BIN_ROWS, copies: int = COPIES) -> DataFrame:
    """Every pair of a row of ``points`` and a row of ``intervals`` with low < point <= high, with the columns of both.

    The three columns are numbers (or dates cast to numbers by the caller); the sides share no column name. Nulls and NaN lie in no
    interval, and an interval whose ends are not in order holds nothing. Both sides are read more than once.
    """
    x, a, b = F.col(point), F.col(low), F.col(high)
    xs, as_, bs = x.cast("double"), a.cast("double"), b.cast("double")
    points = points.where(x.isNotNull() & ~F.isnan(xs))
    intervals = intervals.where((a < b) & ~F.isnan(as_) & ~F.isnan(bs))
    n, cuts = points.agg(F.count("*"), F.percentile_approx(xs, [i / COARSE for i in range(COARSE + 1)], 1000)).first()
    bounds = sorted(set(cuts or [0.0]))
    placed = _placed(points, "_x", bounds, point)
    spread = stage(_placed(_placed(intervals, "_a", bounds, low), "_b", bounds, high))
    finer = [1 << (2 * i) for i in range(FINEST + 1)]
    met = spread.agg(F.count("*").alias("n"), *[F.sum(_bin("_b", f) - _bin("_a", f) + 1).alias(f"f{f}") for f in finer]).first()
    few = [f for f in finer if (met[f"f{f}"] or 0) <= copies * met["n"] and f * len(bounds) <= max(n, len(bounds))]
    fine = max(few, default=1)
    placed = placed.withColumn("_bin", _bin("_x", fine)).drop("_x")
    spread = spread.withColumn("_bin", F.explode(F.sequence(_bin("_a", fine), _bin("_b", fine)))).drop("_a", "_b")
    hot = stage(placed.groupBy("_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > bin_rows).select("_bin", F.ceil(F.col("_n") / bin_rows).cast("long").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    placed = placed.join(hot, "_bin", "left").withColumn("_part", F.monotonically_increasing_id() % parts).drop("_parts")
    spread = spread.join(hot, "_bin", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return placed.join(spread, ["_bin", "_part"]).where((a < x) & (x <= b)).drop("_bin", "_part")
