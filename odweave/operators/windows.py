"""Rank-size gaps, time weights, day profiles, trajectories, sampling by rank."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import ratio
from odweave.operators.iterate import shared_table

DAY = 86400.0


# ---- rank-size ----
def zipf_exponent(df: DataFrame, value: str) -> DataFrame:
    """Weighted least squares of ln value by ln rank, weights ln value, for values above 1: one row."""
    rows = global_ranks(df, value).where("v > 1").select(F.ln("rank").alias("x"), F.ln("v").alias("y"), F.ln("v").alias("w"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    s = rows.agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"), F.sum(w * x * x).alias("sxx"))
    slope = ratio(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.select(slope.alias("slope"), ratio(F.col("sy") - slope * F.col("sx"), "sw").alias("intercept"))


def value_counts(df: DataFrame, value: str, parts: int | None = None, descending: bool = True) -> DataFrame:
    """``(v, n, before)``: the distinct values, their rows, and the rows of all values before them.

    Equal values fold before any shuffle. Distinct values are range-partitioned, summed up within their partition, and
    shifted by the rows of the partitions before (one row a partition). The partitioned rows are written once, as a
    second sampling of the ranges could cut them elsewhere."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("v").desc() if descending else F.col("v").asc()
    rows = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.repartitionByRange(n, order).withColumn("p", F.spark_partition_id())
    rows = shared_table(rows.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy(order))), "ranks")
    sizes = rows.groupBy("p").agg(F.sum("n").alias("m"))
    shift = sizes.select("p", (F.sum("m").over(Window.orderBy("p")) - F.col("m")).alias("shift"))
    return rows.join(F.broadcast(shift), "p").select("v", "n", (F.col("upto") - F.col("n") + F.col("shift")).alias("before"))


#: Ranks of one value that are made in one go.
RANK_STEP = 10_000


def global_ranks(df: DataFrame, value: str, parts: int | None = None, descending: bool = True) -> DataFrame:
    """``(v, rank)`` of every row by value: the running counts of distinct values, each spread over its rows' ranks; the
    ranks of a frequent value are dealt out in pieces."""
    counts = value_counts(df, value, parts, descending)
    pieces = counts.select("v", "n", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANK_STEP).cast("long"))).alias("low"))
    pieces = pieces.repartition("v", "low")
    last = F.least(F.col("low") + RANK_STEP, F.col("n"))
    return pieces.select("v", F.explode(F.sequence(F.col("before") + F.col("low") + 1, F.col("before") + last)).alias("rank"))


def zipf_gaps(df: DataFrame, value: str, exponent: float = -1.0, spread: int = 5) -> DataFrame:
    """``(rank, value, gap, smooth)``: how much larger a value is than the one ``spread`` ranks later, against what the
    exponent expects, and its centred moving average. Neighbours in rank come from equi-joins on the rank, so no
    window spans the whole table."""
    r = global_ranks(df, value)
    later = r.select((F.col("rank") - spread).alias("rank"), F.col("v").alias("later"))
    mid = r.select((F.col("rank") - spread // 2).alias("rank"), F.col("v").alias("label"), F.col("rank").alias("at"))
    expected = F.pow(F.col("rank") / (F.col("rank") + spread), F.lit(float(exponent)))
    gaps = r.join(later, "rank").join(mid, "rank").select(F.col("at").alias("rank"), F.col("label").alias("value"), ratio(ratio("v", "later"), expected).alias("gap"))
    offsets = F.explode(F.sequence(F.lit(-(spread // 2)), F.lit((spread + 1) // 2 - 1)))
    near = gaps.select("rank", F.col("gap").alias("g")).withColumn("o", offsets).select((F.col("rank") + F.col("o")).alias("rank"), "g")
    smooth = near.groupBy("rank").agg(F.avg("g").alias("smooth"))
    return gaps.join(smooth, "rank")


def threshold_ratings(df: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """``(value, next_value, rating)`` of the gaps in the upper half of the values: relative gap to the next larger
    value times ln of the values above it."""
    r = global_ranks(df, value, descending=False)
    n = r.agg(F.count(F.lit(1)).alias("n"))
    nxt = r.select((F.col("rank") - 1).alias("rank"), F.col("v").alias("next_value"))
    rows = r.join(nxt, "rank").join(F.broadcast(n))  # one row
    i = F.col("rank") - 1
    above = F.col("n") - i - 1
    rows = rows.where(i >= F.floor(F.col("n") / 2)).withColumn("rating", ratio(F.col("next_value") - F.col("v"), "next_value") * F.ln(above))
    rows = rows.select(F.col("v").alias("value"), "next_value", "rating")
    return rows.orderBy(F.desc("rating"), "value").limit(top) if top else rows


# ---- time ----
def micros(ts: str | Column) -> Column:
    """Microseconds of the wall clock: as written for times without a zone, in the session's zone for others."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


def time_weights(df: DataFrame, keys: list[str], ts: str, resolution: float = 3600.0, start: float | None = None, end: float | None = None) -> DataFrame:
    """Adds ``weight``: half the time to the previous and to the next observation of the same keys, each gap clipped to
    the resolution (seconds); beyond the first and last, the start and end of the period or the resolution."""
    t = micros(ts) / 1e6
    w = Window.partitionBy(*keys).orderBy("_t")
    rows = df.withColumn("_t", t)
    first = F.col("_t") - F.lit(start) if start is not None else F.lit(resolution)
    last = F.lit(end) - F.col("_t") if end is not None else F.lit(resolution)
    back, ahead = F.coalesce(F.col("_t") - F.lag("_t").over(w), first), F.coalesce(F.lead("_t").over(w) - F.col("_t"), last)
    return rows.withColumn("weight", F.least((back + ahead) / 2, F.lit(float(resolution)))).drop("_t")


def day_seconds(ts: str) -> Column:
    return F.pmod(micros(ts) / 1e6, F.lit(DAY))


def day_profile(df: DataFrame, keys: list[str], ts: str, weight: str, bins: int = 48, sigma: float = 1800.0) -> DataFrame:
    """``keys, bin, density``: a circular kernel density of the time of day. Observations are first added up by second,
    so repeated times cost nothing more."""
    k = 1 / (sigma * 2 * math.pi / DAY) ** 2  # concentration of the von Mises kernel
    rows = df.groupBy(*keys, F.floor(day_seconds(ts)).alias("s")).agg(F.sum(weight).alias("w"))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    angle = (F.col("s") - (F.col("bin") + 0.5) * (DAY / bins)) * (2 * math.pi / DAY)
    sums = rows.groupBy(*keys, "bin").agg(F.sum(F.col("w") * F.exp(k * (F.cos(angle) - 1))).alias("d"))
    return sums.select(*keys, "bin", ratio("d", F.sum("d").over(Window.partitionBy(*keys))).alias("density"))


def _libm(function: Callable[..., float]) -> Callable[..., Column]:
    """A function of the C library, whose last bits differ from the JVM's: a mean that lies on a rounding limit (that of one
    time, or of two) falls on the same side of it as in SQL engines that use that library."""

    def kernel(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if None in row else function(*row) for row in rows], pa.float64())

    return F.arrow_udf(kernel, "double")


def _on_circle(df: DataFrame, ts: str) -> DataFrame:
    """Adds ``_sin`` and ``_cos`` of the time of day."""
    a = day_seconds(ts) * 2 * math.pi / DAY
    return df.withColumns({"_sin": _libm(math.sin)(a), "_cos": _libm(math.cos)(a)})


def _mean_second(sums: DataFrame) -> DataFrame:
    """``mean_second`` in place of the sums ``_sin`` and ``_cos``, step by step as in SQL; a mean that is less than zero by
    a rounding error is a whole day."""
    mean = _libm(math.atan2)("_sin", "_cos") * DAY / (2 * math.pi)
    return sums.withColumn("_mean", mean).withColumn("mean_second", F.col("_mean") - F.floor(F.col("_mean") / DAY) * DAY).drop("_sin", "_cos", "_mean")


def circular_mean(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """``keys, mean_second``: the mean time of day on the circle."""
    return _mean_second(_on_circle(df, ts).groupBy(*keys).agg(F.sum("_sin").alias("_sin"), F.sum("_cos").alias("_cos")))


def night_index(profile: DataFrame, keys: list[str], bins: int = 48) -> DataFrame:
    """``keys, night_index``: the profile against a cosine that is 1 at midnight and -1 at noon."""
    c = F.cos((F.col("bin") + 0.5) * (2 * math.pi / bins))
    return profile.groupBy(*keys).agg(F.sum(F.col("density") * c).alias("night_index"))


def detect_anchors(df: DataFrame, user: str, cell: str, ts: str, resolution: float = 3600.0) -> DataFrame:
    """Anchor statistics of each user and cell: observations, time weight, span, mean time of day, night index, and
    whether it looks like a home."""
    keys = [user, cell]
    weighted = time_weights(_on_circle(df, ts), [user], ts, resolution)
    span = ((micros(F.max(ts)) - micros(F.min(ts))) / 1e6).alias("timespan")
    # The window leaves a user's rows in order of time in one partition, so that is the order of the sums.
    base = weighted.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.sum("weight").alias("weight"), span, F.sum("_sin").alias("_sin"), F.sum("_cos").alias("_cos"))
    night = night_index(day_profile(weighted, keys, ts, "weight"), keys)
    return _mean_second(base).join(night, keys).withColumn("is_home", F.col("night_index") > 0)


def trajectory(df: DataFrame, keys: list[str], ts: str, x: str, y: str, step: int = 60, sigma: float = 300.0) -> DataFrame:
    """``keys, tick, x, y``: positions on a regular time grid. An observation belongs to the first tick at or after it;
    ticks are smoothed with a Gaussian of ``sigma`` seconds, cut at four of them."""
    t = micros(ts) / 1e6
    first = F.min("_t").over(Window.partitionBy(*keys))
    rows = df.withColumn("_t", t).withColumn("tick", F.ceil((F.col("_t") - first) / step).cast("long"))
    at = rows.groupBy(*keys, "tick").agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    grid = at.groupBy(*keys).agg(F.max("tick").alias("n")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("tick"))
    width = int(math.ceil(4 * sigma / step))
    offsets = F.explode(F.sequence(F.lit(-width), F.lit(width)))
    near = at.withColumn("o", offsets).withColumn("w", F.exp(-F.pow(F.col("o") * step / sigma, 2) / 2)).withColumn("tick", F.col("tick") + F.col("o"))
    sums = near.groupBy(*keys, "tick").agg(F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum("w").alias("sw"))
    return grid.join(sums, [*keys, "tick"], "left").select(*keys, "tick", ratio("sx", "sw").alias("x"), ratio("sy", "sw").alias("y"))


def entropy(df: DataFrame, group: str, mass: str) -> DataFrame:
    """One row: the entropy of the groups' shares of mass over ln of their number."""
    sums = df.groupBy(group).agg(F.sum(mass).cast("double").alias("m"))
    total = sums.agg(F.sum("m").alias("t"), F.count(F.lit(1)).alias("n"))
    rows = sums.join(F.broadcast(total)).withColumn("p", ratio("m", "t"))  # one row
    return rows.agg(ratio(-F.sum(F.col("p") * F.ln("p")), F.ln(F.max("n"))).alias("entropy"))
