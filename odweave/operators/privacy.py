"""Differential privacy of interactions: two-sided geometric noise, and gravity supplements of suppressed pairs.

Random draws are hashes of the pair and a seed, so results repeat whatever the partitions.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import is_close, like_input, ratio


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) of 52 bits from the MD5 of the columns' values and the seed, joined by colons; any engine can
    draw it again."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def geometric_noise(epsilon: float, seed: int, *cols: str) -> Column:
    """Difference of two geometric draws."""
    rate = F.lit(-float(epsilon))
    draw = lambda s: F.floor(F.ln(uniform(s, *cols)) / rate)
    return draw(2 * seed) - draw(2 * seed + 1)


def atomic(flows: DataFrame, fields: list[str], epsilon: float = 0.5, seed: int = 1) -> DataFrame:
    """Noise on every value of the existing pairs; rows whose values are all zero or less go."""
    out = flows
    for k, f in enumerate(fields):
        kind = flows.schema[f].dataType.simpleString()
        out = out.withColumn(f, F.greatest(like_input(F.col(f) + geometric_noise(epsilon, seed + k, "from_id", "to_id"), kind), F.lit(0).cast(kind)))
    keep = F.lit(False)
    for f in fields:
        keep = keep | (F.col(f) > 0)
    return out.where(keep)


def gravity_candidates(units: DataFrame, counts: DataFrame) -> DataFrame:
    """``(from_id, to_id, gravity)`` of the strongest possible partners of each source by m m' / d2; ``counts`` is
    (from_id, k). Pairs that tie with the first one beyond k are left out, as are units at one place.

    All pairs of units are scored, which is the model's definition: units are zones, not records. The one side is
    broadcast only while the zoning is small (checked by the optimiser's size estimate).
    """
    a = units.select(F.col("id").alias("from_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("mass").cast("double").alias("m1"))
    b = units.select(F.col("id").alias("to_id"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("mass").cast("double").alias("m2"))
    rows = a.join(counts, "from_id").join(b, F.col("from_id") != F.col("to_id"))
    d2 = F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)
    rows = rows.where(~is_close(d2, F.lit(0.0))).withColumn("gravity", F.col("m1") * F.col("m2") / d2)
    w = Window.partitionBy("from_id").orderBy(F.desc("gravity")).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n <= k").select("from_id", "to_id", "gravity")


def gravity(flows: DataFrame, units: DataFrame, field: str, epsilon: float = 0.5, supplement: float = 3.0, seed: int = 1) -> DataFrame:
    """Noise, then as many new pairs a source as the noise suppressed, from its strongest gravity partners, with noise on
    zero, and outflow sums scaled back to the original ones."""
    kind = flows.schema[field].dataType.simpleString()
    base = flows.select("from_id", "to_id", F.col(field).cast("double").alias("v0"))
    noisy = base.withColumn("v", F.col("v0") + geometric_noise(epsilon, seed, "from_id", "to_id"))
    per = noisy.groupBy("from_id").agg(F.sum((F.col("v") <= 0).cast("int")).alias("lost"), F.sum((F.col("v") > 0).cast("int")).alias("kept"), F.sum("v0").alias("total"))
    counts = per.where("lost > 0").select("from_id", (F.col("kept") + supplement * F.col("lost")).alias("k"))
    cand = gravity_candidates(units, counts).join(noisy.where("v > 0").select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    cand = cand.withColumn("v", geometric_noise(epsilon, seed + 100, "from_id", "to_id")).where("v > 0").join(per.select("from_id", "lost"), "from_id")
    order = Window.partitionBy("from_id").orderBy(uniform(seed + 200, "from_id", "to_id"), "to_id")
    added = cand.withColumn("_r", F.row_number().over(order)).where("_r <= lost").select("from_id", "to_id", F.col("v").cast("double").alias("v"))
    every = noisy.where("v > 0").select("from_id", "to_id", "v").union(added).join(per.select("from_id", "total"), "from_id")
    factor = F.coalesce(ratio("total", F.sum("v").over(Window.partitionBy("from_id"))), F.lit(1.0))
    out = every.select("from_id", "to_id", like_input(F.col("v") * factor, kind).alias(field))
    return out.where(F.col(field) > 0)


METHODS = {"atomic": atomic, "gravity": gravity}
