"""Signal strength of antennas, connections, observation weights, and estimation of antenna parameters.

Antennas: ``(antenna, x, y, range, strength, angle, kappa)``; angle in radians (NULL: all directions), kappa the
concentration of its beam.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.functions.columns import bessel_i0, ratio, top_rows
from odweave.operators.privacy import uniform


def signal_strength(x: Column, y: Column) -> Column:
    """Strength at a place: a Cauchy density of the distance times a von Mises density of the direction."""
    d2 = F.pow(x - F.col("x"), 2) + F.pow(y - F.col("y"), 2)
    radial = F.col("range") / (math.pi * (d2 + F.col("range") * F.col("range")))
    phi = F.atan2(y - F.col("y"), x - F.col("x"))
    beam = F.exp(F.col("kappa") * F.cos(phi - F.col("angle"))) / (2 * math.pi * bessel_i0(F.col("kappa")))
    return F.col("strength") * radial * F.when(F.col("angle").isNull() | (F.col("kappa") == 0), 1 / (2 * math.pi)).otherwise(beam)


def strengths(places: DataFrame, antennas: DataFrame, reach: float | None = None) -> DataFrame:
    """``(place, antenna, signal)``. Within a reach candidates meet in grid cells; without one every antenna counts
    everywhere by definition, and the (small) network is the inner side."""
    a = antennas
    p = places.select(F.col("id").alias("place"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    if reach is None:
        rows = p.join(a)
    else:
        cell = lambda c: F.floor(F.col(c) / reach).cast("long")
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        left = p.withColumn("cx", cell("px")).withColumn("cy", cell("py"))
        rows = left.join(a.withColumn("cx", around("x")).withColumn("cy", around("y")), ["cx", "cy"])
        rows = rows.where(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= reach)
    return rows.select("place", "antenna", signal_strength(F.col("px"), F.col("py")).alias("signal"))


def connections(signals: DataFrame, fraction: float = 1.0) -> DataFrame:
    """The strongest antenna of each place, or with a fraction all antennas of at least that part of it."""
    if fraction >= 1:
        return top_rows(signals, ["place"], "signal", "antenna")
    best = F.max("signal").over(Window.partitionBy("place"))
    return signals.withColumn("_b", best).where(F.col("signal") >= fraction * F.col("_b")).drop("_b")


def random_network(spark: SparkSession, masts: int, box: tuple[float, float, float, float], per_mast: int = 3, rng: float = 1.0, kappa: float = 1.0, seed: int = 1, fixed: bool = True) -> DataFrame:
    """Masts at random places with antennas at equal angles, or at random ones."""
    ids = spark.range(masts).withColumnRenamed("id", "mast")
    x, y = box[0] + uniform(seed, "mast") * (box[2] - box[0]), box[1] + uniform(seed + 1, "mast") * (box[3] - box[1])
    rows = ids.select("mast", x.alias("x"), y.alias("y"), uniform(seed + 2, "mast").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(per_mast - 1))).alias("k"))
    turn = F.col("turn") + F.col("k") / per_mast if fixed else uniform(seed + 3, "mast", "k")
    angle = F.pmod(turn, F.lit(1.0)) * 2 * math.pi
    return rows.select((F.col("mast") * per_mast + F.col("k")).alias("antenna"), "x", "y", F.lit(rng).alias("range"), F.lit(1.0).alias("strength"), angle.alias("angle"), F.lit(kappa).alias("kappa"))


def grid_places(spark: SparkSession, n: int, box: tuple[float, float, float, float]) -> DataFrame:
    """About n places on a regular grid, at the centres of its cells."""
    w, h = box[2] - box[0], box[3] - box[1]
    cols = max(1, round(math.sqrt(n * w / h)))
    rows = max(1, math.ceil(n / cols))
    at = spark.range(cols * rows)
    i, j = F.col("id") % cols, F.floor(F.col("id") / cols)
    return at.select("id", (box[0] + (i + 0.5) * w / cols).alias("x"), (box[1] + (j + 0.5) * h / rows).alias("y"))


def random_places(spark: SparkSession, n: int, box: tuple[float, float, float, float], seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", (box[0] + uniform(seed, "id") * (box[2] - box[0])).alias("x"), (box[1] + uniform(seed + 1, "id") * (box[3] - box[1])).alias("y"))


def density(points: DataFrame, cell: float) -> DataFrame:
    """``(cx, cy, n)``: points by square cell."""
    c = lambda k: F.floor(F.col(k) / cell).cast("long")
    return points.groupBy(c("x").alias("cx"), c("y").alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def density_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed square roots of the change of each cell's count."""
    rows = before.withColumnRenamed("n", "a").join(after.withColumnRenamed("n", "b"), ["cx", "cy"], "full").na.fill(0, ["a", "b"])
    d = F.col("b") - F.col("a")
    return rows.select("cx", "cy", (F.signum(d) * F.sqrt(F.abs(d))).alias("delta"))


def initial_moments(observations: DataFrame) -> DataFrame:
    """``(antenna, x, y, range, angle, kappa)`` from weighted places ``(antenna, mast_x, mast_y, x, y, weight)``: mean
    distance, mean direction (0 where the directions cancel out), and the concentration that the resultant length implies."""
    w, dx, dy = F.col("weight"), F.col("x") - F.col("mast_x"), F.col("y") - F.col("mast_y")
    d = F.hypot(dx, dy)
    sw = F.sum(w)
    c, s = ratio(F.sum(w * F.coalesce(F.try_divide(dx, d), F.lit(0.0))), sw), ratio(F.sum(w * F.coalesce(F.try_divide(dy, d), F.lit(0.0))), sw)
    rows = observations.groupBy("antenna").agg(F.first("mast_x").alias("x"), F.first("mast_y").alias("y"), ratio(F.sum(w * d), sw).alias("range"), c.alias("c"), s.alias("s"))
    r = F.hypot("c", "s")
    kappa = r * (2 - r * r) / F.greatest(1 - r * r, F.lit(1e-9))
    return rows.select("antenna", "x", "y", "range", F.when(r < 1e-9, 0.0).otherwise(F.atan2("s", "c")).alias("angle"), kappa.alias("kappa"))


def adjusted(observations: DataFrame, signals_of, antennas: DataFrame, rounds: int = 5) -> DataFrame:
    """Strengths that make the expected weight of each antenna meet the observed one: a short loop of grouped sums."""
    seen = observations.groupBy("antenna").agg(F.sum("weight").alias("seen"))
    for _ in range(rounds):
        rows = signals_of(antennas)
        p = ratio("signal", F.sum("signal").over(Window.partitionBy("place")))
        expected = rows.withColumn("p", p).groupBy("antenna").agg(F.sum("p").alias("expected"))
        total = expected.join(seen, "antenna", "left").na.fill(0.0)
        sums = total.agg(F.sum("seen").alias("_s"), F.sum("expected").alias("_e"))
        factor = F.coalesce(ratio(ratio("seen", "_s"), ratio("expected", "_e")), F.lit(1.0))
        total = total.join(F.broadcast(sums)).select("antenna", factor.alias("_f"))  # one row
        antennas = antennas.join(total, "antenna", "left").withColumn("strength", F.col("strength") * F.coalesce("_f", F.lit(1.0))).drop("_f")
    return antennas


def fit_antennas(observations: DataFrame, steps: int = 60, population: int = 25, seed: int = 1, method: str = "climb") -> DataFrame:
    """``(antenna, range, angle, kappa, loglik)`` by maximum likelihood of each antenna's weighted observations.

    ``climb`` goes from the moments by coordinate steps that halve; ``genetic`` breeds a population of parameter sets
    (averaging, mixing, mutation). An antenna is one task: observations of an antenna are first added up by place.
    """
    rows = observations.groupBy("antenna", "mast_x", "mast_y", "x", "y").agg(F.sum("weight").alias("weight"))
    kind = observations.schema["antenna"].dataType.simpleString()

    def loglik(theta: np.ndarray, d: np.ndarray, phi: np.ndarray, w: np.ndarray) -> float:
        g, a, k = np.exp(theta[0]), theta[1], np.exp(theta[2])
        return float((w * (np.log(g / (math.pi * (d * d + g * g))) + k * np.cos(phi - a) - np.log(2 * math.pi * np.i0(k)))).sum())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dx, dy, w = (pdf.x - pdf.mast_x).to_numpy(float), (pdf.y - pdf.mast_y).to_numpy(float), pdf.weight.to_numpy(float)
        d, phi = np.hypot(dx, dy), np.arctan2(dy, dx)
        mean = max(float((w * d).sum() / max(w.sum(), 1e-12)), 1e-6)
        best = np.array([math.log(mean), math.atan2(float((w * np.sin(phi)).sum()), float((w * np.cos(phi)).sum())), 0.0])
        score = loglik(best, d, phi, w)
        if method == "genetic":
            rng = np.random.default_rng(seed)
            pool = [best] + [best + rng.normal(0, 1, 3) for _ in range(population - 1)]
            for _ in range(steps):
                pool.sort(key=lambda t: -loglik(t, d, phi, w))
                half = pool[: population // 2]
                kids = []
                while len(kids) < population - len(half):
                    a, b = half[rng.integers(len(half))], half[rng.integers(len(half))]
                    kid = (a + b) / 2 if rng.random() < 0.5 else np.where(rng.random(3) < 0.5, a, b)
                    kids.append(kid + rng.normal(0, 0.2, 3) * (rng.random(3) < 0.5))
                pool = half + kids
            best = max(pool, key=lambda t: loglik(t, d, phi, w))
            score = loglik(best, d, phi, w)
        else:
            step = 0.5
            for _ in range(steps):
                moved = False
                for i in range(3):
                    for sign in (-step, step):
                        trial = best.copy()
                        trial[i] = min(trial[i] + sign, 6.0) if i == 2 else trial[i] + sign
                        if (v := loglik(trial, d, phi, w)) > score + 1e-12:
                            best, score, moved = trial, v, True
                if not moved:
                    step /= 2
        angle = math.atan2(math.sin(best[1]), math.cos(best[1]))
        return pd.DataFrame({"antenna": [pdf.antenna.iloc[0]], "range": [math.exp(best[0])], "angle": [angle], "kappa": [math.exp(min(best[2], 6.0))], "loglik": [score]})

    return rows.groupBy("antenna").applyInPandas(run, f"antenna {kind}, range double, angle double, kappa double, loglik double")
