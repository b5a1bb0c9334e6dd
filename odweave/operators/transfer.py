"""Areal interpolation: moving static values and interactions to another zoning through a transfer table.

A transfer table's first three columns are source id, target id and weight; weights of a source sum to 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import ratio, share


def _table(transfer: DataFrame) -> DataFrame:
    a, b, w = transfer.columns[:3]
    eta = F.col("eta") if "eta" in transfer.columns else F.lit(0.0)
    return transfer.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.col(w).cast("double").alias("w"), eta.alias("eta"))


def transfer_static(values: DataFrame, transfer: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Weighted sums of the fields for each target; sources without a target vanish."""
    rows = values.join(_table(transfer), F.col(id_col) == F.col("source_id"), "left").where("target_id IS NOT NULL")
    return rows.groupBy("target_id").agg(*[F.coalesce(F.sum(F.col(f) * F.col("w")), F.lit(0.0)).alias(f) for f in fields])


def transfer_interactions(flows: DataFrame, transfer: DataFrame, fields: list[str], eta: DataFrame | None = None) -> DataFrame:
    """Interactions between targets. A pair's weight is the product of its ends' weights; the self-interaction of a
    source is split with the factor eta, the share of it that stays within one target."""
    t = _table(transfer)
    if eta is not None:
        t = t.drop("eta").join(eta.select("source_id", F.col("eta").cast("double")), "source_id", "left").na.fill(0.0, ["eta"])
    one = t.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("from_target"), F.col("w").alias("w1"), "eta")
    two = t.select(F.col("source_id").alias("to_id"), F.col("target_id").alias("to_target"), F.col("w").alias("w2"))
    rows = flows.join(one, "from_id", "left").join(two, "to_id", "left").where("from_target IS NOT NULL AND to_target IS NOT NULL")
    stays = F.when(F.col("from_target") == F.col("to_target"), F.col("eta")).otherwise(0.0)
    within = stays + F.col("w2") * (1 - F.col("eta"))
    weight = F.col("w1") * F.when(F.col("from_id") == F.col("to_id"), within).otherwise(F.col("w2"))
    sums = [F.coalesce(F.sum(F.col(f) * F.col("w")), F.lit(0.0)).alias(f) for f in fields]
    return rows.withColumn("w", weight).groupBy(F.col("from_target").alias("from_id"), F.col("to_target").alias("to_id")).agg(*sums)


def eta_of_intraflows(flows: DataFrame, field: str) -> DataFrame:
    """``(source_id, eta)``: the share of a source's outflow that stays in it."""
    own = F.coalesce(F.sum(F.when(F.col("from_id") == F.col("to_id"), F.col(field))), F.lit(0))
    eta = F.coalesce(ratio(own, F.sum(field)), F.lit(0.0))
    return flows.groupBy(F.col("from_id").alias("source_id")).agg(eta.alias("eta"))


def eta_of_neighbours(flows: DataFrame, neighbours: DataFrame, field: str = "strength") -> DataFrame:
    """``(from_id, to_id, eta, weight)`` of neighbouring pairs: how far two units keep to themselves beyond what their
    inflows lead to expect. The four flows of a pair come from one conditional aggregation."""
    pair = neighbours.select("from_id", "to_id")
    ends = pair.select("from_id", "to_id", F.explode(F.array("from_id", "to_id")).alias("a"))
    both = ends.withColumn("b", F.explode(F.array("from_id", "to_id")))
    rows = both.join(flows.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col(field).cast("double").alias("v")), ["a", "b"], "left")
    cell = lambda x, y: F.coalesce(F.sum(F.when((F.col("a") == F.col(x)) & (F.col("b") == F.col(y)), F.col("v"))), F.lit(0.0))
    m = rows.groupBy("from_id", "to_id").agg(*[cell(x, y).alias(n) for n, x, y in (("r00", "from_id", "from_id"), ("r01", "from_id", "to_id"), ("r10", "to_id", "from_id"), ("r11", "to_id", "to_id"))])
    total = F.col("r00") + F.col("r01") + F.col("r10") + F.col("r11")
    base = [ratio(F.col("r00") + F.col("r10"), total), ratio(F.col("r01") + F.col("r11"), total)]
    row_sum = [F.col("r00") + F.col("r01"), F.col("r10") + F.col("r11")]
    parts = F.lit(0.0)
    for i in range(2):
        for j in range(2):
            own = ratio(F.col(f"r{i}{j}"), row_sum[j])  # the division runs along columns, as the method defines it
            diagonal = F.lit(1.0 if i == j else 0.0)
            parts = parts + F.coalesce(ratio(own - base[j], diagonal - base[j]) * F.col(f"r{i}{j}"), F.lit(0.0))
    eta = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(parts, total)))
    return m.select("from_id", "to_id", eta.alias("eta"), total.alias("weight"))


def weighted_fit(eta: DataFrame) -> DataFrame:
    """Weighted mean of eta, and the weighted root mean square and mean absolute error around it."""
    mean = eta.agg(ratio(F.sum(F.col("eta") * F.col("weight")), F.sum("weight")).alias("mean"))
    rows = eta.join(F.broadcast(mean))  # one row
    d, w = F.col("eta") - F.col("mean"), F.col("weight")
    return rows.agg(F.max("mean").alias("mean"), F.sqrt(ratio(F.sum(w * d * d), F.sum(w))).alias("rmse"), ratio(F.sum(w * F.abs(d)), F.sum(w)).alias("mae"))


def table_from_areas(overlaps: DataFrame) -> DataFrame:
    """``(source_id, target_id, weight)`` of overlap areas ``(source_id, target_id, area)``: share by area."""
    rows = overlaps.where("area > 0")
    return rows.select("source_id", "target_id", share("area", "source_id").alias("weight")).where("weight IS NOT NULL")


def dasymetric_table(source_parts: DataFrame, sources: DataFrame, target_parts: DataFrame) -> DataFrame:
    """A transfer table through weighting polygons.

    ``source_parts``: (source_id, wt_id, weight, area) of sources with weighting polygons; ``sources``: all source
    ids; ``target_parts``: (wt_id, target_id, area) of weighting polygons (and of sources that overlap none, whose
    ``wt_id`` is NULL and which carry ``source_id``) with targets. Weights are spread over a weighting polygon by area.
    """
    parts = source_parts.where("area > 0").withColumn("part", F.coalesce(F.col("weight") * share("area", "wt_id"), F.lit(0.0)))
    found = parts.select("source_id", "wt_id", "part")
    lone = sources.join(found.select("source_id").distinct(), "source_id", "left_anti").select("source_id", F.lit(None).cast(found.schema["wt_id"].dataType).alias("wt_id"), F.lit(1.0).alias("part"))
    every = found.unionByName(lone)
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    every = every.withColumn("sw", F.coalesce(share("part", "source_id"), 1.0 / n))
    whole = target_parts.where("area > 0")
    shared = whole.where("wt_id IS NOT NULL").select("wt_id", "target_id", share("area", "wt_id").alias("tw"))
    own = whole.where("wt_id IS NULL").select("source_id", "target_id", share("area", "source_id").alias("tw"))
    rows = every.where("wt_id IS NOT NULL").join(shared, "wt_id").select("source_id", "target_id", (F.col("sw") * F.col("tw")).alias("w"))
    rows = rows.unionByName(every.where("wt_id IS NULL").join(own, "source_id").select("source_id", "target_id", (F.col("sw") * F.col("tw")).alias("w")))
    sums = rows.groupBy("source_id", "target_id").agg(F.sum("w").alias("w"))
    return sums.select("source_id", "target_id", share("w", "source_id").alias("weight"))
