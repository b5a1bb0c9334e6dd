"""Measures of regions: names, property sums, interaction sums by unit types, integrities.

Units have ``id, region, is_core, name`` and numeric properties.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import prefixed, ratio

TYPES = ("largest", "core", "hinterland", "region")


def labelled_units(units: DataFrame, size: str, fraction: float = 1.0) -> DataFrame:
    """Adds ``is_largest`` (the region's largest unit, smallest id on ties; with a fraction below 1 every unit of at
    least that part of the largest) and ``is_hinterland``."""
    region = Window.partitionBy("region")
    if fraction < 1:
        largest = F.col(size) >= fraction * F.max(size).over(region)
    else:
        largest = F.row_number().over(region.orderBy(F.col(size).desc_nulls_last(), "id")) == 1
    return units.withColumn("is_largest", F.coalesce(largest, F.lit(False))).withColumn("is_hinterland", ~F.col("is_core"))


def labelled_flows(flows: DataFrame, labels: DataFrame) -> DataFrame:
    flags = labels.select("id", "region", "is_largest", "is_core", "is_hinterland")
    a, b = prefixed(flags, suffix="_from").withColumnRenamed("id_from", "from_id"), prefixed(flags, suffix="_to").withColumnRenamed("id_to", "to_id")
    return flows.join(a, "from_id", "left").join(b, "to_id", "left")


def names(units: DataFrame, size: str, fraction: float = 1.0) -> DataFrame:
    """``(region, name)``: names of core units (of at least the fraction of the largest core unit, if below 1) in
    descending size, else the largest unit's name."""
    core = units.where("is_core")
    if fraction < 1:
        core = core.withColumn("_m", F.max(size).over(Window.partitionBy("region"))).where(F.col(size) >= fraction * F.col("_m"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("s"), F.col("id"), F.col("name"))))
    cores = core.groupBy("region").agg(F.concat_ws("–", F.transform(listed, lambda r: r["name"])).alias("name"))
    top = Window.partitionBy("region").orderBy(F.col(size).desc_nulls_last(), "id")
    largest = units.withColumn("_r", F.row_number().over(top)).where("_r = 1").select("region", F.col("name").alias("largest"))
    return largest.join(cores, "region", "left").select("region", F.coalesce("name", "largest").alias("name"))


def property_sums(labels: DataFrame, props: list[str]) -> DataFrame:
    """Sums of the properties and the number of units: whole region, by type, and the types' shares."""
    rows = labels.withColumn("unit_count", F.lit(1))
    aggs, shares = [], []
    for p in [*props, "unit_count"]:
        aggs.append(F.sum(p).alias(p))
        for t in TYPES[:3]:
            aggs.append(F.coalesce(F.sum(F.when(F.col(f"is_{t}"), F.col(p))), F.lit(0)).alias(f"{p}_{t}"))
            shares.append(ratio(f"{p}_{t}", p).alias(f"{p}_{t}_frac"))
    return rows.groupBy("region").agg(*aggs).select("*", *shares).drop("unit_count_largest", "unit_count_largest_frac")


def interaction_sums(labelled: DataFrame, strength: str = "strength") -> DataFrame:
    """All sums between unit types, inside the region and across its border, in two aggregations.

    ``inter_<a>_to_<b>`` inside; ``<a>_to_out``, ``<a>_to_all`` by origin; ``out_to_<b>``, ``all_to_<b>`` by target.
    """
    flag = lambda t, side: F.lit(True) if t == "region" else F.col(f"is_{t}_{side}")
    inside = F.col("region_from").eqNullSafe(F.col("region_to"))
    v = F.col(strength)

    def total(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).alias(name)

    outs = [total(inside & flag(a, "from") & flag(b, "to"), f"inter_{a}_to_{b}") for a in TYPES for b in TYPES]
    outs += [total(~inside & flag(a, "from"), f"inter_{a}_to_out") for a in TYPES] + [total(flag(a, "from"), f"inter_{a}_to_all") for a in TYPES]
    ins = [total(~inside & flag(b, "to"), f"inter_out_to_{b}") for b in TYPES] + [total(flag(b, "to"), f"inter_all_to_{b}") for b in TYPES]
    a = labelled.where("region_from IS NOT NULL").groupBy(F.col("region_from").alias("region")).agg(*outs)
    b = labelled.where("region_to IS NOT NULL").groupBy(F.col("region_to").alias("region")).agg(*ins)
    out = a.join(b, "region", "full")
    return out.na.fill(0, [c for c in out.columns if c != "region"])


def integrities(sums: DataFrame) -> DataFrame:
    """Measures of self-containment from interaction sums."""
    c = F.col
    res = ratio("inter_region_to_region", "inter_region_to_all")
    work = ratio("inter_region_to_region", "inter_all_to_region")
    return sums.select(
        "region",
        ratio("inter_hinterland_to_core", "inter_hinterland_to_out").alias("hampl_hinterland"),
        ratio(c("inter_hinterland_to_core") + c("inter_core_to_hinterland"), "inter_region_to_out").alias("hampl_region"),
        ratio("inter_region_to_region", c("inter_region_to_out") + c("inter_out_to_region")).alias("bezak"),
        res.alias("coombes_residence"),
        work.alias("coombes_workplace"),
        ((res + work) / 2).alias("self_containment"),
    )


def calculate(units: DataFrame, flows: DataFrame, size: str, props: list[str], fraction: float = 1.0, only: str | None = None, exclude: str | None = None) -> DataFrame:
    """All measures of all regions; ``only`` and ``exclude`` are patterns of measure names. What is not selected is
    pruned from the plan."""
    labels = labelled_units(units, size, fraction)
    sums = interaction_sums(labelled_flows(flows, labels))
    out = names(units, size, fraction)
    for one in (property_sums(labels, props), sums, integrities(sums)):
        out = out.join(one, "region", "left")
    keep = [c for c in out.columns if c == "region" or ((not only or re.fullmatch(only, c)) and not (exclude and re.fullmatch(exclude, c)))]
    return out.select(*keep)
