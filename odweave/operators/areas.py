"""Units with geometries: merging, attribute aggregation, representative points, extents, urban layers, snapping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.functions.columns import ratio
from odweave.operators import spatial
from odweave.operators.measures import labelled_units
from odweave.operators.privacy import uniform


def merge_areas(units: DataFrame, areas: DataFrame, unit_id: str = "id", area_id: str = "id") -> DataFrame:
    """Units and areas by id, those of one side only as well; the unit's columns win over an area's of the same name,
    and the area's id is cast to the unit's type."""
    kind = units.schema[unit_id].dataType
    extra = [c for c in areas.columns if c != area_id and c not in units.columns]
    right = areas.select(F.col(area_id).cast(kind).alias("_aid"), *extra)
    out = units.join(right, F.col(unit_id) == F.col("_aid"), "full")
    return out.select(F.coalesce(unit_id, "_aid").alias(unit_id), *[c for c in units.columns if c != unit_id], *extra)


def with_places(table: DataFrame, places: DataFrame, key: str = "id") -> DataFrame:
    """A model or measure table with the places' attributes; rows of one side only stay."""
    return table.join(places.select(key, *[c for c in places.columns if c not in table.columns]), key, "full")


def aggregate_units(units: DataFrame, columns: list[str], size: str, region: str = "region", prefix: str = "") -> DataFrame:
    """Sums and unit counts by region, and the sums of its core, hinterland (0 if none) and largest unit, in one
    aggregation. Units without a region are left out."""
    rows = units.where(F.col(region).isNotNull()).withColumn("region", F.col(region))
    rows = labelled_units(rows, size)
    aggs = []
    for c in columns:
        aggs.append(F.sum(c).alias(f"{prefix}{c}"))
        aggs.append(F.sum(F.when(F.col("is_core"), F.col(c))).alias(f"{prefix}{c}_core"))
        aggs.append(F.coalesce(F.sum(F.when(~F.col("is_core"), F.col(c))), F.lit(0)).alias(f"{prefix}{c}_hinterland"))
        aggs.append(F.sum(F.when(F.col("is_largest"), F.col(c))).alias(f"{prefix}{c}_largest"))
    return rows.groupBy("region").agg(*aggs, F.count(F.lit(1)).alias(f"{prefix}unit_count"))


def dissolve_units(units: DataFrame, areas: DataFrame, columns: list[str], size: str) -> DataFrame:
    """Regions with their aggregated attributes and the rings of their union: ``(region, part, ring, is_hole, ..)``."""
    rings = spatial.dissolve(areas.join(units.select("id", "region"), "id").where("region IS NOT NULL"), "region")
    return rings.join(aggregate_units(units, columns, size), "region")


def representative_point(ring: str) -> Column:
    """A point inside a ring: the middle of the widest stretch inside it at half its height (moved off the corners)."""
    r, b = F.col(ring), spatial.bounds(ring)
    ys = F.array_sort(F.array_distinct(F.transform(r, lambda p: p["y"])))
    mid = (b["y0"] + b["y1"]) / 2
    above = F.array_min(F.filter(ys, lambda v: v > mid))
    below = F.array_max(F.filter(ys, lambda v: v <= mid))
    y = (F.coalesce(above, mid) + F.coalesce(below, mid)) / 2
    crossing = F.zip_with(r, spatial._next(r), lambda p, q: F.when((p["y"] > y) != (q["y"] > y), (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], None).otherwise(q["y"] - p["y"]) + p["x"]))
    xs = F.array_sort(F.filter(crossing, lambda v: v.isNotNull()))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(xs) / 2), F.lit(1)).cast("int")), lambda i: F.struct((F.get(xs, 2 * i - 1) - F.get(xs, 2 * i - 2)).alias("w"), ((F.get(xs, 2 * i - 1) + F.get(xs, 2 * i - 2)) / 2).alias("x")))
    return F.struct(F.array_max(pairs)["x"].alias("x"), y.alias("y"))


def within_extent(points: DataFrame, extent: DataFrame) -> DataFrame:
    """Points inside the one ring of ``extent``."""
    return points.join(F.broadcast(extent.select(F.col("ring").alias("_e")).limit(1))).where(spatial.contains("_e", F.col("x"), F.col("y"))).drop("_e")  # one row


def places_within(spark: SparkSession, extent: DataFrame, n: int, box: tuple[float, float, float, float], grid: bool = False, seed: int = 1) -> DataFrame:
    """``n`` random places (or a regular grid of about as many) inside an extent of the box: enough are drawn for the
    extent's share of the box, and the first n inside are taken in the order of their numbers."""
    from odweave.operators import antenna

    area = extent.select(spatial.area("ring").alias("a")).first()["a"]
    share = max(1e-6, area / ((box[2] - box[0]) * (box[3] - box[1])))
    if grid:
        return within_extent(antenna.grid_places(spark, math.ceil(n / share), box), extent)
    drawn = antenna.random_places(spark, math.ceil(2 * n / share) + 50, box, seed)
    return within_extent(drawn, extent).orderBy("id").limit(n)


def urban_layer(areas: DataFrame, min_size: float, key: str = "layer") -> DataFrame:
    """Unions of touching areas above a size, without their small holes. Areas have to share whole edges; a buffer is
    not applied, as there is no geometry engine for curved outlines."""
    rings = spatial.dissolve(areas, key)
    return rings.where(~F.col("is_hole")).withColumn("area", spatial.area("ring")).where(F.col("area") > min_size)


def snap_corners(polygons: DataFrame, tolerance: float) -> DataFrame:
    """Corners of neighbours that differ by less than the tolerance become one: each corner moves to the mean of the
    corners in its cell of a grid of that size."""
    corners = polygons.select("id", F.posexplode("ring").alias("pos", "p"))
    cell = lambda c: F.round(F.col(f"p.{c}") / tolerance).cast("long")
    rows = corners.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    w = Window.partitionBy("cx", "cy")
    moved = rows.select("id", "pos", F.struct(F.avg("p.x").over(w).alias("x"), F.avg("p.y").over(w).alias("y")).alias("p"))
    rings = moved.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("ring"))
    return polygons.drop("ring").join(rings, "id")


def succession_areas(assignments: DataFrame, areas: DataFrame) -> DataFrame:
    """``(region, part, ring, is_hole)``: the union of all units that are assigned to each region; a unit may be in
    several."""
    return spatial.dissolve(assignments.select("id", "region").join(areas, "id"), "region")


def observation_weights(places: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(id, weight)``: each place's share of the area by its Voronoi cell."""
    cells = spatial.voronoi(places, box=box).select("id", spatial.area("ring").alias("a"))
    total = cells.agg(F.sum("a").alias("t"))
    return cells.join(F.broadcast(total)).select("id", ratio("a", "t").alias("weight"))  # one row


def clustered_weights(places: DataFrame, clusters: int, spread: float, seed: int = 1) -> DataFrame:
    """``(id, weight)``: random weights that fall off around random cluster centres."""
    spark = places.sparkSession
    r = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    centres = spark.range(clusters).select((r[0] + uniform(seed, "id") * (r[2] - r[0])).alias("cx"), (r[1] + uniform(seed + 1, "id") * (r[3] - r[1])).alias("cy"))
    near = places.join(F.broadcast(centres))  # a stated number of centres
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    return near.groupBy("id").agg(F.sum(F.exp(-d2 / (2 * spread * spread))).alias("weight"))


def shared_border_change(own_perimeter: Column, other_perimeter: Column, shared: Column, own_area: Column, other_area: Column, target: float) -> Column:
    """Change of the compactness criterion when a polygon takes in a neighbour."""
    before = spatial.compactness_criterion(own_area, own_perimeter, target)
    after = spatial.compactness_criterion(own_area + other_area, own_perimeter + other_perimeter - 2 * shared, target)
    return after - before


def shared_border_lengths(polygons: DataFrame, decimals: int = 9) -> DataFrame:
    """``(from_id, to_id, length)`` of neighbours that share whole edges."""
    ring = F.transform("ring", lambda p: F.struct(F.round(p["x"], decimals).alias("x"), F.round(p["y"], decimals).alias("y")))
    rows = polygons.select("id", ring.alias("r"))
    e = rows.select("id", F.explode(F.arrays_zip(F.col("r").alias("p"), spatial._next(F.col("r")).alias("q"))).alias("e"))
    e = e.select("id", F.least("e.p", "e.q").alias("p"), F.greatest("e.p", "e.q").alias("q"))
    pairs = e.join(e.withColumnRenamed("id", "to_id"), ["p", "q"]).where("id < to_id")
    length = F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y"))
    return pairs.groupBy(F.col("id").alias("from_id"), "to_id").agg(F.sum(length).alias("length"))
