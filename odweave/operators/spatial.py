"""Points, rectangles and polygons: grid joins, nearest neighbours, areas, clipping, dissolving, Voronoi cells.

Points are columns x and y. Polygons are ``ring array<struct<x,y>>`` without the closing point; a unit of several parts
has several rows. Spatial joins are equi-joins on grid cells with an exact test after, so they shuffle like any join and
a dense cell can be split by a finer grid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import ratio
from odweave.operators.iterate import shared_table


# ---- expressions on rings ----
def _next(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area(ring: str) -> Column:
    """Shoelace formula; counter-clockwise rings are positive."""
    r = F.col(ring)
    parts = F.zip_with(r, _next(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / 2


def area(ring: str) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: str) -> Column:
    r = F.col(ring)
    parts = F.zip_with(r, _next(r), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def line_length(line: str) -> Column:
    r = F.col(line)
    parts = F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def centroid(ring: str) -> Column:
    """Centre of mass of a ring; of degenerate rings the mean of its points."""
    r = F.col(ring)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    total = lambda c: F.aggregate(F.zip_with(r, _next(r), lambda p, q: (p[c] + q[c]) * cross(p, q)), F.lit(0.0), lambda a, v: a + v)
    mean = lambda c: F.aggregate(r, F.lit(0.0), lambda a, p: a + p[c]) / F.size(r)
    six = 6 * signed_area(ring)
    return F.struct(F.coalesce(F.try_divide(total("x"), six), mean("x")).alias("x"), F.coalesce(F.try_divide(total("y"), six), mean("y")).alias("y"))


def bounds(ring: str) -> Column:
    r = F.col(ring)
    low = lambda c: F.array_min(F.transform(r, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(r, lambda p: p[c]))
    return F.struct(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


def contains(ring: str, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring (crossings of a ray)."""
    r = F.col(ring)
    crosses = F.zip_with(r, _next(r), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def curved_line(x1: Column, y1: Column, x2: Column, y2: Column, points: int = 16, degrees: float = 30.0) -> Column:
    """An arc between two points that leaves its chord at the given angle."""
    a = math.radians(degrees)
    h = 1 / (2 * math.tan(a)) if a else 0.0
    cx, cy = (x1 + x2) / 2 + h * (y2 - y1), (y1 + y2) / 2 - h * (x2 - x1)
    start, turn = F.atan2(y1 - cy, x1 - cx), -2 * a
    r = F.hypot(x1 - cx, y1 - cy)
    angle = lambda i: start + turn * i / (points - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct((cx + r * F.cos(angle(i))).alias("x"), (cy + r * F.sin(angle(i))).alias("y")))


def vector_length(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def vector_angle(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def wkt_of(ring: str) -> Column:
    text = F.transform(F.concat(F.col(ring), F.slice(F.col(ring), 1, 1)), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", text), F.lit("))"))


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lon: Column, lat: Column, precision: int = 9) -> Column:
    """Geohash by interleaving the bits of both coordinates."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    ix = F.least(F.floor((lon + 180) / 360 * 2**nx), F.lit(2**nx - 1)).cast("long")
    iy = F.least(F.floor((lat + 90) / 180 * 2**ny), F.lit(2**ny - 1)).cast("long")
    out = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5):
            k = 5 * c + b
            bit = F.shiftright(ix, nx - 1 - k // 2) if k % 2 == 0 else F.shiftright(iy, ny - 1 - k // 2)
            value = value * 2 + bit.bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substr(F.lit(_BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


# ---- grid joins ----
def _cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(a / size).cast("long"), F.floor(b / size).cast("long"))
    return df.withColumn("_cx", F.explode(span(x0, x1))).withColumn("_cy", F.explode(span(y0, y1)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """All pairs of a point and a polygon that contains it."""
    b = bounds("ring")
    cells = _cells(polygons, b["x0"], b["y0"], b["x1"], b["y1"], size)
    pts = points.withColumn("_cx", F.floor(F.col("x") / size).cast("long")).withColumn("_cy", F.floor(F.col("y") / size).cast("long"))
    hits = pts.join(cells, ["_cx", "_cy"]).where(contains("ring", F.col("x"), F.col("y"))).drop("_cx", "_cy")
    if how == "inner":
        return hits
    key = points.columns[0]
    return points.join(hits.drop(*[c for c in points.columns if c != key]), key, how)


def rectangle_pairs(a: DataFrame, b: DataFrame, size: float, tolerance: float = 0.0) -> DataFrame:
    """``(a_id, b_id, area)`` of rectangles ``(id, x0, y0, x1, y1)`` that meet (touching counts). A pair that shares
    several grid cells is tested in the cell of its lower corner alone, so no distinct is needed."""
    t = tolerance
    left = _cells(a.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "x0", "y0", "x1", "y1")]), F.col("a_x0") - t, F.col("a_y0") - t, F.col("a_x1") + t, F.col("a_y1") + t, size)
    right = _cells(b.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1")]), F.col("b_x0"), F.col("b_y0"), F.col("b_x1"), F.col("b_y1"), size)
    low_x, low_y = F.greatest(F.col("a_x0") - t, F.col("b_x0")), F.greatest(F.col("a_y0") - t, F.col("b_y0"))
    w, h = F.least(F.col("a_x1"), F.col("b_x1")) - F.greatest("a_x0", "b_x0"), F.least(F.col("a_y1"), F.col("b_y1")) - F.greatest("a_y0", "b_y0")
    rows = left.join(right, ["_cx", "_cy"]).where((F.col("_cx") == F.floor(low_x / size)) & (F.col("_cy") == F.floor(low_y / size)))
    return rows.where((w >= -t) & (h >= -t)).select("a_id", "b_id", (F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))).alias("area"))


def neighbour_pairs(rectangles: DataFrame, size: float, tolerance: float = 0.0) -> DataFrame:
    """``(from_id, to_id)`` of units that touch, each pair once."""
    pairs = rectangle_pairs(rectangles, rectangles, size, tolerance).where("a_id < b_id")
    return pairs.select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"))


def nearest(points: DataFrame, targets: DataFrame, size: float, max_rings: int = 64) -> DataFrame:
    """``(id, target, distance)`` of each point's nearest target; smallest target id on ties.

    Rings of grid cells grow around the points that are still open; a point is done when its best distance is not
    beyond what the rings seen so far cover, so the result is exact. Points farther than ``max_rings`` cells from every
    target fall back to a comparison with all targets.
    """
    t = targets.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    cells = t.withColumn("_cx", F.floor(F.col("tx") / size).cast("long")).withColumn("_cy", F.floor(F.col("ty") / size).cast("long"))
    open_ = points.select("id", F.col("x").cast("double"), F.col("y").cast("double"))
    done, ring = None, 1
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    while True:
        near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size).cast("long") - ring, F.floor(F.col(c) / size).cast("long") + ring))
        around = open_.withColumn("_cx", near("x")).withColumn("_cy", near("y"))
        found = around.join(cells, ["_cx", "_cy"]) if ring <= max_rings else open_.join(t)
        best = found.groupBy("id").agg(F.min(F.struct(d.alias("distance"), F.col("target"))).alias("b")).select("id", "b.*")
        sure = best.where(F.col("distance") <= ring * size) if ring <= max_rings else best
        sure = shared_table(sure.select("id", "target", "distance"), "nearest")
        done = sure if done is None else done.unionByName(sure)
        open_ = shared_table(open_.join(sure.select("id"), "id", "left_anti"), "nearest")
        if ring > max_rings or open_.isEmpty():
            return done
        ring *= 4


# ---- dissolve ----
def dissolve_edges(polygons: DataFrame, key: str) -> DataFrame:
    """``(key, x1, y1, x2, y2)``: outer edges of the union of polygons that meet along whole edges. Every inner edge is
    there twice, in opposite directions, and cancels; one aggregation, no geometry engine."""
    ccw = F.when(signed_area("ring") < 0, F.reverse("ring")).otherwise(F.col("ring"))
    rows = polygons.withColumn("ring", ccw)
    edges = rows.select(key, F.explode(F.arrays_zip(F.col("ring").alias("p"), _next(F.col("ring")).alias("q"))).alias("e"))
    edges = edges.select(key, *[F.col(f"e.{a}.{b}").alias(f"{b}{i}") for i, a in ((1, "p"), (2, "q")) for b in ("x", "y")])
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    turned = edges.select(key, F.when(forward, 1).otherwise(-1).alias("s"), *[F.when(forward, F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")).alias(f"{c}{i}") for i in (1, 2) for c in ("x", "y")])
    left = turned.groupBy(key, "x1", "y1", "x2", "y2").agg(F.sum("s").alias("s")).where("s <> 0")
    return left.select(key, *[F.when(F.col("s") > 0, F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")).alias(f"{c}{i}") for i in (1, 2) for c in ("x", "y")])


def dissolve(polygons: DataFrame, key: str, least_hole: float = 0.1) -> DataFrame:
    """``(key, part, ring, is_hole)``: rings of each union, traced from its outer edges; holes below the size go."""
    kind = polygons.schema[key].dataType.simpleString()

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        nxt: dict = {}
        for x1, y1, x2, y2 in pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False):
            nxt.setdefault((x1, y1), []).append((x2, y2))
        while nxt:
            start = min(nxt)
            ring, at, came = [], start, None
            while at in nxt:
                ring.append(at)
                goals = nxt[at]
                if len(goals) > 1 and came is not None:  # at a touching point turn left as far as possible
                    back = math.atan2(came[1] - at[1], came[0] - at[0])
                    goals.sort(key=lambda q: (back - math.atan2(q[1] - at[1], q[0] - at[0])) % (2 * math.pi))
                came, at = at, goals.pop(0)
                if not nxt[came]:
                    del nxt[came]
                if at == start:
                    break
            a = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
            if a > 0 or -a >= least_hole:
                out.append((pdf[key].iloc[0], len(out), [{"x": p[0], "y": p[1]} for p in ring], a < 0))
        return pd.DataFrame(out, columns=[key, "part", "ring", "is_hole"])

    return dissolve_edges(polygons, key).groupBy(key).applyInPandas(trace, f"`{key}` {kind}, part int, ring array<struct<x double, y double>>, is_hole boolean")


def strip_exclaves(parts: DataFrame, key: str, max_area: float | None = None) -> DataFrame:
    """Adds ``is_exclave``: every part of a unit but its largest, if it is not above the size."""
    w = Window.partitionBy(key).orderBy(F.desc("area"), "part")
    rows = parts.withColumn("_r", F.row_number().over(w))
    small = F.lit(True) if max_area is None else F.col("area") <= max_area
    return rows.withColumn("is_exclave", (F.col("_r") > 1) & small).drop("_r")


def eliminate_exclaves(parts: DataFrame, borders: DataFrame, key: str, max_area: float | None = None) -> DataFrame:
    """Exclaves join the unit they share the longest border with; ``borders`` is (part, other_key, length)."""
    flagged = strip_exclaves(parts, key, max_area)
    w = Window.partitionBy("part").orderBy(F.desc("length"), "other_key")
    best = borders.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("part", "other_key")
    out = flagged.join(best, "part", "left")
    return out.withColumn(key, F.when(F.col("is_exclave"), F.coalesce("other_key", key)).otherwise(F.col(key))).drop("other_key")


# ---- kernels ----
def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a convex, counter-clockwise polygon (half-plane by half-plane)."""
    out = subject
    for p, q in zip(clip, np.roll(clip, -1, 0), strict=True):
        if not len(out):
            break
        side = (q[0] - p[0]) * (out[:, 1] - p[1]) - (q[1] - p[1]) * (out[:, 0] - p[0])
        out = _cut(out, side)
    return out


def _cut(ring: np.ndarray, side: np.ndarray) -> np.ndarray:
    kept = []
    for i in range(len(ring)):
        a, b, s, t = ring[i - 1], ring[i], side[i - 1], side[i]
        if (s >= 0) != (t >= 0):
            kept.append(a + (b - a) * (s / (s - t)))
        if t >= 0:
            kept.append(b)
    return np.array(kept).reshape(-1, 2)


def ring_area(ring: np.ndarray) -> float:
    x, y = (ring[:, 0], ring[:, 1]) if len(ring) else (np.zeros(0), np.zeros(0))
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def overlaps(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """``(a_id, b_id, area)`` of convex polygons that overlap: grid join of bounds, exact clipping after."""
    bound = lambda df: df.select("id", "ring", bounds("ring").alias("_b")).select("id", "ring", "_b.*")
    pairs = rectangle_pairs(bound(a), bound(b), size).select("a_id", "b_id")
    rows = pairs.join(a.select(F.col("id").alias("a_id"), F.col("ring").alias("ra")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("ring").alias("rb")), "b_id")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("a_id", "b_id")}

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = lambda ring: np.array([(p["x"], p["y"]) for p in ring])
        for pdf in batches:
            made = []
            for ra, rb in zip(pdf.ra, pdf.rb, strict=True):
                clip = array(rb)
                if (clip[:, 0] * np.roll(clip[:, 1], -1) - np.roll(clip[:, 0], -1) * clip[:, 1]).sum() < 0:
                    clip = clip[::-1]
                made.append(ring_area(clip_convex(array(ra), clip)))
            yield pd.DataFrame({"a_id": pdf.a_id, "b_id": pdf.b_id, "area": made})

    return rows.mapInPandas(kernel, f"a_id {kinds['a_id']}, b_id {kinds['b_id']}, area double").where("area > 0")


def voronoi_cells(sites: np.ndarray, box: tuple[float, float, float, float], which: np.ndarray | None = None) -> list[np.ndarray]:
    """Voronoi cells of distinct sites in a box: the box cut by the bisectors of a site and its neighbours by distance,
    until no farther site can reach the cell."""
    x0, y0, x1, y1 = box
    start = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)
    out = []
    for s in sites if which is None else sites[which]:
        d = np.hypot(*(sites - s).T)
        cell = start
        for j in np.argsort(d, kind="stable"):
            if d[j] == 0:
                continue
            if len(cell) and d[j] > 2 * np.hypot(*(cell - s).T).max():
                break
            mid, n = (s + sites[j]) / 2, s - sites[j]
            cell = _cut(cell, (cell - mid) @ n)
            if not len(cell):
                break
        out.append(cell)
    return out


def _tile_kernel(size: float, box: tuple[float, float, float, float]):
    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.array([pdf.gx.iloc[0], pdf.gy.iloc[0]])
        mine = np.flatnonzero((pdf.tx == g[0]) & (pdf.ty == g[1]) & pdf.want)
        low, high = np.array(box[:2]) + (g - 1) * size, np.array(box[:2]) + (g + 2) * size
        low[low <= box[:2]], high[high >= box[2:]] = -np.inf, np.inf
        sites, made = pdf[["x", "y"]].to_numpy(), []
        for i, c in zip(mine, voronoi_cells(sites, box, mine), strict=True):
            reach = 2 * np.hypot(*(c - sites[i]).T).max() if len(c) else 0.0
            sure = bool((sites[i] - reach >= low).all() and (sites[i] + reach <= high).all())
            made.append((pdf.id.iloc[i], [{"x": float(p[0]), "y": float(p[1])} for p in c], sure))
        return pd.DataFrame(made, columns=["id", "ring", "sure"])

    return cells


def voronoi(points: DataFrame, margin: float = 1.0, box: tuple[float, float, float, float] | None = None, per_tile: int = 500) -> DataFrame:
    """``(id, ring)``: the Voronoi cell of each point, clipped to the box (the points' bounds and a margin).

    Tiles of about ``per_tile`` points work apart, each with the points of the tiles around it. A cell is sure when all
    sites that could cut it (within twice its reach) lie in those tiles; the others are done again with tiles four
    times as wide, until the tiles cover the box.
    """
    pts = points.select("id", F.col("x").cast("double"), F.col("y").cast("double"))
    r = pts.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
    if not r[4]:
        return pts.select("id", F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"))
    box = box or (r[0] - margin, r[1] - margin, r[2] + margin, r[3] + margin)
    extent = max(box[2] - box[0], box[3] - box[1])
    size = extent / max(1.0, math.sqrt(r[4] / per_tile))
    kind = points.schema["id"].dataType.simpleString()
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    wanted, out = pts.select("id"), None
    while True:
        own = pts.join(wanted.withColumn("want", F.lit(True)), "id", "left").na.fill(False, ["want"])
        own = own.withColumn("tx", F.floor((F.col("x") - box[0]) / size).cast("long")).withColumn("ty", F.floor((F.col("y") - box[1]) / size).cast("long"))
        spread = own.withColumn("gx", near("tx")).withColumn("gy", near("ty"))

        found = spread.groupBy("gx", "gy").applyInPandas(_tile_kernel(size, box), f"id {kind}, ring array<struct<x double, y double>>, sure boolean")
        found = shared_table(found, "voronoi")
        sure = found.where("sure").select("id", "ring")
        out = sure if out is None else out.unionByName(sure)
        wanted = found.where("NOT sure").select("id")
        if size >= extent or wanted.isEmpty():
            return out
        size *= 4


def voronoi_neighbours(cells: DataFrame, decimals: int = 6) -> DataFrame:
    """``(from_id, to_id)`` of cells that share a corner: an equi-join on rounded corners."""
    corners = cells.select("id", F.explode("ring").alias("p")).select("id", F.round("p.x", decimals).alias("x"), F.round("p.y", decimals).alias("y")).distinct()
    other = corners.withColumnRenamed("id", "to_id")
    return corners.join(other, ["x", "y"]).where("id < to_id").select(F.col("id").alias("from_id"), "to_id").distinct()


def delaunay_edges(cells: DataFrame, decimals: int = 6) -> DataFrame:
    """``(from_id, to_id)`` both ways: cells that share an edge of positive length, the dual of the Voronoi diagram."""
    ring = F.transform("ring", lambda p: F.struct(F.round(p["x"], decimals).alias("x"), F.round(p["y"], decimals).alias("y")))
    rows = cells.withColumn("r", ring)
    e = rows.select("id", F.explode(F.arrays_zip(F.col("r").alias("p"), _next(F.col("r")).alias("q"))).alias("e")).where("e.p <> e.q")
    e = e.select("id", F.least("e.p", "e.q").alias("p"), F.greatest("e.p", "e.q").alias("q"))
    return e.join(e.withColumnRenamed("id", "to_id"), ["p", "q"]).where("id <> to_id").select(F.col("id").alias("from_id"), "to_id").distinct()


def weighted_centroids(points: DataFrame, key: str, weight: str) -> DataFrame:
    """``(key, x, y)``: weighted mean position; the plain mean where weights add up to 0."""
    s = F.sum(weight)
    mean = lambda c: F.coalesce(ratio(F.sum(F.col(c) * F.col(weight)), s), F.avg(c)).alias(c)
    return points.groupBy(key).agg(mean("x"), mean("y"))


def antenna_centroids(cells: DataFrame, distance: float) -> DataFrame:
    """Antennas ``(cell_name, x, y, azim)`` with ``xcent, ycent``: the place shifted along the azimuth (degrees from
    north); azimuths above 360 are missing and do not shift."""
    a = F.radians(F.when(F.col("azim") <= 360, F.col("azim")))
    return cells.withColumn("xcent", F.col("x") + F.coalesce(distance * F.sin(a), F.lit(0.0))).withColumn("ycent", F.col("y") + F.coalesce(distance * F.cos(a), F.lit(0.0)))


def point_spread(points: DataFrame, key: str) -> DataFrame:
    """``(key, x, y, spread)``: centre and area of the bounding box of each group's points."""
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), box.alias("spread"))


def cell_pairs(site_pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of cells of neighbouring sites and of one site: ``site_pairs`` (from_id, to_id), ``cells`` (site, cell)."""
    a, b = cells.select(F.col("site").alias("from_id"), F.col("cell").alias("cell_a")), cells.select(F.col("site").alias("to_id"), F.col("cell").alias("cell_b"))
    across = site_pairs.join(a, "from_id").join(b, "to_id").select("cell_a", "cell_b")
    same = a.join(b, F.col("from_id") == F.col("to_id")).where("cell_a < cell_b").select("cell_a", "cell_b")
    return across.union(same)


def equalisation_groups(polygons: DataFrame, target_area: float, seed: int = 1711) -> DataFrame:
    """``(id, cluster)``: polygons grouped to about the target area by weighted k-means of their centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = polygons.select("id", area("ring").alias("area"), centroid("ring").alias("c")).select("id", "area", "c.x", "c.y")
    n = rows.agg(F.sum(F.least(F.col("area"), F.lit(1.5 * target_area))) / target_area).first()[0] or 1
    data = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows)
    model = KMeans(k=max(2, round(n)), seed=seed, weightCol="area", featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select("id", "cluster")


def compactness_criterion(area_: Column, perimeter_: Column, target: float) -> Column:
    """Deviation from the target area times the perimeter over that of a circle of the same area."""
    return F.abs(1 - area_ / target) * perimeter_ / (2 * F.sqrt(math.pi * area_))
