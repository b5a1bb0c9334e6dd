"""Rasters as cell tables, affine worlds, potential surfaces."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions.columns import INVERSES, lagged_decay


@dataclass(frozen=True)
class World:
    """The affine transformation of a raster: cell sizes, rotations, and the centre of the upper left cell."""

    xx: float
    yx: float
    xy: float
    yy: float
    x0: float
    y0: float

    @classmethod
    def read(cls, text: str) -> World:
        return cls(*(float(line) for line in text.split()[:6]))

    @classmethod
    def rect(cls, left: float, top: float, size: float) -> World:
        return cls(size, 0.0, 0.0, -size, left + size / 2, top - size / 2)

    def geotransform(self) -> tuple[float, ...]:
        """Upper left corner, then the cell vectors."""
        return self.x0 - self.xx / 2 - self.xy / 2, self.xx, self.xy, self.y0 - self.yx / 2 - self.yy / 2, self.yx, self.yy

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.x0 + col * self.xx + row * self.xy, self.y0 + col * self.yx + row * self.yy


def world_paths(path: str) -> list[str]:
    """Names a raster's world file may have."""
    stem, _, ext = path.rpartition(".")
    return [f"{stem}.{ext[0]}{ext[-1]}w", f"{path}w", f"{stem}.wld", f"{stem}.tfw"]


def cells_to_points(cells: DataFrame, world: World, nodata: float | None = None) -> DataFrame:
    """``(x, y, value)`` of raster cells ``(row, col, value)`` other than nodata."""
    x, y = world.centre(F.col("row"), F.col("col"))
    out = cells.select(x.alias("x"), y.alias("y"), "value").where("value IS NOT NULL")
    return out if nodata is None else out.where(F.col("value") != nodata)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, col, value)`` of rasters stored as numpy arrays; every file is unpacked on an executor."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                a = np.load(io.BytesIO(content))
                for first in range(0, len(a), 1024):
                    block = a[first : first + 1024]
                    row, col = np.indices(block.shape)
                    yield pd.DataFrame({"path": name, "row": row.ravel() + first, "col": col.ravel(), "value": block.ravel().astype(float)})

    return files.mapInPandas(unpack, "path string, row long, col long, value double")


def snapped_bounds(points: DataFrame, cell: float, extension: float = 0.0) -> tuple[float, float, float, float]:
    """Bounds of the points, extended and snapped outwards to the cell size."""
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    down, up = lambda v: math.floor((v - extension) / cell) * cell, lambda v: math.ceil((v + extension) / cell) * cell
    return down(r[0]), down(r[1]), up(r[2]), up(r[3])


def potential(points: DataFrame, bounds: tuple[float, float, float, float], cell: float, decay: str = "gaussian", tolerance: float = 0.01, how: str = "sum") -> DataFrame:
    """``(row, col, value)``: the sum or maximum of magnitude times decay of distance over the cells where a point
    contributes at least the tolerance; row 0 is the top.

    Points ``(x, y, magnitude, halfrange, fullrange)`` explode to the cells in their own reach only, and contributions
    are added up in the map side of one aggregation.
    """
    x0, y0, x1, y1 = bounds
    cols, rows = round((x1 - x0) / cell), round((y1 - y0) / cell)
    p = points.where(F.col("magnitude") > tolerance)
    half, full = F.col("halfrange") / cell, F.col("fullrange") / cell
    reach = INVERSES[decay](F.lit(tolerance) / F.col("magnitude"), half - full) + full
    cx, cy = (F.col("x") - x0) / cell, (F.col("y") - y0) / cell
    span = lambda c, n: F.when((c + reach >= 0) & (c - reach < n), F.sequence(F.greatest(F.floor(c - reach), F.lit(0)).cast("int"), F.least(F.ceil(c + reach), F.lit(n - 1)).cast("int")))
    p = p.select("*", cx.alias("cx"), cy.alias("cy"), F.explode(span(cx, cols)).alias("col"), span(cy, rows).alias("_r")).withColumn("up", F.explode("_r"))
    d = F.hypot(F.col("col") + 0.5 - F.col("cx"), F.col("up") + 0.5 - F.col("cy"))
    v = F.col("magnitude") * lagged_decay(decay, d, half, full)
    hits = p.select((F.lit(rows - 1) - F.col("up")).alias("row"), "col", v.alias("v")).where(F.col("v") >= tolerance)
    return hits.groupBy("row", "col").agg((F.max if how == "max" else F.sum)("v").alias("value"))
