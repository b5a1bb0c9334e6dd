"""Road layers: selection, default repair, speeds, splitting at crossings, urban parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import lookup, ratio, repair_defaults, select_in


def select_roads(roads: DataFrame, rideable: dict[str, list], keep: list[str], defaults: dict[str, tuple] | None = None) -> DataFrame:
    """Roads whose attributes are listed, with the kept attributes; ``defaults`` maps an attribute to (default value,
    {other attribute: {value: replacement}})."""
    out = select_in(roads, rideable)
    for target, (default, sources) in (defaults or {}).items():
        out = repair_defaults(out, target, default, sources)
    return out.select(*keep)


def speeds(roads: DataFrame, mapping: dict, maxspeed: str | None = "maxspeed", length: str = "length") -> DataFrame:
    """Adds ``speed`` (by a nested mapping of attributes, not above a limit that is set) and ``time`` in seconds for a
    length in metres and speeds in km/h."""
    speed = lookup(*next(iter(mapping.items()))).cast("double")
    if maxspeed:
        limit = F.col(maxspeed)
        speed = F.when(limit.isNotNull() & (limit != 0), F.least(speed, limit.cast("double"))).otherwise(speed)
    return roads.withColumn("speed", speed).withColumn("time", ratio(F.col(length) * 3.6, "speed"))


def segments(lines: DataFrame, line: str = "ring") -> DataFrame:
    """``(id, layer, pos, ax, ay, bx, by)``: the segments of each line in order."""
    a, b = F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1)
    rows = lines.where(F.size(line) > 1).select("id", "layer", F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("pos", "s"))
    return rows.select("id", "layer", "pos", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def crossings(segs: DataFrame, size: float) -> DataFrame:
    """``(id, pos, t)``: where segments of one vertical layer cross or touch another line, as the position along the
    segment. Candidates meet in grid cells."""
    lo = lambda a, b: F.floor(F.least(a, b) / size).cast("long")
    hi = lambda a, b: F.floor(F.greatest(a, b) / size).cast("long")
    cells = segs.withColumn("cx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("cy", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    other = cells.select("cx", "cy", "layer", *[F.col(c).alias(f"o_{c}") for c in ("id", "pos", "ax", "ay", "bx", "by")])
    c = F.col
    rx, ry, sx, sy = c("bx") - c("ax"), c("by") - c("ay"), c("o_bx") - c("o_ax"), c("o_by") - c("o_ay")
    den = rx * sy - ry * sx
    qx, qy = c("o_ax") - c("ax"), c("o_ay") - c("ay")
    t, u = F.try_divide(qx * sy - qy * sx, den), F.try_divide(qx * ry - qy * rx, den)
    hits = cells.join(other, ["cx", "cy", "layer"]).where("id <> o_id").withColumn("t", F.round(t, 9)).withColumn("u", F.round(u, 9))
    return hits.where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1").select("id", "pos", "t").distinct()


def split_at_crossings(lines: DataFrame, size: float) -> DataFrame:
    """``(id, part, ring)``: every line cut where another line of its layer crosses or touches it."""
    segs = segments(lines)
    cuts = crossings(segs, size).groupBy("id", "pos").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    rows = segs.join(cuts, ["id", "pos"], "left")
    inner = F.coalesce(F.filter("ts", lambda t: (t > 0) & (t < 1)), F.array().cast("array<double>"))
    at = F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))
    rows = rows.withColumn("at", at).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("at") - 1)))
    point = lambda t: F.struct((F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
    f, t = F.element_at("at", F.col("k")), F.element_at("at", F.col("k") + 1)
    opens = (F.col("k") > 1) | F.array_contains(F.coalesce("ts", F.array().cast("array<double>")), 0.0)
    closed = F.array_contains(F.coalesce("ts", F.array().cast("array<double>")), 1.0) & (F.col("k") == F.size("at") - 1)
    rows = rows.select("id", "pos", "k", point(f).alias("p"), point(t).alias("q"), opens.alias("opens"), closed.alias("closed"))
    w = Window.partitionBy("id").orderBy("pos", "k")
    new = F.col("opens") | F.coalesce(F.lag("closed").over(w), F.lit(False))
    rows = rows.withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(w) - F.first("new").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "k", "p", "q")))
    return rows.groupBy("id", "part").agg(ordered.alias("s")).select("id", "part", F.concat(F.transform("s", lambda r: r["p"]), F.array(F.element_at("s", -1)["q"])).alias("ring"))


def urban_flags(parts: DataFrame, inside: DataFrame, share: float = 0.95) -> DataFrame:
    """Adds ``urban``: more than the share of a part's length lies in urban areas; ``inside`` is (part, length_inside)."""
    rows = parts.join(inside, "part", "left").na.fill(0.0, ["length_inside"])
    return rows.withColumn("urban", F.coalesce(ratio("length_inside", "length"), F.lit(0.0)) > share).drop("length_inside")


def part_edge(cost: Column, position: Column) -> tuple[Column, Column]:
    """Costs of both parts of an edge that a point splits in proportion."""
    return cost * position, cost * (1 - position)
