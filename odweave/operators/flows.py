"""Interactions from anchors, interaction metrics, cores of several units.

Interaction tables have ``from_id, to_id`` and one or more strengths; anchors have ``user_id, site_id, importance,
type`` with type codes for home, work and multi-purpose anchors. Pairs are unique after loading: duplicates add up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import ratio, top_rows
from odweave.operators.iterate import connected_components

HOME, WORK, MULTI = "k", "t", "m"


def interactions(df: DataFrame, from_id: str, to_id: str, *strengths: str) -> DataFrame:
    """Canonical names, one row for each pair."""
    named = df.select(F.col(from_id).alias("from_id"), F.col(to_id).alias("to_id"), *[F.col(s) for s in strengths])
    return named.groupBy("from_id", "to_id").agg(*[F.sum(s).alias(s) for s in strengths])


@dataclass(frozen=True)
class Generator:
    """How one user's anchors become interactions.

    ``source`` and ``target`` weight anchor types (None: every type counts 1). ``maximum`` links only the most
    important source with the most important other target; otherwise the user's one unit is spread in proportion.
    """

    name: str
    source: dict[str, float] | None
    target: dict[str, float] | None
    maximum: bool = False
    selfinter: bool = True

    def weight(self, side: dict[str, float] | None) -> Column:
        if side is None:
            return F.col("importance").cast("double")
        w = F.lit(0.0)
        for code, v in side.items():
            w = F.when(F.col("type") == code, F.lit(float(v))).otherwise(w)
        return F.col("importance") * w


def default_generators(home: str = HOME, work: str = WORK, multi: str = MULTI, multi_home: float = 0.5, selfinter: bool = True) -> list[Generator]:
    """General, home-based and home-work flows, spread in proportion or between the first anchors only."""
    at_home = {home: 1.0, multi: multi_home}
    at_work = {work: 1.0, multi: 1 - multi_home}
    return [
        Generator("general", None, None, False, selfinter),
        Generator("homebased", at_home, None, False, selfinter),
        Generator("homework", at_home, at_work, False, selfinter),
        Generator("genfirst", at_home, None, True, selfinter),
        Generator("homefirst", at_home, None, True, selfinter),
        Generator("homeworkfirst", at_home, at_work, True, selfinter),
    ]


def _weighted(anchors: DataFrame, g: Generator) -> DataFrame:
    sides = anchors.select("user_id", "site_id", g.weight(g.source).alias("s"), g.weight(g.target).alias("t"))
    return sides.groupBy("user_id", "site_id").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def proportional(anchors: DataFrame, g: Generator) -> DataFrame:
    """``(from_id, to_id, strength)``: with self-interaction the proportional fit of an all-ones seed is the outer
    product of the shares, so it is a self-join on the user; without, small groups are fitted iteratively."""
    sites = _weighted(anchors, g)
    if not g.selfinter:
        return _fitted_without_self(sites)
    user = Window.partitionBy("user_id")
    sites = sites.withColumn("s_all", F.sum("s").over(user)).withColumn("t_all", F.sum("t").over(user)).where("s_all > 0")
    src = sites.where("s > 0").select("user_id", F.col("site_id").alias("from_id"), (F.col("s") / F.col("s_all")).alias("s"), "t_all")
    dst = sites.where("t > 0").select("user_id", F.col("site_id").alias("to_id"), (F.col("t") / F.col("t_all")).alias("t"))
    pairs = src.where("t_all > 0").join(dst, "user_id").select("from_id", "to_id", (F.col("s") * F.col("t")).alias("strength"))
    alone = src.where("t_all <= 0 OR t_all IS NULL").select("from_id", F.col("from_id").alias("to_id"), F.col("s").alias("strength"))
    return pairs.unionByName(alone).groupBy("from_id", "to_id").agg(F.sum("strength").alias("strength"))


def fit_margins(seed: np.ndarray, rows: np.ndarray, cols: np.ndarray, tol: float = 1e-9, limit: int = 100) -> np.ndarray:
    """Iterative proportional fitting of a small matrix; zero sums divide by 1."""
    m = seed.astype(float)
    for _ in range(limit):
        old = m.copy()
        sums = m.sum(1)
        m = m * (rows / np.where(sums == 0, 1, sums))[:, None]
        sums = m.sum(0)
        m = m * (cols / np.where(sums == 0, 1, sums))[None, :]
        if np.abs(m - old).sum() <= tol:
            break
    sums = m.sum(1)
    return m * (rows / np.where(sums == 0, 1, sums))[:, None]


def _fitted_without_self(sites: DataFrame) -> DataFrame:
    site_type = sites.schema["site_id"].dataType.simpleString()

    def user(pdf: pd.DataFrame) -> pd.DataFrame:
        s, t, n = pdf["s"].to_numpy(float), pdf["t"].to_numpy(float), len(pdf)
        allowed = 1.0 - np.eye(n)
        s = s * ((allowed * (t > 0)).sum(1) > 0)
        t = t * ((allowed * (s > 0)[:, None]).sum(0) > 0)
        if s.sum() <= 0 or t.sum() <= 0:
            return pd.DataFrame({"from_id": [], "to_id": [], "strength": []})
        m = fit_margins(allowed, s / s.sum(), t / t.sum())
        i, j = np.nonzero(m)
        site = pdf["site_id"].to_numpy()
        return pd.DataFrame({"from_id": site[i], "to_id": site[j], "strength": m[i, j]})

    out = sites.groupBy("user_id").applyInPandas(user, f"from_id {site_type}, to_id {site_type}, strength double")
    return out.groupBy("from_id", "to_id").agg(F.sum("strength").alias("strength"))


def maximum(anchors: DataFrame, g: Generator) -> DataFrame:
    """One interaction a user, from the most important source to the most important other target."""
    sites = _weighted(anchors, g)
    total = F.sum("t").over(Window.partitionBy("user_id"))
    src = top_rows(sites.withColumn("t_all", total).where("s > 0"), ["user_id"], "s", "site_id")
    src = src.select("user_id", F.col("site_id").alias("from_id"), (F.col("t_all") - F.col("t")).alias("rest"))
    others = sites.where("t > 0").join(src.select("user_id", "from_id"), "user_id").where("site_id <> from_id")
    dst = top_rows(others, ["user_id"], "t", "site_id").select("user_id", F.col("site_id").alias("to_id"))
    pairs = src.join(dst, "user_id", "left")
    if g.selfinter:
        pairs = pairs.withColumn("to_id", F.coalesce("to_id", "from_id"))
    return pairs.where("to_id IS NOT NULL").groupBy("from_id", "to_id").agg(F.count(F.lit(1)).cast("double").alias("strength"))


def from_anchors(anchors: DataFrame, generators: list[Generator] | None = None) -> DataFrame:
    """One row for each pair with a column for each generator, 0 where a generator has no flow.

    Results are stacked with their generator's name and pivoted in one aggregation, instead of a chain of outer joins.
    """
    generators = generators or default_generators()
    out = None
    for g in generators:
        one = (maximum if g.maximum else proportional)(anchors, g).withColumn("name", F.lit(g.name))
        out = one if out is None else out.unionByName(one)
    wide = out.groupBy("from_id", "to_id").agg(*[F.sum(F.when(F.col("name") == g.name, F.col("strength"))).alias(g.name) for g in generators])
    return wide.na.fill(0.0, [g.name for g in generators])


def both_directions(flows: DataFrame, strength: str = "strength", distance: str | None = None) -> DataFrame:
    """Pairs with the smaller id first: both directions, their sum, counter-flow and its share, also per distance.

    One aggregation by the unordered pair replaces a full outer self-join. Self flows are left out.
    """
    named = flows.where("from_id <> to_id").withColumn("forward", F.col("from_id") < F.col("to_id"))
    aggs = [F.sum(F.when(F.col("forward"), F.col(strength)).otherwise(0)).alias(f"{strength}_one"), F.sum(F.when(~F.col("forward"), F.col(strength)).otherwise(0)).alias(f"{strength}_other")]
    if distance:
        aggs.append(F.max(distance).alias(distance))
    out = named.groupBy(F.least("from_id", "to_id").alias("id_one"), F.greatest("from_id", "to_id").alias("id_other")).agg(*aggs)
    one, other = F.col(f"{strength}_one"), F.col(f"{strength}_other")
    out = out.withColumn(strength, one + other).withColumn(f"{strength}_cpabs", 2 * F.least(one, other))
    out = out.withColumn(f"{strength}_cp", ratio(f"{strength}_cpabs", strength))
    if distance:
        out = out.withColumn(f"{strength}_per_{distance}", ratio(strength, distance)).withColumn(f"{strength}_cp_per_{distance}", ratio(f"{strength}_cp", distance))
    return out


def add_distances(flows: DataFrame, places: DataFrame, x: str = "x", y: str = "y", factor: float = 1.0) -> DataFrame:
    """Straight-line distance of every pair; NULL where an end has no place."""
    a = places.select(F.col("id").alias("from_id"), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    b = places.select(F.col("id").alias("to_id"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    out = flows.join(a, "from_id", "left").join(b, "to_id", "left")
    d = F.sqrt((F.col("_x1") - F.col("_x2")) * (F.col("_x1") - F.col("_x2")) + (F.col("_y1") - F.col("_y2")) * (F.col("_y1") - F.col("_y2")))
    return out.withColumn("distance", d / factor).drop("_x1", "_y1", "_x2", "_y2")


def unmatched_ids(flows: DataFrame, places: DataFrame) -> DataFrame:
    """Ids of interactions that have no place."""
    ids = flows.select(F.col("from_id").alias("id")).union(flows.select("to_id")).distinct()
    return ids.join(places.select("id"), "id", "left_anti")


def to_lines(flows: DataFrame, places: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Interactions with a straight WKT line between their ends."""
    a = places.select(F.col("id").alias("from_id"), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    b = places.select(F.col("id").alias("to_id"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    out = flows.join(a, "from_id", "left").join(b, "to_id", "left")
    text = [F.col(c).cast("string") for c in ("_x1", "_y1", "_x2", "_y2")]
    wkt = F.concat(F.lit("LINESTRING ("), text[0], F.lit(" "), text[1], F.lit(", "), text[2], F.lit(" "), text[3], F.lit(")"))
    return out.withColumn("wkt", wkt).drop("_x1", "_y1", "_x2", "_y2")


TARGETS = ("to_core", "to_hinterland", "within_region", "outof_region", "to_largest")


def unit_flow_summary(flows: DataFrame, units: DataFrame, strength: str = "strength") -> DataFrame:
    """Outflows of each unit by kind of target, and total in- and outflow.

    A target is out of the region, within it, its core, its hinterland, or the region's unit of largest inflow; the
    later kinds override. Flows to the largest unit count to the core as well.
    """
    noself = flows.where("from_id <> to_id").select("from_id", "to_id", F.col(strength).alias("v"))
    inflow = noself.join(units.select(F.col("id").alias("to_id"), "region"), "to_id").groupBy("region", "to_id").agg(F.sum("v").alias("v"))
    largest = top_rows(inflow, ["region"], "v", "to_id").select(F.col("region").alias("region_to"), F.col("to_id").alias("largest"))
    src = units.select(F.col("id").alias("from_id"), F.col("region").alias("region_from"), F.col("is_core").alias("core_from"))
    dst = units.select(F.col("id").alias("to_id"), F.col("region").alias("region_to"), F.col("is_core").alias("core_to"))
    both = noself.join(src, "from_id").join(dst, "to_id", "left").join(largest, "region_to", "left")
    same = F.col("region_from") == F.col("region_to")
    kind = F.when(same & (F.col("to_id") == F.col("largest")), "to_largest").when(same & F.col("core_to"), "to_core")
    kind = kind.when(same & ~F.col("core_to") & F.col("core_from"), "to_hinterland").when(same, "within_region").otherwise("outof_region")
    sums = both.withColumn("kind", kind).groupBy("from_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("v"))), F.lit(0)).alias(k) for k in TARGETS])
    sums = sums.withColumn("to_core", F.col("to_core") + F.col("to_largest"))
    outs = flows.groupBy(F.col("from_id").alias("id")).agg(F.sum(strength).alias("outflow"))
    ins = flows.groupBy(F.col("to_id").alias("id")).agg(F.sum(strength).alias("inflow"))
    every = units.select("id").join(sums.withColumnRenamed("from_id", "id"), "id", "left").join(outs, "id", "left").join(ins, "id", "left")
    return every.na.fill(0, [*TARGETS, "outflow", "inflow"])


def undirected_pairs(df: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def multicores(flows: DataFrame, minimum: float, importance: DataFrame | None = None, presets: DataFrame | None = None, strength: str = "strength") -> DataFrame:
    """``(id, multicore)``: groups of units that strong flows connect, named by their most important member.

    Importance is total inflow unless given as ``(id, importance)``. ``presets`` adds pairs ``(a, b)``.
    """
    pairs = undirected_pairs(flows.where(F.col(strength) >= minimum))
    if presets is not None:
        pairs = pairs.union(presets.select("a", "b")).distinct()
    groups = connected_components(pairs).withColumnRenamed("node", "id")
    if importance is None:
        importance = flows.groupBy(F.col("to_id").alias("id")).agg(F.sum(strength).alias("importance"))
    members = groups.join(importance, "id", "left")
    heads = top_rows(members, ["component"], "importance", "id").select("component", F.col("id").alias("multicore"))
    return members.join(heads, "component").select("id", "multicore")


def in_any_column(df: DataFrame, id_col: str, others: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose id stands in any of the given columns."""
    ids = None
    for table, name in others:
        one = table.select(F.col(name).alias(id_col))
        ids = one if ids is None else ids.union(one)
    return df.join(ids.distinct(), id_col, "left_semi")
