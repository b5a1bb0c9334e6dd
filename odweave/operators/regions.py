"""Region delimitation: criteria, targets, and stepwise aggregation.

A state is ``(unit_id, region, is_core)``; each unit starts as its own region and core.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.functions.columns import top_rows

SENTINEL = 2**31 - 1


def initial_state(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("unit_id"), F.col("id").alias("region"), F.lit(True).alias("is_core"))


def apply_presets(state: DataFrame, presets: DataFrame, core: bool) -> DataFrame:
    """``presets`` is ``(unit_id, region)``: a core preset keeps the units' core flag, another clears it."""
    p = presets.where("region IS NOT NULL").select("unit_id", F.col("region").alias("_p"))
    out = state.join(p, "unit_id", "left")
    flag = F.col("is_core") if core else F.when(F.col("_p").isNull() | (F.col("_p") == F.col("unit_id")), F.col("is_core")).otherwise(F.lit(False))
    return out.select("unit_id", F.coalesce("_p", "region").alias("region"), flag.alias("is_core"))


# Criteria: each is an aggregate over a state joined with units and outflows.
def constant() -> Column:
    return F.first(F.lit(1))


def unit_count() -> Column:
    return F.count(F.lit(1))


def sourceflow_sum() -> Column:
    """All outflows of member units, internal ones too."""
    return F.coalesce(F.sum("outflow"), F.lit(0))


def property_sum(name: str) -> Column:
    return F.sum(name)


def hinterland_sum(name: str) -> Column:
    """The property outside core units; 0 where the region has no core."""
    total, core = F.coalesce(F.sum(name), F.lit(0)), F.sum(F.when(F.col("is_core"), F.col(name)))
    return F.when(core.isNull(), F.lit(0)).otherwise(total - core)


def criterion(name: str) -> Column:
    """A criterion by name: ``constant``, ``unit_count``, ``sourceflow_sum``, ``hinterland_<property>`` or a property."""
    fixed = {"constant": constant, "unit_count": unit_count, "sourceflow_sum": sourceflow_sum}
    if name in fixed:
        return fixed[name]()
    return hinterland_sum(name.removeprefix("hinterland_")) if name.startswith("hinterland_") else property_sum(name)


def evaluate(state: DataFrame, units: DataFrame, flows: DataFrame, criteria: list[str], strength: str = "strength") -> DataFrame:
    """``(region, criteria..)`` in one aggregation."""
    known = {"constant", "unit_count", "sourceflow_sum"}
    props = sorted({c.removeprefix("hinterland_") for c in criteria if c not in known})
    rows = state.join(units.select(F.col("id").alias("unit_id"), *props), "unit_id", "left")
    rows = rows.join(flows.groupBy(F.col("from_id").alias("unit_id")).agg(F.sum(strength).alias("outflow")), "unit_id", "left")
    return rows.groupBy("region").agg(*[criterion(c).alias(c) for c in criteria])


def verified(evaluation: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Adds ``verified``: every criterion reaches its minimum (all do without minimums)."""
    ok = F.lit(True)
    for name, least in minimums.items():
        ok = ok & (F.col(name) >= least)
    return evaluation.withColumn("verified", ok)


def target_strengths(state: DataFrame, flows: DataFrame, source_core: bool = False, target_core: bool = False, strength: str = "strength") -> DataFrame:
    """``(region, unit_id, target, strength)``: flows of (core) units to other regions; with ``target_core`` only flows
    to core units count, though a unit that has none keeps its candidates with strength 0."""
    a = state.select(F.col("unit_id").alias("from_id"), F.col("region"), F.col("is_core").alias("ca"))
    b = state.select(F.col("unit_id").alias("to_id"), F.col("region").alias("target"), F.col("is_core").alias("cb"))
    rows = flows.join(a, "from_id").join(b, "to_id").where("region <> target")
    if source_core:
        rows = rows.where("ca")
    v = F.col(strength) * F.col("cb").cast("int") if target_core else F.col(strength)
    return rows.groupBy("region", F.col("from_id").alias("unit_id"), "target").agg(F.sum(v).alias("strength"))


def region_targets(state: DataFrame, flows: DataFrame, **options) -> DataFrame:
    """``(region, target)``: the region that each region's units are drawn to most; smallest id on ties."""
    sums = target_strengths(state, flows, **options).groupBy("region", "target").agg(F.sum("strength").alias("strength"))
    return top_rows(sums, ["region"], "strength", "target")


def unit_targets(state: DataFrame, flows: DataFrame, **options) -> DataFrame:
    """``(region, unit_id, target)``: each unit's own strongest target, for dissolving a region."""
    return top_rows(target_strengths(state, flows, **options), ["region", "unit_id"], "strength", "target")


def stepwise(state: DataFrame, units: DataFrame, flows: DataFrame, criteria: list[str], minimums: dict[str, float], source_core: bool = False, target_core: bool = False, dissolve: bool = False, strength: str = "strength") -> DataFrame:
    """``(unit_id, region, is_core, stage)``: aggregate the weakest region into its target until all pass.

    Each step depends on all steps before it, so the loop runs in one task, on pre-aggregated flows between units (one
    row a pair) and one row a unit: its input is the zoning, whose size does not grow with the flow records.
    ``stage`` is the step at which the unit's first region was dissolved, NULL for regions that remain.
    """
    known = {"constant", "unit_count", "sourceflow_sum"}
    props = sorted({c.removeprefix("hinterland_") for c in criteria if c not in known})
    u = state.join(units.select(F.col("id").alias("unit_id"), *props), "unit_id", "left").withColumn("kind", F.lit("u"))
    f = flows.groupBy(F.col("from_id").alias("unit_id"), F.col("to_id").alias("region")).agg(F.sum(strength).cast("double").alias("strength")).withColumn("kind", F.lit("f"))
    both = u.unionByName(f, allowMissingColumns=True).withColumn("_one", F.lit(1))
    kind = state.schema["unit_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf.kind == "u"].sort_values("unit_id")
        region = dict(zip(rows.unit_id, rows.region, strict=True))
        core = dict(zip(rows.unit_id, rows.is_core.astype(bool), strict=True))
        prop = {p: dict(zip(rows.unit_id, rows[p].fillna(0), strict=True)) for p in props}
        out: dict = {i: [] for i in region}
        for a, b, v in pdf[pdf.kind == "f"][["unit_id", "region", "strength"]].itertuples(index=False):
            if a in out:
                out[a].append((b, v))
        members: dict = {}
        for i, r in region.items():
            members.setdefault(r, set()).add(i)

        def value(name: str, r) -> float:
            own = members[r]
            if name == "constant":
                return 1
            if name == "unit_count":
                return len(own)
            if name == "sourceflow_sum":
                return sum(v for i in own for _, v in out[i])
            p = prop[name.removeprefix("hinterland_")]
            if not name.startswith("hinterland_"):
                return sum(p[i] for i in own)
            return sum(p[i] for i in own if not core[i]) if any(core[i] for i in own) else 0

        def drawn(i) -> dict:
            sums: dict = {}
            if source_core and not core[i]:
                return sums
            for j, v in out[i]:
                if j in region and region[j] != region[i]:
                    sums[region[j]] = sums.get(region[j], 0) + v * (core[j] if target_core else 1)
            return sums

        table = {r: [value(c, r) for c in criteria] for r in sorted(members)}
        stage, step = {}, 0
        while table:
            code = min(table, key=lambda r: (table[r][0], r))
            if all(v >= minimums.get(c, float("-inf")) for c, v in zip(criteria, table[code], strict=True)):
                if len(criteria) == 1 or table[code][0] == SENTINEL:
                    break
                table[code][0] = SENTINEL
                continue
            step += 1
            moving = sorted(members.get(code, ()))
            if dissolve:
                goal = {i: min(d, key=lambda r: (-d[r], r)) for i in moving if (d := drawn(i))}
            else:
                sums: dict = {}
                for i in moving:
                    for r, v in drawn(i).items():
                        sums[r] = sums.get(r, 0) + v
                goal = dict.fromkeys(moving, min(sums, key=lambda r: (-sums[r], r))) if sums else {}
            for i, r in goal.items():
                region[i], core[i] = r, False
                stage.setdefault(i, step)
                members[code].discard(i)
                members.setdefault(r, set()).add(i)
            for r in set(goal.values()):
                if r in table:
                    table[r] = [value(c, r) for c in criteria]
            del table[code]
        ids = sorted(region)
        return pd.DataFrame({"unit_id": ids, "region": [region[i] for i in ids], "is_core": [core[i] for i in ids], "stage": pd.array([stage.get(i) for i in ids], "Int32")})

    return both.groupBy("_one").applyInPandas(run, f"unit_id {kind}, region {kind}, is_core boolean, stage int")


def markov_regions(flows: DataFrame, masses: DataFrame, minimum: float, direct: bool = False, strength: str = "strength") -> DataFrame:
    """``(unit_id, region)``: the lightest region below the minimum joins the one that is reached first from it (mean
    first passage time of the flows as a Markov chain), or with ``direct`` the one with the largest flow to it.

    One task over the zoning's flow matrix, as each step needs the regions of the step before.
    """
    from odweave.operators.graphs import _matrix_kernel, passage_times

    f = flows.groupBy("from_id", "to_id").agg(F.sum(strength).cast("double").alias("strength"))
    m = masses.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.col("mass").cast("double").alias("mass"))
    rows = f.withColumn("mass", F.lit(None).cast("double")).unionByName(m.withColumn("strength", F.lit(0.0))).withColumn("_one", F.lit(1))
    kind = flows.schema["from_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, matrix = _matrix_kernel(pdf)
        mass = pdf.dropna(subset=["mass"]).groupby("from_id").mass.sum().reindex(ids).fillna(0).to_numpy()
        n = len(ids)
        region = np.arange(n)
        while True:
            names = np.unique(region)
            sums = np.array([mass[region == r].sum() for r in names])
            k = int(sums.argmin())
            if sums[k] >= minimum or len(names) < 2:
                break
            member = (region[:, None] == names[None, :]).astype(float)
            grouped = member.T @ matrix @ member
            if direct:
                score = grouped[k].copy()
                score[k] = -1
                best = int(score.argmax())
                if score[best] <= 0:
                    best = None
            else:
                p = grouped + np.eye(len(names)) * (grouped.sum(1) == 0)[:, None] + 1e-12
                t = passage_times(p / p.sum(1, keepdims=True))[k]
                t[k] = np.inf
                best = int(t.argmin())
            if best is None:
                mass[region == names[k]] = np.inf
                continue
            region[region == names[k]] = names[best]
        return pd.DataFrame({"unit_id": ids, "region": [ids[r] for r in region]})

    return rows.groupBy("_one").applyInPandas(run, f"unit_id {kind}, region {kind}")
