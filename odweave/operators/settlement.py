"""Hierarchical settlement-system models.

A model is ``(id, parent, stage)`` with stage N (node of the hierarchy), O (organic: part of its parent's urban
system) or A (autonomous: outside the tree). Criteria that are sums over links are plans; builders and path-based
criteria are small kernels over the matrix of the zoning, which has one row a unit whatever the number of trips.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import ratio, top_rows
from odweave.operators.graphs import _matrix_kernel, ancestors, parent_cycles, passage_times, strong_components
from odweave.operators.privacy import uniform


# ---- relation vectors and single-step choices ----
def relation_vectors(flows: DataFrame, strength: str = "strength") -> DataFrame:
    """``(id, outsum, insum, selfsum, max_out, unit_weight)``; a unit without outflow counts as one self flow of 1."""
    v = F.col(strength)
    outs = flows.groupBy(F.col("from_id").alias("id")).agg(F.sum(v).alias("outsum"), F.sum(F.when(F.col("from_id") == F.col("to_id"), v).otherwise(0)).alias("selfsum"), F.coalesce(F.max(F.when(F.col("from_id") != F.col("to_id"), v)), F.lit(0)).alias("max_out"))
    ins = flows.groupBy(F.col("to_id").alias("id")).agg(F.sum(v).alias("insum"))
    out = outs.join(ins, "id", "full").na.fill(0)
    absorbing = F.col("outsum") == 0
    out = out.withColumn("selfsum", F.when(absorbing, 1).otherwise(F.col("selfsum"))).withColumn("outsum", F.when(absorbing, 1).otherwise(F.col("outsum")))
    total = out.agg(F.sum("outsum").alias("_t"))
    return out.join(F.broadcast(total)).withColumn("unit_weight", ratio("outsum", "_t")).drop("_t")  # one row


def flow_weighting(flows: DataFrame, strength: str = "strength") -> DataFrame:
    """Each non-self flow's share of its source, times the source's share of everything."""
    others = F.when(F.col("from_id") != F.col("to_id"), F.col(strength))
    sums = flows.groupBy("from_id").agg(F.sum(strength).alias("_out"), F.sum(others).alias("_no"))  # one row a source
    total = flows.agg(F.sum(strength).alias("_all"))
    rows = flows.where("from_id <> to_id").join(sums, "from_id").join(F.broadcast(total))  # one row
    return rows.select("from_id", "to_id", (ratio(strength, "_no") * ratio("_out", "_all")).alias("weighting"))


def maxflow_parents(flows: DataFrame, strength: str = "strength") -> DataFrame:
    """``(id, parent)``: where each unit's largest outflow goes."""
    return top_rows(flows.where("from_id <> to_id"), ["from_id"], strength, "to_id").select(F.col("from_id").alias("id"), F.col("to_id").alias("parent"))


def sampled_parents(flows: DataFrame, seed: int, strength: str = "strength") -> DataFrame:
    """A random parent in proportion to the flows: the first of an exponential race whose times a hash gives, so the
    draw does not depend on partitions."""
    rows = flows.where(f"from_id <> to_id AND {strength} > 0").withColumn("_race", F.ln(uniform(seed, "from_id", "to_id")) / F.col(strength))
    return top_rows(rows, ["from_id"], "_race", "to_id").select(F.col("from_id").alias("id"), F.col("to_id").alias("parent"))


def root_by_outflow(flows: DataFrame, strength: str = "strength") -> DataFrame:
    """The unit of largest outflow, self flows included."""
    sums = flows.groupBy(F.col("from_id").alias("id")).agg(F.sum(strength).alias("outsum"))
    return sums.orderBy(F.desc("outsum"), "id").limit(1)


def scale_k(flows: DataFrame, strength: str = "strength") -> DataFrame:
    """Slope through the origin of the largest other outflow by the outflow of all units."""
    v = relation_vectors(flows, strength)
    o, m = F.col("outsum").cast("double"), F.col("max_out").cast("double")
    return v.agg(ratio(F.sum(o * m), F.sum(o * o)).alias("k"))


# ---- model tables ----
def connections(model: DataFrame) -> DataFrame:
    """``(a, b)``: parent links, and the links that organic units add: dependants to the organic siblings of their head,
    organic units of one head to each other, organic units to their head's parent."""
    links = model.where("parent IS NOT NULL AND parent <> id AND stage <> 'A'").select("id", "parent", "stage")
    organic = links.where("stage = 'O'").select(F.col("id").alias("org"), F.col("parent").alias("head"))
    direct = links.select(F.col("id").alias("a"), F.col("parent").alias("b"))
    siblings = links.where("stage = 'N'").join(organic, F.col("parent") == F.col("head")).select(F.col("id").alias("a"), F.col("org").alias("b"))
    other = organic.select(F.col("org").alias("org2"), "head")
    peers = organic.join(other, "head").where("org > org2").select(F.col("org").alias("a"), F.col("org2").alias("b"))
    up = direct.union(siblings).select(F.col("a").alias("head"), F.col("b").alias("top"))
    above = organic.join(up, "head").where("org <> top").select(F.col("org").alias("a"), F.col("top").alias("b"))
    return direct.union(siblings).union(peers).union(above).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def check_model(model: DataFrame) -> DataFrame:
    """``(problem, n)`` of every rule the model breaks: unknown parents or stages, cycles, links to units that are not
    nodes, not exactly one root."""
    ids = model.select(F.col("id").alias("parent"))
    tests = [
        ("unknown_parent", model.where("parent IS NOT NULL").join(ids, "parent", "left_anti")),
        ("unknown_stage", model.where("stage IS NULL OR stage NOT IN ('A', 'N', 'O')")),
        ("cycle", parent_cycles(model)),
        ("link_to_other_than_node", model.where("parent <> id AND stage <> 'A'").join(model.where("stage <> 'N'").select(F.col("id").alias("parent")), "parent", "left_semi")),
    ]
    out = None
    for name, rows in tests:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n").where("n > 0")
        out = one if out is None else out.union(one)
    roots = model.where("stage = 'N' AND (parent IS NULL OR parent = id)").agg(F.count(F.lit(1)).alias("n"))
    return out.union(roots.where("n <> 1").select(F.lit("roots"), "n"))


def descendants(model: DataFrame, head) -> DataFrame:
    return ancestors(model.where("stage <> 'A'").select("id", "parent"), include_self=False).where(F.col("ancestor") == head).select("id")


def subtree_sums(parents: DataFrame, weights: DataFrame) -> DataFrame:
    """``(id, weight)``: each unit's weight with all units below it."""
    up = ancestors(parents)
    return up.join(weights, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("weight").alias("weight"))


def regional_succession(model: DataFrame, weights: DataFrame) -> DataFrame:
    """``(id, region, weight)``: every unit in the region of each of its ancestors, with the region's whole weight."""
    pairs = ancestors(model.where("stage <> 'A'").select("id", "parent"))
    sums = pairs.join(weights, "id").groupBy("ancestor").agg(F.sum("weight").alias("weight"))
    return pairs.join(sums, "ancestor").select("id", F.col("ancestor").alias("region"), "weight")


def model_lines(model: DataFrame, places: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``(id, parent, stage, x1, y1, x2, y2)``: organic units point to the centre of their urban system, nodes to their
    parent's centre, autonomous units to themselves."""
    p = places.select("id", F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"))
    rows = model.join(p, "id")
    system = rows.withColumn("sys", F.when(F.col("stage") == "O", F.col("parent")).otherwise(F.col("id")))
    centre = system.groupBy("sys").agg(F.avg("x1").alias("x2"), F.avg("y1").alias("y2"))
    goal = F.when(F.col("stage") == "A", F.col("id")).otherwise(F.coalesce("parent", "id"))
    out = rows.withColumn("sys", goal).join(centre, "sys", "left")
    own = F.col("stage") == "A"
    return out.select("id", "parent", "stage", "x1", "y1", F.when(own, F.col("x1")).otherwise(F.col("x2")).alias("x2"), F.when(own, F.col("y1")).otherwise(F.col("y2")).alias("y2"))


# ---- criteria over links ----
def symmetric_cohesion(model: DataFrame, flows: DataFrame, strength: str = "strength") -> DataFrame:
    """``(id, symcoh, organicity)``: over a unit's organic links the least of the smaller mutual flow by k times the
    larger outflow."""
    organic = model.where("stage = 'O'").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    links = organic.union(organic.select("b", "a"))
    f = flows.select("from_id", "to_id", F.col(strength).cast("double").alias("v"))
    rows = links.join(f.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("v").alias("ab")), ["a", "b"], "left")
    rows = rows.join(f.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), F.col("v").alias("ba")), ["a", "b"], "left").na.fill(0.0, ["ab", "ba"])
    outs = relation_vectors(flows, strength).select("id", F.col("outsum").cast("double").alias("outsum"))
    rows = rows.join(outs.select(F.col("id").alias("a"), F.col("outsum").alias("fa")), "a").join(outs.select(F.col("id").alias("b"), F.col("outsum").alias("fb")), "b")
    rows = rows.join(F.broadcast(scale_k(flows, strength)))  # one row
    coh = rows.groupBy(F.col("a").alias("id")).agg(F.min(ratio(F.least("ab", "ba"), F.col("k") * F.greatest("fa", "fb"))).alias("symcoh"))
    return coh.withColumn("organicity", F.least("symcoh", F.lit(1.0)))


def nodality(model: DataFrame, flows: DataFrame, strength: str = "strength") -> DataFrame:
    """``(id, nodality)``: the larger of the largest out- and inflow (inflows of organic units count to their head) by k
    times the outflow, at most 1; autonomous units have its complement."""
    head = model.select(F.col("id").alias("to_id"), F.when(F.col("stage") == "O", F.col("parent")).otherwise(F.col("id")).alias("head"))
    f = flows.where("from_id <> to_id").select("from_id", "to_id", F.col(strength).cast("double").alias("v"))
    own = f.select("from_id", F.col("to_id").alias("to"), "v")
    folded = f.join(head.where("head <> to_id"), "to_id").where("from_id <> head").select("from_id", F.col("head").alias("to"), "v")
    every = own.union(folded).groupBy("from_id", "to").agg(F.sum("v").alias("v"))
    outs = every.groupBy(F.col("from_id").alias("id")).agg(F.max("v").alias("mo"))
    ins = every.groupBy(F.col("to").alias("id")).agg(F.max("v").alias("mi"))
    rows = model.select("id", "stage").join(outs, "id", "left").join(ins, "id", "left").na.fill(0.0, ["mo", "mi"])
    rows = rows.join(relation_vectors(flows, strength).select("id", "outsum"), "id").join(F.broadcast(scale_k(flows, strength)))  # one row
    value = F.least(F.lit(1.0), ratio(F.greatest("mo", "mi"), F.col("k") * F.col("outsum")))
    return rows.select("id", F.when(F.col("stage") == "A", 1 - value).otherwise(value).alias("nodality"))


def outflow_similarity(model: DataFrame, flows: DataFrame, strength: str = "strength") -> DataFrame:
    """``(id, outsim)``: how far the outside flows of an organic system's members follow the members' weights."""
    organic = model.where("stage = 'O'").select("id", F.col("parent").alias("head"))
    members = organic.union(organic.select(F.col("head").alias("id"), "head")).distinct()
    weights = relation_vectors(flows, strength).select("id", F.col("outsum").cast("double").alias("w"))
    members = members.join(weights, "id").withColumn("ws", ratio("w", F.sum("w").over(Window.partitionBy("head"))))
    f = flows.select("from_id", "to_id", F.col(strength).cast("double").alias("v"))
    ends = f.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "v", F.lit("o").alias("way")).union(f.select("to_id", "from_id", "v", F.lit("i")))
    rows = ends.join(members, "id")
    inner = members.select(F.col("id").alias("other"), F.col("head").alias("h2"))
    rows = rows.join(inner, (rows["other"] == inner["other"]) & (rows["head"] == inner["h2"]), "left_anti")
    total = rows.groupBy("head", "other", "way").agg(F.sum("v").alias("all"))
    grid = members.join(total, "head").join(rows.select("id", "head", "other", "way", "v"), ["id", "head", "other", "way"], "left").na.fill(0.0, ["v"])
    e = F.col("all") * F.col("ws")
    return grid.groupBy("id").agg(ratio(F.sum(F.least("v", e)), F.sum(F.greatest("v", e))).alias("outsim"))


def flow_coverage(model: DataFrame, flows: DataFrame, strength: str = "strength") -> DataFrame:
    """One row: the share of non-self flows on child-parent links and reverse organic links, per link and unit."""
    links = model.where("parent IS NOT NULL AND parent <> id AND stage <> 'A'")
    direct = links.select(F.col("id").alias("from_id"), F.col("parent").alias("to_id"))
    organic = links.where("stage = 'O'").select(F.col("parent").alias("from_id"), F.col("id").alias("to_id"))
    covered = flows.join(direct.union(organic).distinct(), ["from_id", "to_id"], "left_semi").agg(F.coalesce(F.sum(strength), F.lit(0)).alias("covered"))
    total = flows.where("from_id <> to_id").agg(F.sum(strength).alias("total"))
    n = model.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("stage") == "O").cast("int")).alias("organic"))
    rows = covered.join(total).join(n)  # one row each
    return rows.select((ratio("covered", "total") * F.col("n") / (F.col("n") + F.col("organic"))).alias("coverage"))


# ---- kernels over one matrix ----
class System:
    """A model over a dense matrix of flows: parents by position, stages as letters."""

    def __init__(self, m: np.ndarray, weights: np.ndarray | None = None):
        self.m = m + np.diag((m.sum(1) == 0).astype(float))
        self.n, self.out = len(m), self.m.sum(1)
        self.weights = self.out if weights is None else weights
        self.unit = self.out / self.out.sum()
        other = self.m - np.diag(np.diag(self.m))
        self.k = float((self.out * other.max(1, initial=0)).sum() / (self.out**2).sum())
        self.p = self.m / self.out[:, None]
        self.parent, self.stage = np.arange(self.n), np.array(["N"] * self.n)

    def copy(self) -> System:
        new = object.__new__(System)
        new.__dict__.update(self.__dict__)
        new.parent, new.stage = self.parent.copy(), self.stage.copy()
        return new

    def edges(self) -> set[tuple[int, int]]:
        links = [(i, int(j)) for i, j in enumerate(self.parent) if i != j and self.stage[i] != "A"]
        heads: dict[int, list[int]] = {}
        for i, j in links:
            if self.stage[i] == "O":
                heads.setdefault(j, []).append(i)
        out = set(links)
        for i, j in links:
            if self.stage[i] == "N":
                out |= {(i, o) for o in heads.get(j, ())}
        up: dict[int, set[int]] = {}
        for i, j in out:
            up.setdefault(i, set()).add(j)
        for head, own in heads.items():
            out |= {(a, b) for a in own for b in own if a > b}
            out |= {(o, t) for o in own for t in up.get(head, ()) if o != t}
        return {(min(e), max(e)) for e in out}

    def hops(self) -> np.ndarray:
        near: dict[int, list[int]] = {}
        for a, b in self.edges():
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        d = np.full((self.n, self.n), np.inf)
        for i in range(self.n):
            d[i, i], front = 0, [i]
            while front:
                nxt = []
                for x in front:
                    for y in near.get(x, ()):
                        if np.isinf(d[i, y]):
                            d[i, y] = d[i, x] + 1
                            nxt.append(y)
                front = nxt
        return d

    def fits(self) -> np.ndarray:
        """How near each unit's flows end: shares of its other flows by the number of hops."""
        stay = 1 - np.diag(self.p)
        d = self.hops()
        np.fill_diagonal(d, np.inf)
        return (self.p / np.where(stay == 0, 1, stay)[:, None] / d).sum(1)

    def nodalities(self) -> np.ndarray:
        f = self.m - np.diag(np.diag(self.m))
        for i in np.flatnonzero(self.stage == "O"):
            f[:, self.parent[i]] += f[:, i]
        np.fill_diagonal(f, 0)
        return np.minimum(1, np.maximum(f.max(1, initial=0), f.max(0, initial=0)) / (self.k * self.out)) if self.k else np.zeros(self.n)

    def organicities(self) -> np.ndarray:
        least = np.ones(self.n)
        for i in np.flatnonzero(self.stage == "O"):
            j = self.parent[i]
            v = min(self.m[i, j], self.m[j, i]) / (self.k * max(self.out[i], self.out[j])) if self.k else 0
            least[i], least[j] = min(least[i], v), min(least[j], v)
        return np.minimum(least, 1)

    def node_values(self) -> np.ndarray:
        nod = self.nodalities()
        coef = np.where(self.stage == "A", 1 - nod, nod) * self.organicities()
        return np.where(self.stage == "A", 1.0, self.fits()) * coef

    def binding_costs(self) -> np.ndarray:
        """Costs of the model's links: own flow over the flow to the other end; among organic ends the smaller of both."""
        d, cost = np.diag(self.m), np.full((self.n, self.n), np.inf)
        for a, b in self.edges():
            for i, j in ((a, b), (b, a)):
                organic = self.stage[i] == "O" or self.stage[j] == "O"
                flow = min(self.m[i, j], self.m[j, i]) if organic else self.m[i, j]
                own = min(d[i], d[j]) if organic else d[i]
                if flow > 0:
                    cost[i, j] = max(own, 1e-12) / flow
        return cost

    def path_costs(self) -> np.ndarray:
        """Cheapest paths over the links' binding costs, all pairs."""
        c = self.binding_costs()
        np.fill_diagonal(c, 0)
        for k in range(self.n):
            c = np.minimum(c, c[:, [k]] + c[[k], :])
        return c

    def path_fits(self) -> np.ndarray:
        """Shares of each unit's other flows, each over one plus the cost of its path; unreachable ends count 0."""
        stay, c = 1 - np.diag(self.p), self.path_costs()
        share = self.p - np.diag(np.diag(self.p))
        return (share / np.where(stay == 0, 1, stay)[:, None] / (1 + c)).sum(1)

    def passage_fit(self) -> float:
        """Weighted mean, over units, of the passage times of the chain restricted to the model's links against those of
        all flows; 1 when the links carry everything."""
        links = np.zeros((self.n, self.n), bool)
        for a, b in self.edges():
            links[a, b] = links[b, a] = True
        np.fill_diagonal(links, True)
        kept = np.where(links, self.m, 0) + 1e-12
        every = self.m + 1e-12
        own = passage_times(kept / kept.sum(1, keepdims=True))
        all_ = passage_times(every / every.sum(1, keepdims=True))
        return float((np.minimum(all_ / own, own / all_).mean(1) * self.unit).sum())

    def value(self) -> float:
        return float((self.node_values() * self.unit).sum())


def argmax_parents(m: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
    f = m - np.diag(np.diag(m))
    if rng is None:
        return f.argmax(1)
    return np.array([rng.choice(len(f), p=r / r.sum()) if r.sum() else int(np.argmax(r)) for r in f])


def decycled(system: System, heaviest: bool = False, rng: np.random.Generator | None = None) -> System:
    """Max-flow parents, where cycles other than the root's are contracted one by one into their heaviest member.

    The lightest cycle goes first (or the heaviest). Contracted members become organic units of their head. Every round
    takes a unit away at least, so the loop ends when no cycle is left.
    """
    m, w = system.m.astype(float).copy(), system.weights.astype(float).copy()
    alive, organic = np.ones(system.n, bool), {}
    while True:
        sums = np.where(alive, m.sum(1), -1)
        root = int(sums.argmax()) if rng is None else int(rng.choice(system.n, p=np.clip(sums, 0, None) / np.clip(sums, 0, None).sum()))
        parent = argmax_parents(m, rng)
        parent[root] = root
        graph = np.zeros((system.n, system.n), bool)
        graph[np.arange(system.n), parent] = True
        graph[~alive] = False
        cycles = [c for c in strong_components(graph) if len(c) > 1]
        if not cycles:
            break
        cycle = (max if heaviest else min)(cycles, key=lambda c: (w[c].sum(), c[0]))
        head = max(cycle, key=lambda i: (w[i], -i))
        for o in (i for i in cycle if i != head):
            m[head, head] += m[o, o] + m[head, o] + m[o, head]
            m[o, o] = m[head, o] = m[o, head] = 0
            m[:, head] += m[:, o]
            m[head, :] += m[o, :]
            m[:, o] = m[o, :] = 0
            m[o, head] = 1
            w[head], w[o], alive[o], organic[o] = w[head] + w[o], 0, False, head
    out = system.copy()
    out.parent, out.stage = parent.copy(), np.where(alive, "N", "O")
    for o, head in organic.items():
        while head in organic:
            head = organic[head]
        out.parent[o] = head
    return out


def improved(system: System) -> System:
    """Hill climbing from a decycled model: weak leaves become autonomous, children join the root's urban system and
    organic units become nodes while the model's value rises."""
    best = system.copy()
    nod, values = best.nodalities(), best.node_values()
    pointed = {int(j) for i, j in enumerate(best.parent) if i != j}
    for i in range(best.n):
        if best.stage[i] == "N" and i not in pointed and best.parent[i] != i and nod[i] < 0.5 and values[i] < 0.5:
            best.stage[i], best.parent[i] = "A", i
    score = best.value()
    while True:
        root = next((i for i in range(best.n) if best.stage[i] == "N" and best.parent[i] == i), None)
        if root is None:
            return best
        own = [root, *(i for i in range(best.n) if best.stage[i] == "O" and best.parent[i] == root)]
        child = [i for i in range(best.n) if best.stage[i] == "N" and best.parent[i] == root and i != root]
        if not child:
            break
        pull = lambda i: min(best.m[own, i].sum(), best.m[i, own].sum()) / np.sqrt(best.weights[own].sum() * best.weights[i])
        i = max(child, key=lambda c: (pull(c), -c))
        trial = best.copy()
        trial.stage[i] = "O"
        trial.parent[trial.parent == i] = root
        trial.parent[i] = root
        if (v := trial.value()) <= score:
            break
        best, score = trial, v
    changed = True
    while changed:
        changed = False
        for i in sorted(np.flatnonzero(best.stage == "O"), key=lambda i: (best.weights[i], i)):
            head = best.parent[i]
            system_ = [head, *(j for j in range(best.n) if best.stage[j] == "O" and best.parent[j] == head and j != i)]
            trial = best.copy()
            trial.stage[i] = "N"
            for j in range(best.n):
                if best.stage[j] == "N" and best.parent[j] == head and j not in (i, head) and best.m[j, i] > best.m[j, system_].sum():
                    trial.parent[j] = i
            if (v := trial.value()) > score:
                best, score, changed = trial, v, True
    return best


def evolved(system: System, seed: int = 1, population: int = 30, generations: int = 100, stable: int = 20, elite: float = 0.05) -> System:
    """Genetic search over models: parents drawn by flows, crossover by subtrees of parents, mutation of one unit."""
    rng = np.random.default_rng(seed)
    pool = [decycled(system)] + [decycled(system, rng=rng) for _ in range(population - 1)]
    pool = sorted(pool, key=lambda s: -s.value())
    kept, best = 0, pool[0].value()
    for _ in range(generations):
        nxt = pool[: max(1, int(elite * population))]
        while len(nxt) < population:
            a, b = (pool[min(rng.integers(0, len(pool), 2))] for _ in range(2))
            child = a.copy()
            for i in rng.choice(system.n, max(1, system.n // 4), replace=False):
                _graft(child, int(i), int(b.parent[i]), str(b.stage[i]))
            i = int(rng.integers(system.n))
            f = np.where(np.arange(system.n) == i, 0, system.m[i])
            if f.sum():
                _graft(child, i, int(rng.choice(system.n, p=f / f.sum())), str(rng.choice(["N", "O"])))
            nxt.append(child)
        pool = sorted(nxt, key=lambda s: -s.value())[:population]
        kept = 0 if pool[0].value() > best + 1e-12 else kept + 1
        best = max(best, pool[0].value())
        if kept >= stable:
            break
    return pool[0]


def _graft(s: System, i: int, parent: int, stage: str) -> None:
    """Give a unit another parent and stage if the model stays a tree of nodes."""
    if s.parent[i] == i or parent == i or s.stage[parent] != "N" or (stage == "O" and (s.parent == i).any()):
        return
    x = parent
    for _ in range(s.n):
        if x == i:
            return
        if s.parent[x] == x:
            break
        x = s.parent[x]
    s.parent[i], s.stage[i] = parent, stage


#: Values of the units of a model by criterion.
CRITERIA = {
    "stagestate": lambda s: s.node_values(),
    "path": lambda s: s.path_fits(),
    "mfpt": lambda s: np.full(s.n, s.passage_fit()),
}


BUILDERS = {
    "maxflow": lambda s, seed: decycled(s),
    "heaviest": lambda s, seed: decycled(s, heaviest=True),
    "stochastic": lambda s, seed: decycled(s, rng=np.random.default_rng(seed)),
    "improvement": lambda s, seed: improved(decycled(s)),
    "genetic": lambda s, seed: evolved(s, seed),
}


def build_model(flows: DataFrame, builder: str = "maxflow", strength: str = "strength", seed: int = 1, criterion: str = "stagestate") -> DataFrame:
    """``(id, parent, stage, weight, value)`` of all units; those outside the main component are autonomous.

    One task holds the zoning's matrix; flows are added up to one row a pair before.
    """
    f = flows.groupBy("from_id", "to_id").agg(F.sum(strength).cast("double").alias("strength")).withColumn("_one", F.lit(1))
    kind = flows.schema["from_id"].dataType.simpleString()
    make = BUILDERS[builder]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = _matrix_kernel(pdf)
        linked = (m + m.T) > 0
        parts = sorted(strong_components(linked), key=lambda c: (-len(c), c[0]))
        main = parts[0]
        full = System(m)
        sub = make(System(m[np.ix_(main, main)]), seed)
        full.stage[:] = "A"
        for i, x in enumerate(main):
            full.parent[x], full.stage[x] = main[sub.parent[i]], sub.stage[i]
        return pd.DataFrame({"id": ids, "parent": [ids[i] for i in full.parent], "stage": full.stage, "weight": full.out, "value": CRITERIA[criterion](full)})

    return f.groupBy("_one").applyInPandas(run, f"id {kind}, parent {kind}, stage string, weight double, value double")


def transition_criterion(model: DataFrame, flows: DataFrame, strength: str = "strength", tolerance: float = 1.0) -> DataFrame:
    """``(id, cohesion, reciprocity, organic)`` of every urban system (a head and its organic units)."""
    system = model.where("stage <> 'A'").select("id", F.when(F.col("stage") == "O", F.col("parent")).otherwise(F.col("id")).alias("sys"))
    f = flows.select("from_id", "to_id", F.col(strength).cast("double").alias("v"))
    outs = f.groupBy(F.col("from_id").alias("id")).agg(F.sum("v").alias("w"), F.sum(F.when(F.col("from_id") == F.col("to_id"), F.col("v")).otherwise(0.0)).alias("self"))
    a, b = system.select(F.col("id").alias("from_id"), F.col("sys").alias("sa")), system.select(F.col("id").alias("to_id"), F.col("sys").alias("sb"))
    inner = f.join(a, "from_id").join(b, "to_id").where("sa = sb AND from_id <> to_id")
    sums = inner.groupBy(F.col("sa").alias("sys")).agg(F.sum("v").alias("inside"))
    base = system.join(outs, "id").groupBy("sys").agg(F.sum(F.col("w") - F.col("self")).alias("leaving"), F.count(F.lit(1)).alias("n"))
    ends = inner.select(F.col("sa").alias("sys"), F.col("from_id").alias("id"), F.col("v").alias("o"), F.lit(0.0).alias("i")).union(inner.select("sa", "to_id", F.lit(0.0), "v"))
    each = ends.groupBy("sys", "id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    rec = each.groupBy("sys").agg(F.avg(1 - F.coalesce(ratio(F.abs(F.col("o") - F.col("i")), F.col("o") + F.col("i")), F.lit(0.0))).alias("reciprocity"))
    rows = base.join(sums, "sys", "left").join(rec, "sys", "left").where("n > 1").na.fill(0.0)
    cohesion = F.coalesce(ratio("inside", "leaving"), F.lit(0.0))
    return rows.select(F.col("sys").alias("id"), cohesion.alias("cohesion"), "reciprocity", F.pow(cohesion * F.col("reciprocity"), F.lit(1 / (2 * tolerance))).alias("organic"))


def regions_by_weight(model: DataFrame, weights: DataFrame, minimum: float) -> DataFrame:
    """``(id, region)``: bottom-up, a unit with what is left of the units below it becomes a region when it reaches the
    minimum; what is left at the top is a region of its own. One task over the zoning's tree."""
    rows = model.where("stage <> 'A'").select("id", "parent").join(weights.select("id", F.col("weight").cast("double")), "id", "left").na.fill(0.0, ["weight"])
    rows = rows.withColumn("_one", F.lit(1))
    kind = model.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = {i: (p if pd.notna(p) else i) for i, p in zip(pdf.id, pdf.parent, strict=True)}
        weight = dict(zip(pdf.id, pdf.weight, strict=True))
        below: dict = {}
        for i, p in parent.items():
            if p != i:
                below.setdefault(p, []).append(i)
        order, stack = [], sorted((i for i, p in parent.items() if p == i or p not in parent), reverse=True)
        tops = set(stack)
        while stack:
            x = stack.pop()
            order.append(x)
            stack += sorted(below.get(x, ()), reverse=True)
        left: dict = {}
        region = {}
        for x in reversed(order):
            group = [x] + [y for c in sorted(below.get(x, ())) for y in left.pop(c, [])]
            if sum(weight[y] for y in group) >= minimum or x in tops:
                region |= dict.fromkeys(group, x)
            else:
                left[x] = group
        return pd.DataFrame({"id": list(region), "region": list(region.values())})

    return rows.groupBy("_one").applyInPandas(run, f"id {kind}, region {kind}")
