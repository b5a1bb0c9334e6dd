"""Graphs over edge tables: closures, shortest paths, cycles, stationary distributions, routes."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.columns import ratio, top_rows
from odweave.operators.iterate import connected_components, drop_shared, shared_table


def ancestors(parents: DataFrame, include_self: bool = True, max_rounds: int = 40) -> DataFrame:
    """``(id, ancestor, depth)`` of a forest ``(id, parent)``: pointer doubling, so a path of length n takes log2 n
    joins. Roots have a NULL parent or are their own."""
    up = parents.where("parent IS NOT NULL AND parent <> id").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    current = shared_table(up, "ancestors")
    reach = 1
    for _ in range(max_rounds):
        far = current.where(F.col("depth") == reach).select(F.col("id"), F.col("ancestor").alias("mid"), F.col("depth").alias("d1"))
        step = current.select(F.col("id").alias("mid"), F.col("ancestor"), F.col("depth").alias("d2"))
        more = far.join(step, "mid").select("id", "ancestor", (F.col("d1") + F.col("d2")).alias("depth")).where(F.col("id") != F.col("ancestor"))
        more = shared_table(more, "ancestors")
        if more.isEmpty():
            break
        current, reach = current.union(more), reach * 2
    else:
        raise RuntimeError("parents have a cycle")
    if include_self:
        current = current.union(parents.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    return current


def parent_cycles(parents: DataFrame, rounds: int = 30) -> DataFrame:
    """Ids that lie on a cycle of a parent table (self parents apart): after 2**rounds steps only cycle members are
    reached; the loop ends when the set of reached ids stops shrinking."""
    jump = parents.where("parent IS NOT NULL AND parent <> id").select("id", F.col("parent").alias("to"))
    base = jump
    reached = None
    for _ in range(rounds):
        nxt = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"))
        nxt = shared_table(nxt, "jumps")
        now = nxt.select("to").distinct().count()
        done = now == reached
        jump, reached = nxt, now
        if done:
            break
    return jump.select(F.col("to").alias("id")).distinct().join(base.select("id"), "id", "left_semi")


def min_closure(edges: DataFrame, product: bool = False, value: str = "cost", max_rounds: int = 40) -> DataFrame:
    """``(from_id, to_id, cost)``: least path sums (or products) over an edge table, by doubling path lengths."""
    best = edges.groupBy("from_id", "to_id").agg(F.min(F.col(value).cast("double")).alias("cost"))
    current, seen = shared_table(best, "closure"), None
    for _ in range(max_rounds):
        a = current.select("from_id", F.col("to_id").alias("mid"), F.col("cost").alias("c1"))
        b = current.select(F.col("from_id").alias("mid"), "to_id", F.col("cost").alias("c2"))
        both = F.col("c1") * F.col("c2") if product else F.col("c1") + F.col("c2")
        longer = a.join(b, "mid").where("from_id <> to_id").select("from_id", "to_id", both.alias("cost"))
        nxt = shared_table(current.union(longer).groupBy("from_id", "to_id").agg(F.min("cost").alias("cost")), "closure")
        row = nxt.agg(F.count(F.lit(1)), F.sum("cost")).first()
        drop_shared(current)
        current = nxt
        if seen is not None and seen[0] == row[0] and abs((seen[1] or 0) - (row[1] or 0)) <= 1e-12 * abs(row[1] or 1):
            break
        seen = row
    return current


def transition_probabilities(flows: DataFrame, strength: str = "strength") -> DataFrame:
    sums = flows.groupBy("from_id").agg(F.sum(strength).alias("_out"))  # one row a source
    return flows.join(sums, "from_id", "left").select(*flows.columns, ratio(strength, "_out").alias("p"))


def _matrix_kernel(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    ids = sorted(set(pdf.from_id) | set(pdf.to_id))
    at = {i: k for k, i in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    np.add.at(m, (pdf.from_id.map(at).to_numpy(), pdf.to_id.map(at).to_numpy()), pdf.strength.to_numpy(float))
    return ids, m


def stationary(p: np.ndarray) -> np.ndarray:
    """Stationary distribution of a row-stochastic matrix, by the linear system."""
    n = len(p)
    a = np.vstack([p.T - np.eye(n), np.ones(n)])
    pi = np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0]
    pi = np.clip(pi, 0, None)
    low = pi[pi > 0].min() / 4 if (pi > 0).any() else 1.0
    return np.where(pi <= 0, low, pi)


def passage_times(p: np.ndarray) -> np.ndarray:
    """Mean first passage times of an irreducible chain; the diagonal is the mean return time."""
    n, pi = len(p), stationary(p)
    z = np.linalg.inv(np.eye(n) - p + np.outer(np.ones(n), pi))
    return (np.eye(n) - z + np.outer(np.ones(n), np.diag(z))) / pi


def mean_first_passage(flows: DataFrame, strength: str = "strength") -> DataFrame:
    """``(from_id, to_id, steps, pi)`` within each strongly connected part; pairs of different parts are left out
    (infinite), an absorbing unit returns in 1 step.

    Each weakly connected component is one task: it needs its dense matrix, so its size is the zoning's, not the data's.
    """
    parts = connected_components(flows, "from_id", "to_id").select(F.col("node").alias("from_id"), "component")
    rows = flows.select("from_id", "to_id", F.col(strength).cast("double").alias("strength")).join(parts, "from_id")
    kind = flows.schema["from_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = _matrix_kernel(pdf)
        out = []
        for part in strong_components(m > 0):
            own = m[np.ix_(part, part)]
            if len(part) == 1:
                out.append((ids[part[0]], ids[part[0]], 1.0, 1.0))
                continue
            p = own / own.sum(1, keepdims=True)
            pi, t = stationary(p), passage_times(p)
            out += [(ids[part[i]], ids[part[j]], t[i, j], pi[j]) for i in range(len(part)) for j in range(len(part))]
        return pd.DataFrame(out, columns=["from_id", "to_id", "steps", "pi"])

    return rows.groupBy("component").applyInPandas(run, f"from_id {kind}, to_id {kind}, steps double, pi double")


def strong_components(adjacent: np.ndarray) -> list[list[int]]:
    """Strongly connected components of a small dense graph, by reachability from and to each node."""
    n, left, out = len(adjacent), set(range(len(adjacent))), []

    def reach(start: int, a: np.ndarray) -> set[int]:
        seen, stack = {start}, [start]
        while stack:
            for j in np.flatnonzero(a[stack.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    stack.append(int(j))
        return seen

    for i in range(n):
        if i in left:
            part = reach(i, adjacent) & reach(i, adjacent.T) & left
            left -= part
            out.append(sorted(part))
    return out


def largest_component(edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Ids of the weak component with most nodes; smallest label on ties."""
    parts = connected_components(edges, a, b)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1)
    return parts.join(F.broadcast(best.select("component")), "component", "left_semi").select(F.col("node").alias("id"))


# Road networks: edges are (src, dst, geometry array<struct<x,y>>, ..)
def lines_to_edges(lines: DataFrame, tolerance: int = 6, ring: str = "ring") -> DataFrame:
    """Adds ``src`` and ``dst`` (rounded end points); of several lines between the same ends the last id stays."""
    end = lambda i: F.struct(F.round(F.element_at(ring, F.lit(i))["x"], tolerance).alias("x"), F.round(F.element_at(ring, F.lit(i))["y"], tolerance).alias("y"))
    out = lines.withColumn("src", end(1)).withColumn("dst", end(-1))
    last = Window.partitionBy("src", "dst").orderBy(F.desc("id"))
    return out.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def flipped(edges: DataFrame, ring: str | None = None, a: str = "src", b: str = "dst") -> DataFrame:
    out = edges.withColumns({a: F.col(b), b: F.col(a)})
    return out.withColumn(ring, F.reverse(ring)) if ring else out


def apply_oneway(edges: DataFrame, forward: str, backward: str, oneway: str = "oneway", ring: str | None = None, a: str = "src", b: str = "dst") -> DataFrame:
    """Forward edges stay, backward ones turn round, all others go both ways."""
    f, r = edges.where(F.col(oneway) == forward), edges.where(F.col(oneway) == backward)
    both = edges.where(F.col(oneway).isNull() | ~F.col(oneway).isin(forward, backward))
    return f.unionByName(flipped(r, ring, a, b)).unionByName(both).unionByName(flipped(both, ring, a, b))


def both_ways(edges: DataFrame, ring: str | None = None, a: str = "src", b: str = "dst") -> DataFrame:
    """Adds the reverse of every edge whose reverse is not there."""
    turned = flipped(edges, ring, a, b)
    return edges.unionByName(turned.join(edges.select(a, b), [a, b], "left_anti"))


def route_costs(edges: DataFrame, requests: DataFrame, a: str = "src", b: str = "dst", cost: str = "cost", limit_rows: int = 2_000_000) -> DataFrame:
    """``requests`` (from_node, to_node) with ``cost`` of the cheapest path; NULL if there is none.

    A network up to ``limit_rows`` edges (checked) is broadcast and each partition of sources runs Dijkstra on it;
    a larger one is relaxed by joins, one path edge a round.
    """
    spark = edges.sparkSession
    kind = edges.schema[a].dataType.simpleString()
    net = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(cost).cast("double").alias("c"))
    wanted = requests.select("from_node", "to_node").distinct()
    if net.count() > limit_rows:
        return _relaxed(net, wanted)
    rows = net.toPandas()
    graph: dict = {}
    for x, y, c in rows.itertuples(index=False):
        graph.setdefault(x, []).append((y, c))
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, targets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            goals: dict = {}
            for s, t in zip(sources, targets, strict=True):
                goals.setdefault(s, set()).add(t)
            found = {s: cheapest(shared.value, s, g) for s, g in goals.items()}
            costs = [found[s].get(t) for s, t in zip(sources, targets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.float64())], ["from_node", "to_node", "cost"])

    return wanted.repartition("from_node").mapInArrow(run, f"from_node {kind}, to_node {kind}, cost double")


def cheapest(graph: dict, source, goals: set) -> dict:
    """Dijkstra from one source until all goals are settled."""
    best, heap, out = {source: 0.0}, [(0.0, 0, source)], {}
    tie, left = 1, set(goals)
    done = set()
    while heap and left:
        d, _, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        if x in left:
            out[x] = d
            left.discard(x)
        for y, c in graph.get(x, ()):
            if y not in done and d + c < best.get(y, float("inf")):
                best[y] = d + c
                heapq.heappush(heap, (d + c, tie, y))
                tie += 1
    return out


def _relaxed(net: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cheapest paths, one edge a round, until no distance falls. A path of least cost has fewer edges than there are
    nodes, so distances that fall beyond that are an error (a cycle of negative cost)."""
    nodes = net.select("a").union(net.select("b")).distinct().count()
    dist = shared_table(wanted.select(F.col("from_node").alias("s"), F.col("from_node").alias("x"), F.lit(0.0).alias("d")).distinct(), "routes")
    front = dist
    for hops in itertools.count():
        if hops > nodes:
            raise ValueError("the network has a cycle of negative cost")
        step = front.join(net, front.x == net.a).groupBy("s", F.col("b").alias("x")).agg(F.min(F.col("d") + F.col("c")).alias("d"))
        merged = step.join(dist.withColumnRenamed("d", "old"), ["s", "x"], "full")
        merged = shared_table(merged.select("s", "x", F.least("d", "old").alias("d"), F.coalesce(F.col("d") < F.coalesce("old", F.lit(float("inf"))), F.lit(False)).alias("new")), "routes")
        dist, front = merged.select("s", "x", "d"), merged.where("new").select("s", "x", "d")
        if front.isEmpty():
            break
    return wanted.join(dist.select(F.col("s").alias("from_node"), F.col("x").alias("to_node"), F.col("d").alias("cost")), ["from_node", "to_node"], "left")


def strongest(flows: DataFrame, strength: str = "strength") -> DataFrame:
    """``(from_id, to_id, strength)``: each unit's strongest outflow to another unit; smallest target on ties."""
    return top_rows(flows.where("from_id <> to_id"), ["from_id"], strength, "to_id")
