"""Queries that SQL cannot express, against plain programmes written apart from the operators."""

import math
from collections import defaultdict

import pytest

from odweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def zone(spark):
    from odweave.plans.fixtures import Tables

    t = Tables(spark, SF)
    flows = {(r.from_id, r.to_id): float(r.strength) for r in t.zone_flows.collect()}
    return t, flows


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_homework_without_self_interaction(spark, zone):
    """Each user's sites are fitted over all pairs but a site with itself, by plain loops."""
    home, work = {"k": 1.0, "m": 0.5}, {"t": 1.0, "m": 0.5}
    users = defaultdict(lambda: defaultdict(lambda: [0.0, 0.0]))
    for r in zone[0].anchors.collect():
        own = users[r.user_id][r.site_id]
        own[0] += home.get(r.type, 0.0) * r.importance
        own[1] += work.get(r.type, 0.0) * r.importance
    want = defaultdict(float)
    for sites in users.values():
        ids = list(sites)
        s, t = {i: sites[i][0] for i in ids}, {i: sites[i][1] for i in ids}
        s = {i: s[i] if any(t[j] > 0 for j in ids if j != i) else 0.0 for i in ids}
        t = {j: t[j] if any(s[i] > 0 for i in ids if i != j) else 0.0 for j in ids}
        if sum(s.values()) <= 0 or sum(t.values()) <= 0:
            continue
        rows, cols = ({i: v / sum(side.values()) for i, v in side.items()} for side in (s, t))
        m = {(i, j): 1.0 for i in ids for j in ids if i != j}

        def fit(margin, at, m=m):
            sums = defaultdict(float)
            for pair, v in m.items():
                sums[pair[at]] += v
            for pair in m:
                m[pair] *= margin[pair[at]] / (sums[pair[at]] or 1.0)

        for _ in range(100):
            before = dict(m)
            fit(rows, 0)
            fit(cols, 1)
            if sum(abs(m[p] - before[p]) for p in m) <= 1e-9:
                break
        fit(rows, 0)
        for p, v in m.items():
            want[p] += v
    got = {(r.from_id, r.to_id): r.strength for r in run(spark, "rels_homework_noself")}
    assert set(got) == {p for p, v in want.items() if v}
    for p, v in got.items():
        assert v == pytest.approx(want[p], abs=2e-6)


def cycle_of(parent, start):
    seen = []
    while start not in seen:
        seen.append(start)
        start = parent[start]
    return seen[seen.index(start) :]


@pytest.mark.parametrize("name, pick", [("hssm_build_maxflow", min), ("hssm_build_heaviest", max)])
def test_cycles_are_contracted_one_by_one(spark, zone, name, pick):
    """Dictionaries instead of a matrix: parents by largest outflow, then the lightest (heaviest) cycle joins its head."""
    flows = zone[1]
    ids = sorted({i for pair in flows for i in pair})
    m = defaultdict(float, flows)
    for i in ids:  # a unit that sends nothing keeps to itself
        if not any(m[i, j] for j in ids):
            m[i, i] = 1.0
    weight = {i: sum(m[i, j] for j in ids) for i in ids}
    alive, head_of = set(ids), {}
    while True:
        root = max(sorted(alive), key=lambda i: (sum(m[i, j] for j in ids), -i))
        parent = {i: i if i == root else max((j for j in ids if j != i), key=lambda j: (m[i, j], -j)) for i in alive}
        cycles = {tuple(sorted(c)) for i in alive if all(x in alive for x in walk(parent, i)) and len(c := cycle_of(parent, i)) > 1}
        if not cycles:
            break
        cycle = pick(sorted(cycles), key=lambda c: (sum(weight[i] for i in c), c[0]))
        head = max(cycle, key=lambda i: (weight[i], -i))
        for o in cycle:
            if o == head:
                continue
            m[head, head] += m[o, o] + m[head, o] + m[o, head]
            for x in ids:
                if x not in (o, head):
                    m[x, head] += m[x, o]
                    m[head, x] += m[o, x]
                m[x, o] = m[o, x] = 0.0
            weight[head] += weight[o]
            weight[o] = 0.0
            alive.discard(o)
            head_of[o] = head
    want = {i: (parent[i], "N") for i in alive}
    for o in head_of:
        h = head_of[o]
        while h in head_of:
            h = head_of[h]
        want[o] = (h, "O")
    parts = run(spark, name)
    got = {r.id: (r.parent, r.stage) for r in parts if r.stage != "A"}
    assert len(parts) == len(ids)
    if len(got) == len(ids):  # the flows are connected throughout
        assert got == want


def walk(parent, i):
    seen = []
    while i in parent and i not in seen:
        seen.append(i)
        i = parent[i]
    return seen if i in parent else [*seen, None]


@pytest.mark.parametrize("dissolve", [False, True])
def test_stepwise_regions_step_by_step(spark, zone, dissolve):
    t, flows = zone
    total = sum(flows.values())
    least = {"sourceflow_sum": total / 6} | ({"unit_count": 3} if dissolve else {})
    names = list(least)
    region = {r.id: r.id for r in t.units.collect()}
    out = defaultdict(dict)
    for (a, b), v in flows.items():
        out[a][b] = v

    def values(r):
        own = [i for i in region if region[i] == r]
        known = {"sourceflow_sum": sum(sum(out[i].values()) for i in own), "unit_count": len(own)}
        return [known[n] for n in names]

    def pulls(units, own):
        sums = defaultdict(float)
        for i in units:
            for j, v in out[i].items():
                if region[j] != own:
                    sums[region[j]] += v
        return min(sums, key=lambda r: (-sums[r], r)) if sums else None

    # A region's values are taken when it starts and whenever it receives units, the rest of the time they stay.
    table, passed, stage, step = {r: values(r) for r in sorted(set(region.values()))}, set(), {}, 0
    while table:
        code = min(table, key=lambda r: (math.inf if r in passed else table[r][0], r))
        if code in passed:
            break
        if all(v >= least[n] for v, n in zip(table[code], names, strict=True)):
            if len(names) == 1:
                break
            passed.add(code)
            continue
        step += 1
        units = [i for i in sorted(region) if region[i] == code]
        goals = {i: pulls([i], code) for i in units} if dissolve else dict.fromkeys(units, pulls(units, code))
        for i, r in goals.items():
            if r is not None:
                region[i] = r
                stage.setdefault(i, step)
        del table[code]
        for r in set(goals.values()):
            if r in table:
                table[r] = values(r)
                passed.discard(r)
    got = {r.unit_id: (r.region, r.stage) for r in run(spark, "region_stepwise_dissolve" if dissolve else "region_stepwise")}
    assert got == {i: (region[i], stage.get(i)) for i in region}
