"""Hand-computed cases on an 8 x 8 matrix of flows, and properties of the builders."""

import numpy as np
import pytest

from odweave.functions.columns import common_name_part, literal_of, nice_number
from odweave.operators import flows, graphs, regions, settlement

M = np.array([[int(x) for x in row.split()] for row in """30 3 4 2 1 0 1 1|6 15 10 3 2 1 0 1|7 9 12 3 1 2 0 0|10 3 2 10 0 1 2 1
5 8 3 1 9 4 0 0|3 3 7 1 2 8 1 0|4 0 1 6 0 1 10 2|3 1 1 5 0 1 1 6""".replace("\n", "|").split("|")])


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(i, j, int(v)) for i, row in enumerate(M) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "from_id int, to_id int, strength long")


def test_max_flow_parents_and_root(matrix):
    got = {r.id: r.parent for r in settlement.maxflow_parents(matrix).collect()}
    assert [got[i] for i in range(8)] == [2, 2, 1, 0, 1, 2, 3, 3]
    assert settlement.root_by_outflow(matrix).first()["id"] == 0
    assert settlement.scale_k(matrix).first()["k"] == pytest.approx(0.234993, abs=1e-6)


def test_decycling_contracts_the_cycle(matrix):
    got = {r.id: (r.parent, r.stage) for r in settlement.build_model(matrix).collect()}
    assert [got[i][0] for i in range(8)] == [1, 1, 1, 0, 1, 1, 3, 3]
    assert [got[i][1] for i in range(8)] == ["N", "N", "O", "N", "N", "N", "N", "N"]
    assert settlement.check_model(settlement.build_model(matrix)).count() == 0


def test_components_other_than_the_main_one_are_autonomous(spark, matrix):
    more = spark.createDataFrame([(8, 8, 8), (9, 8, 2), (9, 9, 4)], "from_id int, to_id int, strength long")
    got = {r.id: r.stage for r in settlement.build_model(matrix.union(more)).collect()}
    assert got[8] == got[9] == "A" and all(got[i] != "A" for i in range(8))


@pytest.mark.parametrize("builder", ["heaviest", "stochastic", "improvement"])
def test_builders_give_valid_models(matrix, builder):
    model = settlement.build_model(matrix, builder)
    assert model.count() == 8
    assert settlement.check_model(model).count() == 0


def test_search_does_not_lose_value():
    s = settlement.System(M.astype(float))
    start = settlement.decycled(s)
    assert settlement.improved(start).value() >= start.value() - 1e-12
    assert settlement.evolved(s, generations=5, population=8).value() >= start.value() - 1e-12


def test_stationary_and_passage_times(matrix):
    p = M / M.sum(1, keepdims=True)
    assert graphs.stationary(p) == pytest.approx([0.41676, 0.167923, 0.168249, 0.104068, 0.038274, 0.03853, 0.034934, 0.031262], abs=1e-5)
    got = {(r.from_id, r.to_id): r.steps for r in graphs.mean_first_passage(matrix).collect()}
    assert got[0, 1] == pytest.approx(9.733807, abs=1e-5) and got[7, 7] == pytest.approx(31.9873, abs=1e-3)


def test_cycles_and_closure(spark):
    parents = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (4, 3), (5, None), (6, 6)], "id int, parent int")
    assert {r.id for r in graphs.parent_cycles(parents).collect()} == {0, 1, 2}
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "id int, parent int")
    assert graphs.ancestors(tree).count() == 20 * 21 // 2


def test_anchor_generators_on_six_anchors(spark):
    rows = [(1, s, float(v), k) for s, v, k in zip([1, 2, 3, 4, 4, 5], [4, 2, 2, 1, 1, 1], ["k", "t", "m", "t", "k", ""], strict=True)]
    anchors = spark.createDataFrame(rows, "user_id int, site_id int, importance double, type string")
    g = {x.name: x for x in flows.default_generators()}
    got = {(r.from_id, r.to_id): r.strength for r in flows.proportional(anchors, g["homework"]).collect()}
    for s, a in {1: 4 / 6, 3: 1 / 6, 4: 1 / 6}.items():
        for t, b in {2: 0.5, 3: 0.25, 4: 0.25}.items():
            assert got[s, t] == pytest.approx(a * b)
    assert len(got) == 9 and sum(got.values()) == pytest.approx(1)
    for name in ("homeworkfirst", "genfirst", "homefirst"):
        assert [(r.from_id, r.to_id, r.strength) for r in flows.maximum(anchors, g[name]).collect()] == [(1, 2, 1.0)]
    alone = flows.proportional(anchors, flows.default_generators(selfinter=False)[2]).collect()
    assert all(r.from_id != r.to_id for r in alone) and sum(r.strength for r in alone) == pytest.approx(1)


def test_stepwise_regions_are_a_partition_that_passes(spark, matrix):
    units = spark.createDataFrame([(i, 10 * i + 1) for i in range(8)], "id int, pop int")
    got = regions.stepwise(regions.initial_state(units), units, matrix, ["sourceflow_sum"], {"sourceflow_sum": 70}).collect()
    sums = {}
    for r in got:
        sums[r.region] = sums.get(r.region, 0) + M[r.unit_id].sum()
    assert len(got) == 8 and min(sums.values()) >= 70
    assert all(r.is_core == (r.region == r.unit_id) for r in got)


def test_small_helpers():
    assert nice_number(12.3, 18.9) in (15.0, 18.0, 13.0) and 12.3 <= nice_number(12.3, 18.9) <= 18.9
    assert nice_number(480, 1010) in (500.0, 1000.0)
    assert common_name_part("from_site_id", "to_site_id") == "site_id"
    assert [literal_of(x) for x in ("3", "2.5", "true", "abc")] == [3, 2.5, True, "abc"]
