"""What the plans must look like: pruned scans, pushed filters, map-side limits, no hidden Python or cross products."""

import re

from odweave.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    text = plan(spark, "value_range")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_totalprice,100000\.0\)", text)


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "maxflow_parents_large")
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_top_rows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "maxflow_parents_large")


def test_sums_are_partial_before_the_shuffle(spark):
    text = plan(spark, "region_interaction_sums")
    assert text.count("partial_sum") >= 32


def test_relational_queries_stay_in_the_jvm(spark):
    for name in ("region_integrities", "bidir_flow_indices_large", "from_anchors", "transfer_rels_intraflow_eta", "calibrate_ipf_3", "error_metrics", "day_profile", "potential_raster", "neighbour_pairs"):
        text = plan(spark, name)
        assert not re.search("Python|Pandas|Arrow", text), name
        assert "CartesianProduct" not in text, name
