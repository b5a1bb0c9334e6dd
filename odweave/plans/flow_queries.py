"""Queries over flows, anchors, transfer, calibration and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.operators import calibrate, flows, measures, transfer
from odweave.plans.fixtures import Tables, rounded, with_ctes

QUERIES, SQL = {}, {}


def query(name: str, ctes: str = "", sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            SQL[name] = with_ctes(ctes, sql, recursive)
        return f

    return add


_LABEL = """lab AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY pop DESC, id) = 1 AS is_largest, NOT is_core AS is_hinterland FROM u),
lf AS (SELECT z.strength, a.region AS ra, b.region AS rb, a.is_largest AS la, b.is_largest AS lb, a.is_core AS ca, b.is_core AS cb
  FROM z JOIN lab a ON z.from_id = a.id JOIN lab b ON z.to_id = b.id)"""


def _sums() -> tuple[str, str, list[str]]:
    flag = {"largest": "l{}", "core": "c{}", "hinterland": "NOT c{}", "region": "TRUE"}
    outs, ins, names = [], [], []
    total = lambda cond, name: f"coalesce(sum(strength) FILTER (WHERE {cond}), 0)::BIGINT AS {name}"
    for a in measures.TYPES:
        for b in measures.TYPES:
            outs.append(total(f"ra = rb AND ({flag[a].format('a')}) AND ({flag[b].format('b')})", f"inter_{a}_to_{b}"))
    for a in measures.TYPES:
        outs.append(total(f"ra <> rb AND ({flag[a].format('a')})", f"inter_{a}_to_out"))
        outs.append(total(f"({flag[a].format('a')})", f"inter_{a}_to_all"))
        ins.append(total(f"ra <> rb AND ({flag[a].format('b')})", f"inter_out_to_{a}"))
        ins.append(total(f"({flag[a].format('b')})", f"inter_all_to_{a}"))
    names = [x.rpartition(" AS ")[2] for x in outs + ins]
    return ", ".join(outs), ", ".join(ins), names


_OUTS, _INS, _NAMES = _sums()
_SUMS = f"{_LABEL}, so AS (SELECT ra AS region, {_OUTS} FROM lf GROUP BY 1), si AS (SELECT rb AS region, {_INS} FROM lf GROUP BY 1), s AS (SELECT region, {', '.join(f'coalesce({n}, 0)::BIGINT AS {n}' for n in _NAMES)} FROM so FULL JOIN si USING (region))"


def _labelled(t: Tables):
    labels = measures.labelled_units(t.units, "pop")
    return labels, measures.interaction_sums(measures.labelled_flows(t.zone_flows, labels))


@query("region_integrities", "z u", f"""{_SUMS} SELECT region,
 round(inter_hinterland_to_core / nullif(inter_hinterland_to_out, 0)::DOUBLE, 6) AS hampl_hinterland,
 round((inter_hinterland_to_core + inter_core_to_hinterland) / nullif(inter_region_to_out, 0)::DOUBLE, 6) AS hampl_region,
 round(inter_region_to_region / nullif(inter_region_to_out + inter_out_to_region, 0)::DOUBLE, 6) AS bezak,
 round(inter_region_to_region / nullif(inter_region_to_all, 0)::DOUBLE, 6) AS coombes_residence,
 round(inter_region_to_region / nullif(inter_all_to_region, 0)::DOUBLE, 6) AS coombes_workplace,
 round((inter_region_to_region / nullif(inter_region_to_all, 0)::DOUBLE + inter_region_to_region / nullif(inter_all_to_region, 0)::DOUBLE) / 2, 6) AS self_containment FROM s""")  # fmt: skip
def region_integrities(t):
    return measures.integrities(_labelled(t)[1])


@query("region_interaction_sums", "z u", f"{_SUMS} SELECT * FROM s")
def region_interaction_sums(t):
    return _labelled(t)[1]


_PROPS = []
for _p in ("pop", "balance", "unit_count"):
    _kind = "DOUBLE" if _p == "balance" else "BIGINT"
    _PROPS.append(f"round(sum({_p}), 6)::{_kind} AS {_p}")
    for _t in ("largest", "core", "hinterland"):
        if (_p, _t) != ("unit_count", "largest"):
            _PROPS.append(f"round(coalesce(sum({_p}) FILTER (WHERE is_{_t}), 0), 6)::{_kind} AS {_p}_{_t}")
            _PROPS.append(f"round(coalesce(sum({_p}) FILTER (WHERE is_{_t}), 0)::DOUBLE / nullif(sum({_p}), 0)::DOUBLE, 6) AS {_p}_{_t}_frac")


@query("region_unit_prop_sums", "z u", f"{_LABEL}, one AS (SELECT *, 1 AS unit_count FROM lab) SELECT region, {', '.join(_PROPS)} FROM one GROUP BY 1")
def region_unit_prop_sums(t):
    return measures.property_sums(_labelled(t)[0], ["pop", "balance"])


@query("region_names", "u", """SELECT region, coalesce(string_agg(name, '–' ORDER BY pop DESC, id) FILTER (WHERE is_core), first(name ORDER BY pop DESC, id)) AS name FROM u GROUP BY 1""")
def region_names(t):
    return measures.names(t.units, "pop")


@query("region_measures", "z u", f"""{_SUMS}, one AS (SELECT *, 1 AS unit_count FROM lab), pr AS (SELECT region, {', '.join(_PROPS)} FROM one GROUP BY 1),
 nm AS (SELECT region, coalesce(string_agg(name, '–' ORDER BY pop DESC, id) FILTER (WHERE is_core), first(name ORDER BY pop DESC, id)) AS name FROM u GROUP BY 1),
 al AS (SELECT *, round((inter_region_to_region / nullif(inter_region_to_all, 0)::DOUBLE + inter_region_to_region / nullif(inter_all_to_region, 0)::DOUBLE) / 2, 6) AS self_containment FROM nm LEFT JOIN pr USING (region) LEFT JOIN s USING (region))
 SELECT region, COLUMNS(lambda c: regexp_full_match(c, 'pop.*|inter_region_.*|name|self_containment') AND NOT regexp_full_match(c, '.*_frac')) FROM al""")
def region_measures(t):
    return measures.calculate(t.units, t.zone_flows, "pop", ["pop"], only="pop.*|inter_region_.*|name|self_containment", exclude=".*_frac")


_PAIR = """b AS (SELECT least(from_id, to_id) AS id_one, greatest(from_id, to_id) AS id_other, coalesce(sum(strength) FILTER (WHERE from_id < to_id), 0)::BIGINT AS strength_one,
 coalesce(sum(strength) FILTER (WHERE from_id > to_id), 0)::BIGINT AS strength_other FROM {} WHERE from_id <> to_id GROUP BY 1, 2),
c AS (SELECT *, strength_one + strength_other AS strength, 2 * least(strength_one, strength_other) AS strength_cpabs FROM b),
d AS (SELECT *, strength_cpabs / nullif(strength, 0)::DOUBLE AS strength_cp FROM c)"""


@query("bidir_flow_indices", "z", _PAIR.format("z") + " SELECT id_one, id_other, strength_one, strength_other, strength, strength_cpabs, round(strength_cp, 6) AS strength_cp FROM d")
def bidir_flow_indices(t):
    return flows.both_directions(t.zone_flows)


@query("bidir_flow_indices_large", "l", _PAIR.format("l") + " SELECT id_one, id_other, strength_one, strength_other, strength, strength_cpabs, round(strength_cp, 6) AS strength_cp FROM d")
def bidir_flow_indices_large(t):
    return flows.both_directions(t.large_flows)


@query("bidir_flow_per_distance", "z p", _PAIR.format("z") + """, e AS (SELECT d.*, sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) AS distance FROM d JOIN p q ON q.id = id_one JOIN p r ON r.id = id_other)
 SELECT id_one, id_other, strength_one, strength_other, strength, strength_cpabs, round(strength_cp, 6) AS strength_cp, round(distance, 6) AS distance,
 round(strength / nullif(distance, 0), 6) AS strength_per_distance, round(strength_cp / nullif(distance, 0), 6) AS strength_cp_per_distance FROM e""")  # fmt: skip
def bidir_flow_per_distance(t):
    return flows.both_directions(flows.add_distances(t.zone_flows, t.places), distance="distance")


@query("add_distances", "l p", """SELECT from_id, to_id, strength, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1000, 6) AS distance FROM l LEFT JOIN p a ON from_id = a.id LEFT JOIN p b ON to_id = b.id""")
def add_distances(t):
    return flows.add_distances(t.large_flows, t.places, factor=1000)


@query("unmatched_ids", "l p", "SELECT DISTINCT id FROM (SELECT from_id AS id FROM l UNION SELECT to_id FROM l) i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = i.id)")
def unmatched_ids(t):
    return flows.unmatched_ids(t.large_flows, t.places)


@query("rels_to_lines", "z p", """SELECT from_id, to_id, strength, 'LINESTRING (' || a.x || ' ' || a.y || ', ' || b.x || ' ' || b.y || ')' AS wkt FROM z LEFT JOIN p a ON from_id = a.id LEFT JOIN p b ON to_id = b.id""")
def rels_to_lines(t):
    return flows.to_lines(t.zone_flows, t.places)


@query("unit_flow_summary", "z u", """inflow AS (SELECT u.region, to_id, sum(strength) AS v FROM z JOIN u ON u.id = to_id WHERE from_id <> to_id GROUP BY 1, 2),
 lg AS (SELECT region, to_id AS largest FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY v DESC, to_id) AS r FROM inflow) WHERE r = 1),
 k AS (SELECT from_id, strength, CASE WHEN a.region = b.region AND to_id = largest THEN 'to_largest' WHEN a.region = b.region AND b.is_core THEN 'to_core' WHEN a.region = b.region AND NOT b.is_core AND a.is_core THEN 'to_hinterland'
   WHEN a.region = b.region THEN 'within_region' ELSE 'outof_region' END AS kind FROM z JOIN u a ON a.id = from_id LEFT JOIN u b ON b.id = to_id LEFT JOIN lg ON lg.region = b.region WHERE from_id <> to_id),
 s AS (SELECT from_id AS id, coalesce(sum(strength) FILTER (WHERE kind IN ('to_core', 'to_largest')), 0) AS to_core, coalesce(sum(strength) FILTER (WHERE kind = 'to_hinterland'), 0) AS to_hinterland,
   coalesce(sum(strength) FILTER (WHERE kind = 'within_region'), 0) AS within_region, coalesce(sum(strength) FILTER (WHERE kind = 'outof_region'), 0) AS outof_region, coalesce(sum(strength) FILTER (WHERE kind = 'to_largest'), 0) AS to_largest FROM k GROUP BY 1)
 SELECT u.id, coalesce(to_core, 0)::BIGINT AS to_core, coalesce(to_hinterland, 0)::BIGINT AS to_hinterland, coalesce(within_region, 0)::BIGINT AS within_region, coalesce(outof_region, 0)::BIGINT AS outof_region, coalesce(to_largest, 0)::BIGINT AS to_largest,
   coalesce((SELECT sum(strength) FROM z WHERE from_id = u.id), 0)::BIGINT AS outflow, coalesce((SELECT sum(strength) FROM z WHERE to_id = u.id), 0)::BIGINT AS inflow FROM u LEFT JOIN s USING (id)""")  # fmt: skip
def unit_flow_summary(t):
    return flows.unit_flow_summary(t.zone_flows, t.units)


_SRC = {"general": ("1", "1"), "homebased": ("CASE type WHEN 'k' THEN 1 WHEN 'm' THEN 0.5 ELSE 0 END", "1"), "homework": ("CASE type WHEN 'k' THEN 1 WHEN 'm' THEN 0.5 ELSE 0 END", "CASE type WHEN 't' THEN 1 WHEN 'm' THEN 0.5 ELSE 0 END")}


def _prop_sql(name: str, out: str) -> str:
    s, t = _SRC[name]
    return f"""{out}_w AS (SELECT user_id, site_id, sum(importance * ({s})) AS s, sum(importance * ({t})) AS t FROM a GROUP BY 1, 2),
 {out}_x AS (SELECT *, sum(s) OVER (PARTITION BY user_id) AS sa, sum(t) OVER (PARTITION BY user_id) AS ta FROM {out}_w),
 {out} AS (SELECT from_id, to_id, sum(v) AS strength FROM (SELECT p.site_id AS from_id, q.site_id AS to_id, p.s / p.sa * q.t / q.ta AS v FROM {out}_x p JOIN {out}_x q USING (user_id) WHERE p.s > 0 AND p.sa > 0 AND q.t > 0
   UNION ALL SELECT site_id, site_id, s / sa FROM {out}_x WHERE s > 0 AND sa > 0 AND ta <= 0) GROUP BY 1, 2)"""


def _max_sql(name: str, out: str) -> str:
    s, t = _SRC[name]
    return f"""{out}_w AS (SELECT user_id, site_id, sum(importance * ({s})) AS s, sum(importance * ({t})) AS t FROM a GROUP BY 1, 2),
 {out}_s AS (SELECT user_id, site_id AS from_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, site_id) AS r FROM {out}_w WHERE s > 0) WHERE r = 1),
 {out}_t AS (SELECT user_id, site_id AS to_id FROM (SELECT w.*, row_number() OVER (PARTITION BY w.user_id ORDER BY t DESC, site_id) AS r FROM {out}_w w JOIN {out}_s b ON w.user_id = b.user_id AND site_id <> from_id WHERE t > 0) WHERE r = 1),
 {out} AS (SELECT from_id, coalesce(to_id, from_id) AS to_id, count(*)::DOUBLE AS strength FROM {out}_s LEFT JOIN {out}_t USING (user_id) GROUP BY 1, 2)"""


def _rel(index: int):
    return lambda t: (flows.maximum if flows.default_generators()[index].maximum else flows.proportional)(t.anchors, flows.default_generators()[index])


for _i, _n in enumerate(("general", "homebased", "homework")):
    query(f"rels_{_n}", "a", _prop_sql(_n, "g") + " SELECT from_id, to_id, round(strength, 6) AS strength FROM g")(_rel(_i))
for _i, _n, _b in ((3, "genfirst", "homebased"), (4, "homefirst", "homebased"), (5, "homeworkfirst", "homework")):
    query(f"rels_{_n}", "a", _max_sql(_b, "g") + " SELECT from_id, to_id, strength FROM g")(_rel(_i))

_ALL = {"general": "g1", "homebased": "g2", "homework": "g3", "genfirst": "g4", "homefirst": "g5", "homeworkfirst": "g6"}
_ALL_SQL = ", ".join([*(_prop_sql(n, _ALL[n]) for n in ("general", "homebased", "homework")), _max_sql("homebased", "g4"), _max_sql("homebased", "g5"), _max_sql("homework", "g6")])


@query("from_anchors", "a", _ALL_SQL + ", al AS (" + " UNION ALL ".join(f"SELECT from_id, to_id, '{n}' AS n, strength FROM {g}" for n, g in _ALL.items()) + ") SELECT from_id, to_id, "
       + ", ".join(f"round(coalesce(sum(strength) FILTER (WHERE n = '{n}'), 0), 6) AS {n}" for n in _ALL) + " FROM al GROUP BY 1, 2")
def from_anchors(t):
    return flows.from_anchors(t.anchors)


@query("rels_homework_noself")
def rels_homework_noself(t):
    return flows.proportional(t.anchors, flows.default_generators(selfinter=False)[2])


@query("multicores", "z", """e AS (SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM z WHERE strength >= (SELECT quantile_disc(strength, 0.97) FROM z)),
 s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS m FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.id), c AS (SELECT id, min(m) AS comp FROM r GROUP BY 1),
 i AS (SELECT c.id, comp, coalesce((SELECT sum(strength) FROM z WHERE to_id = c.id), 0) AS imp FROM c)
 SELECT id, first_value(id) OVER (PARTITION BY comp ORDER BY imp DESC, id) AS multicore FROM i""", recursive=True)  # fmt: skip
def multicores(t):
    z = t.zone_flows
    least = z.select(F.expr("percentile_disc(0.97) WITHIN GROUP (ORDER BY strength)")).first()[0]
    return flows.multicores(z, least)


@query("select_by_presence", "", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) OR p_partkey IN (SELECT s_suppkey FROM supplier)")
def select_by_presence(t):
    big = t.raw("lineitem").where("l_quantity > 45")
    return flows.in_any_column(t.raw("part").select("p_partkey", "p_brand"), "p_partkey", [(big, "l_partkey"), (t.raw("supplier"), "s_suppkey")])


# ---- transfer ----
@query("transfer_static", "u t", "SELECT target_id, round(sum(pop * weight), 6) AS pop, round(sum(balance * weight), 6) AS balance FROM u JOIN t ON id = source_id GROUP BY 1")
def transfer_static(t):
    return transfer.transfer_static(t.units, t.transfer, "id", ["pop", "balance"])


_TRANS = """x AS (SELECT a.target_id AS from_id, b.target_id AS to_id, z.strength * a.weight * CASE WHEN z.from_id = z.to_id THEN (CASE WHEN a.target_id = b.target_id THEN {eta} ELSE 0 END) + b.weight * (1 - {eta}) ELSE b.weight END AS v
 FROM z JOIN t a ON a.source_id = z.from_id JOIN t b ON b.source_id = z.to_id{join}) SELECT from_id, to_id, round(sum(v), 6) AS strength FROM x GROUP BY 1, 2"""


@query("transfer_rels", "z t", _TRANS.format(eta="0", join=""))
def transfer_rels(t):
    return transfer.transfer_interactions(t.zone_flows, t.transfer, ["strength"])


_ETA = "eta AS (SELECT from_id AS source_id, coalesce(sum(strength) FILTER (WHERE from_id = to_id), 0) / nullif(sum(strength), 0)::DOUBLE AS eta FROM z GROUP BY 1)"


@query("eta_intraflow", "z", f"{_ETA} SELECT source_id, round(eta, 6) AS eta FROM eta")
def eta_intraflow(t):
    return transfer.eta_of_intraflows(t.zone_flows, "strength")


@query("transfer_rels_intraflow_eta", "z t", _ETA + ", " + _TRANS.format(eta="coalesce(eta.eta, 0)", join=" LEFT JOIN eta ON eta.source_id = z.from_id"))
def transfer_rels_intraflow_eta(t):
    return transfer.transfer_interactions(t.zone_flows, t.transfer, ["strength"], transfer.eta_of_intraflows(t.zone_flows, "strength"))


_NEAR = """nb AS (SELECT a.id AS f, b.id AS g FROM sq a JOIN sq b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
 c AS (SELECT f, g, coalesce((SELECT strength FROM z WHERE from_id = f AND to_id = f), 0)::DOUBLE AS r00, coalesce((SELECT strength FROM z WHERE from_id = f AND to_id = g), 0)::DOUBLE AS r01,
   coalesce((SELECT strength FROM z WHERE from_id = g AND to_id = f), 0)::DOUBLE AS r10, coalesce((SELECT strength FROM z WHERE from_id = g AND to_id = g), 0)::DOUBLE AS r11 FROM nb),
 d AS (SELECT *, r00 + r01 + r10 + r11 AS tot, nullif(r00 + r01, 0) AS s0, nullif(r10 + r11, 0) AS s1, (r00 + r10) / nullif(r00 + r01 + r10 + r11, 0) AS b0, (r01 + r11) / nullif(r00 + r01 + r10 + r11, 0) AS b1 FROM c)
 SELECT f AS from_id, g AS to_id, round(greatest(0, least(1, (coalesce((r00 / s0 - b0) / nullif(1 - b0, 0) * r00, 0) + coalesce((r01 / s1 - b1) / nullif(0 - b1, 0) * r01, 0) + coalesce((r10 / s0 - b0) / nullif(0 - b0, 0) * r10, 0)
   + coalesce((r11 / s1 - b1) / nullif(1 - b1, 0) * r11, 0)) / nullif(tot, 0))), 6) AS eta, tot AS weight FROM d"""


@query("eta_neighbours", "z sq", _NEAR)
def eta_neighbours(t):
    from odweave.operators import spatial

    return transfer.eta_of_neighbours(t.zone_flows, spatial.neighbour_pairs(t.squares, 2.0))


_FIT = _NEAR.replace(" SELECT f AS from_id", ", en AS (SELECT f AS from_id").replace("round(greatest(0, least(1,", "(greatest(0, least(1,").replace("nullif(tot, 0))), 6) AS eta", "nullif(tot, 0)))) AS eta") + "), mn AS (SELECT sum(eta * weight) / nullif(sum(weight), 0) AS m FROM en)"


@query("eta_summary", "z sq", f"{_FIT} SELECT round(max(m), 6) AS mean, round(sqrt(sum(weight * (eta - m) * (eta - m)) / sum(weight)), 6) AS rmse, round(sum(weight * abs(eta - m)) / sum(weight), 6) AS mae FROM en, mn")
def eta_summary(t):
    return transfer.weighted_fit(eta_neighbours(t))


_OVER = "o AS (SELECT a.id AS source_id, b.id AS target_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM sq a, ws b)"


@query("transfer_table_rect", "sq ws", f"{_OVER}, k AS (SELECT * FROM o WHERE area > 0) SELECT source_id, target_id, round(area / sum(area) OVER (PARTITION BY source_id), 6) AS weight FROM k")
def transfer_table_rect(t):
    from odweave.operators import spatial

    pairs = spatial.rectangle_pairs(t.squares, t.wide_squares, 2.0)
    return transfer.table_from_areas(pairs.withColumnsRenamed({"a_id": "source_id", "b_id": "target_id"}))


@query("transfer_table_dasymetric", "sq ws", f"""{_OVER}, wt AS (SELECT source_id, target_id AS wt_id, (target_id % 4)::DOUBLE AS w, area FROM o WHERE area > 0 AND target_id < 108),
 pt AS (SELECT source_id, wt_id, w * area / sum(area) OVER (PARTITION BY wt_id) AS part FROM wt),
 ev AS (SELECT source_id, wt_id, part FROM pt UNION ALL SELECT DISTINCT source_id, NULL::BIGINT, 1.0 FROM o WHERE source_id NOT IN (SELECT source_id FROM pt)),
 sw AS (SELECT *, coalesce(part / nullif(sum(part) OVER (PARTITION BY source_id), 0), 1.0 / count(*) OVER (PARTITION BY source_id)) AS sw FROM ev),
 r AS (SELECT source_id, wt_id % 2 AS target_id, sum(sw) AS w FROM sw WHERE wt_id IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT source_id, source_id % 2, sw FROM sw WHERE wt_id IS NULL)
 SELECT source_id, target_id::BIGINT AS target_id, round(sum(w) / sum(sum(w)) OVER (PARTITION BY source_id), 6) AS weight FROM r GROUP BY 1, 2""")  # fmt: skip
def transfer_table_dasymetric(t):
    from odweave.operators import spatial

    pairs = spatial.rectangle_pairs(t.squares, t.wide_squares, 2.0).where("area > 0")
    parts = pairs.where("b_id < 108").select(F.col("a_id").alias("source_id"), F.col("b_id").alias("wt_id"), (F.col("b_id") % 4).cast("double").alias("weight"), "area")
    none = F.lit(None).cast("bigint")
    targets = t.wide_squares.where("id < 108").select(F.col("id").alias("wt_id"), none.alias("source_id"), (F.col("id") % 2).alias("target_id"), F.lit(1.0).alias("area"))
    own = t.squares.select(none.alias("wt_id"), F.col("id").cast("bigint").alias("source_id"), (F.col("id") % 2).cast("bigint").alias("target_id"), F.lit(1.0).alias("area"))
    return transfer.dasymetric_table(parts, t.squares.select(F.col("id").alias("source_id")), targets.unionByName(own))


# ---- calibration ----
@query("calibrate_source", "z truth", """v AS (SELECT from_id, sum(strength) AS v FROM z GROUP BY 1), c AS (SELECT from_id, sum(strength) AS c FROM truth GROUP BY 1)
 SELECT from_id, to_id, round(strength * coalesce(c / nullif(v, 0)::DOUBLE, 1), 6) AS strength FROM z JOIN v USING (from_id) LEFT JOIN c USING (from_id)""")
def calibrate_source(t):
    return calibrate.by_source(t.zone_flows, t.truth, "strength")


@query("calibrate_dirstat", "z truth", """v AS (SELECT from_id, from_id = to_id AS s, sum(strength) AS v FROM z GROUP BY 1, 2), c AS (SELECT from_id, from_id = to_id AS s, sum(strength) AS c FROM truth GROUP BY 1, 2)
 SELECT z.from_id, to_id, round(strength * coalesce(c / nullif(v, 0)::DOUBLE, 1), 6) AS strength FROM z JOIN v ON v.from_id = z.from_id AND v.s = (z.from_id = z.to_id) LEFT JOIN c ON c.from_id = z.from_id AND c.s = (z.from_id = z.to_id)""")
def calibrate_dirstat(t):
    return calibrate.by_source(t.zone_flows, t.truth, "strength", self_flows=True)


def _ipf_sql(sweeps: int) -> str:
    out = ["rw AS (SELECT from_id, sum(strength)::DOUBLE AS r FROM truth GROUP BY 1)", "cl AS (SELECT to_id, sum(strength)::DOUBLE AS c FROM truth GROUP BY 1)",
           "i0 AS (SELECT z.from_id, z.to_id, strength::DOUBLE AS v, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM z LEFT JOIN rw USING (from_id) LEFT JOIN cl USING (to_id))"]
    step = "SELECT from_id, to_id, r, c, v * {m} / CASE WHEN sum(v) OVER (PARTITION BY {k}) = 0 THEN 1 ELSE sum(v) OVER (PARTITION BY {k}) END AS v FROM {t}"
    last = "i0"
    for k in range(sweeps):
        out += [f"r{k} AS ({step.format(m='r', k='from_id', t=last)})", f"c{k} AS ({step.format(m='c', k='to_id', t=f'r{k}')})"]
        last = f"c{k}"
    return ", ".join(out) + f" SELECT from_id, to_id, round(v, 6) AS strength FROM ({step.format(m='r', k='from_id', t=last)}) WHERE v <> 0"


@query("calibrate_ipf_3", "z truth", _ipf_sql(3))
def calibrate_ipf_3(t):
    return calibrate.by_margins(t.zone_flows, t.truth, "strength", sweeps=3)


def _factors_sql(sweeps: int) -> str:
    """Fitting by factors of rows and columns; more sweeps than it takes to settle change nothing."""
    out = ["rw AS (SELECT from_id, sum(strength)::DOUBLE AS r FROM truth GROUP BY 1)", "cl AS (SELECT to_id, sum(strength)::DOUBLE AS c FROM truth GROUP BY 1)",
           "b0 AS (SELECT DISTINCT to_id, 1.0::DOUBLE AS b FROM z)"]
    row = "a{k} AS MATERIALIZED (SELECT from_id, coalesce(any_value(r), 0) / CASE WHEN sum(strength * b) = 0 THEN 1 ELSE sum(strength * b) END AS a FROM z JOIN b{j} USING (to_id) LEFT JOIN rw USING (from_id) GROUP BY 1)"
    col = "b{k} AS MATERIALIZED (SELECT to_id, coalesce(any_value(c), 0) / CASE WHEN sum(strength * a) = 0 THEN 1 ELSE sum(strength * a) END AS b FROM z JOIN a{k} USING (from_id) LEFT JOIN cl USING (to_id) GROUP BY 1)"
    for k in range(1, sweeps + 1):
        out += [row.format(k=k, j=k - 1), col.format(k=k)]
    out.append(row.format(k=sweeps + 1, j=sweeps))
    return ", ".join(out) + f", ip AS (SELECT from_id, to_id, strength * a * b AS v FROM z JOIN a{sweeps + 1} USING (from_id) JOIN b{sweeps} USING (to_id) WHERE strength * a * b <> 0)"


@query("calibrate_ipf", "z truth", _factors_sql(60) + " SELECT from_id, to_id, round(v, 6) AS strength FROM ip")
def calibrate_ipf(t):
    return calibrate.by_margins(t.zone_flows, t.truth, "strength")


_XY = "xy AS (SELECT id, pop AS x, (pop * 3 + id % 7)::DOUBLE AS y FROM u)"


def _xy(t):
    return t.units.select("id", F.col("pop").alias("x"), (F.col("pop") * 3 + F.col("id") % 7).cast("double").alias("y"))


@query("calibrate_sum", "u", f"{_XY}, m AS (SELECT sum(y) / nullif(sum(x), 0)::DOUBLE AS s FROM xy) SELECT id, x, y, round(greatest(0, x * s), 6) AS calibrated FROM xy, m")
def calibrate_sum(t):
    return calibrate.calibrated(_xy(t), "x", "y", "sum")


@query("calibrate_ols", "u", f"{_XY}, m AS (SELECT sum(x::DOUBLE * y) / nullif(sum(x::DOUBLE * x), 0) AS s FROM xy) SELECT id, x, y, round(greatest(0, x * s), 6) AS calibrated FROM xy, m")
def calibrate_ols(t):
    return calibrate.calibrated(_xy(t), "x", "y", "ols")


@query("calibrate_logols", "u", f"{_XY}, m AS (SELECT regr_slope(log10(y), log10(x)) AS s, regr_intercept(log10(y), log10(x)) AS i FROM xy WHERE x > 0.1 AND y > 0.1) SELECT id, x, y, round(CASE WHEN x <= 0.1 THEN x::DOUBLE ELSE pow(10, i + s * log10(x)) END, 6) AS calibrated FROM xy, m")
def calibrate_logols(t):
    return calibrate.calibrated(_xy(t), "x", "y", "logols")


def _lad_sql(rounds: int, x: str, y: str, rows: str, intercept: bool) -> str:
    """Reweighted least squares, written out; rounds beyond the settled one change nothing."""
    out = [f"pt AS (SELECT {x} AS x, {y} AS y FROM xy {rows})"]
    for k in range(rounds):
        w = "1.0::DOUBLE" if k == 0 else "1 / greatest(abs(y - s * x - i), 1e-3)"
        own = f"(SELECT x, y, {w} AS w FROM pt" + (f", k{k - 1})" if k else ")")
        sums = "sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx"
        slope = "(sw * sxy - sx * sy) / (sw * sxx - sx * sx)" if intercept else "sxy / sxx"
        out.append(f"k{k} AS MATERIALIZED (SELECT s, {'(sy - s * sx) / sw' if intercept else '0.0::DOUBLE'} AS i FROM (SELECT *, {slope} AS s FROM (SELECT {sums} FROM {own} q)))")
    return ", ".join(out) + f", m AS (SELECT * FROM k{rounds - 1})"


@query("calibrate_lad", "u", f"{_XY}, {_lad_sql(200, 'x::DOUBLE', 'y', '', False)} SELECT id, x, y, round(greatest(0, x * s), 3) AS calibrated FROM xy, m")
def calibrate_lad(t):
    return rounded(calibrate.calibrated(_xy(t), "x", "y", "lad"), 3)


@query("calibrate_loglad", "u", f"{_XY}, {_lad_sql(300, 'log10(x)', 'log10(y)', 'WHERE x > 0.1 AND y > 0.1', True)} SELECT id, x, y, round(CASE WHEN x <= 0.1 THEN x::DOUBLE ELSE pow(10, i + s * log10(x)) END, 2) AS calibrated FROM xy, m")
def calibrate_loglad(t):
    return rounded(calibrate.calibrated(_xy(t), "x", "y", "loglad"), 2)


@query("calibrate_rels_all", "z truth", _factors_sql(60) + """, vs AS (SELECT from_id, sum(strength) AS v FROM z GROUP BY 1), cs AS (SELECT from_id, sum(strength) AS c FROM truth GROUP BY 1),
 so AS (SELECT from_id, to_id, round(strength * coalesce(c / nullif(v, 0)::DOUBLE, 1), 6) AS w FROM z JOIN vs USING (from_id) LEFT JOIN cs USING (from_id)),
 vd AS (SELECT from_id, from_id = to_id AS s, sum(strength) AS v FROM z GROUP BY 1, 2), cd AS (SELECT from_id, from_id = to_id AS s, sum(strength) AS c FROM truth GROUP BY 1, 2),
 di AS (SELECT z.from_id, to_id, round(strength * coalesce(c / nullif(v, 0)::DOUBLE, 1), 6) AS w FROM z JOIN vd ON vd.from_id = z.from_id AND vd.s = (z.from_id = z.to_id) LEFT JOIN cd ON cd.from_id = z.from_id AND cd.s = (z.from_id = z.to_id))
 SELECT from_id, to_id, strength, so.w AS strength_cal_source, di.w AS strength_cal_dirstat, round(ip.v, 6) AS strength_cal_ipf
 FROM z FULL JOIN so USING (from_id, to_id) FULL JOIN di USING (from_id, to_id) FULL JOIN ip USING (from_id, to_id)""")
def calibrate_rels_all(t):
    return calibrate.calibrate_all(t.zone_flows, t.truth, "strength")


@query("describe_percentiles", "l", """SELECT min(strength)::DOUBLE AS min, max(strength)::DOUBLE AS max, sum(strength)::DOUBLE AS sum, round(avg(strength), 6) AS mean, quantile_cont(strength::DOUBLE, 0.025) AS p2_5, quantile_cont(strength::DOUBLE, 0.1) AS p10,
 quantile_cont(strength::DOUBLE, 0.25) AS p25, quantile_cont(strength::DOUBLE, 0.5) AS median, quantile_cont(strength::DOUBLE, 0.75) AS p75, quantile_cont(strength::DOUBLE, 0.9) AS p90, round(quantile_cont(strength::DOUBLE, 0.975), 6) AS p97_5 FROM l""")
def describe_percentiles(t):
    return calibrate.describe(t.large_flows, "strength")


@query("error_metrics", "z truth", """j AS (SELECT coalesce(a.strength, 0)::DOUBLE AS t, coalesce(z.strength, 0)::DOUBLE AS m FROM truth a FULL JOIN z ON a.from_id = z.from_id AND a.to_id = z.to_id),
 k AS (SELECT t, m, log10(t + 1) AS lt, log10(m + 1) AS lm FROM j) SELECT sum(m) - sum(t) AS diff, sum(abs(t - m)) AS tae, round(sum(abs(t - m)) / nullif(sum(t), 0), 6) AS rtae,
 round(1 - sum((t - m) * (t - m)) / nullif(sum(t * t) - sum(t) * sum(t) / count(*), 0), 6) AS r2, round(sqrt(avg((t - m) * (t - m))), 6) AS rmse, round(2 * sum(least(t, m)) / nullif(sum(t) + sum(m), 0), 6) AS cp,
 round(1 - sum((lt - lm) * (lt - lm)) / nullif(sum(lt * lt) - sum(lt) * sum(lt) / count(*), 0), 6) AS logr2 FROM k""")
def error_metrics(t):
    return calibrate.error_metrics(t.zone_flows, t.truth, ["from_id", "to_id"], "strength")


@query("aggregate_by_name", "", "SELECT o_custkey, round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1")
def aggregate_by_name(t):
    return calibrate.aggregate_by_name(t.raw("orders"), ["o_custkey"], "o_totalprice", "mean")
