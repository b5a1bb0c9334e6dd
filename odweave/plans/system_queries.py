"""Queries over regions, graphs and settlement-system models."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.functions.columns import top_rows
from odweave.operators import graphs, regions, settlement
from odweave.plans.fixtures import Tables, draw, rounded, with_ctes

QUERIES, SQL = {}, {}


def query(name: str, ctes: str = "", sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            SQL[name] = with_ctes(ctes, sql, recursive)
        return f

    return add


def _state(t):
    return t.units.select(F.col("id").alias("unit_id"), "region", "is_core")


_CRIT = ["unit_count", "sourceflow_sum", "pop", "hinterland_pop"]


@query("region_evaluate", "z u", """o AS (SELECT from_id, sum(strength) AS v FROM z GROUP BY 1) SELECT region, count(*)::BIGINT AS unit_count, coalesce(sum(v), 0)::BIGINT AS sourceflow_sum, sum(pop)::BIGINT AS pop,
 (CASE WHEN count(*) FILTER (WHERE is_core) = 0 THEN 0 ELSE sum(pop) - sum(pop) FILTER (WHERE is_core) END)::BIGINT AS hinterland_pop, count(*) >= 5 AND sum(pop) >= 200 AS verified FROM u LEFT JOIN o ON from_id = id GROUP BY 1""")  # fmt: skip
def region_evaluate(t):
    found = regions.evaluate(_state(t), t.units, t.zone_flows, _CRIT)
    return regions.verified(found, {"unit_count": 5, "pop": 200})


_STRENGTHS = "s AS (SELECT a.region, from_id AS unit_id, b.region AS target, sum(strength * b.is_core::INT) AS v FROM z JOIN u a ON a.id = from_id JOIN u b ON b.id = to_id WHERE a.region <> b.region AND a.is_core GROUP BY 1, 2, 3)"


@query("region_target_step", "z u", f"{_STRENGTHS}, g AS (SELECT region, target, sum(v) AS strength FROM s GROUP BY 1, 2) SELECT region, target, strength::BIGINT AS strength FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY strength DESC, target) AS r FROM g) WHERE r = 1")
def region_target_step(t):
    return regions.region_targets(_state(t), t.zone_flows, source_core=True, target_core=True)


@query("region_unit_targets", "z u", f"{_STRENGTHS} SELECT region, unit_id, target, v::BIGINT AS strength FROM (SELECT *, row_number() OVER (PARTITION BY region, unit_id ORDER BY v DESC, target) AS r FROM s) WHERE r = 1")
def region_unit_targets(t):
    return regions.unit_targets(_state(t), t.zone_flows, source_core=True, target_core=True)


@query("region_presets", "u", "SELECT id AS unit_id, CASE WHEN id % 5 = 0 THEN 1 ELSE id END AS region, id % 5 <> 0 AS is_core FROM u")
def region_presets(t):
    state = regions.initial_state(t.units)
    return regions.apply_presets(state, t.units.where("id % 5 = 0").select(F.col("id").alias("unit_id"), F.lit(1).alias("region")), core=False)


@query("region_stepwise")
def region_stepwise(t):
    total = t.zone_flows.agg(F.sum("strength")).first()[0]
    return regions.stepwise(regions.initial_state(t.units), t.units, t.zone_flows, ["sourceflow_sum"], {"sourceflow_sum": total / 6})


@query("region_stepwise_dissolve")
def region_stepwise_dissolve(t):
    total = t.zone_flows.agg(F.sum("strength")).first()[0]
    return regions.stepwise(regions.initial_state(t.units), t.units, t.zone_flows, ["sourceflow_sum", "unit_count"], {"sourceflow_sum": total / 6, "unit_count": 3}, dissolve=True)


@query("maxflow_parents", "z", "SELECT from_id AS id, to_id AS parent FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY strength DESC, to_id) AS r FROM z WHERE from_id <> to_id) WHERE r = 1")
def maxflow_parents(t):
    return settlement.maxflow_parents(t.zone_flows)


@query("maxflow_parents_large", "l", "SELECT from_id AS id, to_id AS parent FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY strength DESC, to_id) AS r FROM l WHERE from_id <> to_id) WHERE r = 1")
def maxflow_parents_large(t):
    return settlement.maxflow_parents(t.large_flows)


@query("root_by_outflow", "z", "SELECT from_id AS id, sum(strength)::BIGINT AS outsum FROM z GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def root_by_outflow(t):
    return settlement.root_by_outflow(t.zone_flows)


_VEC = """o AS (SELECT from_id AS id, sum(strength) AS outsum, coalesce(sum(strength) FILTER (WHERE from_id = to_id), 0) AS selfsum, coalesce(max(strength) FILTER (WHERE from_id <> to_id), 0) AS max_out FROM z GROUP BY 1),
 i AS (SELECT to_id AS id, sum(strength) AS insum FROM z GROUP BY 1), v0 AS (SELECT id, coalesce(outsum, 0) AS o0, coalesce(selfsum, 0) AS s0, coalesce(max_out, 0) AS max_out, coalesce(insum, 0) AS insum FROM o FULL JOIN i USING (id)),
 vec AS (SELECT id, CASE WHEN o0 = 0 THEN 1 ELSE o0 END::BIGINT AS outsum, CASE WHEN o0 = 0 THEN 1 ELSE s0 END::BIGINT AS selfsum, max_out::BIGINT AS max_out, insum::BIGINT AS insum FROM v0),
 k AS (SELECT sum(outsum::DOUBLE * max_out) / sum(outsum::DOUBLE * outsum) AS k FROM vec)"""


@query("relation_vectors", "z", f"{_VEC} SELECT id, outsum, selfsum, max_out, insum, round(outsum / (SELECT sum(outsum) FROM vec)::DOUBLE, 6) AS unit_weight FROM vec")
def relation_vectors(t):
    return settlement.relation_vectors(t.zone_flows)


@query("hssm_scale", "z", f"{_VEC} SELECT round(k, 6) AS k FROM k")
def hssm_scale(t):
    return settlement.scale_k(t.zone_flows)


@query("transition_probs", "z", "SELECT from_id, to_id, strength, round(strength / sum(strength) OVER (PARTITION BY from_id)::DOUBLE, 6) AS p FROM z")
def transition_probs(t):
    return graphs.transition_probabilities(t.zone_flows)


@query("flow_weighting", "z", """a AS (SELECT *, sum(strength) OVER (PARTITION BY from_id) AS o FROM z), b AS (SELECT *, sum(strength) OVER (PARTITION BY from_id) AS n FROM a WHERE from_id <> to_id)
 SELECT from_id, to_id, round(strength / n::DOUBLE * o / (SELECT sum(strength) FROM z)::DOUBLE, 6) AS weighting FROM b""")
def flow_weighting(t):
    return settlement.flow_weighting(t.zone_flows)


@query("sampled_parents", "z", f"SELECT from_id AS id, to_id AS parent FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY ln({draw(3, 'from_id', 'to_id')}) / strength DESC, to_id) AS r FROM z WHERE from_id <> to_id) WHERE r = 1")
def sampled_parents(t):
    return settlement.sampled_parents(t.zone_flows, seed=3)


_LINKS = """lk AS (SELECT id, parent, stage FROM model WHERE parent IS NOT NULL AND parent <> id AND stage <> 'A'), og AS (SELECT id AS org, parent AS head FROM lk WHERE stage = 'O'),
 sib AS (SELECT id AS a, org AS b FROM lk JOIN og ON parent = head WHERE stage = 'N'), up AS (SELECT id AS a, parent AS b FROM lk UNION ALL SELECT a, b FROM sib),
 e AS (SELECT id AS a, parent AS b FROM lk UNION ALL SELECT a, b FROM sib UNION ALL SELECT p.org, q.org FROM og p JOIN og q ON p.head = q.head AND p.org > q.org UNION ALL SELECT org, up.b FROM og JOIN up ON up.a = head WHERE org <> up.b)"""


@query("hssm_connections", "model", f"{_LINKS} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e")
def hssm_connections(t):
    return settlement.connections(t.model)


@query("hssm_check", "model", "SELECT 'roots' AS problem, count(*) AS n FROM model WHERE stage = 'N' AND (parent IS NULL OR parent = id) HAVING count(*) <> 1")
def hssm_check(t):
    return settlement.check_model(t.model)


_F = "COALESCE((SELECT strength FROM z WHERE from_id = {a} AND to_id = {b}), 0)"


@query("hssm_symcoh", "z model", f"""{_VEC}, og AS (SELECT id AS a, parent AS b FROM model WHERE stage = 'O'), li AS (SELECT a, b FROM og UNION ALL SELECT b, a FROM og),
 c AS (SELECT a AS id, min(least({_F.format(a='a', b='b')}, {_F.format(a='b', b='a')}) / (k.k * greatest(va.outsum, vb.outsum))) AS symcoh FROM li JOIN vec va ON va.id = a JOIN vec vb ON vb.id = b, k GROUP BY 1)
 SELECT id, round(symcoh, 6) AS symcoh, round(least(symcoh, 1), 6) AS organicity FROM c""")  # fmt: skip
def hssm_symcoh(t):
    return settlement.symmetric_cohesion(t.model, t.zone_flows)


@query("hssm_nodality", "z model", f"""{_VEC}, h AS (SELECT id, CASE WHEN stage = 'O' THEN parent ELSE id END AS head FROM model), nf AS (SELECT * FROM z WHERE from_id <> to_id),
 ev AS (SELECT from_id, t, sum(strength) AS v FROM (SELECT from_id, to_id AS t, strength FROM nf UNION ALL SELECT from_id, head, strength FROM nf JOIN h ON h.id = to_id WHERE head <> to_id AND from_id <> head) GROUP BY 1, 2),
 r AS (SELECT m.id, stage, greatest(coalesce((SELECT max(v) FROM ev WHERE from_id = m.id), 0), coalesce((SELECT max(v) FROM ev WHERE t = m.id), 0)) AS mx FROM model m)
 SELECT r.id, round(CASE WHEN stage = 'A' THEN 1 - least(1, mx / (k.k * outsum)) ELSE least(1, mx / (k.k * outsum)) END, 6) AS nodality FROM r JOIN vec USING (id), k""")  # fmt: skip
def hssm_nodality(t):
    return settlement.nodality(t.model, t.zone_flows)


@query("hssm_outsim", "z model", f"""{_VEC}, og AS (SELECT id, parent AS head FROM model WHERE stage = 'O'), me AS (SELECT id, head FROM og UNION SELECT head, head FROM og),
 mw AS (SELECT id, head, outsum / nullif(sum(outsum) OVER (PARTITION BY head), 0)::DOUBLE AS ws FROM me JOIN vec USING (id)), en AS (SELECT from_id AS id, to_id AS other, strength AS v, 'o' AS way FROM z UNION ALL SELECT to_id, from_id, strength, 'i' FROM z),
 rw AS (SELECT en.*, head FROM en JOIN mw USING (id) WHERE NOT EXISTS (SELECT 1 FROM me WHERE me.id = en.other AND me.head = mw.head)), tt AS (SELECT head, other, way, sum(v)::DOUBLE AS al FROM rw GROUP BY 1, 2, 3),
 gr AS (SELECT mw.id, al * ws AS e, coalesce(rw.v, 0)::DOUBLE AS v FROM mw JOIN tt USING (head) LEFT JOIN rw ON rw.id = mw.id AND rw.head = mw.head AND rw.other = tt.other AND rw.way = tt.way)
 SELECT id, round(sum(least(v, e)) / nullif(sum(greatest(v, e)), 0), 6) AS outsim FROM gr GROUP BY 1""")
def hssm_outsim(t):
    return settlement.outflow_similarity(t.model, t.zone_flows)


@query("hssm_flow_coverage", "z model", """lk AS (SELECT * FROM model WHERE parent IS NOT NULL AND parent <> id AND stage <> 'A'), e AS (SELECT id AS f, parent AS t FROM lk UNION SELECT parent, id FROM lk WHERE stage = 'O')
 SELECT round((SELECT sum(strength) FROM z JOIN e ON f = from_id AND t = to_id) / (SELECT sum(strength) FROM z WHERE from_id <> to_id)::DOUBLE * count(*) / (count(*) + count(*) FILTER (WHERE stage = 'O')), 6) AS coverage FROM model""")
def hssm_flow_coverage(t):
    return settlement.flow_coverage(t.model, t.zone_flows)


_UP = "up(id, ancestor, depth) AS (SELECT id, id, 0 FROM {t} UNION ALL SELECT up.id, par2.parent, depth + 1 FROM up JOIN {t} par2 ON par2.id = up.ancestor WHERE par2.parent IS NOT NULL AND par2.parent <> par2.id)"


@query("hierarchy_ancestors", "par", _UP.format(t="par") + " SELECT id, ancestor, depth FROM up", recursive=True)
def hierarchy_ancestors(t):
    return graphs.ancestors(t.parents)


@query("hierarchy_descendants", "model", "tr AS (SELECT id, parent FROM model WHERE stage <> 'A'), " + _UP.format(t="tr") + " SELECT id FROM up WHERE ancestor = 1 AND depth > 0", recursive=True)
def hierarchy_descendants(t):
    return settlement.descendants(t.model, 1)


@query("subtree_levels", "u par", _UP.format(t="par") + " SELECT ancestor AS id, sum(pop)::BIGINT AS weight FROM up JOIN u USING (id) GROUP BY 1", recursive=True)
def subtree_levels(t):
    return settlement.subtree_sums(t.parents, t.units.select("id", F.col("pop").alias("weight")))


@query("regional_succession", "u model", "tr AS (SELECT id, parent FROM model WHERE stage <> 'A'), " + _UP.format(t="tr") + ", s AS (SELECT ancestor, sum(pop)::BIGINT AS weight FROM up JOIN u USING (id) GROUP BY 1) SELECT id, ancestor AS region, weight FROM up JOIN s USING (ancestor)", recursive=True)
def regional_succession(t):
    return settlement.regional_succession(t.model, t.units.select("id", F.col("pop").alias("weight")))


@query("hssm_lines", "p model", """r AS (SELECT m.id, parent, stage, x AS x1, y AS y1 FROM model m JOIN p USING (id)), c AS (SELECT CASE WHEN stage = 'O' THEN parent ELSE id END AS sys, avg(x1) AS x2, avg(y1) AS y2 FROM r GROUP BY 1)
 SELECT id, parent, stage, x1, y1, round(CASE WHEN stage = 'A' THEN x1 ELSE x2 END, 6) AS x2, round(CASE WHEN stage = 'A' THEN y1 ELSE y2 END, 6) AS y2 FROM r LEFT JOIN c ON sys = CASE WHEN stage = 'A' THEN id ELSE coalesce(parent, id) END""")
def hssm_lines(t):
    return settlement.model_lines(t.model, t.places)


@query("parent_cycles", "z", """mp AS (SELECT from_id AS id, to_id AS parent FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY strength DESC, to_id) AS r FROM z WHERE from_id <> to_id) WHERE r = 1),
 w(id, pos, n) AS (SELECT id, parent, 1 FROM mp UNION ALL SELECT w.id, mp.parent, n + 1 FROM w JOIN mp ON mp.id = w.pos WHERE n < 30 AND w.pos <> w.id) SELECT DISTINCT id FROM w WHERE id = pos""", recursive=True)  # fmt: skip
def parent_cycles(t):
    return graphs.parent_cycles(settlement.maxflow_parents(t.zone_flows))


for _b in ("maxflow", "heaviest", "stochastic", "improvement", "genetic"):
    query(f"hssm_build_{_b}")(lambda t, b=_b: settlement.build_model(t.zone_flows, b))


@query("transition_criterion", "z model", """sy AS (SELECT id, CASE WHEN stage = 'O' THEN parent ELSE id END AS sys FROM model WHERE stage <> 'A'),
 ou AS (SELECT from_id AS id, sum(strength)::DOUBLE AS w, coalesce(sum(strength) FILTER (WHERE from_id = to_id), 0)::DOUBLE AS self FROM z GROUP BY 1),
 nr AS (SELECT a.sys, from_id, to_id, strength::DOUBLE AS v FROM z JOIN sy a ON a.id = from_id JOIN sy b ON b.id = to_id WHERE a.sys = b.sys AND from_id <> to_id),
 ea AS (SELECT sys, id, sum(o) AS o, sum(i) AS i FROM (SELECT sys, from_id AS id, v AS o, 0 AS i FROM nr UNION ALL SELECT sys, to_id, 0, v FROM nr) GROUP BY 1, 2),
 re AS (SELECT sys, avg(1 - coalesce(abs(o - i) / nullif(o + i, 0), 0)) AS reciprocity FROM ea GROUP BY 1), su AS (SELECT sys, sum(v) AS inside FROM nr GROUP BY 1),
 ba AS (SELECT sys, sum(w - self) AS leaving, count(*) AS n FROM sy JOIN ou USING (id) GROUP BY 1),
 ro AS (SELECT sys, coalesce(coalesce(inside, 0) / nullif(leaving, 0), 0) AS c, coalesce(reciprocity, 0) AS r FROM ba LEFT JOIN su USING (sys) LEFT JOIN re USING (sys) WHERE n > 1)
 SELECT sys AS id, round(c, 6) AS cohesion, round(r, 6) AS reciprocity, round(sqrt(c * r), 6) AS organic FROM ro""")
def transition_criterion(t):
    return settlement.transition_criterion(t.model, t.zone_flows)


@query("hierarchy_regions", "u model", """me AS (SELECT id, CASE WHEN parent IS NULL THEN id ELSE parent END AS parent, coalesce(u.pop, 0)::DOUBLE AS w FROM model LEFT JOIN u USING (id) WHERE stage <> 'A'),
 mi AS (SELECT sum(pop) / 5.0 AS m FROM u), tp AS (SELECT id FROM me WHERE id = parent OR parent NOT IN (SELECT id FROM me)),
 up AS (SELECT id AS x, 0 AS d FROM tp UNION ALL SELECT me.id, d + 1 FROM me JOIN up ON me.parent = up.x AND me.id <> me.parent),
 bt AS (SELECT (SELECT max(d) FROM up) AS d, [{'id': -1, 'l': 0.0::DOUBLE, 'r': false}] AS st UNION ALL
   SELECT d - 1, list_concat(st, (SELECT list({'id': x, 'l': g, 'r': g >= (SELECT m FROM mi) OR x IN (SELECT id FROM tp)}) FROM (
     SELECT x, w + coalesce((SELECT sum(s.l) FROM (SELECT unnest(bt.st) AS s) q JOIN me k ON k.id = s.id WHERE k.parent = up.x AND k.id <> up.x AND NOT s.r), 0) AS g FROM up JOIN me ON me.id = up.x WHERE up.d = bt.d) v)) FROM bt WHERE d >= 0),
 hd AS (SELECT s.id AS id, s.r AS r FROM (SELECT unnest(st) AS s FROM bt WHERE d = -1)),
 go AS (SELECT id, id AS pos FROM me UNION ALL SELECT go.id, me.parent FROM go JOIN hd ON hd.id = go.pos AND NOT hd.r JOIN me ON me.id = go.pos)
 SELECT go.id, go.pos AS region FROM go JOIN hd ON hd.id = go.pos WHERE hd.r""", recursive=True)
def hierarchy_regions(t):
    total = t.units.agg(F.sum("pop")).first()[0]
    return settlement.regions_by_weight(t.model, t.units.select("id", F.col("pop").alias("weight")), total / 5)


def _passage_sql(squarings: int = 10) -> str:
    """Chains within strongly connected parts: the stationary row by squaring, the fundamental matrix as a sum of powers
    of the transition matrix less that row, doubled each time."""
    out = ["""n AS (SELECT from_id AS i FROM z UNION SELECT to_id FROM z), rc AS (SELECT i, i AS j FROM n UNION SELECT rc.i, z.to_id FROM rc JOIN z ON z.from_id = rc.j),
 sc AS (SELECT x.i, x.j FROM rc x JOIN rc y ON x.i = y.j AND x.j = y.i), k AS (SELECT i, j, sum(v) AS v FROM (SELECT sc.i, sc.j, strength::DOUBLE AS v FROM z JOIN sc ON from_id = sc.i AND to_id = sc.j
   UNION ALL SELECT i, i, 1.0 FROM n WHERE i NOT IN (SELECT from_id FROM z JOIN sc ON from_id = sc.i AND to_id = sc.j)) GROUP BY 1, 2),
 p0 AS MATERIALIZED (SELECT sc.i, sc.j, coalesce(v, 0) / sum(v) OVER (PARTITION BY sc.i) AS v FROM sc LEFT JOIN k ON k.i = sc.i AND k.j = sc.j)"""]
    times = "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {} a JOIN {} b ON a.j = b.i GROUP BY 1, 2"
    out += [f"p{k} AS MATERIALIZED ({times.format(f'p{k - 1}', f'p{k - 1}')})" for k in range(1, squarings + 1)]
    out += [f"q0 AS MATERIALIZED (SELECT p0.i, p0.j, p0.v - l.v AS v FROM p0 JOIN p{squarings} l USING (i, j))", "s0 AS MATERIALIZED (SELECT i, j, (i = j)::INT::DOUBLE AS v FROM sc)"]
    for k in range(1, squarings + 1):
        out.append(f"s{k} AS MATERIALIZED (SELECT i, j, s.v + t.v AS v FROM s{k - 1} s JOIN ({times.format(f'q{k - 1}', f's{k - 1}')}) t USING (i, j))")
        out.append(f"q{k} AS MATERIALIZED ({times.format(f'q{k - 1}', f'q{k - 1}')})")
    return ", ".join(out) + f" SELECT a.i AS from_id, a.j AS to_id, round(((a.i = a.j)::INT - a.v + d.v) / l.v, 6) AS steps, round(l.v, 6) AS pi FROM s{squarings} a JOIN s{squarings} d ON d.i = a.j AND d.j = a.j JOIN p{squarings} l ON l.i = a.i AND l.j = a.j"


@query("markov_mfpt", "z", _passage_sql(), recursive=True)
def markov_mfpt(t):
    return graphs.mean_first_passage(t.zone_flows)


_EDGE = "ed AS (SELECT from_id, to_id, 1000.0 / strength AS cost FROM z WHERE from_id <> to_id)"


def _edges(t):
    return t.zone_flows.where("from_id <> to_id").select("from_id", "to_id", (F.lit(1000.0) / F.col("strength")).alias("cost"))


@query("shortest_distances", "z", f"{_EDGE}, s1 AS (SELECT from_id, to_id, min(cost) AS c FROM ed GROUP BY 1, 2), " + ", ".join(
    f"s{2**k} AS (SELECT from_id, to_id, min(c) AS c FROM (SELECT * FROM s{2 ** (k - 1)} UNION ALL SELECT a.from_id, b.to_id, a.c + b.c FROM s{2 ** (k - 1)} a JOIN s{2 ** (k - 1)} b ON a.to_id = b.from_id WHERE a.from_id <> b.to_id) GROUP BY 1, 2)" for k in range(1, 6))
    + " SELECT from_id, to_id, round(c, 6) AS cost FROM s32")
def shortest_distances(t):
    return graphs.min_closure(_edges(t))


@query("shortest_distances_product", "z", f"{_EDGE}, s1 AS (SELECT from_id, to_id, min(1 + cost) AS c FROM ed GROUP BY 1, 2), " + ", ".join(
    f"s{2**k} AS (SELECT from_id, to_id, min(c) AS c FROM (SELECT * FROM s{2 ** (k - 1)} UNION ALL SELECT a.from_id, b.to_id, a.c * b.c FROM s{2 ** (k - 1)} a JOIN s{2 ** (k - 1)} b ON a.to_id = b.from_id WHERE a.from_id <> b.to_id) GROUP BY 1, 2)" for k in range(1, 6))
    + " SELECT from_id, to_id, round(c, 6) AS cost FROM s32")
def shortest_distances_product(t):
    return graphs.min_closure(_edges(t).withColumn("cost", 1 + F.col("cost")), product=True)


@query("route_costs", "z", f"{_EDGE}, s1 AS (SELECT from_id, to_id, min(cost) AS c FROM ed GROUP BY 1, 2), " + ", ".join(
    f"s{2**k} AS (SELECT from_id, to_id, min(c) AS c FROM (SELECT * FROM s{2 ** (k - 1)} UNION ALL SELECT a.from_id, b.to_id, a.c + b.c FROM s{2 ** (k - 1)} a JOIN s{2 ** (k - 1)} b ON a.to_id = b.from_id WHERE a.from_id <> b.to_id) GROUP BY 1, 2)" for k in range(1, 6))
    + ", rq AS (SELECT a.n_nationkey AS from_node, b.n_nationkey AS to_node FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey) SELECT from_node, to_node, round(c, 6) AS cost FROM rq LEFT JOIN s32 ON from_id = from_node AND to_id = to_node")
def route_costs(t):
    n = t.raw("nation").select(F.col("n_nationkey").alias("from_node"))
    req = n.join(n.withColumnRenamed("from_node", "to_node"), F.col("from_node") < F.col("to_node"))
    return graphs.route_costs(_edges(t), req, "from_id", "to_id")


@query("largest_component", "z", """e AS (SELECT from_id AS a, to_id AS b FROM z WHERE strength >= (SELECT quantile_disc(strength, 0.97) FROM z)), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS id, a AS m FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.id), c AS (SELECT id, min(m) AS comp FROM r GROUP BY 1) SELECT id FROM c WHERE comp = (SELECT comp FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""", recursive=True)
def largest_component(t):
    z = t.zone_flows
    least = z.select(F.expr("percentile_disc(0.97) WITHIN GROUP (ORDER BY strength)")).first()[0]
    return graphs.largest_component(z.where(F.col("strength") >= least))


@query("network_edges_bidir", "z", "e AS (SELECT from_id AS src, to_id AS dst, strength FROM z WHERE from_id < to_id OR (from_id + to_id) % 3 = 0) SELECT * FROM e UNION ALL SELECT dst, src, strength FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)")
def network_edges_bidir(t):
    return graphs.both_ways(t.zone_flows.where("from_id < to_id OR (from_id + to_id) % 3 = 0").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "strength"))


@query("network_oneway", "z", """e AS (SELECT from_id AS src, to_id AS dst, strength, CASE from_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'T' ELSE 'B' END AS oneway FROM z WHERE from_id < to_id)
 SELECT * FROM e WHERE oneway <> 'T' UNION ALL SELECT dst, src, strength, oneway FROM e WHERE oneway <> 'F'""")
def network_oneway(t):
    way = F.when(F.col("from_id") % 3 == 0, "F").when(F.col("from_id") % 3 == 1, "T").otherwise("B")
    return graphs.apply_oneway(t.zone_flows.where("from_id < to_id").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "strength", way.alias("oneway")), "F", "T")


@query("siblings_top2", "z", "SELECT from_id, to_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY strength DESC, to_id) AS r FROM z) WHERE r <= 2")
def siblings_top2(t):
    return top_rows(t.zone_flows, ["from_id"], "strength", "to_id", 2)


for _c in ("path", "mfpt"):
    query(f"hssm_criterion_{_c}")(lambda t, c=_c: settlement.build_model(t.zone_flows, criterion=c))

for _n, _direct in (("markov_regions", False), ("direct_regions", True)):

    def _regions(t, direct=_direct):
        total = t.units.agg(F.sum("pop")).first()[0]
        return regions.markov_regions(t.zone_flows, t.units.select("id", F.col("pop").alias("mass")), total / 6, direct)

    query(_n)(_regions)
