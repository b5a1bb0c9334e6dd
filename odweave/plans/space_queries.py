"""Queries over time, ranks, privacy, geometry, rasters, antennas and roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.functions import columns
from odweave.operators import antenna, areas, calibrate, privacy, raster, roads, spatial, transfer, windows
from odweave.plans.fixtures import Tables, draw, noise, rounded, with_ctes
from odweave.sources import tables as sources

QUERIES, SQL = {}, {}


def query(name: str, ctes: str = "", sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            SQL[name] = with_ctes(ctes, sql, recursive)
        return f

    return add


_SPEND = "s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)"


def _spend(t):
    return t.raw("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


# ---- ranks ----
@query("zipf_exponent", "", f"""WITH {_SPEND}, r AS (SELECT ln(v) AS y, ln(row_number() OVER (ORDER BY v DESC)) AS x FROM s), k AS (SELECT x, y, y AS w FROM r WHERE y > 0),
 q AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx FROM k) SELECT round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 6) AS slope, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 6) AS intercept FROM q""")
def zipf_exponent(t):
    return windows.zipf_exponent(_spend(t), "v")


@query("zipf_gaps", "", f"""WITH {_SPEND}, r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS rk FROM s),
 g AS (SELECT rk + 2 AS rank, lead(v, 2) OVER (ORDER BY rk) AS value, v / lead(v, 5) OVER (ORDER BY rk) / pow(rk / (rk + 5)::DOUBLE, -0.9) AS gap, lead(v, 5) OVER (ORDER BY rk) AS later FROM r)
 SELECT rank::BIGINT AS rank, value, round(gap, 6) AS gap, round(avg(gap) OVER (ORDER BY rank ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM g WHERE later IS NOT NULL""")
def zipf_gaps(t):
    return windows.zipf_gaps(_spend(t), "v", exponent=-0.9, spread=5)


@query("zipf_threshold_ratings", "", f"""WITH {_SPEND}, r AS (SELECT v AS value, row_number() OVER (ORDER BY v) - 1 AS i, lead(v) OVER (ORDER BY v) AS next_value, count(*) OVER () AS n FROM s)
 SELECT value, next_value, round((next_value - value) / next_value * ln(n - i - 1), 6) AS rating FROM r WHERE next_value IS NOT NULL AND i >= n // 2""")
def zipf_threshold_ratings(t):
    return windows.threshold_ratings(_spend(t), "v")


@query("global_ranks", "", f"WITH {_SPEND} SELECT v, row_number() OVER (ORDER BY v DESC) AS rank FROM s")
def global_ranks(t):
    return windows.global_ranks(_spend(t), "v")


@query("entropy", "u", "g AS (SELECT region, sum(pop)::DOUBLE AS m FROM u GROUP BY 1), p AS (SELECT m / sum(m) OVER () AS p, count(*) OVER () AS n FROM g) SELECT round(-sum(p * ln(p)) / ln(max(n)), 6) AS entropy FROM p")
def entropy(t):
    return windows.entropy(t.units, "region", "pop")


@query("value_range", "", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 100500")
def value_range(t):
    return columns.select_range(t.raw("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100000, 100500)


# ---- time ----
@query("time_weights", "", """SELECT event_id, user_id, round(least((coalesce(t - lag(t) OVER w, 3600) + coalesce(lead(t) OVER w - t, 3600)) / 2, 3600), 6) AS weight
 FROM (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t)""")
def time_weights(t):
    return windows.time_weights(t.raw("events"), ["user_id"], "ts").select("event_id", "user_id", "weight")


_OBS = """e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events), d AS (SELECT user_id, t - floor(t / 86400) * 86400 AS s FROM e)"""
_PROFILE = f"""WITH {_OBS}, g AS (SELECT user_id, floor(s) AS s, count(*)::DOUBLE AS w FROM d GROUP BY 1, 2),
 pr AS (SELECT user_id, b AS bin, sum(w * exp(1 / pow(1800.0 * 2 * pi() / 86400, 2) * (cos((s - (b + 0.5) * 1800) * 2 * pi() / 86400) - 1))) AS d FROM g, range(48) r(b) GROUP BY 1, 2),
 f AS (SELECT user_id, bin, d / nullif(sum(d) OVER (PARTITION BY user_id), 0) AS density FROM pr)"""


@query("day_profile", "", f"{_PROFILE} SELECT user_id, bin::INT AS bin, round(density, 6) AS density FROM f")
def day_profile(t):
    return windows.day_profile(t.raw("events").withColumn("w", F.lit(1.0)), ["user_id"], "ts", "w")


@query("night_index", "", f"{_PROFILE} SELECT user_id, round(sum(density * cos((bin + 0.5) * 2 * pi() / 48)), 6) AS night_index FROM f GROUP BY 1")
def night_index(t):
    return windows.night_index(day_profile(t), ["user_id"])


@query("circular_mean", "", f"WITH {_OBS}, m AS (SELECT user_id, atan2(sum(sin(s * 2 * pi() / 86400)), sum(cos(s * 2 * pi() / 86400))) * 86400 / (2 * pi()) AS m FROM d GROUP BY 1) SELECT user_id, round(m - floor(m / 86400) * 86400, 4) AS mean_second FROM m")
def circular_mean(t):
    return rounded(windows.circular_mean(t.raw("events"), ["user_id"], "ts"), 4)


@query("detect_anchors", "", """WITH o AS (SELECT user_id, regexp_extract(props, '"k": (\\d+)', 1)::BIGINT AS site_id, epoch_us(ts) AS us, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events),
 w AS (SELECT *, t - floor(t / 86400) * 86400 AS s, least((coalesce(t - lag(t) OVER k, 3600) + coalesce(lead(t) OVER k - t, 3600)) / 2, 3600) AS weight FROM o WINDOW k AS (PARTITION BY user_id ORDER BY t)),
 b AS (SELECT user_id, site_id, count(*) AS observations, sum(weight) AS weight, (max(us) - min(us)) / 1000000.0::DOUBLE AS timespan, atan2(sum(sin(s * 2 * pi() / 86400)), sum(cos(s * 2 * pi() / 86400))) * 86400 / (2 * pi()) AS m FROM w GROUP BY 1, 2),
 g AS (SELECT user_id, site_id, floor(s) AS s, sum(weight) AS w FROM w GROUP BY 1, 2, 3),
 pr AS (SELECT user_id, site_id, b AS bin, sum(w * exp(1 / pow(1800.0 * 2 * pi() / 86400, 2) * (cos((s - (b + 0.5) * 1800) * 2 * pi() / 86400) - 1))) AS d FROM g, range(48) r(b) GROUP BY 1, 2, 3),
 n AS (SELECT user_id, site_id, sum(d * cos((bin + 0.5) * 2 * pi() / 48)) / nullif(sum(d), 0) AS night_index FROM pr GROUP BY 1, 2)
 SELECT user_id, site_id, observations, round(weight, 2) AS weight, round(timespan, 6) AS timespan, round(m - floor(m / 86400) * 86400, 3) AS mean_second, round(night_index, 5) AS night_index, night_index > 0 AS is_home FROM b JOIN n USING (user_id, site_id)""")
def detect_anchors(t):
    site = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    found = windows.detect_anchors(t.raw("events").withColumn("site_id", site), "user_id", "site_id", "ts")
    return found.withColumns({c: F.round(c, n) for c, n in (("weight", 2), ("mean_second", 3), ("night_index", 5))})


@query("trajectory_grid", "", """WITH o AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, value AS x, (event_id % 100)::DOUBLE AS y FROM events),
 k AS (SELECT user_id, ceil((t - min(t) OVER (PARTITION BY user_id)) / 3600)::BIGINT AS tick, x, y FROM o), a AS (SELECT user_id, tick, avg(x) AS x, avg(y) AS y FROM k GROUP BY 1, 2),
 g AS (SELECT user_id, unnest(range(0, max(tick) + 1)) AS tick FROM a GROUP BY 1), n AS (SELECT user_id, tick + d AS tick, exp(-pow(d * 3600 / 7200.0, 2) / 2) AS w, x, y FROM a, range(-8, 9) r(d)),
 s AS (SELECT user_id, tick, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y FROM n GROUP BY 1, 2) SELECT user_id, tick, round(x, 6) AS x, round(y, 6) AS y FROM g LEFT JOIN s USING (user_id, tick)""")
def trajectory_grid(t):
    e = t.raw("events").select("user_id", "ts", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    return windows.trajectory(e, ["user_id"], "ts", "x", "y", step=3600, sigma=7200.0)


# ---- privacy ----
@query("gravity_topk", "u p", """m AS (SELECT id, x, y, pop FROM u JOIN p USING (id)), g AS (SELECT a.id AS from_id, b.id AS to_id, a.pop::DOUBLE * b.pop / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS gravity FROM m a JOIN m b ON a.id <> b.id),
 c AS (SELECT *, count(*) OVER (PARTITION BY from_id ORDER BY gravity DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g) SELECT from_id, to_id, round(gravity, 6) AS gravity FROM c WHERE n <= 4""")
def gravity_topk(t):
    units = t.units.join(t.places, "id").withColumnRenamed("pop", "mass")
    return privacy.gravity_candidates(units, units.select(F.col("id").alias("from_id"), F.lit(4).alias("k")))


@query("dp_atomic", "l", f"n AS (SELECT from_id, to_id, greatest(strength + {noise(0.5, 1, 'from_id', 'to_id')}, 0)::BIGINT AS strength FROM l) SELECT * FROM n WHERE strength > 0")
def dp_atomic(t):
    return privacy.atomic(t.large_flows, ["strength"])


@query("dp_gravity", "z u p", f"""f AS (SELECT from_id, to_id, (strength % 4 + 1)::DOUBLE AS v0 FROM z), n AS (SELECT *, v0 + {noise(0.5, 1, 'from_id', 'to_id')} AS v FROM f),
 pe AS (SELECT from_id, count(*) FILTER (WHERE v <= 0) AS lost, count(*) FILTER (WHERE v > 0) AS kept, sum(v0) AS total FROM n GROUP BY 1), m AS (SELECT id, x, y, pop::DOUBLE AS pop FROM u JOIN p USING (id)),
 g AS (SELECT a.id AS from_id, b.id AS to_id, a.pop * b.pop / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS gravity FROM m a JOIN m b ON a.id <> b.id),
 c AS (SELECT *, count(*) OVER (PARTITION BY from_id ORDER BY gravity DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g),
 d AS (SELECT from_id, to_id, lost, {noise(0.5, 101, 'from_id', 'to_id')} AS v FROM c JOIN pe USING (from_id) WHERE lost > 0 AND k <= kept + 3 * lost AND NOT EXISTS (SELECT 1 FROM n WHERE n.from_id = c.from_id AND n.to_id = c.to_id AND n.v > 0)),
 ad AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY {draw(201, 'from_id', 'to_id')}, to_id) AS r FROM d WHERE v > 0) WHERE r <= lost),
 al AS (SELECT from_id, to_id, v FROM n WHERE v > 0 UNION ALL SELECT from_id, to_id, v FROM ad), o AS (SELECT al.from_id, to_id, round_even(v * total / sum(v) OVER (PARTITION BY al.from_id), 0)::BIGINT AS strength FROM al JOIN pe USING (from_id))
 SELECT * FROM o WHERE strength > 0""")
def dp_gravity(t):
    small = t.zone_flows.withColumn("strength", (F.col("strength") % 4 + 1))
    return privacy.gravity(small, t.units.join(t.places, "id").withColumnRenamed("pop", "mass"), "strength")


# ---- geometry ----
def _rings(df):
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return df.select("id", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("ring"))


@query("neighbour_pairs", "sq", "SELECT a.id AS from_id, b.id AS to_id FROM sq a JOIN sq b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def neighbour_pairs(t):
    return spatial.neighbour_pairs(t.squares, 2.0)


@query("rectangle_overlaps", "sq ws", "o AS (SELECT a.id AS a_id, b.id AS b_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h FROM sq a, ws b) SELECT a_id, b_id, w * h AS area FROM o WHERE w >= 0 AND h >= 0")
def rectangle_overlaps(t):
    return spatial.rectangle_pairs(t.squares, t.wide_squares, 2.0)


@query("polygon_overlaps", "sq ws", "o AS (SELECT a.id AS a_id, b.id AS b_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h FROM sq a, ws b) SELECT a_id, b_id, round(w * h, 6) AS area FROM o WHERE w > 0 AND h > 0")
def polygon_overlaps(t):
    return spatial.overlaps(_rings(t.squares), _rings(t.wide_squares), 2.0)


@query("points_in_cells", "sq", "c AS (SELECT c_custkey AS pid, (c_custkey * 37 % 500) / 100.0::DOUBLE + 0.003 AS x, (c_custkey * 91 % 500) / 100.0::DOUBLE + 0.003 AS y FROM customer) SELECT pid, id FROM c JOIN sq ON x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def points_in_cells(t):
    pts = t.raw("customer").select(F.col("c_custkey").alias("pid"), ((F.col("c_custkey") * 37 % 500) / 100 + 0.003).alias("x"), ((F.col("c_custkey") * 91 % 500) / 100 + 0.003).alias("y"))
    return spatial.points_in_polygons(pts, _rings(t.squares), 1.0).select("pid", "id")


@query("nearest_place", "p", """c AS (SELECT c_custkey AS id, (c_custkey * 37 % 997) / 100.0::DOUBLE AS x, (c_custkey * 91 % 997) / 100.0::DOUBLE AS y FROM customer), q AS (SELECT id AS target, x AS tx, y AS ty FROM p),
 d AS (SELECT id, target, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS distance FROM c, q) SELECT id, target, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), target) AS r FROM d) WHERE r = 1""")
def nearest_place(t):
    pts = t.raw("customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37 % 997) / 100).alias("x"), ((F.col("c_custkey") * 91 % 997) / 100).alias("y"))
    return spatial.nearest(pts, t.places, 1.0)


@query("ring_measures", "ws", "SELECT id, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * ((x1 - x0) + (y1 - y0)), 6) AS perimeter, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy FROM ws")
def ring_measures(t):
    r = _rings(t.wide_squares)
    c = spatial.centroid("ring")
    return r.select("id", spatial.area("ring").alias("area"), spatial.perimeter("ring").alias("perimeter"), c["x"].alias("cx"), c["y"].alias("cy"))


@query("dissolve_areas", "sq", "SELECT id % 5 AS col, count(*)::DOUBLE AS area, count(*)::BIGINT AS units FROM sq GROUP BY 1")
def dissolve_areas(t):
    parts = _rings(t.squares).withColumn("col", F.col("id") % 5)
    rings = spatial.dissolve(parts, "col").groupBy("col").agg(F.sum(F.when(F.col("is_hole"), -spatial.area("ring")).otherwise(spatial.area("ring"))).alias("area"))
    return rings.join(parts.groupBy("col").agg(F.count(F.lit(1)).alias("units")), "col")


@query("voronoi_areas", "p", "SELECT id, (CASE WHEN x IN (0, 4) THEN 1.5 ELSE 1 END * CASE WHEN y IN (0, 4) THEN 1.5 ELSE 1 END)::DOUBLE AS area FROM p")
def voronoi_areas(t):
    return spatial.voronoi(t.places).select("id", spatial.area("ring").alias("area"))


@query("voronoi_neighbours", "p", "SELECT a.id AS from_id, b.id AS to_id FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1")
def voronoi_neighbours(t):
    return spatial.voronoi_neighbours(spatial.voronoi(t.places))


@query("delaunay_edges", "p", "SELECT a.id AS from_id, b.id AS to_id FROM p a JOIN p b ON abs(a.x - b.x) + abs(a.y - b.y) = 1")
def delaunay_edges(t):
    return spatial.delaunay_edges(spatial.voronoi(t.places))


@query("weighted_centroids", "u p", "SELECT region, round(coalesce(sum(x * pop) / nullif(sum(pop), 0), avg(x)), 6) AS x, round(coalesce(sum(y * pop) / nullif(sum(pop), 0), avg(y)), 6) AS y FROM u JOIN p USING (id) GROUP BY 1")
def weighted_centroids(t):
    return spatial.weighted_centroids(t.units.join(t.places, "id"), "region", "pop")


@query("point_spread", "u p", "SELECT region, round(avg(x), 6) AS x, round(avg(y), 6) AS y, (max(x) - min(x)) * (max(y) - min(y)) AS spread FROM u JOIN p USING (id) GROUP BY 1")
def point_spread(t):
    return spatial.point_spread(t.units.join(t.places, "id"), "region")


@query("antenna_centroids", "p", "SELECT id AS cell_name, x, y, CASE WHEN id % 4 = 3 THEN 999.0 ELSE id * 30.0 END::DOUBLE AS azim, round(x + CASE WHEN id % 4 = 3 OR id * 30 > 360 THEN 0 ELSE 0.5 * sin(radians(id * 30.0)) END, 6) AS xcent, round(y + CASE WHEN id % 4 = 3 OR id * 30 > 360 THEN 0 ELSE 0.5 * cos(radians(id * 30.0)) END, 6) AS ycent FROM p")
def antenna_centroids(t):
    azim = F.when(F.col("id") % 4 == 3, 999.0).otherwise(F.col("id") * 30.0)
    return spatial.antenna_centroids(t.places.select(F.col("id").alias("cell_name"), "x", "y", azim.alias("azim")), 0.5)


@query("cell_pairs", "sq", """n AS (SELECT a.id AS f, b.id AS g FROM sq a JOIN sq b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1), c AS (SELECT s_suppkey AS cell, s_nationkey AS site FROM supplier)
 SELECT a.cell AS cell_a, b.cell AS cell_b FROM n JOIN c a ON a.site = f JOIN c b ON b.site = g UNION ALL SELECT a.cell, b.cell FROM c a JOIN c b ON a.site = b.site AND a.cell < b.cell""")
def cell_pairs(t):
    return spatial.cell_pairs(neighbour_pairs(t), t.raw("supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("site")))


@query("exclaves", "u p", "d AS (SELECT region, id AS part, pop::DOUBLE AS area, row_number() OVER (PARTITION BY region ORDER BY pop DESC, id) > 1 AS is_exclave FROM u) SELECT * FROM d")
def exclaves(t):
    return spatial.strip_exclaves(t.units.select("region", F.col("id").alias("part"), F.col("pop").cast("double").alias("area")), "region")


@query("exclave_elimination", "z u", """d AS (SELECT region, id AS part, pop::DOUBLE AS area, row_number() OVER (PARTITION BY region ORDER BY pop DESC, id) > 1 AND pop <= 60 AS is_exclave FROM u),
 b AS (SELECT from_id AS part, u.region AS other_key, sum(strength) AS length FROM z JOIN u ON u.id = to_id WHERE from_id <> to_id GROUP BY 1, 2), m AS (SELECT part, other_key FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY length DESC, other_key DESC) AS r FROM b) WHERE r = 1)
 SELECT CASE WHEN is_exclave THEN coalesce(other_key, region) ELSE region END AS region, d.part, area, is_exclave FROM d LEFT JOIN m USING (part)""")
def exclave_elimination(t):
    parts = t.units.select("region", F.col("id").alias("part"), F.col("pop").cast("double").alias("area"))
    borders = t.zone_flows.where("from_id <> to_id").join(t.units.select(F.col("id").alias("to_id"), F.col("region").alias("other_key")), "to_id").groupBy(F.col("from_id").alias("part"), "other_key").agg(F.sum("strength").alias("length"))
    return spatial.eliminate_exclaves(parts, borders, "region", 60)


_HASH = "substr('0123456789bcdefghjkmnpqrstuvwxyz', ({}) + 1, 1)"
_BITS = [f"(({'ix' if k % 2 == 0 else 'iy'} >> {(22 if k % 2 == 0 else 21) - k // 2}) & 1)" for k in range(45)]
_HASHED = " || ".join(_HASH.format(" + ".join(f"{_BITS[5 * c + b]} * {16 >> b}" for b in range(5))) for c in range(9))


@query("geohash", "p", f"g AS (SELECT id, least(floor((x * 30 + 120) / 360 * 8388608), 8388607)::BIGINT AS ix, least(floor((y * 15 + 60) / 180 * 4194304), 4194303)::BIGINT AS iy FROM p) SELECT id, {_HASHED} AS geohash FROM g")
def geohash(t):
    return t.places.select("id", spatial.geohash(F.col("x") * 30 - 60, F.col("y") * 15 - 30).alias("geohash"))


@query("curved_lines", "p", """h AS (SELECT id, x, y, 1 / (2 * tan(radians(30))) AS h FROM p), c AS (SELECT *, x + 1 + h AS cx, y + 0.5 - 2 * h AS cy FROM h), r AS (SELECT *, atan2(y - cy, x - cx) AS a, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM c)
 SELECT id, k::INT AS k, round(cx + r * cos(a - 2 * radians(30) * k / 15), 6) + 0.0 AS x, round(cy + r * sin(a - 2 * radians(30) * k / 15), 6) + 0.0 AS y FROM r, range(16) g(k)""")
def curved_lines(t):
    p = t.places
    arc = spatial.curved_line(F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 1)
    return p.select("id", F.posexplode(arc).alias("k", "q")).select("id", "k", F.col("q.x").alias("x"), F.col("q.y").alias("y"))


@query("equalisation_groups")
def equalisation_groups(t):
    return spatial.equalisation_groups(_rings(t.squares), 5.0)


# ---- rasters, antennas ----
def _sources(t):
    return t.places.select("x", "y", (F.col("id") + 1).cast("double").alias("magnitude"), F.lit(1.5).alias("halfrange"), F.lit(0.5).alias("fullrange"))


_POT = """s AS (SELECT x, y, (id + 1)::DOUBLE AS magnitude FROM p), c AS (SELECT r, k, x, y, magnitude, sqrt(pow((k + 0.5) - (x + 2) / 0.5, 2) + pow((r + 0.5) - (y + 2) / 0.5, 2)) AS d FROM s, range(18) a(r), range(18) b(k)),
 v AS (SELECT r, k, magnitude * CASE WHEN d <= 1 THEN 1 ELSE {f} END AS v FROM c) SELECT (17 - r)::INT AS row, k::INT AS col, round({a}(v), 6) AS value FROM v WHERE v >= 0.01 GROUP BY 1, 2"""


@query("potential_raster", "p", _POT.format(f="pow(2, -pow((d - 1) / 2, 2))", a="sum"))
def potential_raster(t):
    return raster.potential(_sources(t), (-2.0, -2.0, 7.0, 7.0), 0.5)


@query("potential_raster_max", "p", _POT.format(f="greatest(0, 1 - (d - 1) / 4)", a="max"))
def potential_raster_max(t):
    return raster.potential(_sources(t), (-2.0, -2.0, 7.0, 7.0), 0.5, decay="linear", how="max")


@query("raster_points", "p", "SELECT 0.5 + id % 5 AS x, 9.5 - id // 5 AS y, id::DOUBLE AS value FROM p WHERE id <> 7")
def raster_points(t):
    cells = t.places.select(F.floor("y").alias("row"), F.floor("x").alias("col"), F.col("id").cast("double").alias("value"))
    return raster.cells_to_points(cells, raster.World.rect(0.0, 10.0, 1.0), nodata=7.0)


def _antennas(t):
    return t.places.select(F.col("id").alias("antenna"), "x", "y", (F.col("id") / 10 + 0.5).alias("range"), F.lit(1.0).alias("strength"), F.lit(None).cast("double").alias("angle"), F.lit(0.0).alias("kappa"))


_SIG = "an AS (SELECT id AS antenna, x, y, id / 10.0::DOUBLE + 0.5 AS g FROM p), s AS (SELECT p.id AS place, antenna, g / (pi() * (pow(p.x - an.x, 2) + pow(p.y - an.y, 2) + g * g)) / (2 * pi()) AS signal FROM p, an)"


@query("antenna_strength", "p", f"{_SIG} SELECT place, antenna, round(signal, 6) AS signal FROM s")
def antenna_strength(t):
    return antenna.strengths(t.places, _antennas(t))


@query("antenna_connections", "p", f"{_SIG} SELECT place, antenna, round(signal, 6) AS signal FROM (SELECT *, max(signal) OVER (PARTITION BY place) AS m FROM s) WHERE signal >= 0.6 * m")
def antenna_connections(t):
    return antenna.connections(antenna.strengths(t.places, _antennas(t)), 0.6)


@query("antenna_network", "", f"""WITH m AS (SELECT mast, {draw(1, 'mast')} * 5 AS x, {draw(2, 'mast')} * 5 AS y, {draw(3, 'mast')} AS turn, k FROM range(20) g(mast), range(3) h(k))
 SELECT mast * 3 + k AS antenna, round(x, 6) AS x, round(y, 6) AS y, 1.0::DOUBLE AS range, 1.0::DOUBLE AS strength, round((turn + k / 3.0::DOUBLE - floor(turn + k / 3.0::DOUBLE)) * 2 * pi(), 6) AS angle, 1.0::DOUBLE AS kappa FROM m""")
def antenna_network(t):
    return antenna.random_network(t.spark, 20, (0.0, 0.0, 5.0, 5.0))


@query("antenna_moments", "p", f"""{_SIG}, co AS (SELECT * FROM (SELECT *, max(signal) OVER (PARTITION BY place) AS m FROM s) WHERE signal >= 0.5 * m),
 ob AS (SELECT co.antenna, an.x AS mx, an.y AS my, signal AS w, p.x - an.x AS dx, p.y - an.y AS dy, sqrt(pow(p.x - an.x, 2) + pow(p.y - an.y, 2)) AS d FROM co JOIN an USING (antenna) JOIN p ON p.id = place),
 mo AS (SELECT antenna, any_value(mx) AS x, any_value(my) AS y, sum(w * d) / sum(w) AS range, sum(w * coalesce(dx / nullif(d, 0), 0)) / sum(w) AS c, sum(w * coalesce(dy / nullif(d, 0), 0)) / sum(w) AS s FROM ob GROUP BY 1), re AS (SELECT *, sqrt(c * c + s * s) AS r FROM mo)
 SELECT antenna, x, y, round(range, 6) AS range, round(CASE WHEN r < 1e-9 THEN 0 ELSE atan2(s, c) END, 6) AS angle, round(r * (2 - r * r) / greatest(1 - r * r, 1e-9), 6) AS kappa FROM re""")
def antenna_moments(t):
    seen = antenna.connections(antenna.strengths(t.places, _antennas(t)), 0.5)
    a = _antennas(t).select("antenna", F.col("x").alias("mast_x"), F.col("y").alias("mast_y"))
    return antenna.initial_moments(seen.join(a, "antenna").join(t.places.withColumnRenamed("id", "place"), "place").withColumnRenamed("signal", "weight"))


def _adjusted_sql(rounds: int) -> str:
    out = ["se AS (SELECT antenna, count(*)::DOUBLE AS w FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY signal DESC, antenna) AS r FROM s) WHERE r = 1 GROUP BY 1)", "f0 AS (SELECT antenna, 1.0::DOUBLE AS f FROM an)"]
    for k in range(1, rounds + 1):
        out.append(f"e{k} AS (SELECT antenna, sum(q) AS e FROM (SELECT antenna, signal * f / sum(signal * f) OVER (PARTITION BY place) AS q FROM s JOIN f{k - 1} USING (antenna)) GROUP BY 1)")
        out.append(f"t{k} AS (SELECT antenna, e, coalesce(w, 0) AS w FROM e{k} LEFT JOIN se USING (antenna))")
        out.append(f"f{k} AS (SELECT antenna, f * coalesce((w / nullif((SELECT sum(w) FROM t{k}), 0)) / nullif(e / nullif((SELECT sum(e) FROM t{k}), 0), 0), 1) AS f FROM f{k - 1} JOIN t{k} USING (antenna))")
    return ", ".join(out) + f" SELECT antenna, x, y, g AS range, round(f, 6) AS strength, NULL::DOUBLE AS angle, 0.0::DOUBLE AS kappa FROM an JOIN f{rounds} USING (antenna)"


@query("antenna_adjusted", "p", f"{_SIG}, {_adjusted_sql(2)}")
def antenna_adjusted(t):
    seen = antenna.connections(antenna.strengths(t.places, _antennas(t))).groupBy("antenna").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return antenna.adjusted(seen, lambda a: antenna.strengths(t.places, a), _antennas(t), rounds=2)


for _m in ("climb", "genetic"):

    def _fit(t, m=_m):
        seen = antenna.connections(antenna.strengths(t.places, _antennas(t)), 0.5)
        a = _antennas(t).select("antenna", F.col("x").alias("mast_x"), F.col("y").alias("mast_y"))
        return antenna.fit_antennas(seen.join(a, "antenna").join(t.places.withColumnRenamed("id", "place"), "place").withColumnRenamed("signal", "weight"), steps=30, method=m)

    query(f"antenna_fit_{_m}")(_fit)


@query("density_map", "p", "SELECT floor(x / 2)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, count(*) AS n FROM p GROUP BY 1, 2")
def density_map(t):
    return antenna.density(t.places, 2.0)


@query("density_change", "p", "a AS (SELECT floor(x / 2)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, count(*) AS n FROM p GROUP BY 1, 2), b AS (SELECT floor(x / 2)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, count(*) AS n FROM p WHERE id % 3 = 0 GROUP BY 1, 2) SELECT cx, cy, round(sign(coalesce(b.n, 0) - coalesce(a.n, 0)) * sqrt(abs(coalesce(b.n, 0) - coalesce(a.n, 0))), 6) AS delta FROM a FULL JOIN b USING (cx, cy)")
def density_change(t):
    return antenna.density_change(antenna.density(t.places, 2.0), antenna.density(t.places.where("id % 3 = 0"), 2.0))


# ---- attributes, roads ----
@query("attribute_filter", "", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#2', 'Brand#7') AND p_type IN ('ECONOMY', 'STANDARD')")
def attribute_filter(t):
    return columns.select_in(t.raw("part"), {"p_brand": ["Brand#2", "Brand#7"], "p_type": ["ECONOMY", "STANDARD"]}).select("p_partkey", "p_brand", "p_type")


@query("default_repair", "", "SELECT p_partkey, CASE WHEN p_size = 11 AND p_type = 'PROMO' THEN 51 WHEN p_size = 11 AND p_brand = 'Brand#2' THEN 52 ELSE p_size END AS p_size FROM part")
def default_repair(t):
    return columns.repair_defaults(t.raw("part"), "p_size", 11, {"p_brand": {"Brand#2": 52}, "p_type": {"PROMO": 51}}).select("p_partkey", "p_size")


@query("speed_lookup", "", """WITH s AS (SELECT p_partkey, p_retailprice, CASE p_type WHEN 'ECONOMY' THEN (CASE p_brand WHEN 'Brand#2' THEN 90 WHEN 'Brand#7' THEN 70 END) WHEN 'STANDARD' THEN 50 END::DOUBLE AS v, p_size FROM part),
 q AS (SELECT p_partkey, p_retailprice, CASE WHEN p_size <> 0 THEN least(v, p_size::DOUBLE) ELSE v END AS speed FROM s) SELECT p_partkey, CASE WHEN speed IS NULL THEN NULL ELSE speed END AS speed, round(p_retailprice * 3.6 / nullif(speed, 0), 6) AS time FROM q""")
def speed_lookup(t):
    mapping = {"p_type": {"ECONOMY": {"p_brand": {"Brand#2": 90, "Brand#7": 70}}, "STANDARD": 50}}
    out = roads.speeds(t.raw("part"), mapping, "p_size", "p_retailprice")
    return out.select("p_partkey", "speed", "time")


@query("split_lines", "", """SELECT * FROM (VALUES (1, 0, 2.0::DOUBLE), (1, 1, 2.0), (2, 0, 2.0), (2, 1, 2.0), (3, 0, 1.0), (4, 0, 4.0)) v(id, part, length)""")
def split_lines(t):
    rows = [(1, 0, [(0.0, 2.0), (4.0, 2.0)]), (2, 0, [(2.0, 0.0), (2.0, 1.0), (2.0, 4.0)]), (3, 0, [(2.0, 4.0), (2.0, 5.0)]), (4, 1, [(0.0, 1.0), (4.0, 1.0)])]
    lines = t.spark.createDataFrame(rows, "id int, layer int, ring array<struct<x double, y double>>")
    return roads.split_at_crossings(lines, 1.0).select("id", F.col("part").cast("int").alias("part"), spatial.line_length("ring").alias("length"))


@query("point_layer_wkt", "p", "SELECT id, 'POINT (' || x || ' ' || y || ')' AS wkt, x, y FROM p")
def point_layer_wkt(t):
    return sources.point_wkt(sources.points(t.places, "x", "y", drop=True))


@query("wkt_round_trip", "p", "SELECT id, x, y FROM p")
def wkt_round_trip(t):
    pts = sources.wkt_points(point_layer_wkt(t).select("id", "wkt"), "wkt")
    return pts.select("id", F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y"))


@query("decay_functions", "p", "SELECT id, round(pow(2, -pow(id / 4.0, 2)), 6) AS gaussian, round(16.0 / (16 + id * id), 6)::DOUBLE AS cauchy, round(greatest(0, 1 - id / 8.0), 6)::DOUBLE AS linear FROM p")
def decay_functions(t):
    d = F.col("id").cast("double")
    return t.places.select("id", *[f(d, F.lit(4.0)).alias(n) for n, f in columns.DECAYS.items()])


@query("transfer_of_squares", "z sq ws", """o AS (SELECT a.id AS s, b.id AS t, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM sq a, ws b),
 w AS (SELECT s, t, area / sum(area) OVER (PARTITION BY s) AS w FROM o WHERE area > 0) SELECT a.t AS from_id, b.t AS to_id, round(sum(strength * a.w * b.w), 6) AS strength FROM z JOIN w a ON a.s = from_id JOIN w b ON b.s = to_id GROUP BY 1, 2""")
def transfer_of_squares(t):
    pairs = spatial.rectangle_pairs(t.squares, t.wide_squares, 2.0).withColumnsRenamed({"a_id": "source_id", "b_id": "target_id"})
    return transfer.transfer_interactions(t.zone_flows, transfer.table_from_areas(pairs), ["strength"])


# ---- units with areas ----
@query("merge_areas", "u sq", "SELECT coalesce(u.id, a.id) AS id, name, region, is_core, pop, balance, x0, y0, x1, y1 FROM (SELECT * FROM u WHERE id < 20) u FULL JOIN (SELECT * FROM sq WHERE id >= 5) a ON u.id = a.id")
def merge_areas(t):
    return areas.merge_areas(t.units.where("id < 20"), t.squares.where("id >= 5").withColumn("name", F.lit("x")))


@query("aggregate_units", "u", """k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY pop DESC, id) = 1 AS l FROM u) SELECT region, sum(pop)::BIGINT AS pop, (sum(pop) FILTER (WHERE is_core))::BIGINT AS pop_core,
 coalesce(sum(pop) FILTER (WHERE NOT is_core), 0)::BIGINT AS pop_hinterland, (sum(pop) FILTER (WHERE l))::BIGINT AS pop_largest, count(*) AS unit_count FROM k GROUP BY 1""")
def aggregate_units(t):
    return areas.aggregate_units(t.units, ["pop"], "pop")


@query("dissolve_regions", "u", "SELECT region, count(*)::DOUBLE AS area, sum(pop)::BIGINT AS pop FROM u GROUP BY 1")
def dissolve_regions(t):
    rows = areas.dissolve_units(t.units, _rings(t.squares), ["pop"], "pop")
    signed = F.when(F.col("is_hole"), -spatial.area("ring")).otherwise(spatial.area("ring"))
    return rows.groupBy("region").agg(F.sum(signed).alias("area"), F.max("pop").alias("pop"))


@query("representative_points", "ws", "SELECT id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM ws")
def representative_points(t):
    p = areas.representative_point("ring")
    return _rings(t.wide_squares).select("id", p["x"].alias("x"), p["y"].alias("y"))


@query("within_extent", "p", "SELECT id, x, y FROM p WHERE x > 0.5 AND x < 3.5 AND y > 0.5 AND y < 2.5")
def within_extent(t):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    extent = t.spark.range(1).select(F.array(corner(0.5, 0.5), corner(3.5, 0.5), corner(3.5, 2.5), corner(0.5, 2.5)).alias("ring"))
    return areas.within_extent(t.places, extent)


@query("random_places_within", "", f"WITH r AS (SELECT id, {draw(1, 'id')} * 4 AS x, {draw(2, 'id')} * 4 AS y FROM range(250) g(id)) SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM r WHERE x + y < 4 ORDER BY id LIMIT 50")
def random_places_within(t):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    extent = t.spark.range(1).select(F.array(corner(0.0, 0.0), corner(4.0, 0.0), corner(0.0, 4.0)).alias("ring"))
    return areas.places_within(t.spark, extent, 50, (0.0, 0.0, 4.0, 4.0))


@query("urban_layer", "sq", "SELECT id % 5 AS layer, count(*)::DOUBLE AS area FROM sq WHERE id % 5 < 3 OR id < 10 GROUP BY 1 HAVING count(*) > 2")
def urban_layer(t):
    rows = _rings(t.squares).where("id % 5 < 3 OR id < 10").withColumn("layer", F.col("id") % 5)
    return areas.urban_layer(rows, 2.0).select("layer", "area")


@query("snap_corners", "sq", "SELECT id, 1.0::DOUBLE AS area FROM sq")
def snap_corners(t):
    noise = lambda p: F.struct((p["x"] + F.col("id") * 1e-4).alias("x"), p["y"].alias("y"))
    moved = _rings(t.squares).withColumn("ring", F.transform("ring", noise))
    return areas.snap_corners(moved, 0.2).select("id", F.round(spatial.area("ring"), 1).alias("area"))


@query("succession_areas", "par", "up(id, ancestor) AS (SELECT id, id FROM par UNION ALL SELECT up.id, p2.parent FROM up JOIN par p2 ON p2.id = up.ancestor WHERE p2.parent IS NOT NULL) SELECT ancestor AS region, count(*)::DOUBLE AS area FROM up GROUP BY 1", recursive=True)
def succession_areas(t):
    from odweave.operators import graphs

    pairs = graphs.ancestors(t.parents).select("id", F.col("ancestor").alias("region"))
    rows = areas.succession_areas(pairs, _rings(t.squares))
    signed = F.when(F.col("is_hole"), -spatial.area("ring")).otherwise(spatial.area("ring"))
    return rows.groupBy("region").agg(F.sum(signed).alias("area"))


@query("observation_weights", "p", "SELECT id, round(CASE WHEN x IN (0, 4) THEN 1.5 ELSE 1 END * CASE WHEN y IN (0, 4) THEN 1.5 ELSE 1 END / 36.0, 6)::DOUBLE AS weight FROM p")
def observation_weights(t):
    return areas.observation_weights(t.places)


@query("clustered_weights", "p", f"""b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p), c AS (SELECT x0 + {draw(1, 'id')} * (x1 - x0) AS cx, y0 + {draw(2, 'id')} * (y1 - y0) AS cy FROM range(3) g(id), b)
 SELECT id, round(sum(exp(-(pow(x - cx, 2) + pow(y - cy, 2)) / 2)), 6) AS weight FROM p, c GROUP BY 1""")
def clustered_weights(t):
    return areas.clustered_weights(t.places, 3, 1.0)


@query("shared_borders", "sq", "SELECT a.id AS from_id, b.id AS to_id, 1.0::DOUBLE AS length FROM sq a JOIN sq b ON a.id < b.id AND abs(a.x0 - b.x0) + abs(a.y0 - b.y0) = 1")
def shared_borders(t):
    return areas.shared_border_lengths(_rings(t.squares))


@query("models_with_places", "p par", "SELECT id, parent, x, y FROM par FULL JOIN p USING (id)")
def models_with_places(t):
    return areas.with_places(t.parents, t.places)


@query("source_calibration_report", "z truth", """v AS (SELECT from_id, sum(strength) AS v FROM z GROUP BY 1), c AS (SELECT from_id, sum(strength) AS c FROM truth GROUP BY 1),
 k AS (SELECT from_id, to_id, strength * coalesce(c / nullif(v, 0)::DOUBLE, 1) AS m FROM z JOIN v USING (from_id) LEFT JOIN c USING (from_id)),
 j AS (SELECT coalesce(a.strength, 0)::DOUBLE AS t, coalesce(m, 0) AS m FROM truth a FULL JOIN k ON a.from_id = k.from_id AND a.to_id = k.to_id) SELECT round(sum(abs(t - m)), 4) AS tae, round(2 * sum(least(t, m)) / (sum(t) + sum(m)), 6) AS cp FROM j""")
def source_calibration_report(t):
    model = calibrate.by_source(t.zone_flows, t.truth, "strength")
    return calibrate.error_metrics(model, t.truth, ["from_id", "to_id"], "strength").select(F.round("tae", 4).alias("tae"), "cp")
