"""Queries over the plain building blocks: sets of rows, default columns, text and array helpers, projections, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.functions import columns
from odweave.plans.fixtures import Tables, rounded, with_ctes
from odweave.sources import tables as sources

QUERIES, SQL = {}, {}


def query(name: str, ctes: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            SQL[name] = with_ctes(ctes, sql)
        return f

    return add


@query("unit_id_union", "z l", "SELECT id FROM (SELECT from_id AS id FROM z UNION SELECT to_id FROM z UNION SELECT to_id FROM l) ORDER BY id")
def unit_id_union(t):
    return columns.id_union(t.zone_flows.select("from_id"), t.zone_flows.select("to_id"), t.large_flows.select("to_id"))


@query("flows_stacked", "z l", "SELECT from_id, to_id, strength, 'zones' AS level FROM z UNION ALL SELECT from_id, to_id, strength, 'points' FROM l")
def flows_stacked(t):
    return columns.stacked({"zones": t.zone_flows, "points": t.large_flows}, "level")


@query("strongest_flows_preview", "l", "SELECT from_id, to_id, strength FROM l ORDER BY strength DESC, from_id, to_id LIMIT 20")
def strongest_flows_preview(t):
    return t.large_flows.orderBy(F.desc("strength"), "from_id", "to_id").limit(20)


@query("default_columns", "", "SELECT p_partkey, p_size::DOUBLE AS magnitude, 1.5::DOUBLE AS halfrange FROM part")
def default_columns(t):
    part = t.raw("part")
    return part.select("p_partkey", columns.or_default(part, "p_size", 1.0).cast("double").alias("magnitude"), columns.or_default(part, "no_such_column", 1.5).alias("halfrange"))


@query("web_mercator_places", "p", "SELECT id, round(radians(x * 30 - 60) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(y * 15 - 30) / 2)) * 6378137.0, 3) + 0.0 AS y FROM p")
def web_mercator_places(t):
    x, y = sources.web_mercator(F.col("x") * 30 - 60, F.col("y") * 15 - 30)
    return rounded(t.places.select("id", x.alias("x"), y.alias("y")), 3)


@query("json_settings", "", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.no.such') AS missing FROM events""")
def json_settings(t):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.no.such").alias("missing"))


@query("joined_names", "", """SELECT p_partkey, concat_ws('_', trim(lower(p_brand)), trim(lower(p_type))) AS name, starts_with(p_type, 'ECO') AS economy, regexp_full_match(p_brand, 'Brand#[1-4]') AS low_brand FROM part""")
def joined_names(t):
    name = F.concat_ws("_", F.trim(F.lower("p_brand")), F.trim(F.lower("p_type")))
    return t.raw("part").select("p_partkey", name.alias("name"), F.startswith("p_type", F.lit("ECO")).alias("economy"), F.col("p_brand").rlike("^Brand#[1-4]$").alias("low_brand"))


@query("array_profiles", "", """WITH h AS (SELECT user_id, extract('hour' FROM ts)::INT AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
 g AS (SELECT u.user_id, i, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(24) r(i) LEFT JOIN h ON h.user_id = u.user_id AND h.h = i),
 c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS upto, sum(n) OVER (PARTITION BY user_id) AS al FROM g)
 SELECT user_id, arg_min(i, (-n, i))::INT AS busiest, min(i) FILTER (WHERE 2 * upto >= al)::INT AS median_hour, sum(n * i) AS moment, any_value((SELECT k.n FROM g k WHERE k.user_id = c.user_id AND k.i = 21)) AS first_rolled FROM c GROUP BY 1""")
def array_profiles(t):
    hours = t.raw("events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = hours.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    profile = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    rows = counts.select("user_id", profile.alias("p")).withColumn("upto", columns.running_sum(F.col("p")))
    half = F.element_at("upto", -1) / 2
    return rows.select(
        "user_id",
        columns.argmax(F.col("p")).alias("busiest"),
        columns.search_sorted(F.col("upto"), half).alias("median_hour"),
        columns.dot(F.col("p"), F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: i.cast("double"))).alias("moment"),
        F.element_at(columns.rolled(F.col("p"), 3), 1).alias("first_rolled"),
    )
