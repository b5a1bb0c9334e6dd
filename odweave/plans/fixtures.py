"""The domain tables that the registered queries use, derived from the driver's tables, in both engines."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def zone_flows(self) -> DataFrame:
        """Trips from customers' nations to suppliers' nations; lines are pre-aggregated before the dimension joins."""
        lines = self.raw("lineitem").select("l_orderkey", "l_suppkey")
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        flows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        flows = flows.join(self.raw("customer").select("c_custkey", F.col("c_nationkey").alias("from_id")), F.col("o_custkey") == F.col("c_custkey"))
        flows = flows.join(self.raw("supplier").select("s_suppkey", F.col("s_nationkey").alias("to_id")), F.col("l_suppkey") == F.col("s_suppkey"))
        return flows.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("strength"))

    @cached_property
    def large_flows(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", F.col("l_suppkey").alias("to_id"))
        orders = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("from_id"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("strength"))

    @cached_property
    def units(self) -> DataFrame:
        c = self.raw("customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("pop"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
        n = self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") < 10).alias("is_core"))
        return n.join(c, "id", "left").na.fill(0)

    @cached_property
    def anchors(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "view", "k").when(F.col("event_type") == "click", "t").when(F.col("event_type") == "purchase", "m").otherwise("")
        site = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
        e = self.raw("events").select("user_id", site.alias("site_id"), kind.alias("type"), "value")
        return e.groupBy("user_id", "site_id", "type").agg(F.round(F.sum("value"), 2).alias("importance"))

    @cached_property
    def places(self) -> DataFrame:
        i = F.col("n_nationkey")
        return self.raw("nation").select(i.alias("id"), (i % 5).cast("double").alias("x"), F.floor(i / 5).cast("double").alias("y"))

    @cached_property
    def squares(self) -> DataFrame:
        return self.places.select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 1).alias("y1"))

    @cached_property
    def wide_squares(self) -> DataFrame:
        """A coarser zoning: 3 x 3 squares of side 1.75 over the same area."""
        i = F.col("id")
        x, y = (i % 3) * 1.75, F.floor(i / 3) * 1.75
        return self.spark.range(9).select((i + 100).alias("id"), x.alias("x0"), y.cast("double").alias("y0"), (x + 1.75).alias("x1"), (y + 1.75).alias("y1"))

    @cached_property
    def transfer(self) -> DataFrame:
        n = self.raw("nation").select(F.col("n_nationkey").alias("source_id"))
        return n.select("source_id", (F.col("source_id") % 3).alias("target_id"), F.lit(0.75).alias("weight")).union(n.select("source_id", (F.col("source_id") + 1) % 3, F.lit(0.25)))

    @cached_property
    def truth(self) -> DataFrame:
        """Other flows between the same zones, to calibrate and validate against: quantities of lines by zone pair."""
        z = self.zone_flows
        return z.where("(from_id + to_id) % 4 <> 0").select("from_id", "to_id", (F.col("strength") * 2 + (F.col("from_id") * 7 + F.col("to_id") * 3) % 11).alias("strength"))

    @cached_property
    def parents(self) -> DataFrame:
        """A fixed tree over the nations: id -> id // 3, root 0."""
        i = F.col("n_nationkey")
        return self.raw("nation").select(i.alias("id"), F.when(i == 0, None).otherwise(F.floor(i / 3).cast("int")).alias("parent"))

    @cached_property
    def model(self) -> DataFrame:
        """A fixed model over that tree: leaves divisible by 4 are organic, 24 is autonomous."""
        i = F.col("id")
        stage = F.when(i == 24, "A").when((i >= 9) & (i % 4 == 0), "O").otherwise("N")
        return self.parents.select("id", F.when(i == 24, i).otherwise(F.col("parent")).alias("parent"), stage.alias("stage"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in any order compare equal; -0 becomes 0."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return (F.round(c, digits) + F.lit(0.0)).alias(name) if kind in ("double", "float") else c

    return df.select(*[one(n, k) for n, k in df.dtypes])


#: Common table expressions of the oracle, one for each fixture.
CTE = {
    "z": "z AS (SELECT c_nationkey AS from_id, s_nationkey AS to_id, count(*)::BIGINT AS strength FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
    "l": "l AS (SELECT o_custkey AS from_id, l_suppkey AS to_id, count(*)::BIGINT AS strength FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "u": "u AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, n_nationkey < 10 AS is_core, coalesce(pop, 0)::BIGINT AS pop, coalesce(balance, 0) AS balance FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS pop, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey)",
    "a": "a AS (SELECT user_id, regexp_extract(props, '\"k\": (\\d+)', 1)::BIGINT AS site_id, CASE event_type WHEN 'view' THEN 'k' WHEN 'click' THEN 't' WHEN 'purchase' THEN 'm' ELSE '' END AS type, round(sum(value), 2) AS importance FROM events GROUP BY 1, 2, 3)",
    "p": "p AS (SELECT n_nationkey AS id, (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y FROM nation)",
    "sq": "sq AS (SELECT n_nationkey AS id, (n_nationkey % 5)::DOUBLE AS x0, (n_nationkey // 5)::DOUBLE AS y0, (n_nationkey % 5 + 1)::DOUBLE AS x1, (n_nationkey // 5 + 1)::DOUBLE AS y1 FROM nation)",
    "ws": "ws AS (SELECT i + 100 AS id, (i % 3) * 1.75::DOUBLE AS x0, (i // 3) * 1.75::DOUBLE AS y0, (i % 3) * 1.75::DOUBLE + 1.75 AS x1, (i // 3) * 1.75::DOUBLE + 1.75 AS y1 FROM range(9) r(i))",
    "t": "t AS (SELECT n_nationkey AS source_id, n_nationkey % 3 AS target_id, 0.75::DOUBLE AS weight FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 3, 0.25::DOUBLE FROM nation)",
    "truth": "truth AS (SELECT from_id, to_id, strength * 2 + (from_id * 7 + to_id * 3) % 11 AS strength FROM z WHERE (from_id + to_id) % 4 <> 0)",
    "par": "par AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey // 3 END AS parent FROM nation)",
    "model": "model AS (SELECT id, CASE WHEN id = 24 THEN id ELSE parent END AS parent, CASE WHEN id = 24 THEN 'A' WHEN id >= 9 AND id % 4 = 0 THEN 'O' ELSE 'N' END AS stage FROM par)",
}


def draw(seed: int, *cols: str) -> str:
    """The uniform draw of the operators, for the oracle."""
    text = " || ':' || ".join([*(f"CAST({c} AS VARCHAR)" for c in cols), f"'{seed}'"])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def noise(epsilon: float, seed: int, *cols: str) -> str:
    one, two = (f"floor(ln({draw(s, *cols)}) / {-epsilon}::DOUBLE)" for s in (2 * seed, 2 * seed + 1))
    return f"({one} - {two})"


_NEEDS = {"truth": ("z",), "model": ("par",)}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    wanted: list[str] = []
    for n in names.split():
        for m in (*_NEEDS.get(n, ()), n):
            if m not in wanted:
                wanted.append(m)
    own = ", ".join(CTE[n] for n in wanted)
    body = body.strip()
    glue = ", " if not body.upper().startswith("SELECT") and own else " "
    return f"WITH {'RECURSIVE ' if recursive else ''}{own}{glue}{body}" if own else f"WITH {'RECURSIVE ' if recursive else ''}{body}" if recursive else body
