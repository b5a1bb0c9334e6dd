"""Calibration to known totals, proportional fitting, regressions through sums, and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.functions.columns import ratio
from odweave.operators.iterate import drop_shared, shared_table
from odweave.operators.windows import value_counts


def by_source(flows: DataFrame, truth: DataFrame, field: str, self_flows: bool = False) -> DataFrame:
    """Scale each row so that its source's sum meets the truth's; sources without truth stay.

    With ``self_flows`` the key is (source, is self flow). ``truth`` has ``from_id, to_id`` and the field, or only
    ``from_id`` and the field. The sums fold before their shuffle to one factor a source, which joins the flows, so a
    large source's flows never have to meet.
    """
    keys = ["from_id", "is_self"] if self_flows else ["from_id"]
    rows = flows.withColumn("is_self", F.col("from_id") == F.col("to_id"))
    if self_flows and "is_self" not in truth.columns:
        truth = truth.withColumn("is_self", F.col("from_id") == F.col("to_id"))
    target = truth.groupBy(*keys).agg(F.sum(field).alias("_t"))
    factors = rows.groupBy(*keys).agg(F.sum(field).alias("_v")).join(target, keys).select(*keys, ratio("_t", "_v").alias("_f"))
    return rows.join(factors, keys, "left").withColumn(field, F.col(field) * F.coalesce("_f", F.lit(1.0))).select(*flows.columns)


def fit_margins(cells: DataFrame, rows: DataFrame, cols: DataFrame, sweeps: int | None = None, tol: float = 1e-9, limit: int = 100) -> DataFrame:
    """Iterative proportional fitting of sparse cells ``(from_id, to_id, value)`` to ``rows (from_id, total)`` and
    ``cols (to_id, total)``; a closing sweep fits the rows. Missing margins are 0, zero sums divide by 1, cells with a
    NULL id fall out.

    The fitted cell is its value times a factor of its row and one of its column. A half sweep is one aggregation of
    the cells, times the other side's factors, so only factors (one a unit) are made again and again. With ``sweeps``
    the plan is unrolled and lazy; otherwise the factors of each sweep are written to the shared folder, and the loop
    ends when cells stop moving.
    """
    cells = cells.select("from_id", "to_id", F.col("value").cast("double").alias("value")).where("from_id IS NOT NULL AND to_id IS NOT NULL")
    margins = {"from_id": rows, "to_id": cols}

    def factors(key: str, other: str, fitted: DataFrame | None) -> DataFrame:
        """``(key, f)`` from the factors of the other side."""
        own = cells if fitted is None else cells.join(fitted, other).withColumn("value", F.col("value") * F.col("f"))
        sums = own.groupBy(key).agg(F.sum("value").alias("_s")).join(margins[key].select(key, F.col("total").cast("double").alias("_t")), key, "left")
        return sums.select(key, (F.coalesce("_t", F.lit(0.0)) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).alias("f"))

    def fitted(by_row: DataFrame, by_col: DataFrame) -> DataFrame:
        both = cells.join(by_row.withColumnRenamed("f", "_a"), "from_id").join(by_col.withColumnRenamed("f", "_b"), "to_id")
        return both.select("from_id", "to_id", (F.col("value") * F.col("_a") * F.col("_b")).alias("value"))

    by_col = None
    if sweeps is not None:
        for _ in range(sweeps):
            by_col = factors("to_id", "from_id", factors("from_id", "to_id", by_col))
    else:
        last = None
        for _ in range(limit):
            by_row = shared_table(factors("from_id", "to_id", by_col), "ipf")
            by_col = shared_table(factors("to_id", "from_id", by_row), "ipf")
            new = fitted(by_row, by_col)
            old = cells.select("from_id", "to_id", F.col("value").alias("old")) if last is None else fitted(*last).withColumnRenamed("value", "old")
            moved = new.join(old, ["from_id", "to_id"]).agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0]
            if last is not None:
                drop_shared(*last)
            last = by_row, by_col
            if (moved or 0.0) <= tol:
                break
    closing = factors("from_id", "to_id", by_col)
    return fitted(closing, by_col) if by_col is not None else cells.join(closing, "from_id").select("from_id", "to_id", (F.col("value") * F.col("f")).alias("value"))


def by_margins(flows: DataFrame, truth: DataFrame, field: str, sweeps: int | None = None) -> DataFrame:
    """Fit the flows to the truth's sums by source and by target; only existing pairs can be other than 0."""
    rows = truth.groupBy("from_id").agg(F.sum(field).alias("total"))
    cols = truth.groupBy("to_id").agg(F.sum(field).alias("total"))
    out = fit_margins(flows.select("from_id", "to_id", F.col(field).alias("value")), rows, cols, sweeps, limit=250)
    return out.where("value <> 0").withColumnRenamed("value", field)


# Models of y by x. Each returns one row of coefficients from sums alone.
def sum_matching(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(ratio(F.sum(y), F.sum(x)).alias("slope"), F.lit(0.0).alias("intercept"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares through the origin."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(ratio(F.sum(xd * yd), F.sum(xd * xd)).alias("slope"), F.lit(0.0).alias("intercept"))


def log_ols(df: DataFrame, x: str, y: str, bound: float = 0.1) -> DataFrame:
    """Least squares of log10 y by log10 x on rows where both exceed the bound."""
    rows = df.where((F.col(x) > bound) & (F.col(y) > bound)).select(F.log10(F.col(x).cast("double")).alias("lx"), F.log10(F.col(y).cast("double")).alias("ly"))
    return rows.agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"))


def lad(df: DataFrame, x: str, y: str, tol: float = 1e-9, floor: float = 1e-3, intercept: bool = False, limit: int = 1000) -> tuple[float, float]:
    """Least absolute deviations by reweighted least squares: a loop of global sums, with two scalars on the driver.

    It ends when the relative error stops moving; if that takes more than ``limit`` rounds, it is an error."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    total = rows.agg(F.sum("y")).first()[0] or 1.0
    slope, base, last = 0.0, 0.0, None
    for i in range(limit):
        r = F.abs(F.col("y") - slope * F.col("x") - base)
        w = F.lit(1.0) if i == 0 else 1 / F.greatest(r, F.lit(floor))
        s = rows.withColumn("r", r).withColumn("w", w).agg(F.sum("w"), F.sum(F.expr("w*x")), F.sum(F.expr("w*y")), F.sum(F.expr("w*x*y")), F.sum(F.expr("w*x*x")), F.sum("r")).first()
        if s[0] is None:
            return 0.0, 0.0
        if i and last is not None and abs(last - s[5] / total) < tol:
            return slope, base
        last = s[5] / total if i else None
        if intercept:
            den = s[0] * s[4] - s[1] * s[1]
            slope = (s[0] * s[3] - s[1] * s[2]) / den if den else 0.0
            base = (s[2] - slope * s[1]) / s[0]
        else:
            slope = s[3] / s[4] if s[4] else 0.0
    raise RuntimeError(f"least absolute deviations did not settle in {limit} rounds")


def log_lad(df: DataFrame, x: str, y: str, bound: float = 0.1) -> tuple[float, float]:
    rows = df.where((F.col(x) > bound) & (F.col(y) > bound)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return lad(rows, "lx", "ly", intercept=True)


MODELS = {"sum": sum_matching, "ols": ols, "lad": lad, "logols": log_ols, "loglad": log_lad}


def predict(df: DataFrame, coefs: DataFrame, x: str, out: str, log: bool = False, bound: float = 0.1) -> DataFrame:
    """Add predictions from one row of coefficients, not below 0; log models leave values up to the bound alone."""
    rows = df.join(F.broadcast(coefs))  # one row
    if log:
        value = F.when(F.col(x) <= bound, F.col(x).cast("double")).otherwise(F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * F.log10(F.col(x).cast("double"))))
    else:
        value = F.col("intercept") + F.col("slope") * F.col(x)
    return rows.withColumn(out, F.greatest(F.lit(0.0), value)).drop("slope", "intercept")


def calibrated(df: DataFrame, x: str, y: str, method: str, out: str = "calibrated") -> DataFrame:
    model = MODELS[method]
    if method in ("lad", "loglad"):
        slope, base = model(df, x, y)
        coefs = df.sparkSession.range(1).select(F.lit(slope).alias("slope"), F.lit(base).alias("intercept"))
    else:
        coefs = model(df, x, y)
    return predict(df, coefs, x, out, method.startswith("log"))


def calibrate_all(flows: DataFrame, truth: DataFrame, field: str, methods: tuple[str, ...] = ("source", "dirstat", "ipf")) -> DataFrame:
    """The flows with one more column ``<field>_cal_<method>`` for each method."""
    made = {"source": lambda: by_source(flows, truth, field), "dirstat": lambda: by_source(flows, truth, field, True), "ipf": lambda: by_margins(flows, truth, field)}
    out = flows
    for m in methods:
        one = made[m]().select("from_id", "to_id", F.col(field).alias(f"{field}_cal_{m}"))
        out = out.join(one, ["from_id", "to_id"], "full")
    return out


def describe(df: DataFrame, value: str) -> DataFrame:
    """Minimum, maximum, sum, mean, median and percentiles (linear interpolation between neighbours in rank).

    Percentiles are read off the running counts of distinct values, so no buffer holds all values.
    """
    levels = (0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975)
    names = ("p2_5", "p10", "p25", "median", "p75", "p90", "p97_5")
    counts = value_counts(df, value, descending=False)
    total = counts.agg(F.sum("n")).first()[0] or 0

    def at(rank: int) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (F.col("before") + F.col("n") > rank), F.col("v")))

    def percentile(level: float) -> Column:
        place = level * max(0, total - 1)
        low = int(place)
        return at(low) + (at(min(low + 1, max(0, total - 1))) - at(low)) * (place - low)

    weighted = F.sum(F.col("v") * F.col("n"))
    return counts.agg(F.min("v").alias("min"), F.max("v").alias("max"), weighted.alias("sum"), ratio(weighted, F.sum("n")).alias("mean"), *[percentile(p).alias(n) for p, n in zip(levels, names, strict=True)])


def error_metrics(model: DataFrame, truth: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Mismatch, TAE, RTAE, R2, RMSE, CP and LOGR2 of a model against the truth; a value missing on one side is 0.

    R2 uses sums and squares alone, so the outer join is read once.
    """
    rows = truth.select(*keys, F.col(field).cast("double").alias("t")).join(model.select(*keys, F.col(field).cast("double").alias("m")), keys, "full").na.fill(0.0, ["t", "m"])
    rows = rows.select("t", "m", F.log10(F.col("t") + 1).alias("lt"), F.log10(F.col("m") + 1).alias("lm"))
    n = F.count(F.lit(1))

    def r2(t: str, m: str) -> Column:
        spread = F.sum(F.col(t) * F.col(t)) - F.sum(t) * F.sum(t) / n
        return 1 - ratio(F.sum((F.col(t) - F.col(m)) * (F.col(t) - F.col(m))), spread)

    tae = F.sum(F.abs(F.col("t") - F.col("m")))
    return rows.agg(
        (F.sum("m") - F.sum("t")).alias("diff"),
        tae.alias("tae"),
        ratio(tae, F.sum("t")).alias("rtae"),
        r2("t", "m").alias("r2"),
        F.sqrt(F.avg((F.col("t") - F.col("m")) * (F.col("t") - F.col("m")))).alias("rmse"),
        ratio(2 * F.sum(F.least("t", "m")), F.sum("t") + F.sum("m")).alias("cp"),
        r2("lt", "lm").alias("logr2"),
    )


AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median}


def aggregate_by_name(df: DataFrame, keys: list[str], field: str, how: str) -> DataFrame:
    return df.groupBy(*keys).agg(AGGREGATES[how](field).alias(field))
