"""Column helpers shared by the operators: null-safe arithmetic, tie-breaks, shares, distance decay, naming."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``; NULL where the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def nan_to_null(c: str | Column) -> Column:
    return F.when(F.isnan(col(c)), None).otherwise(col(c))


def share(value: str | Column, *keys: str) -> Column:
    """A value's share of its group's sum (one window, no join back)."""
    return ratio(col(value), F.sum(col(value)).over(Window.partitionBy(*keys)))


def top_rows(df: DataFrame, keys: list[str], value: str | Column, tie: str, n: int = 1) -> DataFrame:
    """The ``n`` rows of largest value of each group; smaller ``tie`` first; NULL values last.

    Catalyst turns the filter into a group limit below the shuffle, so hot groups are cut on the map side.
    """
    order = Window.partitionBy(*keys).orderBy(col(value).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def prefixed(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return df.toDF(*[f"{prefix}{c}{suffix}" for c in df.columns])


def or_default(df: DataFrame, name: str | None, default) -> Column:
    """The column if the table has it, else the default as a literal."""
    return F.col(name) if name and name in df.columns else F.lit(default)


def select_in(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose every named attribute is in its list; NULL is in no list."""
    for name, values in wanted.items():
        df = df.where(F.col(name).isin(values))
    return df


def repair_defaults(df: DataFrame, target: str, default, sources: dict[str, dict]) -> DataFrame:
    """Where ``target`` has its default value, take it from other attributes' lookups; later sources win."""
    found = F.col(target)
    for name, lookup in sources.items():
        for value, replacement in lookup.items():
            found = F.when((F.col(target) == default) & (F.col(name) == value), F.lit(replacement)).otherwise(found)
    return df.withColumn(target, found)


def lookup(name: str, mapping: dict, default=None) -> Column:
    """A nested mapping as a chain of conditions; inner dicts are ``{column: {value: ...}}``."""

    def build(m) -> Column:
        if not isinstance(m, dict):
            return F.lit(m)
        (column, options), *_ = m.items()
        out = F.lit(default)
        for value, below in options.items():
            out = F.when(F.col(column) == value, build(below)).otherwise(out)
        return out

    return build({name: mapping})


def select_range(df: DataFrame, value: str, low=None, high=None) -> DataFrame:
    if low is not None:
        df = df.where(F.col(value) >= low)
    return df if high is None else df.where(F.col(value) <= high)


def common_name_part(one: str, two: str) -> str:
    """Longest common part of two column names, without separators at its ends."""
    m = SequenceMatcher(None, one, two).find_longest_match()
    return one[m.a : m.a + m.size].strip("_- ")


def literal_of(text: str):
    """A command line value as int, float, bool or text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def like_input(output: Column, kind: str) -> Column:
    """Half-even rounding back to an integer type; other types pass."""
    return F.bround(output, 0).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint") else output.cast(kind)


def nice_number(low: float, high: float) -> float:
    """The roundest number between two bounds, both included."""
    if low > high:
        low, high = high, low
    if low == high:
        return low
    for digits in range(-int(math.floor(math.log10(max(abs(low), abs(high), 1e-300)))), 18):
        scale = 10.0**digits
        for step in (1.0, 0.5):
            n = math.ceil(low * scale / step - 1e-12) * step / scale
            if low <= n <= high:
                return round(n, max(digits + 1, 0))
    return (low + high) / 2


# Distance decay. Halving at ``half``: gaussian and cauchy are 1/2 there, linear reaches 0 at twice that.
def gaussian_decay(d: Column, half: Column) -> Column:
    return F.pow(F.lit(2.0), -(d / half) * (d / half))


def cauchy_decay(d: Column, half: Column) -> Column:
    return half * half / (half * half + d * d)


def linear_decay(d: Column, half: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / (2 * half))


DECAYS = {"gaussian": gaussian_decay, "cauchy": cauchy_decay, "linear": linear_decay}
#: Distance at which a decay falls to y.
INVERSES = {
    "gaussian": lambda y, half: half * F.sqrt(-F.log2(y)),
    "cauchy": lambda y, half: half * F.sqrt(1 / y - 1),
    "linear": lambda y, half: 2 * half * (1 - y),
}


def lagged_decay(method: str, d: Column, half: Column, full: Column) -> Column:
    """Full strength up to ``full``, then decay of the distance beyond it with the half range beyond it."""
    return F.when(d <= full, 1.0).otherwise(DECAYS[method](F.greatest(d - full, F.lit(0.0)), half - full))


def bessel_i0(x: Column, terms: int = 40) -> Column:
    """Modified Bessel function of order 0 by its power series."""
    total, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, terms):
        term = term * (x / 2) * (x / 2) / (k * k)
        total = total + term
    return total


def bessel_i1(x: Column, terms: int = 40) -> Column:
    total, term = x / 2, x / 2
    for k in range(1, terms):
        term = term * (x / 2) * (x / 2) / (k * (k + 1))
        total = total + term
    return total


def bessel_ratio(x: Column) -> Column:
    """I1 / I0, the mean resultant length of a von Mises distribution."""
    return bessel_i1(x) / bessel_i0(x)


# ---- sets of rows ----
def id_union(*tables: DataFrame, name: str = "id") -> DataFrame:
    """The distinct ids of one-column tables, sorted; NULL is no id."""
    out = None
    for t in tables:
        one = t.toDF(name)
        out = one if out is None else out.union(one)
    return out.where(F.col(name).isNotNull()).distinct().orderBy(name)


def stacked(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """All rows of the tables, by column name, with the name of their table; a column that a table lacks is NULL."""
    out = None
    for name, t in tables.items():
        one = t.withColumn(key, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


# ---- arrays ----
def rolled(values: Column, n: int) -> Column:
    """The last ``n`` elements come first."""
    size = F.size(values)
    return F.concat(F.slice(values, size - n + 1, F.lit(n)), F.slice(values, F.lit(1), size - n))


def argmax(values: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def running_sum(values: Column) -> Column:
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))


def search_sorted(values: Column, value: Column) -> Column:
    """Place of the first element that is not below ``value``, from 0; the length if there is none."""
    return F.size(F.filter(values, lambda v: v < value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
