"""Operator 6, mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every document is repeated a Poisson number of times whose mean is its source's target rate: target weight times all
documents over the source's documents. The number comes from inverting the distribution at a uniform value that a hash
of the seed and the document id gives, so it does not depend on partitions, order or reruns. Rates above
``RATE_PART`` are the sum of several Poisson parts, each with a hash of its own, so no rate underflows. Copies are
then shuffled globally by a hash of document and copy number.

Counting sources is a partial aggregation; the rates (one row a source) are broadcast up to ``BROADCAST_ROWS`` of
them and join by a shuffle beyond. The shuffle key is spread evenly whatever the sources' sizes.

Defined cases: a NULL source is a source of its own; rows whose id is NULL draw by their content, and rows of equal
content each draw on their own, by number; rows that repeat an id with other content draw alike; a source without a weight (with
``weights``) gets weight 0 and vanishes; weights are normalised to sum 1; an empty table gives no rows; columns of
the input keep their names, and an added column whose name is taken gets ``_`` appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE_PART = 32.0
BROADCAST_ROWS = 200_000
#: Equal rows that are made from their folded one in one go.
PIECE_ROWS = 1_000


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with ``_`` appended while the input has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def uniform(seed: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of a text."""
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def poisson_thresholds(rate: Column) -> Column:
    """The distribution function at 0, 1, .. as far as it can matter in double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def source_rates(documents: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source") -> DataFrame:
    """``(source, parts, cuts)``: each source's number of Poisson parts and the thresholds of one part.

    Without ``weights`` every source gets the same weight.
    """
    counts = documents.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is not None:
        total_weight = float(sum(weights.values())) or 1.0
        listed = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(w / total_weight)) for s, w in weights.items()]
        counts = counts.withColumn("w", F.coalesce(*listed, F.lit(0.0)))
        total = counts.agg(F.sum("n")).first()[0] or 0
        rate = F.col("w") * F.lit(float(total)) / F.col("n")
    else:
        total, sources = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        rate = F.lit(float(total or 0)) / (F.lit(float(sources)) * F.col("n"))
    parts = F.greatest(F.ceil(F.col("rate") / RATE_PART), F.lit(1)).cast("int")
    rated = counts.withColumn("rate", rate).withColumn("parts", parts).withColumn("part", F.col("rate") / F.col("parts"))
    return rated.select("source", "parts", poisson_thresholds(F.col("part")).alias("cuts"))


def _tagged(documents: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """``(row, src, tag)``: every row with the text that its draw hashes: the id, and for rows of equal content a number.

    Only rows whose id is NULL or repeats are compared with others. They fold to one row and a count by a digest of
    their content (on the map side first), and the count is dealt out again in pieces, so many equal rows spread.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(row.alias("row"), F.col(f"`{source_col}`").alias("src"), F.col(f"`{id_col}`").alias("own"))
    text = F.coalesce(F.col("own").cast("string"), F.lit(""))
    shared = rows.groupBy(F.col("own").alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR i IS NULL").select("i")
    several = shared.count()
    if not several:
        return rows.select("row", "src", text.alias("tag"))
    shared = F.broadcast(shared) if several <= BROADCAST_ROWS else shared
    same = F.col("own").eqNullSafe(F.col("i"))
    folded = rows.join(shared, same, "left_semi").withColumn("digest", F.md5(F.to_json("row").cast("binary")))
    folded = folded.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("row", "src", "own")], F.count(F.lit(1)).alias("n"))
    pieces = folded.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE_ROWS).cast("long")))).repartition("digest", "low")
    each = pieces.withColumn("number", F.explode(F.sequence(F.col("low") + 1, F.least(F.col("low") + PIECE_ROWS, F.col("n")))))
    plain = F.col("own").isNotNull() & (F.col("number") == 1)
    each = each.select("row", "src", F.when(plain, text).otherwise(F.concat_ws(":", text, "digest", F.col("number").cast("string"))).alias("tag"))
    return rows.join(shared, same, "left_anti").select("row", "src", text.alias("tag")).union(each)


def mix(
    documents: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """All columns of the documents, each row repeated by its count, with ``copy`` (from 1) and ``n_copies``."""
    copy_name, count_name = free_name(documents, "copy"), free_name(documents, "n_copies")
    rates = source_rates(documents, weights, source_col)
    side = F.broadcast(rates) if rates.count() <= BROADCAST_ROWS else rates
    rows = _tagged(documents, id_col, source_col).join(side, F.col("src").eqNullSafe(F.col("source")))

    def part(i: Column) -> Column:
        u = uniform(F.concat_ws(":", F.lit(seed), i.cast("string"), "tag"))
        return F.size(F.filter("cuts", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, i: acc + part(i))
    rows = rows.select("row", "tag", count.alias("n")).where("n > 0").select("row", "tag", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(f"{seed}:order"), "tag", "k"))
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.select("row.*", F.col("k").alias(copy_name), F.col("n").alias(count_name))
