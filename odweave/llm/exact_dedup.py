"""Operator 1, exact dedup: counting quotient filters per partition, merged by range, then byte verification.

Texts are equal when identical after lower-casing A-Z only. The plan:

1. One pass over the texts gives light rows (id, 64-bit fingerprint, SHA-256) in the shared folder.
2. Every partition builds a counting quotient filter of its fingerprints, which already adds up a hot text's
   copies, and sends one slice of it to each range of quotients. A range merges its slices by sorted remainders.
   Fingerprints with a count above one remain.
3. Texts of those fingerprints alone are grouped byte by byte (partial aggregation on the map side folds a hot
   group to one row a task), which gives each group's kept id and size.
4. The light rows take their group's values by digest; AQE splits the partition of a hot digest.

Defined cases: a NULL text counts as empty and empty texts equal each other; a NULL id never wins against another
id, and a group of NULL ids alone keeps all its rows; rows that repeat the kept id are all kept (``kept_rows``
then keeps one of them). Extra columns never meet names of this module: only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.llm.quotient import CountingQuotientFilter
from odweave.llm.text import clean, slices, small_batches, trimmed
from odweave.operators.iterate import shared_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Quotient bits of the filters; more only makes the bit vectors longer.
QUOTIENT_BITS = 16
#: Fingerprints (8 bytes each) that one range is to merge.
RANGE_ROWS = 4_000_000
#: Repeated fingerprints up to this number (8 bytes each) are broadcast; beyond it they join by a shuffle.
BROADCAST_ROWS = 500_000


def _fingerprints(texts: pa.Array) -> np.ndarray:
    folded = pc.ascii_lower(clean(texts)).to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in folded), np.uint64, len(folded)).view(np.int64)


def _sha256(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def light_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, sha)`` of each row: fingerprint and SHA-256 of the folded text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                folded = [t.encode() for t in pc.ascii_lower(clean(part.column(1))).to_pylist()]
                fp = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in folded), np.uint64, len(folded))
                sha = [hashlib.sha256(t).hexdigest() for t in folded]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fp.view(np.int64)), pa.array(sha, pa.string())], ["id", "fp", "sha"]
                )

    small_batches(df)
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(kernel, f"id {read.schema['id'].dataType.simpleString()}, fp long, sha string")


def ranges_for(rows: int) -> int:
    """Ranges of fingerprints that leave each about RANGE_ROWS of them."""
    return max(8, -(-rows // RANGE_ROWS))


def repeated_fingerprints(rows: DataFrame, ranges: int, hashed: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Fingerprints (column ``fp``) that occur more than once, through merged counting quotient filters. With ``hashed``
    they are what it makes of the rows' batches, in the worker that builds the filter."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        for batch in hashed(batches) if hashed else batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
        every = np.sort(np.concatenate(held))
        # Quotient ranges are contiguous, so a slice of the sorted fingerprints is the filter of its range.
        owner = ((every >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(ranges + 1, dtype=np.uint64))
        full = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
        blobs = [CountingQuotientFilter.of(every[cuts[i] : cuts[i + 1]], QUOTIENT_BITS).to_bytes() for i in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["rng", "cqf"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = CountingQuotientFilter.merge(CountingQuotientFilter.from_bytes(b) for b in pdf["cqf"])
        return pd.DataFrame({"fp": merged.repeated().view(np.int64)})

    built = rows.mapInArrow(trimmed(build), "rng int, cqf binary") if hashed else rows.select("fp").mapInArrow(build, "rng int, cqf binary")
    return built.groupBy("rng").applyInPandas(merge, "fp long")


def duplicate_groups(df: DataFrame, light: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text that several rows share: ``(sha, keep_id, group_size)``, compared byte by byte."""
    dup = shared_table(repeated_fingerprints(light, ranges_for(light.count())), "fingerprints")

    fingerprint = F.arrow_udf(lambda t: pa.array(_fingerprints(t)), "long")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", fingerprint("text"))
    side = F.broadcast(dup) if dup.count() <= BROADCAST_ROWS else dup
    candidates = rows.join(side, "fp").select("id", F.translate("text", UPPER, LOWER).alias("text"))
    groups = candidates.groupBy("text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1")
    return groups.select(_sha256(F.col("text")).alias("sha"), "keep_id", "group_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row, dropped ones too."""
    light = shared_table(light_rows(df, id_col, text_col), "light")
    groups = duplicate_groups(df, light, id_col, text_col)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return light.join(groups, "sha", "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, exactly one for each text, with all their columns."""
    light = shared_table(light_rows(df, id_col, text_col), "light")
    groups = shared_table(duplicate_groups(df, light, id_col, text_col).select("sha", "keep_id"), "groups")
    small = groups.count() <= BROADCAST_ROWS
    side = F.broadcast(groups) if small else groups
    # The row travels in a struct, so that no name of the input can clash with one of this plan.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.withColumn("sha", _sha256(F.col(f"row.`{text_col}`")))
    found = rows.join(side.withColumn("hit", F.lit(True)), "sha", "left")
    wins = F.col(f"row.`{id_col}`").eqNullSafe(F.col("keep_id"))
    # Only where a group's kept id stands in several rows (repeated rows, or NULL ids alone) one of them is picked.
    winners = light.join(side, "sha").where(F.col("id").eqNullSafe(F.col("keep_id")))
    several = shared_table(winners.groupBy("sha").count().where("count > 1").select("sha"), "several")
    if several.isEmpty():
        return found.where(F.col("hit").isNull() | wins).select("row.*")
    found = found.join(several.withColumn("again", F.lit(True)), "sha", "left")
    one = found.where(F.col("again") & wins).dropDuplicates(["sha"])
    return found.where(F.col("again").isNull() & (F.col("hit").isNull() | wins)).unionByName(one).select("row.*")
