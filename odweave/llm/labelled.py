"""Bounded samples of labelled rows for the classifiers, and the rows that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``. A NULL id is hashed as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_texts(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, y, text)`` of about ``rows`` labelled rows outside the held-out fold, all of them if there are fewer.

    The sample is drawn by a hash of the id from the labels alone, so the join's small side has a bound and one
    pass over the documents finds its texts. Rows with a NULL id or label are no examples.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    own = own.where(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.max("y").alias("y"))
    there = max(1, own.count())
    own = own.where(F.pmod(F.xxhash64("id"), F.lit(there)) < rows)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(own), "id").select("id", "y", "text")
