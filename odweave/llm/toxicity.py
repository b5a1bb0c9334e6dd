"""Operator 9, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are hashed and count once each: its words, their prefixes (so inflected forms of a word share a
feature), pairs of neighbouring words, and pairs with one word between. The model is trained on a bounded sample
of labelled rows (``TRAINING_ROWS``) with per-coordinate learning rates; the L1 term leaves few weights, which are
broadcast (at most ``1 << BITS`` of them, 12 bytes each) and looked up for every whole text.

Defined cases: NULL and empty texts have no feature and score by the intercept alone; without labelled rows of
both classes the score is the share of toxic labels, or 0 without any; texts of any length are read whole; equal texts
score alike, so repeated rows repeat their score, and rows that repeat an id are scored by their own text; a repeated
label counts once, 1 before 0; examples are learnt in the order of a hash of their id, those of one id in the order of
their features; a score of exactly the threshold is predicted 1; only id, text and the label are read, under any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm import labelled
from odweave.llm.text import mix64, slices, small_batches, word_hashes, words

BITS = 20
#: About so many labelled rows train the model, however many there are.
TRAINING_ROWS = 12_000
PREFIXES = (3, 4, 5, 6)
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` arrays, repeats included; features are numbers below ``1 << BITS``."""
    offsets, flat = words(texts)
    coded = flat.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bare = pc.utf8_trim(coded.dictionary, characters=_EDGES)
    length = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    columns = [np.where(length > 0, word_hashes(bare), 0)]
    for k in PREFIXES:
        columns.append(np.where(length > k, mix64(word_hashes(pc.utf8_slice_codeunits(bare, 0, k)) + np.uint64(k)), 0))
    index = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    one = columns[0][index]
    rows, values = [], []
    for column in columns:
        h = column[index]
        rows.append(doc[h != 0])
        values.append(h[h != 0])
    for gap, seed in ((1, _PAIR), (2, _SKIP)):
        same = (doc[gap:] == doc[:-gap]) & (one[gap:] != 0) & (one[:-gap] != 0)
        rows.append(doc[gap:][same])
        values.append(mix64(one[:-gap][same] * seed + one[gap:][same]))
    return np.concatenate(rows), (np.concatenate(values) >> np.uint64(64 - BITS)).astype(np.int64)


_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha=2.0, beta=1.0, l1=8.0, l2=0.01, epochs=8) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, features and weights. ``rows``: each example's distinct features."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the intercept, without L1
    bias = np.array([size])
    for _ in range(epochs):
        for own, label in zip(rows, y, strict=True):
            at = np.concatenate((own, bias))
            za, na = z[at], n[at]
            first = np.full(len(at), l1)
            first[-1] = 0.0
            w = np.where(np.abs(za) <= first, 0.0, -(za - np.sign(za) * first) / ((beta + np.sqrt(na)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / alpha
            z[at] = za + g - sigma * w
            n[at] = na + g * g
    first = np.full(size + 1, l1)
    first[-1] = 0.0
    w = np.where(np.abs(z) <= first, 0.0, -(z - np.sign(z) * first) / ((beta + np.sqrt(n)) / alpha + l2))
    left = np.flatnonzero(w[:size])
    return float(w[size]), left, w[left]


def _distinct(texts: pa.Array) -> list[np.ndarray]:
    rows, values = features(texts)
    key = np.unique((rows << BITS) | values)
    cuts = np.searchsorted(key >> BITS, np.arange(len(texts) + 1))
    key &= (1 << BITS) - 1
    return [key[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


def fit(
    documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, features and weights from a bounded sample of labelled rows outside the held-out fold."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = [x.astype(np.int32).tobytes() for x in _distinct(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), pa.array(own, pa.binary())], ["id", "y", "own"])

    def train(table: pa.Table) -> pa.Table:
        own = table.column("own").to_pylist()
        order = sorted(range(len(own)), key=lambda i, ids=table.column("id").to_pylist(): (hash_of(ids[i]), own[i]))
        y = table.column("y").to_numpy()[order]
        if len(np.unique(y)) < 2:
            share = np.clip(y.mean() if len(y) else 0, 1e-6, 1 - 1e-6)
            bias, at, w = float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0)
        else:
            bias, at, w = ftrl([np.frombuffer(own[i], np.int32) for i in order], y)
        return pa.table({"bias": [bias], "at": pa.array([at], pa.list_(pa.int64())), "w": pa.array([w], pa.list_(pa.float64()))})

    small_batches(documents)
    sample = labelled.training_texts(documents, labels, label_col, folds, fold, rows, id_col, text_col)
    sample = sample.mapInArrow(sparse, "id string, y double, own binary").withColumn("all", F.lit(1))
    model = sample.groupBy("all").applyInArrow(train, "bias double, at array<long>, w array<double>").first()
    if model is None:
        return -20.0, np.zeros(0, np.int64), np.zeros(0)
    return model["bias"], np.array(model["at"], np.int64), np.array(model["w"])


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def scored(documents: DataFrame, model: tuple[float, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row from its whole text."""
    score = score_column(model)
    return documents.select(F.col(f"`{id_col}`").alias("id"), score(F.col(f"`{text_col}`")).alias("score"))


def score_column(model: tuple[float, np.ndarray, np.ndarray]):
    """An Arrow function from texts to scores between 0 and 1."""
    bias, at, w = model

    def kernel(texts: pa.Array) -> pa.Array:
        weights = np.zeros(1 << BITS)
        weights[at] = w
        out = np.full(len(texts), bias)
        for part in slices(pa.RecordBatch.from_arrays([texts, pa.array(np.arange(len(texts)))], ["text", "row"])):
            start = part.column(1)[0].as_py()
            rows, values = features(part.column(0))
            used = np.flatnonzero(weights[values])
            key = np.unique((rows[used] << BITS) | values[used])  # each feature of a text once
            np.add.at(out, start + (key >> BITS), weights[key & ((1 << BITS) - 1)])
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return F.arrow_udf(kernel, "double")


def toxicity(
    documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every document."""
    rows = scored(documents, fit(documents, labels, folds, fold, id_col=id_col, text_col=text_col, label_col=label_col), id_col, text_col)
    return rows.select(
        F.col("id").alias(id_col),
        labelled.held_out(F.col("id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean_rows(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with all their columns."""
    score = score_column(fit(documents, labels, id_col=id_col, text_col=text_col))
    return documents.where(score(F.col(f"`{text_col}`")) < threshold)
