"""Operator 5, quality: a generalised additive model with pairwise interactions.

Every text gives a row of numeric features (counts and shares of characters, words, repeats and lines). Features are
cut into quantile bins. Cyclic boosting visits the features in turn and adds a small step of a shallow tree on one
feature's bins to that feature's lookup table; then the pairs with the largest gain on the residuals get
two-dimensional tables the same way. A score is the logistic function of the sum of the tables' values at a text's
bins: vectorised lookups and additions.

The model is fitted in one task on a bounded sample of labelled rows (``TRAINING_ROWS``, a row of numbers each).

Defined cases: NULL and empty texts have all features 0 and are scored like any other; without labelled rows of both
classes the score is the share of good labels, or 0.5 without any; texts of any length are measured whole; equal texts
score alike, so repeated rows repeat their score, and rows that repeat an id are scored by their own text; a repeated
label counts once, 1 before 0; among training texts of one id the order of their features decides, so rows in any order
give one model; a score of exactly the threshold is predicted 1; only id, text and the label are read, under any names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm import labelled
from odweave.llm.text import clean, slices, small_batches, words

TRAINING_ROWS = 20_000
BINS, COARSE, PAIRS = 32, 8, 8

NAMES = (
    "words", "bytes", "word_bytes", "longest_word", "upper", "digit", "exclamation", "bar", "symbol", "stop", "comma",
    "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "lines", "words_a_line", "repeated_lines", "one_word_lines",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "exclamation": b"!", "bar": b"|", "symbol": b"#$%&*@^~<>=_\\{}[]",
    "stop": b".?", "comma": b",;:",
}


def _repeats(doc: np.ndarray, code: np.ndarray, n: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct codes each document has, and how often its most frequent one occurs."""
    found, counts = np.unique(doc * max(codes, 1) + code, return_counts=True)
    owner = found // max(codes, 1)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, counts)
    return np.bincount(owner, minlength=n), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    texts = clean(texts)
    n = len(texts)
    raw = pa.concat_arrays([texts]) if texts.offset else texts
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer("".join(raw.to_pylist()).encode(), np.uint8)
    offsets, flat = words(raw)
    count = np.diff(offsets)
    doc = np.repeat(np.arange(n), count)
    coded = flat.dictionary_encode()
    code, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    length = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[code] if kinds else code
    per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    out = {"words": np.log1p(count), "bytes": np.log1p(size), "word_bytes": np.bincount(doc, length, n) / per_word, "longest_word": np.log1p(longest)}
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.int32)
        table[list(members)] = 1
        total = np.concatenate(([0], np.cumsum(table[data])))
        out[name] = (total[ends[1:]] - total[ends[:-1]]) / per_byte
    distinct, top = _repeats(doc, code, n, kinds)
    out["distinct_words"], out["top_word"] = distinct / per_word, top / per_word
    same = doc[1:] == doc[:-1]
    out["same_as_previous"] = np.bincount(doc[1:][same & (code[1:] == code[:-1])], minlength=n) / per_word
    pair = (code[:-1] * np.int64(1_000_003) + code[1:])[same] % (1 << 30)
    pairs, _ = _repeats(doc[1:][same], pair, n, 1 << 30)
    out["distinct_pairs"] = pairs / np.maximum(count - 1, 1)
    parts = pc.split_pattern(raw, "\n")
    per_line = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.list_flatten(parts)
    at = np.repeat(np.arange(n), per_line)
    line_code = lines.dictionary_encode()
    kinds_of_line, _ = _repeats(at, line_code.indices.to_numpy().astype(np.int64), n, len(line_code.dictionary))
    blanks = pc.count_substring(lines, " ").to_numpy(zero_copy_only=False)
    out["lines"] = np.log1p(per_line)
    out["words_a_line"] = count / np.maximum(per_line, 1)
    out["repeated_lines"] = 1 - kinds_of_line / np.maximum(per_line, 1)
    out["one_word_lines"] = np.bincount(at[blanks == 0], minlength=n) / np.maximum(per_line, 1)
    made = np.column_stack([out[name] for name in NAMES]).astype(np.float64)
    made[size == 0] = 0.0
    return made


def _shallow_tree(gradient: np.ndarray, hessian: np.ndarray, depth: int = 2, least: float = 2.0) -> np.ndarray:
    """A regression tree on ordered bins; the value of each bin."""
    value = np.full(len(gradient), gradient.sum() / (hessian.sum() + 1))
    if depth == 0 or len(gradient) < 2:
        return value
    g, h = np.cumsum(gradient), np.cumsum(hessian)
    left_g, left_h, right_g, right_h = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g[-1] ** 2 / (h[-1] + 1)
    gain[(left_h < least / 4) | (right_h < least / 4)] = -1
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= 1e-9:
        return value
    return np.concatenate([_shallow_tree(gradient[s], hessian[s], depth - 1, least) for s in (slice(None, cut), slice(cut, None))])


def _quadrants(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes of a grid at once: its gain, and the grid of the four leaves' values."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    a = [g[:-1, :-1], g[:-1, -1:] - g[:-1, :-1], g[-1:, :-1] - g[:-1, :-1]]
    b = [h[:-1, :-1], h[:-1, -1:] - h[:-1, :-1], h[-1:, :-1] - h[:-1, :-1]]
    a.append(g[-1, -1] - a[0] - a[1] - a[2])
    b.append(h[-1, -1] - b[0] - b[1] - b[2])
    gain = sum(x**2 / (y + 1) for x, y in zip(a, b, strict=True))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    leaf = [x[i, j] / (y[i, j] + 1) for x, y in zip(a, b, strict=True)]
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + 1)), out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.15) -> dict:
    """The model: intercept, each feature's bin edges and table, and the pairs' coarse edges and tables."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    model = {"bias": float(np.log(share / (1 - share))), "edges": [], "tables": [], "pairs": []}
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    coarse = [np.unique(np.quantile(column, np.linspace(0, 1, COARSE + 1)[1:-1])) for column in x.T]
    bins = [np.searchsorted(e, column, side="right") for e, column in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    f = np.full(len(y), model["bias"])
    for _ in range(rounds):
        for k, own in enumerate(bins):
            p = 1 / (1 + np.exp(-f))
            step = rate * _shallow_tree(np.bincount(own, y - p, len(tables[k])), np.bincount(own, p * (1 - p), len(tables[k])))
            tables[k] += step
            f += step[own]
    wide = [np.searchsorted(e, column, side="right") for e, column in zip(coarse, x.T, strict=True)]

    def grid(i: int, j: int, weights: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(wide[i] * shape[1] + wide[j], weights, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-f))
    both = [(i, j) for i, j in combinations(range(x.shape[1]), 2) if len(coarse[i]) and len(coarse[j])]
    best = sorted(both, key=lambda ij: -_quadrants(grid(*ij, y - p), grid(*ij, p * (1 - p)))[0])[:PAIRS]
    square = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in best}
    for _ in range(pair_rounds):
        for i, j in best:
            p = 1 / (1 + np.exp(-f))
            step = rate * _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
            square[i, j] += step
            f += step[wide[i], wide[j]]
    model |= {"edges": [e.tolist() for e in edges], "tables": [t.tolist() for t in tables]}
    model["pairs"] = [[i, j, coarse[i].tolist(), coarse[j].tolist(), square[i, j].tolist()] for i, j in best]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows: the sum of the tables' values at their bins."""
    f = np.full(len(x), model["bias"])
    for k, (edges, table) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        f += np.array(table)[np.searchsorted(edges, x[:, k], side="right")]
    for i, j, a, b, table in model["pairs"]:
        f += np.array(table)[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Train on a bounded sample of labelled rows outside the held-out fold."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = pa.array(list(features(part.column(2))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), own], ["id", "y", "x"])

    def learn(table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("id").to_pylist(), table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True))
        return pa.table({"model": [json.dumps(train(np.array([x for _, x, _ in own]), np.array([y for *_, y in own])))]})

    small_batches(documents)
    sample = labelled.training_texts(documents, labels, label_col, folds, fold, rows, id_col, text_col)
    sample = sample.mapInArrow(measure, "id string, y double, x array<double>").withColumn("all", F.lit(1))
    found = sample.groupBy("all").applyInArrow(learn, "model string").first()
    return json.loads(found["model"]) if found else train(np.zeros((0, len(NAMES))), np.zeros(0))


def score_column(model: dict):
    """An Arrow function from texts to scores between 0 and 1."""

    def kernel(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        made = [predict(model, features(part.column(0))) for part in slices(batch)]
        return pa.array(np.concatenate(made) if made else np.zeros(0))

    return F.arrow_udf(kernel, "double")


def quality(
    documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every document."""
    model = fit(documents, labels, folds, fold, id_col=id_col, text_col=text_col, label_col=label_col)
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), score_column(model)(F.col(f"`{text_col}`")).alias("score"))
    return rows.select(
        F.col("id").alias(id_col),
        labelled.held_out(F.col("id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
