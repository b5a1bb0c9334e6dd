"""Classifiers on held-out rows, and their defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave.llm import labelled, quality, toxicity, trees

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n = y.sum()
    return (rank[y].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("run,label,least", [(quality.quality, "quality", 0.97), (toxicity.toxicity, "toxic", 0.95)])
def test_held_out_rows(spark, run, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = run(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert auc(got.score.to_numpy(), got[label].to_numpy(bool)) > least
    # Labels of held-out rows must not matter.
    folds = {"quality": (4, 2), "toxic": (3, 1)}[label]
    turned = labels.withColumn(label, F.when(labelled.held_out(F.col("doc_id"), *folds), 1 - F.col(label)).otherwise(F.col(label)))
    again = run(docs, turned).join(labels.select("doc_id"), "doc_id").where("held_out").toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_edge_cases(spark, run):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some words"), (3, "long " * 30_000), (3, "a"), (4, "idiot " * 3)], "doc_id long, text string").selectExpr("*", "'x' AS score")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = run(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len(run(docs, labels.limit(0)).collect()) == 6
    assert run(docs.limit(0), labels).count() == 0


def test_additive_model_scores_by_tables():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x[:2000], y[:2000])
    assert ((quality.predict(model, x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.9
    assert [0, 1] in [p[:2] for p in model["pairs"]]


def test_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    assert ((trees.Boosted(x, y).margin(x) > 0) == (y > 0)).mean() > 0.97
    assert ((trees.Forest(x, y).score(x) > 0.5) == (y > 0)).mean() > 0.97


def test_ftrl_step_by_step():
    """One coordinate after the other, in dictionaries."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(120)]
    y = np.array([float(3 in r or 7 in r) for r in rows])
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.7, 0.1, 3
    z, n = {}, {}

    def weight(i):
        own, least = z.get(i, 0.0), 0.0 if i == "bias" else l1
        if abs(own) <= least:
            return 0.0
        return -(own - np.sign(own) * least) / ((beta + np.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for row, label in zip(rows, y, strict=True):
            at = [*row.tolist(), "bias"]
            before = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(before.values()))) - label
            for i in at:
                sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * before[i]
                n[i] = n.get(i, 0.0) + g * g
    bias, at, w = toxicity.ftrl(rows, y, alpha, beta, l1, l2, epochs)
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert bias == pytest.approx(weight("bias")) and set(at.tolist()) == set(want) and len(want) < 40
    assert w.tolist() == pytest.approx([want[i] for i in at.tolist()])


def test_additive_model_step_by_step():
    """Every cut of every shallow tree and of every pair's grid is tried row by row."""
    rng = np.random.default_rng(5)
    x = rng.random((90, 3))
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6)).astype(float)
    rounds, pair_rounds, rate = 3, 2, 0.3
    model = quality.train(x, y, rounds, pair_rounds, rate)
    cells = [[sum(v >= e for e in edges) for v in x[:, k]] for k, edges in enumerate(model["edges"])]
    f = [np.log(y.mean() / (1 - y.mean()))] * len(y)

    def slopes():
        p = [1 / (1 + np.exp(-v)) for v in f]
        return [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

    def leaf(rows, g, h):
        return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)

    def gain(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    def tree(rows, own, low, high, depth, g, h):
        best = (1e-9, None)
        if depth:
            for cut in range(low + 1, high):
                left, right = [i for i in rows if own[i] < cut], [i for i in rows if own[i] >= cut]
                if min(sum(h[i] for i in left), sum(h[i] for i in right)) < 0.5:
                    continue
                value = gain(left, g, h) + gain(right, g, h) - gain(rows, g, h)
                if value > best[0] + 1e-12:
                    best = (value, (cut, left, right))
        if best[1] is None:
            return dict.fromkeys(rows, leaf(rows, g, h))
        cut, left, right = best[1]
        return tree(left, own, low, cut, depth - 1, g, h) | tree(right, own, cut, high, depth - 1, g, h)

    every = list(range(len(y)))
    for _ in range(rounds):
        for k, own in enumerate(cells):
            step = tree(every, own, 0, len(model["edges"][k]) + 1, 2, *slopes())
            f = [v + rate * step[i] for i, v in enumerate(f)]

    def grids(i, j, g, h):
        a, b = ([sum(v >= e for e in edges) for v in x[:, k]] for k, edges in ((i, model_coarse[i]), (j, model_coarse[j])))
        best = (-np.inf, None)
        for p in range(1, max(a) + 1):
            for q in range(1, max(b) + 1):
                parts = [[r for r in every if (a[r] >= p, b[r] >= q) == side] for side in ((False, False), (False, True), (True, False), (True, True))]
                value = sum(gain(rows, g, h) for rows in parts)
                if value > best[0] + 1e-12:
                    best = (value, parts)
        return best

    model_coarse = {k: edges for i, j, a, b, _ in model["pairs"] for k, edges in ((i, a), (j, b))}
    assert [[0, 1], [0, 2], [1, 2]] == sorted([p[:2] for p in model["pairs"]])
    for _ in range(pair_rounds):
        for i, j, *_ in model["pairs"]:
            g, h = slopes()
            for rows in grids(i, j, g, h)[1]:
                for r in rows:
                    f[r] += rate * leaf(rows, g, h)
    assert quality.predict(model, x) == pytest.approx([1 / (1 + np.exp(-v)) for v in f], abs=1e-9)


def test_forest_scores_by_walking_each_tree():
    rng = np.random.default_rng(6)
    x = rng.random((400, 6))
    forest = trees.Forest(x, (x[:, 0] + x[:, 3] > 1).astype(float), trees=9)
    codes = trees.binned(x, forest.edges)

    def walk(tree, row, at=0):
        feature, cut, left, right, value = tree[at]
        return value if feature < 0 else walk(tree, row, left if row[feature] <= cut else right)

    assert forest.score(x) == pytest.approx([np.mean([walk(t, row) for t in forest.trees]) for row in codes])


def test_other_column_names_and_row_order(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twice = docs.select("doc_id", "text").union(docs.select("doc_id", F.concat(F.lit("other "), "text")))
    for run, label in ((quality.quality, "quality"), (toxicity.toxicity, "toxic")):
        want = sorted(map(tuple, run(twice, labels).collect()), key=repr)
        other = twice.orderBy(F.desc("doc_id"), F.desc("text")).repartition(3).select(F.col("text").alias("id"), F.col("doc_id").alias("score"), F.lit(1).alias("y"))
        got = run(other, labels.withColumnsRenamed({"doc_id": "score", label: "text"}), id_col="score", text_col="id", label_col="text")
        assert sorted(map(tuple, got.collect()), key=repr) == want
