"""Each stage of the pipeline on its own input, against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odweave.llm import decontaminate, toxicity
from tests.llm.test_exact_dedup import fold
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxicity(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = toxicity.toxicity(before, labels)
    assert set(rows(after)) == {r.doc_id for r in score.where("predicted = 0").collect()}


def test_exact_dedup(stages):
    before, after = map(rows, stages[1])
    best = {}
    for i, t in before.items():
        best[fold(t)] = max(i, best.get(fold(t), i))
    assert set(after) == set(best.values())


def test_near_dedup(stages):
    before, after = map(rows, stages[2])
    found = brute(list(before.items()), 5, 80)
    assert set(after) == {i for i, (_, c) in found.items() if i == c}


def test_decontamination(spark, stages):
    """Bit vectors of every item over whole texts, without pieces."""
    before, after = map(rows, stages[3])
    items = [decontaminate.folded(r.text).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(before) - set(after)
    assert set(after) <= set(before)
    short = [i for i in sorted(before) if len(before[i] or "") <= 3000][:30]
    for i in short + sorted(gone):
        text = decontaminate.folded(before[i] or "")
        leaks = any(min(decontaminate.Myers(item).distances(text), default=len(item)) <= int(decontaminate.RATE * len(item)) for item in items)
        assert leaks == (i in gone)


def test_mixing(stages):
    before, after = stages[4]
    known = rows(before)
    got = after.collect()
    assert all(known[r.doc_id] == r.text and 1 <= r["copy"] <= r.n_copies for r in got)
    assert len({(r.doc_id, r["copy"]) for r in got}) == len(got)


def test_stages_with_nulls_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    df = docs.limit(30).union(odd).withColumn("sha", F.lit(1)).withColumn("id", F.lit(2)).withColumn("row", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and 0 < out.count() <= df.count()
        assert stage(spark, df.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).columns[: len(df.columns)] == df.columns
