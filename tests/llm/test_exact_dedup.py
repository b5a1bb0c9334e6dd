import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave.llm import exact_dedup, registry
from odweave.llm.quotient import CountingQuotientFilter
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_filters_are_lossless():
    rng = np.random.default_rng(1)
    parts = [np.concatenate((rng.integers(0, 2**63, 50).astype(np.uint64), rng.choice(np.arange(20, dtype=np.uint64) << np.uint64(58), 30))) for _ in range(7)]
    filters = [CountingQuotientFilter.from_bytes(CountingQuotientFilter.of(p, q).to_bytes()) for p in parts for q in (8,)]
    merged = CountingQuotientFilter.merge(filters)
    want, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.fingerprints() == want).all() and (merged.counts == counts).all()
    back = CountingQuotientFilter.from_bytes(merged.to_bytes())
    assert (back.fingerprints() == want).all() and (back.counts == counts).all()
    assert set(back.repeated()) == set(want[counts > 1])
    assert len(CountingQuotientFilter.from_bytes(CountingQuotientFilter.of(np.zeros(0, np.uint64), 8).to_bytes()).fingerprints()) == 0


def test_oracle(spark):
    compare(registry.op1_exact_dedup(spark, SF), connect(SF), registry.OP1_SQL)


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_ROWS, 0])
def test_edge_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
    long = "Äb" * 200_000
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, long), (6, long + "x"), (7, long.lower()), (None, "a b"), (None, "q"), (None, "q"), (8, "same"), (8, "same"), (9, "é"), (10, "É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(3)).withColumn("sha", F.lit("s"))
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [fold(t) for i, t in rows if hashlib.sha256(fold(t).encode()).hexdigest() == r.text_sha256]
        ids = [i for i, t in rows if fold(t) == texts[0] and i is not None]
        assert r.group_size == len(texts) and r.keep_id == max(ids, default=None) and r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.kept_rows(df)
    assert kept.columns == df.columns
    assert sorted(fold(r.text) for r in kept.collect()) == sorted({fold(t) for _, t in rows})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df).count() == 0 and exact_dedup.kept_rows(df).count() == 0
