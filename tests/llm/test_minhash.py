import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odweave.llm import minhash

DOCS = "/root/testdata/sf0.01/documents.parquet"


def shingle_set(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force_on_documents(spark, k):
    df = spark.read.parquet(DOCS)
    want = brute([(r.doc_id, r.text) for r in df.collect()], k, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=k).collect()}
    assert got == want


def test_nulls_empty_ties_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base.upper()), (9, base + " tail"), (1, None), (2, ""), (4, "one two"), (6, "One Two"), (None, "alone here"), (7, " \t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("rep", F.lit("x"))
    got = {(r.doc_id): (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert got[3] == (57, 3, True) and got[5] == (57, 3, False) and got[9] == (58, 3, False)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[7] == (0, 7, True)
    assert got[4] == (1, 4, True) and got[6] == (1, 4, False)
    assert got[None] == (1, None, True)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    """A group whose members link only through some of them, cut into many blocks."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 60_000)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(200, rng.integers(1, 9), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert got == brute(rows, 4, 80)


@pytest.mark.parametrize("comps", [[0, 1, 0, 1], [0, 1, 2, 2, 1, 0], [1, 0, 0, 2, 1, 2, 3]])
def test_block_of_tied_components_finds_every_single_link(comps):
    """Components of equal size, their rows interleaved, with a link between any one pair of rows."""
    bounds = minhash.fewest_matches(0.8, minhash.BATCH, minhash.ROWS * minhash.BANDS, 1e-6)
    kernel = minhash._block_kernel(bounds, 80)
    factors = minhash._multipliers(minhash.ROWS * minhash.BANDS)
    for a in range(len(comps)):
        for b in range(a + 1, len(comps)):
            sets = [np.arange(50, dtype=np.uint64) * np.uint64(7919) + np.uint64(10**6 * (a if i == b else i)) for i in range(len(comps))]
            signatures = [minhash.signature(s, factors).tobytes() for s in sets]
            found = kernel(pa.table({"c": list(range(len(comps))), "comp": comps, "items": [s.tobytes() for s in sets], "sig": signatures}))
            got = {tuple(sorted(p)) for p in zip(*found.to_pydict().values(), strict=True)}
            assert got == ({(a, b)} if comps[a] != comps[b] else set())


def test_posterior_bounds_keep_borderline_pairs():
    bounds = minhash.fewest_matches(0.8, 32, 160, 1e-6)
    assert bounds == sorted(bounds) and bounds[-1] < 0.8 * 160
    rng = np.random.default_rng(1)
    seen = np.cumsum(rng.random((20_000, 160)) < 0.8, axis=1)[:, 31::32]
    assert (seen >= np.array(bounds)).all()


def test_null_ids_link_and_are_linked_through(spark):
    base = [f"w{i}" for i in range(100)]
    far = base[:96] + [f"x{i}" for i in range(4)]
    further = base[:92] + [f"x{i}" for i in range(8)]
    rows = [(5, " ".join(base)), (None, " ".join(far)), (9, " ".join(further)), (None, "alone here"), (None, "alone here"), (None, "two three four five six"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=4).collect()), key=repr)
    want = brute([(k, t) for k, (_, t) in enumerate(rows)], 4, 80)  # rows by number
    names = {}
    for k, (_, c) in want.items():
        ids = [rows[j][0] for j in want if want[j][1] == c and rows[j][0] is not None]
        names[k] = min(ids) if ids else None
    assert got == sorted(((rows[k][0], n, names[k], rows[k][0] == names[k]) for k, (n, _) in want.items()), key=repr)
    assert (9, 97, 5, False) in got and (None, 97, 5, False) in got


def test_repeated_rows_and_very_long_texts(spark):
    gen = np.random.default_rng(1)
    long = [f"v{x}" for x in gen.integers(0, 10**9, 60_000)]
    near = long[:30_000] + ["changed"] + long[30_000:]
    rows = [(4, " ".join(long)), (2, " ".join(near)), (4, " ".join(long)), (4, "another text of this id"), (7, "another text of this id")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect())
    assert got == [(2, 59_998, 2), (4, 2, 4), (4, 59_997, 2), (4, 59_997, 2), (7, 2, 4)]


def test_beyond_the_broadcast_limits(spark, monkeypatch):
    from odweave.operators import iterate

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(minhash.near_duplicates(df, shingle=4).collect())
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(iterate, "BROADCAST_ROWS", 0)
    assert sorted(minhash.near_duplicates(df, shingle=4).collect()) == want
