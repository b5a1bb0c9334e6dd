import random

import numpy as np
import pyarrow as pa
import pytest

from odweave.llm import chaining

rng = random.Random(5)


def words(n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n)]


def brute_chain(rows):
    """The best chain score by trying every predecessor."""
    best = []
    for i, (x0, x1, y0, y1) in enumerate(rows):
        own = x1 - x0
        gains = [best[j] - chaining.GAP_COST * (x0 - rows[j][1] + y0 - rows[j][3]) for j in range(i) if rows[j][1] <= x0 and rows[j][3] <= y0]
        best.append(own + max([0.0, *gains]))
    return max(best)


def score(rows, chain):
    total = 0.0
    for k, i in enumerate(chain):
        x0, x1, y0, y1 = rows[i]
        total += x1 - x0
        if k:
            p = rows[chain[k - 1]]
            assert p[1] <= x0 and p[3] <= y0
            total -= chaining.GAP_COST * (x0 - p[1] + y0 - p[3])
    return total


def test_fenwick_chains_are_optimal():
    gen = np.random.default_rng(3)
    for _ in range(200):
        n = int(gen.integers(1, 25))
        x, y, length = gen.integers(0, 80, n), gen.integers(0, 80, n), gen.integers(3, 12, n)
        rows = np.column_stack((x, x + length, y, y + length))
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        chains = chaining.chains_of(rows, 0)
        assert abs(max(score(rows.tolist(), c) for c in chains) - brute_chain(rows.tolist())) < 1e-9
        assert sorted(i for c in chains for i in c) == list(range(n))


def test_edit_distance():
    gen = random.Random(1)
    for _ in range(300):
        a, b = ([gen.randrange(3) for _ in range(gen.randrange(0, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            nxt = [i]
            for j, d in enumerate(b, 1):
                nxt.append(min(row[j - 1] + (c != d), row[j] + 1, nxt[-1] + 1))
            row = nxt
        assert chaining.edit_distance(a, b) == row[-1]


def test_finds_planted_passages_and_no_others(spark):
    passages = [words(n) for n in (52, 60, 75, 120)]
    rows, want = [], {}
    for i in range(80):
        own, k = words(rng.randrange(5, 120)), rng.randrange(6)
        if k < 4:
            p = list(passages[k])
            for at in rng.sample(range(len(p)), len(p) // 30):  # a few words are changed
                p[at] = "zzz"
            cut = rng.randrange(len(own) + 1)
            own = own[:cut] + p + own[cut:]
            want[i] = (k, cut, cut + len(p))
        rows.append((i, " ".join(own).upper() if i % 5 == 0 else "\n".join(own)))
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {k: min(i for i, w in want.items() if w[0] == k) for k in range(4)}
    assert {r.doc_id for r in got} == set(want) - set(first.values())
    for r in got:
        k, a, b = want[r.doc_id]
        assert want[r.source_doc_id][0] == k and r.source_doc_id < r.doc_id
        assert a <= r.start_word + 2 and r.end_word <= b + 2 and r.end_word - r.start_word >= 40


def uncovered(rows, got, least):
    """Words of later places of equal runs of ``least`` words that no passage covers, by trying every run."""
    texts = {}
    for i, text in rows:
        if i is not None:
            texts.setdefault(i, set()).add(tuple((text or "").encode().lower().split()))
    covered = {(r.doc_id, at) for r in got for at in range(r.start_word, r.end_word)}
    seen, missed, later = set(), set(), 0
    for i in sorted(texts):
        for words_ in texts[i]:
            for at in range(len(words_) - least + 1):
                run = words_[at : at + least]
                if run in seen:
                    later += 1
                    missed |= {(i, at + k) for k in range(least) if (i, at + k) not in covered}
                seen.add(run)
    return missed, later


@pytest.mark.parametrize("least", [40, 50])
def test_every_repeated_run_is_covered(spark, least):
    """In other documents and in the same one, at every place but the first."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = chaining.repeated_passages(df, min_words=least).collect()
    missed, later = uncovered(rows, got, least)
    assert later > 5_000 and not missed
    assert all(r.end_word - r.start_word >= least and (r.source_doc_id, r.source_start) < (r.doc_id, r.start_word) for r in got)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    part = " ".join(f"w{i}" for i in range(100, 180))
    other = " ".join(f"u{i}" for i in range(70))
    rows = [(1, long), (2, part), (3, None), (4, ""), (5, "one two"), (None, part), (2, part), (2, other), (7, other + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS src", "2 AS h")
    got = {(r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.source_start, r.source_end, r.edits) for r in chaining.repeated_passages(df).collect()}
    assert got == {(2, 1, 0, 80, 100, 180, 0), (7, 2, 0, 70, 0, 70, 0)}
    assert chaining.repeated_passages(df.limit(0)).count() == 0


def test_repeats_inside_a_document(spark):
    gen = random.Random(4)
    fresh = lambda n: [f"v{gen.randrange(10**9)}" for _ in range(n)]
    passage = fresh(80)
    rows = [(6, " ".join(fresh(9) + passage + fresh(30) + passage + fresh(5))), (7, "same " * 3000), (8, "two words " * 200), (9, "same " * 3000)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not uncovered(rows, got, 50)[0]
    assert [(r.start_word, r.end_word, r.source_start, r.source_end) for r in got if r.doc_id == 6] == [(119, 199, 9, 89)]
    assert [(r.source_doc_id, r.start_word, r.end_word) for r in got if r.doc_id == 9] == [(7, 0, 3000)]
    assert all(r.source_doc_id == r.doc_id for r in got if r.doc_id < 9)


def test_copies_fold_to_the_smallest_id(spark):
    text, head = " ".join(f"w{i}" for i in range(90)), " ".join(f"h{i}" for i in range(60))
    rows = [(i, text if i % 2 else text.upper()) for i in range(5, 400)] + [(1, f"{head} {text}"), (2, head), (3, head)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in got} == {(i, 5, 0, 90) for i in range(6, 400)} | {(5, 1, 0, 90), (2, 1, 0, 60), (3, 2, 0, 60)}


def test_seed_tables_beyond_the_broadcast_limit(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(chaining.repeated_passages(df).collect())
    monkeypatch.setattr(chaining, "BROADCAST_ROWS", 0)
    assert sorted(chaining.repeated_passages(df).collect()) == want


@pytest.mark.parametrize("identity, least", [(0.95, 0.97), (0.9, 0.95), (0.85, 0.8)])
def test_share_of_fuzzy_passages_found(spark, identity, least):
    """Passages of 100 words with random substitutions, deletions and insertions."""
    gen = random.Random(6)
    fresh = lambda n: [f"v{gen.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(0, 400, 2):
        passage = fresh(100)
        changed = []
        for w in passage:
            kind = gen.random() if gen.random() > identity else 1.0
            changed += [] if kind < 0.2 else fresh(1) + [w] if kind < 0.4 else fresh(1) if kind < 1 else [w]
        rows += [(i, " ".join(fresh(30) + passage + fresh(30))), (i + 1, " ".join(fresh(50) + changed + fresh(50)))]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.source_doc_id == r.doc_id - 1 and r.doc_id % 2 for r in got)
    assert len({r.doc_id for r in got}) >= least * 200


def test_equal_passage_put_together_from_earlier_documents(spark):
    """Parts of a passage stand in documents before its first whole occurrence, alone or overlapping."""
    gen = random.Random(8)
    fresh = lambda n: [f"v{gen.randrange(10**9)}" for _ in range(n)]
    for k, parts in enumerate([[(0, 30), (30, 60)], [(0, 49), (5, 54), (11, 60)], [(i, i + 49) for i in range(0, 12, 3)]]):
        passage = fresh(60)
        rows = [fresh(15) + passage[a:b] + fresh(15) for a, b in parts]
        whole = [fresh(20) + passage + fresh(25) for _ in range(4)]
        table = [(i, " ".join(w)) for i, w in enumerate(rows + whole)]
        got = chaining.repeated_passages(spark.createDataFrame(table, "doc_id long, text string")).collect()
        found = {(r.doc_id, r.source_doc_id): (r.start_word, r.end_word, r.source_start, r.source_end) for r in got}
        first = len(rows)
        assert found == {(first + i, first): (20, 80, 20, 80) for i in (1, 2, 3)}, k


def test_equal_run_stays_where_the_rest_of_its_diagonal_differs():
    a = np.arange(400, dtype=np.uint32)
    b = a + 1000
    b[100:140] = a[100:140]
    for at in (150, 165, 180, 195):
        b[at : at + 5] = a[at : at + 5]
    ((x0, x1, y0, y1, edits),) = chaining.aligned(a, b, [[100, 200, 100, 200]], 40, 0.8)
    assert x0 <= 100 and x1 >= 140 and (x0, x1) == (y0, y1) and edits == np.count_nonzero(a[x0:x1] != b[y0:y1]) <= 0.2 * (x1 - x0)


def test_few_spans_cover_what_all_cover():
    gen = np.random.default_rng(4)
    for _ in range(300):
        start = gen.integers(0, 150, int(gen.integers(1, 40)))
        spans = np.column_stack((start, start + gen.integers(1, 30, len(start))))
        words = lambda rows: {w for a, b in rows.tolist() for w in range(a, b)}
        assert words(spans[chaining._needed(spans)]) == words(spans)


def test_passage_stays_beside_a_run_that_is_only_partly_equal():
    x, y = np.array([0, 45, 55, 65, 45]), np.array([0, 45, 55, 65, 500])
    runs = chaining.runs_of(x, y, np.array([40, 5, 5, 5, 40])).tolist()
    assert sorted(runs) == [[0, 70, 0, 70], [45, 85, 500, 540]]


def test_fuzzy_passage_whose_seeds_stand_in_several_earlier_texts(spark):
    """Every piece of 12 words was first seen in a text of its own; the passages share no equal run of 50 words."""
    gen = random.Random(11)
    fresh = lambda n: [f"v{gen.randrange(10**9)}" for _ in range(n)]
    passage = fresh(96)
    rows = [fresh(20) + passage[k : k + 12] + fresh(20) for k in range(0, 96, 12)]
    for shift in (0, 5, 11):
        own = list(passage)
        own[14 + shift :: 24] = fresh(len(own[14 + shift :: 24]))
        rows.append(fresh(30) + own + fresh(30))
    got = chaining.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(9, 8), (10, 8)}
    assert all(r.start_word <= 32 and r.end_word >= 124 and r.start_word == r.source_start for r in got)


def test_stretches_of_one_phrase_count_every_few_words():
    row = np.repeat([0, 1], [40, 3])
    pos = np.concatenate((np.arange(40), [0, 3, 20]))
    h = np.repeat(np.array([7, 7], np.uint64), [40, 3])
    kept, start = chaining._thinned(row, pos, h)
    assert list(zip(row[kept].tolist(), pos[kept].tolist(), strict=True)) == [(0, x) for x in range(0, 40, 8)] + [(1, 0), (1, 20)]
    assert start.tolist() == [True, False, False, False, False, True, True]


def test_bitmap_grows_with_its_hashes(spark):
    """At a fixed size it fills up, and ever more places count as repeated."""
    bits = chaining._bitmap(spark.range(3_000_000).selectExpr("xxhash64(id) AS fp"))
    assert 0 < np.bitwise_count(bits).sum() <= 64 * len(bits) / chaining.HASH_BITS


def test_full_bitmaps_change_no_passage(spark, monkeypatch):
    gen = random.Random(4)
    fresh = lambda n: [f"f{gen.randrange(10**9)}" for _ in range(n)]
    passage = fresh(80)
    rows = [fresh(30) + passage[k : k + 16] + fresh(30) for k in range(0, 80, 16)]
    rows += [fresh(25) + passage[:40] + fresh(1) + passage[41:] + fresh(25) for _ in range(3)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    want = sorted(map(tuple, chaining.repeated_passages(df).collect()))
    monkeypatch.setattr(chaining, "BITMAP_BITS", 64)
    assert {r[0] for r in want} == {6, 7}
    assert sorted(map(tuple, chaining.repeated_passages(df).collect())) == want


def test_later_places_without_an_open_pair_are_left_out(spark):
    """A pair reaches 65 words: a passage that covers them all on both sides leaves nothing open there."""
    seeds = spark.createDataFrame([(1, i, 0, x, chaining.K, False) for i, x in ((1, 0), (2, 0), (2, 64), (2, 130), (2, 131), (2, 150), (3, 64))], "h long, id long, t int, pos int, n int, again boolean")
    several = spark.createDataFrame([(1, 1, 0, 0)], "h long, src long, st int, y int")
    spans = spark.createDataFrame([(2, 0, [(0, 200)])], "id long, t int, spans array<struct<x0: int, x1: int>>")
    got = sorted(r.fp for r in chaining._later_places(seeds, several, spans, 50).collect())
    places = chaining._places(np.ones(3, np.uint64), np.zeros(3, np.int32), np.array([131, 150, 64], np.int32))
    assert got == sorted(places.view(np.int64).tolist())


def test_open_places_meet_texts_and_make_the_matches_of_all_places(spark, monkeypatch):
    """Loops have many places of each pair: the join has one row for a pair and two texts, and no place is lost."""
    gen = random.Random(12)
    fresh = lambda n: [f"p{gen.randrange(10**9)}" for _ in range(n)]
    line = fresh(31)
    rows = [(i, " ".join(fresh(i) + line * (4 + i) + fresh(9) + line[:20])) for i in (3, 5, 8)] + [(9, "same " * 60), (11, "same " * 90)]
    texts = chaining._hashed(spark.createDataFrame(rows, "id long, text string"), "bigint").select("id", "t", "w")
    every = np.full(1, 2**64 - 1, np.uint64)  # all seeds count as repeated, all places as later ones
    spans = spark.createDataFrame([], "id long, t int, spans array<struct<x0: int, x1: int>>")
    monkeypatch.setattr(chaining, "_bitmap", lambda hashes, probes: every)
    met, read_from = chaining._open_matches(texts, spans, spark.sparkContext.broadcast((every, every)), "bigint", 50)
    table = met.toArrow()
    chaining.drop_shared(*read_from)

    near, far = chaining._reach(50)
    places = {}  # of each pair of seeds in each text
    for i, _, w in sorted(tuple(r) for r in texts.collect()):
        ((_, offsets, hashes),) = chaining._pieces([pa.RecordBatch.from_pydict({"w": [bytes(w)]})])
        row, pos, h = chaining._seed_rows(offsets, hashes)
        kept, start = chaining._thinned(row, pos, h)
        seeds = list(zip(pos[kept].tolist(), h[kept].tolist(), start.tolist(), strict=True))
        for x, one, new in seeds:
            for z, two, _ in seeds:
                if near <= z - x <= far and (one != two or new):
                    places.setdefault((one, two), {}).setdefault(i, []).append((x, z))
    want, joined = set(), 0
    for texts_of in places.values():
        for a, own in texts_of.items():
            for b, others in texts_of.items():
                joined += b < a or b == a and len(own) > 1
                for (x, x2), (y, y2) in ((p, q) for p in own for q in others if b < a or b == a and q[0] < p[0] and q[1] < p[1]):
                    want |= {(a, b, x, y), (a, b, x2, y2)}
    assert table.num_rows == joined < len(want) / 2
    for size in (1, 50, 1 << 16):
        monkeypatch.setattr(chaining, "MATCHES", size)
        found = [b for b in chaining._met(table.to_batches()) if b.num_rows]
        assert {(r["id"], r["src"], r["x"], r["y"]) for b in found for r in b.to_pylist()} == want


def test_chains_do_not_depend_on_batches(monkeypatch):
    """All groups of a batch are merged at once; those at its ends wait for the next one."""
    gen = np.random.default_rng(9)
    rows = []
    for group in range(60):
        for _ in range(int(gen.integers(1, 9))):
            x, shift = int(gen.integers(0, 90)), int(gen.integers(-2, 3))
            rows.append((group // 7, 0, group % 7, 0, x, x + shift + 5, 50 if group % 5 == 0 and gen.random() < 0.4 else chaining.K))
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32()] * 2 + [pa.int32()] * 3, strict=True)], names=["id", "t", "src", "st", "x", "y", "n"])

    class Kernel:
        columns = table.column_names

        def mapInArrow(self, kernel, schema):  # noqa: N802
            return kernel

    want = []
    for key in sorted({r[:4] for r in rows}):
        runs = chaining.runs_of(*(np.array(c) for c in zip(*(r[4:] for r in rows if r[:4] == key), strict=True)))
        for own in chaining.chains_of(runs, 30, chaining.GAP_COST):
            part = runs[own]
            want.append((*key, int(part[0, 0]), int(part[-1, 1]), int(part[0, 2]), int(part[-1, 3]), part.reshape(-1).tolist()))
    assert len(want) > 20
    for size in (1, 5, 17, 1 << 16):
        monkeypatch.setattr(chaining, "MATCHES", size)
        out = chaining._chained(Kernel(), "bigint", 30, chaining.GAP_COST)(iter(table.to_batches(max_chunksize=size)))
        assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == sorted(want)


def test_few_pairs_of_seeds_pass_by_chance(spark):
    """With one bit a hash 1.5 % of all others pass, so rows without a partner grow with the square of the input."""
    bits = chaining._bitmap(spark.range(1_000_000).selectExpr("xxhash64(id) AS fp"), chaining.KEY_PROBES)
    table = spark.range(3_000_000).selectExpr("xxhash64(id) AS fp").toArrow()
    there = chaining._there(bits, table.column(0).to_numpy().view(np.uint64), chaining.KEY_PROBES)
    assert there[:1_000_000].all() and there[1_000_000:].mean() < 0.002
