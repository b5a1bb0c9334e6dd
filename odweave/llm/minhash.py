"""Operator 8, near-duplicates: MinHash bands, sequential Bayesian pruning, exact verification, components.

Documents are linked when the Jaccard similarity of their sets of word shingles is at least ``similarity``
(compared in whole numbers); a component holds all documents reachable over links.

1. One pass over the texts gives each document's set size, a 128-bit digest of its set, and a MinHash signature.
   Documents with equal sets fold to one class (a hash aggregate, so copies never meet in one task).
2. Bands of the classes' signatures form buckets. Bucket members pair with the smallest and the largest member only: a
   number of pairs in proportion to the members.
3. Pairs are compared in batches of signature positions. After every batch a pair is dropped once the posterior
   probability (uniform prior) that its similarity reaches the threshold is below ``miss``. Survivors are
   verified on their full sets.
4. Buckets that still hold members of several components are resolved completely: the candidate clusters they
   form are cut into blocks of bounded size (by bytes of their sets), and every two blocks that have members of one
   such bucket and can still link components meet in one task, which prunes by the same posterior, verifies exactly,
   and returns only links that join components. Pairs already in one component need no test: no link between
   components is lost.

``rows`` times ``bands`` fixes the chance that a link shares no band: (1 - s**rows)**bands, 3e-6 at similarity
0.8 with 5 and 32, less above.

Defined cases: NULL and wordless texts have the empty set (size 0) and link with nothing; a text of fewer words
than a shingle has its whole sequence as one shingle; classes have numbers of their own, so rows with a NULL id link
and are linked through like others, get the smallest id of their component, and keep NULL where it has none; a repeated
id's rows each get the component of their own text. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.text import hashed_words, mix64, shingles, slices, small_batches
from odweave.operators.iterate import connected_components, drop_shared, shared_table

ROWS, BANDS, BATCH = 5, 32, 32
#: A side up to this number of narrow rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Bytes of sets and signatures of one block of a candidate cluster.
BLOCK_BYTES = 24 << 20
#: Chance of dropping a pair at the threshold in one comparison.
MISS = 1e-6


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """32-bit minima of multiply-shift permutations of a set of hashes."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(low, (factors[:, None] * hashes[None, i : i + 256]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def fewest_matches(similarity: float, batch: int, total: int, miss: float) -> list[int]:
    """For n = batch, 2 batch, ..: the fewest equal positions that leave P(J >= similarity | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the probability that
    at most m of n + 1 trials with chance t succeed.
    """
    t, out = Fraction(similarity).limit_denominator(1000), []
    for n in range(batch, total + 1, batch):
        tail, m = Fraction(0), -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, in whole numbers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    factors = _multipliers(ROWS * BANDS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, every = shingles(*hashed_words(part.column(1)), k)
                sizes, digests, signatures = [], [], []
                for i in range(part.num_rows):
                    own = np.unique(every[at[i] : at[i + 1]])
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    signatures.append(signature(own, factors).tobytes() if len(own) else b"")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                    ["id", "n", "digest", "sig"],
                )

    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(kernel, f"id {read.schema['id'].dataType.simpleString()}, n long, digest binary, sig binary")


def _banded(classes: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
            for r in range(ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), ids], ["key", "c"])

    return classes.select("c", "sig").mapInArrow(kernel, "key long, c long")


def _may_link(bounds: list[int]):
    def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x = np.frombuffer(b"".join(a.to_pylist()), np.uint32).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b.to_pylist()), np.uint32).reshape(len(b), -1)
        alive, found = np.arange(len(x)), np.zeros(len(x), np.int64)
        for i, least in enumerate(bounds):  # a batch of positions at a time, of the pairs still alive
            cut = slice(i * BATCH, (i + 1) * BATCH)
            found[alive] += np.count_nonzero(x[alive, cut] == y[alive, cut], axis=1)
            alive = alive[found[alive] >= least]
        out = np.zeros(len(x), bool)
        out[alive] = True
        return pa.array(out)

    return F.arrow_udf(kernel, "boolean")


def _verified(percent: int):
    def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs], pa.bool_())

    return F.arrow_udf(kernel, "boolean")


def _sets(df: DataFrame, needed: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(c, items)``: the full set of each needed class ``(c, rep, digest)``, from the texts of its smallest id."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, every = shingles(*hashed_words(part.column(1)), k)
                rows, sets, digests = [], [], []
                wanted = part.column(2).to_pylist()
                for i in range(part.num_rows):
                    own = np.unique(every[at[i] : at[i + 1]]).tobytes()
                    digest = xxhash.xxh3_128_digest(own)
                    if wanted[i] is None or wanted[i] == digest:  # an id may repeat with another text
                        rows.append(i)
                        sets.append(own)
                        digests.append(digest)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["c", "digest", "items"])

    kind = "c long, digest binary, items binary"
    side = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    read = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    found = read.join(side.where("rep IS NOT NULL"), "rep").select("c", "text", "digest").mapInArrow(kernel, kind).select("c", "items")
    nameless = needed.where("rep IS NULL").select("c", "digest")
    if not nameless.isEmpty():  # classes of NULL ids alone are found by their digests
        texts = read.where("rep IS NULL").select(F.lit(None).cast("long").alias("c"), "text", F.lit(None).cast("binary").alias("digest"))
        found = found.unionByName(texts.mapInArrow(kernel, kind).select("digest", "items").join(nameless, "digest").select("c", "items"))
    return found.dropDuplicates(["c"])


def _test(pairs: DataFrame, classes: DataFrame, sets: DataFrame, bounds: list[int], percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link: posterior pruning on signatures, then the full sets."""

    def both(table: DataFrame, value: str, on: DataFrame) -> DataFrame:
        one = table.select(F.col("c").alias("a"), F.col(value).alias("xa"))
        two = table.select(F.col("c").alias("b"), F.col(value).alias("xb"))
        return on.join(one, "a").join(two, "b")

    alive = both(classes, "sig", pairs).where(_may_link(bounds)("xa", "xb")).select("a", "b")
    return both(sets, "items", alive).where(_verified(percent)("xa", "xb")).select("a", "b")


def _block_kernel(bounds: list[int], percent: int):
    def kernel(table: pa.Table) -> pa.Table:
        n = table.num_rows
        ids = table.column("c").to_pylist()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(n, -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        _, comp, size = np.unique(np.array(table.column("comp").to_pylist()), return_inverse=True, return_counts=True)
        root = np.arange(len(size))
        out = []
        order = np.lexsort((comp, size[comp]))  # one component, the last of the largest, need not ask
        for i in order[: n - size.max()]:
            alive = np.flatnonzero(root[comp] != root[comp[i]])
            found = np.zeros(len(alive), np.int64)
            for k, least in enumerate(bounds):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                found += np.count_nonzero(sig[alive, cut] == sig[i, cut], axis=1)
                good = found >= least
                alive, found = alive[good], found[good]
            for j in alive[np.argsort(-found, kind="stable")]:
                x, y = root[comp[i]], root[comp[j]]
                if x != y and links(sets[i], sets[j], percent):
                    root[root == y] = x
                    out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return kernel


def _residual(members: DataFrame, classes: DataFrame, sets: DataFrame, bounds: list[int], percent: int) -> DataFrame:
    """Links between components among bucket members ``(key, c, lo, comp)``; each bucket has several components."""
    cluster = connected_components(members.select(F.col("lo").alias("a"), F.col("c").alias("b")))
    cluster = cluster.select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    rows = members.select("c", "comp").distinct().join(cluster, "c")
    rows = rows.join(sets, "c").join(classes.select("c", "sig"), "c")
    rows = shared_table(rows.withColumn("bytes", F.length("items") + F.length("sig")), "clusters")
    # A component over the block size gets blocks of its own; the others share blocks, each as a whole.
    parts = rows.groupBy("cluster", "comp").agg(F.sum("bytes").alias("bytes"))
    parts = parts.withColumn("own", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    small = parts.where("own <= 1").groupBy("cluster").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("shared"))
    plan = shared_table(parts.join(small, "cluster", "left").select("cluster", "comp", "own", F.coalesce("shared", F.lit(1)).alias("shared")), "blocks")
    block = F.when(
        F.col("own") > 1, F.concat_ws(":", F.lit("c"), F.col("comp").cast("string"), F.expr("pmod(xxhash64(c), own)").cast("string"))
    ).otherwise(F.concat_ws(":", F.lit("s"), F.expr("pmod(xxhash64(comp), shared)").cast("string")))
    placed = rows.join(plan, ["cluster", "comp"]).withColumn("block", block).withColumn("big", F.when(F.col("own") > 1, F.col("comp")))
    placed = placed.select("cluster", "c", "comp", "items", "sig", "block", "big")
    blocks = shared_table(placed.select("cluster", "block", "big").distinct(), "blocks")
    several = blocks.groupBy("cluster").count().where("count > 1").select("cluster")
    alone = blocks.join(several, "cluster", "left_anti").where("big IS NULL").select("cluster", "block", F.col("block").alias("block2"))
    # Of the blocks of one cluster, those meet that have members of one bucket.
    held = members.select("key", "c").join(placed.select("cluster", "c", "block", "big").join(several, "cluster"), "c")
    held = shared_table(held.select("cluster", "key", "block", "big").distinct(), "held")
    other = held.select("cluster", "key", F.col("block").alias("block2"), F.col("big").alias("big2"))
    meets = held.join(other, ["cluster", "key"]).where("block <= block2 AND (big IS NULL OR big2 IS NULL OR big <> big2)")
    meets = meets.select("cluster", "block", "block2").distinct().union(alone)
    meets = meets.withColumn("task", F.concat_ws("|", F.col("cluster").cast("string"), "block", "block2"))
    sides = meets.select("cluster", "task", "block").union(meets.where("block <> block2").select("cluster", "task", "block2"))
    work = placed.join(sides, ["cluster", "block"]).select("task", "c", "comp", "items", "sig")
    return work.groupBy("task").applyInArrow(_block_kernel(bounds, percent), "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, miss: float = MISS
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row; the component's smallest id is kept."""
    small_batches(df)
    percent = round(100 * similarity)
    bounds = fewest_matches(similarity, BATCH, ROWS * BANDS, miss)
    signed = shared_table(_signed(df, id_col, text_col, shingle), "signed")
    classes = signed.where("n > 0").groupBy("digest", "sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    # The number of a class is fixed once its table is written.
    classes = shared_table(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    banded = _banded(classes)
    buckets = banded.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    buckets = shared_table(buckets, "buckets")
    side = F.broadcast(buckets) if buckets.count() <= BROADCAST_ROWS else buckets
    members = shared_table(banded.join(side, "key").select("key", "c", "lo", "hi"), "members")
    drop_shared(buckets)
    needed = classes.join(members.select("c").distinct(), "c").select("c", "rep", "digest")
    sets = shared_table(_sets(df, shared_table(needed, "needed"), id_col, text_col, shingle), "sets")

    def components(edges: DataFrame) -> DataFrame:
        return shared_table(connected_components(edges), "components")

    def labelled(comps: DataFrame) -> DataFrame:
        found = members.join(comps.select(F.col("node").alias("c"), "component"), "c", "left")
        return found.select("key", "c", "lo", F.coalesce("component", "c").alias("comp"))

    ends = F.explode(F.array("lo", "hi")).alias("a")
    pairs = members.select(ends, F.col("c").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = shared_table(_test(pairs, classes, sets, bounds, percent), "links")
    comps = components(edges)

    left = labelled(comps)
    mixed = left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    open_ = shared_table(left.join(mixed, "key").select("key", "c", "lo", "comp"), "open")
    more = shared_table(_residual(open_, classes, sets, bounds, percent), "links")
    drop_shared(members, sets)
    if not more.isEmpty():  # these links join components, which are contracted to one node each
        found = comps.select(F.col("node").alias("a"), F.col("component").alias("x"))
        joined = more.join(found, "a", "left").select("b", F.coalesce("x", "a").alias("x"))
        joined = joined.join(found.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
        again = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))
        lone = again.join(comps.select("node"), "node", "left_anti")
        renamed = comps.join(again.select(F.col("node").alias("component"), F.col("component").alias("z")), "component", "left")
        comps = renamed.select("node", F.coalesce("z", "component").alias("component")).unionByName(lone)
    comps = comps.select(F.col("node").alias("c"), "component")
    drop_shared(open_)

    # A component is named after its smallest id; classes without a link after their own.
    linked = shared_table(classes.join(comps, "c").select("digest", "rep", "component"), "linked")
    names = shared_table(linked.groupBy("component").agg(F.min("rep").alias("name")), "names")
    side = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    shared = linked.join(side, "component").select("digest", F.col("name").alias("component"))
    copies = classes.where("rows > 1").join(comps, "c", "left_anti").select("digest", F.col("rep").alias("component"))
    shared = shared_table(shared.union(copies).where("component IS NOT NULL"), "labels")
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    component = F.coalesce("component", "id")
    return (
        signed.select("id", "n", "digest")
        .join(side, "digest", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    )


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay, one document of each component, with all their columns.

    Rows that share an id are one document and stay together; rows with a NULL id stay.
    """
    found = near_duplicates(df, id_col, text_col, shingle, similarity).select(F.col(id_col).alias("id"), "kept")
    drop = shared_table(found.where("id IS NOT NULL").groupBy("id").agg(F.max("kept").alias("kept")).where("NOT kept").select("id"), "dropped")
    side = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.join(side, F.col(f"row.`{id_col}`") == F.col("id"), "left_anti").select("row.*")
