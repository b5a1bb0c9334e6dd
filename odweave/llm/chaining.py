"""Operator 10, substring dedup: shared k-mer seeds, collinear chains, alignment of chains.

1. One pass over the texts hashes their words, which are written as arrays with a digest of each. Texts of equal words
   fold to the one with the smallest id: the others are one passage each, and take no part in what follows.
2. Seeds are k-mers of words of two lengths. Those of ``K`` words are winnowed: of each ``WINDOW`` neighbours the
   smallest hash is a seed, so two texts that share ``K + WINDOW - 1`` words in a row share a seed. Besides, every run of
   ``min_words`` words that may occur again is one: the smallest hash of its shorter runs (its anchor, winnowed too)
   must be a repeated one. A counting quotient filter of seeds and anchors tells which hashes occur more than once; a
   bitmap of them (of bounded size) drops most others before any row is shuffled.
3. The first place of a seed (smallest id, then position) is its source. Every other place, in the same document too, is
   matched with the source: as many matches as places, however common a passage is. As a seed of ``min_words`` words is
   a passage already, every repeated run of that length is found, whichever documents have its parts.
4. The matches of a document and a source are merged to diagonal runs and chained in order of both texts, with a cost
   for each word of gap. The best predecessor of a run is the largest entry of a prefix of a Fenwick tree.
5. Chains are aligned on the words of both texts: runs word by word, gaps by edit distance (Myers' bit vectors), ends
   by extension until they stop paying. A chain below the identity is cut at its worst gap, a run at its longest stretch
   of unequal words. Passages of at least ``min_words`` words and ``identity`` remain, but for those that lie within
   another one of the same document.

6. What the first places leave open: a passage whose seeds were first seen in several texts. Seeds that are not wholly in
   a passage so far meet every earlier place, not the first alone, where a second seed is shared that a chain of the least
   span reaches from it: the key is the pair of seeds, so a frequent phrase alone makes no match. Texts are joined, with
   the pair's places in each; the places meet in the kernel of the chains. Steps 4 and 5 follow once more, for all texts
   that share a pair. Where a phrase follows itself over and over, it counts every ``STRIDE`` words.

A passage is reported at every place but its first, which keeps it. In the first round matches are bounded by a
document's length; in the second by the places of a pair of seeds that are still open, times all its places, and rows by
its texts with open places, times all its texts. Words are compared by 32 bits of their hashes.

Defined cases: NULL and short texts have no passage; rows with a NULL id take no part; rows that repeat id and text are
one document, rows that repeat an id with another text are documents of their own with the same id; a text that repeats
itself reports its later places with itself as the source, which may overlap them; only id and text are read.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.exact_dedup import ranges_for, repeated_fingerprints
from odweave.llm.text import hashed_words, mix64, powers, shingles, slices, small_batches, trimmed
from odweave.operators.iterate import drop_shared, shared_table

K, WINDOW = 5, 5
MIN_WORDS, IDENTITY = 50, 0.8
GAP_COST = 0.2
#: Words on both sides of a chain that its alignment may extend over.
PAD = 50
#: Words that the starts of two seeds of a pair may be further apart than they must be.
REACH = 40
#: Cost of a word of gap between pairs: two seeds pay for any gap that a pair has.
PAIR_GAP_COST = 0.04
#: Equal seeds of one text that are nearer than this count once in pairs; shorter than the gap that a chain bridges.
STRIDE = 8
#: Bits of a bitmap for each hash in it, rounded up to a power of two, but at least (8 MB) and at most (16 MB) so many. A
#: full one lets more rows through, which find no partner later.
HASH_BITS, LEAST_BITS, BITMAP_BITS = 32, 1 << 26, 1 << 27
#: Bits of a pair of seeds: there are some tens of pairs a word, so a share of them that pass by chance weighs more.
KEY_PROBES = 2
BROADCAST_ROWS = 400_000
#: Words of one piece of the seed kernels.
PIECE_WORDS = 1 << 17
#: Matches that are worked through at once, where one text's matches with another are not more.
MATCHES = 1 << 16


def grams(offsets: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's runs of ``k`` words, at a cost that does not depend on ``k``; none in shorter texts."""
    count = np.maximum(np.diff(offsets) - k + 1, 0)
    out = np.concatenate(([0], np.cumsum(count)))
    take = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    up, down = powers(len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    return out, mix64((sums[take + k] - sums[take]) * down[take])


def _smallest(offsets: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the smallest hash (the last of equal ones) of the window that starts at each k-mer, and the ends of
    the k-mers' documents."""
    n = len(hashes)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(n)
    best, at, done = hashes.copy(), place.copy(), 1
    while done < window:  # windows of ``done`` k-mers, joined with those that end the larger windows
        step = min(done, window - done)
        better = (best[step:] <= best[:-step]) & (place[step:] < doc_end[:-step])
        for own in (best, at):
            own[:-step] = np.where(better, own[step:], own[:-step])
        done += step
    return at, doc_end


def winnowed(offsets: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the k-mers that are smallest in one of their document's windows."""
    n, count = len(hashes), np.diff(offsets)
    at, doc_end = _smallest(offsets, hashes, window)
    # Only full windows count, and the whole document where it is shorter than a window.
    start = np.arange(n) - np.repeat(offsets[:-1], count)
    full = (np.arange(n) + window <= doc_end) | (start == 0)
    chosen = np.zeros(n, bool)
    chosen[at[full]] = True
    return np.flatnonzero(chosen)


def _seed_rows(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and hash of each seed."""
    n = np.diff(offsets)
    at, every = shingles(offsets, hashes, K)
    kept = winnowed(at, every, WINDOW)
    row = np.repeat(np.arange(len(n)), np.diff(at))[kept]
    kept, row = kept[n[row] >= K], row[n[row] >= K]
    # Winnowing prefers small hashes; a bijective mix spreads them evenly again over the filters' ranges.
    return row, kept - at[row], mix64(every[kept])


def _passage_rows(offsets: np.ndarray, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Row, word position and hash of each run of ``min_words`` words, and place and hash of its anchor."""
    window = min(WINDOW, min_words)
    at, every = grams(offsets, hashes, min_words - window + 1)
    start, own = grams(offsets, hashes, min_words)
    smallest, doc_end = _smallest(at, every, window)
    full = np.arange(len(every)) + window <= doc_end
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(start))
    anchor = smallest[full]
    return row, np.arange(start[-1]) - start[row], own, anchor, mix64(every[anchor])


def _hashed(read: DataFrame, id_type: str) -> DataFrame:
    """``(id, t, n, digest, w)``: each text's words as 32-bit hashes, one after another; ``t`` tells texts of one id apart."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                offsets, hashes = hashed_words(part.column(1))
                narrow = (hashes >> np.uint64(32)).astype(np.uint32)
                own = [narrow[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                digests = [xxhash.xxh3_128_digest(w) for w in own]
                tags = np.frombuffer(b"".join(d[:4] for d in digests), np.int32)
                columns = [pa.array(tags), pa.array(np.diff(offsets), pa.int32()), pa.array(digests, pa.binary()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "t", "n", "digest", "w"])

    return read.mapInArrow(trimmed(kernel), f"id {id_type}, t int, n int, digest binary, w binary")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Key columns, offsets and 64-bit word hashes of pieces of batches whose last column has the word arrays."""
    for batch in batches:
        last = batch.num_columns - 1
        for part in slices(batch, batch.schema.names[last], 4 * PIECE_WORDS):
            own = part.column(last)
            ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
            data = own.buffers()[2]
            flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].tobytes() if data is not None else b""
            offsets = (ends - ends[0]).astype(np.int64) // 4
            yield [part.column(k) for k in range(last)], offsets, mix64(np.frombuffer(flat, np.uint32).astype(np.uint64) + np.uint64(1))


def _seed_hashes(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of the hashes of all seeds and anchors (``fp``) from batches of word arrays."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offsets, hashes in _pieces(batches):
            *_, at, anchor = _passage_rows(offsets, hashes, min_words)
            new = np.append(True, at[1:] != at[:-1])[: len(at)]  # an anchor at one place counts once
            fp = np.concatenate((_seed_rows(offsets, hashes)[2], anchor[new]))
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], ["fp"])

    return kernel


def _bitmap(hashes: DataFrame, probes: int = 1) -> np.ndarray:
    """A bitmap in which the bits of a table's hashes are set (built on the executors): one a hash or, with two ``probes``,
    another by its upper half."""
    size = min(BITMAP_BITS, max(LEAST_BITS, 1 << (HASH_BITS * hashes.count()).bit_length()))
    out = np.zeros(size // 64, np.uint64)
    for k in range(probes):
        own = hashes.select(F.shiftrightunsigned("fp", 32 * k).alias("fp"))
        cells = own.groupBy(F.floor(F.pmod("fp", F.lit(size)) / 64).cast("int").alias("cell"))
        table = cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(fp, 64L) as int))")).alias("bits")).toArrow()
        out[table.column("cell").to_numpy()] |= table.column("bits").to_numpy().view(np.uint64)
    return out


def _seeds(texts: DataFrame, bitmap, id_type: str, min_words: int) -> DataFrame:
    """``(h, id, t, pos, n, again)`` of the seeds of ``n`` words whose bit, or whose anchor's bit, is set; ``again`` where
    the text has the seed before."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value

        for keys, offsets, hashes in _pieces(batches):
            row, pos, h = _seed_rows(offsets, hashes)
            row2, pos2, h2, _, anchor = _passage_rows(offsets, hashes, min_words)
            one, two = _there(bits, h), _there(bits, anchor)
            row, pos, h = (np.concatenate((x[one], y[two])) for x, y in ((row, row2), (pos, pos2), (h, h2)))
            n = np.repeat([K, min_words], [np.count_nonzero(one), np.count_nonzero(two)])
            order = np.lexsort((pos, h, row))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
            at = pa.array(row)
            columns = [pa.array(h.view(np.int64)), *(k.take(at) for k in keys), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(again)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "id", "t", "pos", "n", "again"])

    return texts.select("id", "t", "w").mapInArrow(trimmed(kernel), f"h long, id {id_type}, t int, pos int, n int, again boolean")


def _there(bits: np.ndarray, h: np.ndarray, probes: int = 1) -> np.ndarray:
    """Whether the hashes' bits are set."""
    bit = (h % np.uint64(64 * len(bits))).astype(np.int64)
    there = (bits[bit >> 6] >> (h & np.uint64(63))) & np.uint64(1) == 1
    if probes > 1:
        there[there] = _there(bits, h[there] >> np.uint64(32), probes - 1)
    return there


def _thinned(row: np.ndarray, pos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the seeds, in order of row and position, count: one in ``STRIDE`` words where equal seeds of a text follow
    each other closely; and whether each of them begins such a stretch."""
    order = np.lexsort((pos, h, row))
    r, x, v = row[order], pos[order], h[order]
    new = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]) | (x[1:] - x[:-1] >= STRIDE))[: len(x)]
    step = (x - x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]) // STRIDE
    stay = new | np.append(True, step[1:] != step[:-1])[: len(x)]
    place = np.argsort(order[stay])
    return order[stay][place], new[stay][place]


def _places(h: np.ndarray, t: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Hashes of seeds' places."""
    return mix64(h + mix64((t.astype(np.int64).view(np.uint64) << np.uint64(32)) + pos.astype(np.uint64)))


def _later_places(seeds: DataFrame, several: DataFrame, spans: DataFrame, min_words: int) -> DataFrame:
    """``fp`` of the places of short seeds that are not their first, but for those that no open pair can have: where one
    passage (of ``spans``) covers all words that a pair reaches from there."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, t, pos = (batch.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(_places(h.view(np.uint64), t, pos).view(np.int64))], ["fp"])

    far = _reach(min_words)[1]
    later = seeds.where(f"n = {K}").join(several.select("h", "src", "st", "y"), "h").where("id <> src OR t <> st OR pos <> y")
    inside = F.expr(f"exists(spans, s -> s.x0 <= greatest(pos - {far}, 0) AND s.x1 >= pos + {far + K})")
    later = later.select("id", "t", "h", "pos").join(spans, ["id", "t"], "left").where(~F.coalesce(inside, F.lit(False)))
    return later.select("h", "t", "pos").mapInArrow(trimmed(kernel), "fp long")


def _reach(min_words: int) -> tuple[int, int]:
    """Words from start to start of the seeds of a pair, at least and at most."""
    near = max(K, _least(min_words) - K)
    return near, near + REACH


def _seed_pairs(texts: DataFrame, maps, id_type: str, min_words: int, keys=None) -> DataFrame:
    """``(k, id, t, open, every)`` of the pairs of repeated seeds that a chain could span, of texts with their passages so
    far (``spans``): one row a pair and text, with all the places it has there and the open ones, as two numbers each (start
    and words from start to start). A place is open where a word of either seed is in no passage and both have an earlier
    place. Without ``keys`` only the open ones' hashes, as ``fp``; else the pairs whose bit is set there. ``maps`` are
    bitmaps of repeated seeds and of later places."""
    near, far = _reach(min_words)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, later), wanted = maps.value, None if keys is None else keys.value
        for columns, offsets, hashes in _pieces(batches):
            row, pos, h = _seed_rows(offsets, hashes)
            there = _there(bits, h)
            row, pos, h = row[there], pos[there], h[there]
            kept, start = _thinned(row, pos, h)
            row, pos, h = row[kept], pos[kept], h[kept]
            # Words in passages, from their starts and ends; then the words in none before each place.
            turns, spans = np.zeros(offsets[-1] + 1, np.int64), columns[2]
            lengths = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            ends = spans.flatten()
            shift = np.repeat(offsets[:-1], lengths)
            for k, by in ((0, 1), (1, -1)):
                np.add.at(turns, shift + pc.struct_field(ends, k).to_numpy(zero_copy_only=False), by)
            free = np.concatenate(([0], np.cumsum(np.cumsum(turns)[:-1] == 0)))
            at = offsets[row] + pos
            uncovered = free[at + K] > free[at]
            again = _there(later, _places(h, columns[1].to_numpy()[row], pos))
            parts = []
            for step in range(1, far + 1):
                one, two = np.arange(max(len(row) - step, 0)), np.arange(step, max(len(row), step))
                gap = np.where(row[one] == row[two], pos[two] - pos[one], far + 1)
                if not (gap <= far).any():
                    break
                pair = (gap >= near) & (gap <= far) & ((h[one] != h[two]) | start[one])
                one, two = one[pair], two[pair]
                open_ = (uncovered[one] | uncovered[two]) & again[one] & again[two]
                key = mix64(h[one] + mix64(h[two] + np.uint64(1)))
                hit = open_ if wanted is None else _there(wanted, key, KEY_PROBES)
                parts.append((key[hit], one[hit], two[hit], open_[hit]))
            if not parts:
                continue
            key, one, two, open_ = (np.concatenate(x) for x in zip(*parts, strict=True))
            if wanted is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(key).view(np.int64))], ["fp"])
                continue
            order = np.lexsort((one, key, row[one]))
            key, one, two, open_ = key[order], one[order], two[order], open_[order]
            own = row[one]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))[: len(key)])
            places = np.column_stack((pos[one], pos[two] - pos[one]))
            opens = np.append(0, np.cumsum(open_))
            lists = [_packed(places[open_], opens[np.append(first, len(key))]), _packed(places, np.append(first, len(key)))]
            at = pa.array(own[first])
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), columns[0].take(at), columns[1].take(at), *lists], ["k", "id", "t", "open", "every"])

    out = "fp long" if keys is None else f"k long, id {id_type}, t int, open binary, every binary"
    return texts.select("id", "t", "spans", "w").mapInArrow(trimmed(kernel), out)


def _packed(places: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of two numbers as byte strings, cut at ``ends``."""
    data = np.ascontiguousarray(places, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of two numbers of all byte strings, and where each string's begin and end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].tobytes() if data is not None else b""
    return np.frombuffer(flat, np.int32).reshape(-1, 2), (ends - ends[0]).astype(np.int64) // 8


def _turns(batch: pa.RecordBatch) -> np.ndarray:
    """Where two texts, the first four columns, are others than in the row before."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in range(4):
        new |= pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False)
    return np.append(True, new)


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``MATCHES`` rows or a little more, without empty ones."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= MATCHES):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches ``(id, t, src, st, x, y, n)`` of both seeds at each open place of a pair with those at every place in the
    source, in batches of bounded size; in one text with the places before it. Many pairs have a seed in common: a batch
    has each match of two texts once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (opens, at), (every, to) = _unpacked(batch.column(4)), _unpacked(batch.column(5))
        same = pc.equal(batch.column(0), batch.column(2)).to_numpy(zero_copy_only=False)
        same &= batch.column(1).to_numpy() == batch.column(3).to_numpy()
        texts = np.cumsum(_turns(batch))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(at))
        size = np.diff(to)[rows]
        total, start = np.cumsum(size), 0
        while start < len(rows):
            done = int(total[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + MATCHES, side="right")))
            part = slice(start, stop)
            row = np.repeat(rows[part], size[part])
            x, d = np.repeat(opens[part], size[part], axis=0).T
            y, e = every[to[row] + np.arange(len(row)) + done - np.repeat(total[part] - size[part], size[part])].T
            start = stop
            kept = np.flatnonzero(~same[row] | (y < x) & (y + e < x + d))
            row, x, y, d, e = (v[kept] for v in (row, x, y, d, e))
            row, x, y = np.append(row, row), np.append(x, x + d), np.append(y, y + e)
            order = np.lexsort((y, x, texts[row]))
            row, x, y = row[order], x[order], y[order]
            new = (np.diff(texts[row]) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)
            row, x, y = (v[np.append(True, new)[: len(v)]] for v in (row, x, y))
            keys = [batch.column(k).take(pa.array(row)) for k in range(4)]
            numbers = [pa.array(x), pa.array(y), pa.array(np.full(len(row), K, np.int32))]
            yield pa.RecordBatch.from_arrays([*keys, *numbers], ["id", "t", "src", "st", "x", "y", "n"])


def _open_matches(texts: DataFrame, spans: DataFrame, maps, id_type: str, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(id, t, src, st, open, every)``: a pair's open places in a text, to be matched with all its places in an earlier text
    or the same one; and the tables that this is read from."""
    texts = texts.join(spans, ["id", "t"], "left")
    opened = shared_table(_seed_pairs(texts, maps, id_type, min_words), "open")
    keys = texts.sparkSession.sparkContext.broadcast(_bitmap(opened, KEY_PROBES))
    pairs = shared_table(_seed_pairs(texts, maps, id_type, min_words, keys), "pairs")
    # Texts meet, not places. Both sides are read from a table, so that AQE can split the partition of a frequent pair.
    opened_texts = pairs.where("length(open) > 0")
    earlier = pairs.select("k", F.col("id").alias("src"), F.col("t").alias("st"), "every")
    met = opened_texts.select("k", "id", "t", "open").join(earlier, "k").where("src < id OR src = id AND st < t")
    own = opened_texts.where("length(every) > 8").selectExpr("id", "t", "id AS src", "t AS st", "open", "every")
    return met.select("id", "t", "src", "st", "open", "every").unionByName(own), [opened, pairs]


def _needed(spans: np.ndarray) -> np.ndarray:
    """Which spans stay, as few as cover the same words.

    Where a text repeats itself, each of its passages meets the source's first one on another diagonal.
    """
    keep, done, best = np.zeros(len(spans), bool), -1, -1
    order = np.lexsort((-spans[:, 1], spans[:, 0]))
    for i, (start, stop) in zip(order.tolist(), spans[order].tolist(), strict=True):
        if best >= 0 and start > done:  # nothing else reaches further from within what is covered
            keep[best], done, best = True, int(spans[best, 1]), -1
        if start > done:
            keep[i], done = True, stop
        elif stop > done and (best < 0 or stop > spans[best, 1]):
            best = i
    if best >= 0:
        keep[best] = True
    return keep


def runs_of(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Matches of ``n`` words of one diagonal, close to each other, merged: rows of (x start, x end, y start, y end)."""
    order = np.lexsort((x, x - y))
    x, y, n = x[order], y[order], n[order]
    whole = np.flatnonzero(n > K)
    if len(whole):  # passages that touch on a diagonal are equal throughout, so a span stands for all it covers
        first = np.flatnonzero(np.append(True, (np.diff((x - y)[whole]) != 0) | (x[whole][1:] > (x + n)[whole][:-1])))
        count = np.diff(np.append(first, len(whole)))
        keep = _needed(np.column_stack((x[whole][first], (x + n)[whole][first + count - 1])))
        stay = np.ones(len(x), bool)
        stay[whole] = np.repeat(keep, count)
        x, y, n = x[stay], y[stay], n[stay]
    return _merged(np.zeros(len(x), np.int64), x, y, n)[1]


def _merged(group: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups and the runs of matches that are close to each other on a diagonal of a group."""
    order = np.lexsort((x, x - y, group))
    group, x, y, n = group[order], x[order], y[order], n[order]
    turn = np.append(False, (np.diff(x - y) != 0) | (np.diff(group) != 0))
    base = np.cumsum(turn) * (x.max() + n.max() + 1)  # the ends of one diagonal do not reach into the next
    end = np.maximum.accumulate(base + x + n) - base
    first = np.flatnonzero(np.append(True, turn[1:] | (x[1:] - end[:-1] > WINDOW)))
    last = np.append(first[1:], len(x)) - 1
    out = np.column_stack((x[first], end[last], y[first], end[last] - x[first] + y[first]))
    order = np.lexsort((out[:, 2], out[:, 0], group[first]))
    return group[first][order], out[order]


class _PrefixMax:
    """A Fenwick tree that holds, for prefixes, the largest (value, run)."""

    def __init__(self, n: int):
        self.tree = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        while i < len(self.tree):
            if self.tree[i] < value:
                self.tree[i] = value
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while i:
            if self.tree[i][1] >= 0 and self.tree[i] > found:
                found = self.tree[i]
            i -= i & -i
        return found


def chains_of(runs: np.ndarray, least: int, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of runs that span ``least`` words, best first; each run is in one chain at most.

    The score of a chain is the words its runs cover less ``gap_cost`` for every word of gap in either text, which
    splits into a part of the predecessor and one of the successor, so a prefix maximum finds the best predecessor.
    """
    rows = runs.tolist()
    rank = {y: i + 1 for i, y in enumerate(sorted({r[3] for r in rows}))}
    ends = sorted(rank)
    tree, waiting, score, before = _PrefixMax(len(rank)), [], [0.0] * len(rows), [-1] * len(rows)
    for i, (x0, x1, y0, y1) in enumerate(rows):
        while waiting and waiting[0][0] <= x0:  # runs that end before this one begins
            _, j = waiting.pop(0)
            tree.put(rank[rows[j][3]], (score[j] + gap_cost * (rows[j][1] + rows[j][3]), j))
        value, j = tree.best(bisect_right(ends, y0))
        gain = value - gap_cost * (x0 + y0)
        score[i] = x1 - x0 + max(0.0, gain)
        before[i] = j if gain > 0 else -1
        insort(waiting, (x1, i))
    out, used = [], [False] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain and rows[chain[0]][1] - rows[chain[-1]][0] >= least:
            out.append(chain[::-1])
    return out


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, with bit vectors over the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    masks: dict = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return score


def _extension(same: np.ndarray) -> tuple[int, int]:
    """How far an end goes on: the prefix of best score (+1 a word that is equal, -2 else), and its edits."""
    total = np.cumsum(np.where(same, 1, -2))
    if not len(total) or total.max() <= 0:
        return 0, 0
    n = int(np.argmax(total)) + 1
    return n, int(np.count_nonzero(~same[:n]))


def aligned(a: np.ndarray, b: np.ndarray, runs: list[list[int]], min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages ``(start, end, source start, source end, edits)`` of a chain's runs in two word sequences."""
    costs = np.cumsum([0, *(int(np.count_nonzero(a[x0:x1] != b[y0:y1])) for x0, x1, y0, y1 in runs)])
    gaps = np.array([edit_distance(a[p[1] : q[0]].tolist(), b[p[3] : q[2]].tolist()) for p, q in zip(runs, runs[1:], strict=False)], np.int64)
    sums, out = np.cumsum(np.append(0, gaps)), []

    def extended(x0: int, x1: int, y0: int, y1: int, edits: int) -> bool:
        """Whether nothing is left to do with an extent, which is kept if it is long and alike enough."""
        n = min(x0, y0, PAD)
        left, left_edits = _extension(a[x0 - n : x0][::-1] == b[y0 - n : y0][::-1])
        n = min(len(a) - x1, len(b) - y1, PAD)
        right, right_edits = _extension(a[x1 : x1 + n] == b[y1 : y1 + n])
        if min(x1 - x0, y1 - y0) + left + right < min_words:
            return True
        edits += left_edits + right_edits
        if edits > (1 - identity) * (max(x1 - x0, y1 - y0) + left + right):
            return False
        out.append((x0 - left, x1 + right, y0 - left, y1 + right, edits))
        return True

    parts = [(0, len(runs))]
    while parts:
        i, j = parts.pop()
        if extended(runs[i][0], runs[j - 1][1], runs[i][2], runs[j - 1][3], int(costs[j] - costs[i] + sums[j - 1] - sums[i])):
            continue
        if j - i > 1:
            cut = i + int(np.argmax(gaps[i : j - 1])) + 1
            parts += [(cut, j), (i, cut)]
            continue
        shift = runs[i][2] - runs[i][0]
        spans = [tuple(runs[i][:2])]
        while spans:  # one run: cut at its longest stretch of unequal words, of equal ones at the middlemost
            x0, x1 = spans.pop()
            unequal = a[x0:x1] != b[x0 + shift : x1 + shift]
            if x0 >= x1 or extended(x0, x1, x0 + shift, x1 + shift, int(np.count_nonzero(unequal))):
                continue
            bad = np.flatnonzero(np.diff(np.concatenate(([0], unequal, [0])))).reshape(-1, 2)
            if len(bad):
                size = bad[:, 1] - bad[:, 0]
                longest = bad[size == size.max()]
                start, stop = longest[np.argmin(np.abs(2 * longest[:, 0] - (x1 - x0)))].tolist()
                spans += [(x0 + stop, x1), (x0, x0 + start)]
    return out


def _chained(matches: DataFrame, id_type: str, least: int, gap_cost: float) -> DataFrame:
    """Chains of matches ``(id, t, src, st, x, y, n)``, or of what :func:`_open_matches` gives, sorted by both texts: their
    extent in both, and their runs as four numbers each. Groups pass one after another, so a task holds the matches of one
    pair of texts, or of one batch."""
    pairs = "open" in matches.columns
    names = ["id", "t", "src", "st", "x0", "x1", "y0", "y1", "runs"]

    def chains(runs: np.ndarray) -> list[np.ndarray]:
        if len(runs) == 1:
            return [runs] if runs[0, 1] - runs[0, 0] >= least else []
        return [runs[own] for own in chains_of(runs, least, gap_cost)]

    def rows_of(keys: list[pa.Array], at: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found:
            ends = np.append(0, np.cumsum([len(own) for own in found]))
            flat, first, last = np.concatenate(found), ends[:-1], ends[1:] - 1
            sides = [pa.array(v, pa.int32()) for v in (flat[first, 0], flat[last, 1], flat[first, 2], flat[last, 3])]
            runs = pa.ListArray.from_arrays(pa.array(4 * ends, pa.int32()), pa.array(flat.reshape(-1), pa.int32()))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(k.take(take) for k in keys), *sides, runs], names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                x, y, n = (np.concatenate([h[k] for h in held]) for k in range(1, 4))
                keys = held[0][0]
                held.clear()
                if (x + n).max() - x.min() >= least:
                    found = chains(runs_of(x, y, n))
                    yield from rows_of(keys, [0] * len(found), found)

        for batch in _larger(_met(batches) if pairs else batches):
            rows = batch.num_rows
            cuts = np.flatnonzero(_turns(batch))
            x, y, n = (batch.column(k).to_numpy().astype(np.int64) for k in range(4, 7))
            extent = np.maximum.reduceat(x + n, cuts) - np.minimum.reduceat(x, cuts)
            stops = np.append(cuts[1:], rows)
            if held and any(held[0][0][k][0] != batch.column(k)[0] for k in range(4)):
                yield from flush()
            ends = [i for i in {0, len(cuts) - 1} if i and stops[i] == rows or not i and (held or len(cuts) == 1)]
            for i in sorted(ends):  # the groups that may go on before or after this batch
                start, stop = int(cuts[i]), int(stops[i])
                # Copies, as a part of a batch keeps all of it in memory.
                keys = [batch.column(k).take(pa.array([start])) for k in range(4)]
                held.append((keys, *(v[start:stop].copy() for v in (x, y, n))))
                if stop < rows:
                    yield from flush()
            inner = extent >= least
            inner[ends] = False
            long = inner & (np.maximum.reduceat(n, cuts) > K)
            groups = [(i, runs_of(*(v[cuts[i] : stops[i]] for v in (x, y, n)))) for i in np.flatnonzero(long).tolist()]
            group = np.repeat(np.arange(len(cuts)), stops - cuts)
            short = np.flatnonzero((inner & ~long)[group])
            if len(short):
                group, runs = _merged(group[short], x[short], y[short], n[short])
                first = np.flatnonzero(np.append(True, np.diff(group) != 0))
                groups += zip(group[first].tolist(), np.split(runs, first[1:]), strict=True)
            at, found = [], []
            for i, runs in groups:
                own = chains(runs)
                at += [int(cuts[i])] * len(own)
                found += own
            yield from rows_of([batch.column(k) for k in range(4)], at, found)
        yield from flush()

    return matches.mapInArrow(trimmed(kernel), f"id {id_type}, t int, src {id_type}, st int, x0 int, x1 int, y0 int, y1 int, runs array<int>")


def _aligned(sides: DataFrame, id_type: str, min_words: int, identity: float) -> DataFrame:
    names = ["id", "t", "src", "x0", "x1", "y0", "y1", "edits"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            columns = [batch.column(k).to_pylist() for k in range(3, 8)]
            for i, (runs, ax, wa, by, wb) in enumerate(zip(*columns, strict=True)):
                a, b = np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32)
                local = (np.array(runs).reshape(-1, 4) - np.array([ax, ax, by, by])).tolist()
                for x0, x1, y0, y1, edits in aligned(a, b, local, min_words, identity):
                    rows.append(i)
                    found.append((x0 + ax, x1 + ax, y0 + by, y1 + by, edits))
            at = pa.array(rows, pa.int64())
            numbers = [pa.array([f[k] for f in found], pa.int32()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *numbers], names)

    return sides.mapInArrow(trimmed(kernel), f"id {id_type}, t int, src {id_type}, x0 int, x1 int, y0 int, y1 int, edits int")


def _least(min_words: int) -> int:
    """Words that a chain spans at least."""
    return max(K, min_words - 2 * (K + WINDOW))


def _passages(texts: DataFrame, matches: DataFrame, id_type: str, min_words: int, identity: float, gap_cost: float = GAP_COST) -> DataFrame:
    """``(id, t, src, x0, x1, y0, y1, edits)`` of the passages that matches make: chained, and aligned on the words."""
    matches = matches.repartition("id", "t", "src", "st").sortWithinPartitions("id", "t", "src", "st")
    chains = shared_table(_chained(matches, id_type, _least(min_words), gap_cost), "chains")

    needed = chains.select("id", "t").union(chains.select("src", "st")).distinct()
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    arrays = shared_table(texts.join(needed, ["id", "t"], "left_semi").dropDuplicates(["id", "t"]), "words")

    def side_of(first: str, last: str) -> tuple:
        start = F.greatest(F.col(first) - PAD, F.lit(0))
        return start, F.expr(f"substring(w, 4 * greatest({first} - {PAD}, 0) + 1, 4 * ({last} + {PAD} - greatest({first} - {PAD}, 0)))")

    ax, wa = side_of("x0", "x1")
    rows = chains.join(arrays, ["id", "t"]).select("id", "t", "src", "st", "y0", "y1", "runs", ax.alias("ax"), wa.alias("wa"))
    by, wb = side_of("y0", "y1")
    rows = rows.join(arrays.select(F.col("id").alias("src"), F.col("t").alias("st"), "w"), ["src", "st"])
    rows = rows.select("id", "t", "src", "runs", "ax", "wa", by.alias("by"), wb.alias("wb"))
    found = shared_table(_aligned(rows, id_type, min_words, identity), "found")
    drop_shared(chains, arrays)
    return found


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """``(id, start_word, end_word, source_id, source_start, source_end, edits)`` of every repeated passage."""
    small_batches(df)
    spark = df.sparkSession
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    id_type = read.schema["id"].dataType.simpleString()
    hashed = shared_table(_hashed(read, id_type).where(f"n >= {min_words}"), "words")

    # Equal texts fold to one; the light columns alone are grouped.
    groups = hashed.groupBy("digest").agg(F.min("id").alias("src"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = shared_table(groups.select("digest", "src"), "copies")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    copies = hashed.select("id", "n", "digest").join(side, "digest").where("id <> src").distinct()
    whole = copies.select("id", F.lit(0).alias("x0"), F.col("n").alias("x1"), "src", F.lit(0).alias("y0"), F.col("n").alias("y1"), F.lit(0).alias("edits"))
    texts = hashed.join(side, "digest", "left").where("src IS NULL OR id = src").select("id", "t", "w")

    expected = texts.agg(F.sum(F.length("w"))).first()[0] or 0  # four bytes a word, less than one seed a word
    repeated = shared_table(repeated_fingerprints(texts.select("w"), ranges_for(expected // 4), _seed_hashes(min_words)), "fingerprints")
    bitmap = spark.sparkContext.broadcast(_bitmap(repeated))
    drop_shared(repeated)
    seeds = shared_table(_seeds(texts, bitmap, id_type, min_words), "seeds")

    # Sums of primitive columns alone, so that the places of a hot seed fold in hash maps before the shuffle. Both sides
    # of the join are read from tables, so that AQE can split the partition of a hot seed.
    place = F.shiftleft(F.col("t").cast("long"), 32) + F.col("pos")
    first = F.when(~F.col("again"), F.col("id"))
    several = seeds.groupBy("h").agg(F.min("id").alias("src"), F.min_by(place, first).alias("place"), F.count(F.lit(1)).alias("rows"))
    several = shared_table(several.where("rows > 1").select("h", "src", F.shiftright("place", 32).cast("int").alias("st"), F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("y")), "several")
    matches = seeds.join(several, "h").where("id <> src OR t <> st OR pos <> y").select("id", "t", "src", "st", F.col("pos").alias("x"), "y", "n")
    found = _passages(texts, matches, id_type, min_words, identity)
    spans = shared_table(found.groupBy("id", "t").agg(F.collect_list(F.struct("x0", "x1")).alias("spans")), "spans")  # bounded by a text's length
    side = F.broadcast(spans) if found.count() <= BROADCAST_ROWS else spans
    later = shared_table(_later_places(seeds, several, side, min_words), "later")
    maps = spark.sparkContext.broadcast((bitmap.value, _bitmap(later)))
    drop_shared(seeds, several, later)

    matches, read_from = _open_matches(texts, side, maps, id_type, min_words)
    rest = _passages(texts, matches, id_type, min_words, identity, PAIR_GAP_COST)
    drop_shared(spans, *read_from)
    found = found.unionByName(rest)
    # A text's passages are bounded by its length.
    before = Window.partitionBy("id", "t").orderBy("x0", F.desc("x1"), "edits", "src", "y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("reach", F.max("x1").over(before)).where("reach IS NULL OR x1 > reach")
    out = found.select("id", "x0", "x1", "src", "y0", "y1", "edits").unionByName(whole)
    return out.select(
        F.col("id").alias(id_col),
        F.col("x0").alias("start_word"),
        F.col("x1").alias("end_word"),
        F.col("src").alias(f"source_{id_col}"),
        F.col("y0").alias("source_start"),
        F.col("y1").alias("source_end"),
        "edits",
    )
