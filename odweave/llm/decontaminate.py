"""Operator 7, benchmark decontamination: pigeonhole pieces, exact hits, Myers' bit-parallel distance.

A test item of m characters may differ in ``k = floor(rate * m)`` edits from the passage that leaks it. Cut into
k + 1 pieces, at least one piece then stands in the passage unchanged. All pieces of all items form one Aho-Corasick
automaton; each hit fixes where the item would start, give or take k, and the windows around the hits are verified with
Myers' bit vectors (one whole-number word as long as the item). So all occurrences within the budget are found, one
after the other without overlap.

The benchmark is read in blocks of about ``BLOCK_CHARS`` characters, which are broadcast: each block's automaton has a
bounded size and is built once in each task of a pass over the documents.

Case folds A-Z, and each white-space character counts as a space; spans are code points of the original text.
Defined cases: NULL and empty texts have no match; NULL, empty and blank items match nothing; equal items all match;
rows with a NULL id are matched like others. Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from odweave.llm.text import clean, small_batches

RATE = 0.05
BLOCK_CHARS = 4_000_000
_FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


def folded(text: str) -> str:
    """Same length as ``text``."""
    return text.translate(_FOLD)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length, with their starts."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """The least edit distance of a pattern to any substring that ends at each position of a text."""

    def __init__(self, pattern: str):
        self.m, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distances(self, text: str) -> Iterator[int]:
        full, top = (1 << self.m) - 1, 1 << self.m - 1
        pv, mv, score = full, 0, self.m
        for c in text:
            eq = self.masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            yield score


class Matcher:
    """All items of a block: finds their occurrences within the error budget."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = []
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = folded(text or "").strip()
            if not text:
                continue
            k = int(rate * len(text))
            for start, piece in pieces(text, k):
                found.setdefault(piece, []).append((len(self.items), start))
            self.items.append((item_id, text, k, Myers(text), Myers(text[::-1])))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def _windows(self, text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Each item that pieces hit, with the stretches of text that hold all its occurrences; they do not overlap."""
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for item, offset in where:
                starts.setdefault(item, set()).add(end + 1 - length - offset)
        for item, found in sorted(starts.items()):
            _, pattern, k, *_ = self.items[item]
            spans: list[list[int]] = []
            for s in sorted(found):
                low, high = max(0, s - k), min(len(text), s + len(pattern) + k)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            yield item, [(low, high) for low, high in spans]

    def matches(self, text: str) -> list[tuple[object, int, int, int]]:
        """``(item id, start, end, distance)`` of all occurrences of the items; those of one item do not overlap.

        From the left, the first end within the budget and the best end up to twice the budget later (the first of equal
        ones) make an occurrence; the search goes on behind it.
        """
        if not self.items or not text:
            return []
        text, out = folded(text), []
        for item, spans in self._windows(text):
            item_id, pattern, k, forward, backward = self.items[item]
            for low, high in spans:
                while low < high:
                    best = None
                    for i, d in enumerate(forward.distances(text[low:high])):
                        if best is None and d <= k:
                            best, last = (d, i), i + 2 * k
                        if best is not None:
                            if i > last:
                                break
                            best = min(best, (d, i))
                    if best is None:
                        break
                    distance, at = best
                    back = text[low : low + at + 1][::-1][: len(pattern) + k]
                    length = next(i + 1 for i, d in enumerate(backward.distances(back)) if d == distance)
                    out.append((item_id, low + at + 1 - length, low + at + 1, distance))
                    low += at + 1
        return out

    def leaks(self, text: str) -> bool:
        """Whether any item occurs."""
        if not self.items or not text:
            return False
        text = folded(text)
        for item, spans in self._windows(text):
            _, _, k, forward, _ = self.items[item]
            if any(d <= k for low, high in spans for d in forward.distances(text[low:high])):
                return True
        return False


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items, in blocks of bounded size."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("trim(text) <> ''")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(-(-chars // BLOCK_CHARS)) or 1
    for i in range(n):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else items
        yield [(r["id"], r["text"]) for r in block.collect()]


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", rate: float = RATE
) -> DataFrame:
    """``(id, item id, start, end, distance)`` of every passage of a document that leaks a test item."""
    small_batches(documents)
    id_type, item_type = documents.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, `{item_col}` {item_type.simpleString()}, start int, `end` int, distance int"
    read = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_arrow = to_arrow_type(item_type)

    def scan(items: list[tuple[object, str]]) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(clean(batch.column(1)).to_pylist()):
                    own = matcher.matches(text)
                    rows += [i] * len(own)
                    found += own
                if found:
                    item, start, end, distance = zip(*found, strict=True)
                    columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, item_arrow), *(pa.array(x, pa.int32()) for x in (start, end, distance))]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, item_col, "start", "end", "distance"])

        return read.mapInArrow(kernel, schema)

    out = None
    for items in _blocks(benchmark, id_col=item_col, text_col=text_col):
        out = scan(items) if out is None else out.unionByName(scan(items))
    return out


def clean_rows(documents: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``documents`` that leak no test item, with all their columns."""
    small_batches(documents)
    out = documents
    for items in _blocks(benchmark, id_col=item_col, text_col=text_col):
        out = out.where(~_leaks(out.sparkSession.sparkContext.broadcast(items), rate)(F.col(f"`{text_col}`")))
    return out


def _leaks(items: Broadcast, rate: float):
    built: list[Matcher] = []  # the function is unpickled once a task, so the automaton is built once a task

    def kernel(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Matcher(items.value, rate))
        return pa.array([built[0].leaks(t) for t in clean(texts).to_pylist()], pa.bool_())

    return F.arrow_udf(kernel, "boolean")
