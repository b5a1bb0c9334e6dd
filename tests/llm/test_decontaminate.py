import random

from odweave.llm import decontaminate as d


def least_distance(pattern, text):
    """The plain dynamic programme: least edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        nxt = [i]
        for j, c in enumerate(text, 1):
            nxt.append(min(row[j - 1] + (p != c), row[j] + 1, nxt[-1] + 1))
        row = nxt
    return min(row)


def edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        at, kind = rng.randrange(len(s)), rng.choice("sid")
        if kind == "s":
            s[at] = rng.choice("abcxyz")
        elif kind == "i":
            s.insert(at, rng.choice("abcxyz"))
        else:
            del s[at]
    return "".join(s)


def test_myers_equals_dynamic_programme():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert min(d.Myers(p).distances(t), default=len(p)) >= least_distance(p, t)
        assert min([len(p), *d.Myers(p).distances(t)]) == least_distance(p, t)


def test_finds_every_occurrence_within_budget(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(20)]
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(40))
        if i % 2:
            item = rng.choice(items)[1]
            text = f"{text} {edited(rng, item, rng.randrange(0, 12)).upper()}\n{text[::-1]}"
        rows.append((i, text))
    got = d.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, text in rows:
        for j, item in items:
            k = int(d.RATE * len(item))
            if least_distance(item, d.folded(text)) <= k:
                want.add((i, j))
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20
    texts, names = dict(rows), dict(items)
    for r in got:
        assert least_distance(names[r.item_id], d.folded(texts[r.doc_id])[r.start : r.end]) == r.distance


def distances(pattern, text):
    """The plain programme: least distance of the pattern to any substring that ends behind each character."""
    column, out = list(range(len(pattern) + 1)), []
    for c in text:
        nxt = [0]
        for i, p in enumerate(pattern, 1):
            nxt.append(min(column[i - 1] + (p != c), column[i] + 1, nxt[-1] + 1))
        column = nxt
        out.append(column[-1])
    return out


def brute_occurrences(pattern, text, k):
    """One after the other over the whole text: the best end up to 2 k behind the first one within the budget."""
    out, low = [], 0
    while True:
        ends = distances(pattern, text[low:])
        first = next((i for i, x in enumerate(ends) if x <= k), None)
        if first is None:
            return out
        at = min(range(first, min(len(ends), first + 2 * k + 1)), key=lambda i: (ends[i], i))
        start = max(s for s in range(at + 2) if distances(pattern, text[low + s : low + at + 1])[-1:] == [ends[at]] and min(distances(pattern[::-1], text[low + s : low + at + 1][::-1])) == ends[at])
        out.append((low + start, low + at + 1, ends[at]))
        low += at + 1


def test_positions_equal_a_search_of_the_whole_text():
    rng = random.Random(9)
    for _ in range(150):
        item = "".join(rng.choice("ab ") for _ in range(rng.randrange(5, 12))) * rng.randrange(1, 5)
        item = (d.folded(item).strip() or "ab") + "cdc"
        text = "".join(rng.choice([item, edited(rng, item, 1), edited(rng, item, 2), "abc", " ", "bb"]) for _ in range(rng.randrange(0, 7)))
        matcher = d.Matcher([(1, item)], 0.15)
        want = brute_occurrences(item, text, int(0.15 * len(item)))
        assert [m[1:] for m in matcher.matches(text)] == want
        assert matcher.leaks(text) == bool(want)


def test_periodic_item_three_times():
    item = "abcabcabc " * 6
    matcher = d.Matcher([(1, item)], d.RATE)
    assert [m[1:] for m in matcher.matches(item * 3)] == [(60 * i, 60 * i + 59, 0) for i in range(3)]


def test_edge_cases(spark, monkeypatch):
    long = "x" * 300_000 + " the quick brown fox jumps over the lazy dog again and again " + "y" * 300_000
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, long, 0), (3, "clean text", 0), (3, item, 0), (3, item, 0)], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, None, 1), (10, "  ", 1), (None, "zzzz", 1)], "item_id long, text string, distance int")
    for chars in (d.BLOCK_CHARS, 50):
        monkeypatch.setattr(d, "BLOCK_CHARS", chars)
        got = sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.distance) for r in d.contamination(docs, bench).collect())
        assert got == [(0, i, 300_001, 300_060, 0) for i in (7, 8)] + sorted([(3, i, 0, 59, 0) for i in (7, 8)] * 2)
        kept = d.clean_rows(docs, bench)
        assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == ["", "", "clean text"]
    assert d.contamination(docs, bench.limit(0)).count() == 0 and d.clean_rows(docs.limit(0), bench).count() == 0
