"""Mixing against its oracle and a plain inversion; the url filter against a plain implementation."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from odweave.llm import mixing, registry, url_filter
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


def test_mixing_oracle(spark):
    compare(registry.op6_mixing(spark, SF), connect(SF), registry.OP6_SQL)


def poisson(u, rate):
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_invert_the_distribution(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(600)] + [(None, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("copy", F.lit("mine"))
    weights = {"a": 1.0, "b": 150.0, None: 2.0}
    out = mixing.mix(df, weights)
    assert out.columns == ["doc_id", "source", "copy", "copy_", "n_copies"]
    got = Counter((r.doc_id, r.source) for r in out.collect())
    sizes = Counter(s for _, s in rows)
    want = Counter()
    for i, s in rows:
        rate = weights[s] / 153 * len(rows) / sizes[s]
        parts = max(1, math.ceil(rate / mixing.RATE_PART))
        for k in range(1, parts + 1):
            u = int(hashlib.md5(f"mix:{k}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
            want[i, s] += poisson(u, rate / parts)
    assert got == +want


def test_mix_meets_target_weights_and_is_shuffled(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 9).cast("string"))).alias("source"))
    rows = mixing.mix(df).collect()
    by = Counter(r.source for r in rows)
    assert all(abs(n - 6000) < 400 for n in by.values()) and len(by) == 10
    assert mixing.mix(df.limit(0)).count() == 0
    first = [r.doc_id for r in rows[:200]]
    assert first != sorted(first)


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2], re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def plain_rule(host, path):
    best = None
    for action, rule in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith(f".{name}")) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return best or (None, None)


def plain_model(train, order):
    """A url's log ratio per character under the interpolated models, by dictionaries."""
    counts, totals = {a: Counter() for a in ("allow", "block")}, {a: Counter() for a in ("allow", "block")}
    for url, action in train:
        text = "\x02" + (url or "")
        for i in range(1, len(text)):
            for k in range(min(order, i) + 1):
                counts[action][text[i - k : i], text[i]] += 1
                totals[action][text[i - k : i]] += 1
    kinds = {a: Counter(ctx for ctx, _ in counts[a]) for a in counts}

    def p(action, ctx, sym):
        lower = p(action, ctx[1:], sym) if ctx else 1 / url_filter.CHARACTERS
        n, t = totals[action][ctx], kinds[action][ctx]
        if ctx and totals["allow"][ctx] + totals["block"][ctx] < url_filter.SUPPORT or n + t == 0:
            return lower
        return (counts[action][ctx, sym] + t * lower) / (n + t)

    def score(url):
        text, out = "\x02" + (url or ""), 0.0
        for i in range(1, len(text)):
            ctx = text[max(0, i - order) : i]
            out += math.log(p("allow", ctx, text[i])) - math.log(p("block", ctx, text[i]))
        return out / max(1, len(text) - 1)

    return score


def random_urls(rng, n):
    host = lambda: f"{rng.choice(['', 'www.', 'm.'])}{rng.choice(['abc', 'xyz', 'q-9', 'пример', 'é'])}.example.{rng.choice(['com', 'net', 'org'])}"
    return [f"http{rng.choice(['', 's'])}://{host()}/{rng.choice(['en', 'es', 'fr'])}/{rng.choice(['?q=', '', '%20', '_'])}{rng.randrange(999)}" for _ in range(n)]


@pytest.mark.parametrize("order, rows_of", [(url_filter.ORDER, "all"), (2, "all"), (url_filter.ORDER, "allow"), (url_filter.ORDER, "block")])
def test_url_filter_equals_plain_models(spark, monkeypatch, order, rows_of):
    rng = random.Random(1)
    urls = random_urls(rng, 150)
    urls += [None, "", "no scheme", "://", "HTTP://WWW.EXAMPLE.COM/en/", "x://com", "x://com/", "x://com?/", "é://É.net/es/\nü#", "a://b://example.com/en/", "z://" + "long/" * 3000]
    if rows_of != "all":
        urls = [u for u in urls if plain_rule(*plain_host_path(u))[1] in (None, rows_of)]
    if order == 2:
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], "y"), (0, urls[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    held = {r.url for r in df.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).select("url").collect()}
    ruled = [(u, plain_rule(*plain_host_path(u))[1]) for _, u, _ in rows]
    plain_score = plain_model([x for x in ruled if x[1] and x[0] not in held], order)
    accepted = sorted(plain_score(u) for u, action in ruled if action == "allow" and u in held)
    threshold = accepted[int(0.05 * (len(accepted) - 1))] if accepted else 0.0
    got = url_filter.judge(df, order=order).collect()
    assert len(got) == len(rows)
    texts = dict(enumerate(urls)) | {None: urls[0]}
    for r in got:
        url = texts[r.page_id]
        assert (r.host, r.path) == plain_host_path(url)
        rule, action = plain_rule(r.host, r.path)
        score = plain_score(url)
        assert r.rule == rule and r.score == pytest.approx(score, abs=1e-4)
        if abs(score - threshold) > 1e-6:
            assert r.verdict == (action or ("allow" if score >= threshold else "block"))
    if order == 2:
        assert url_filter.judge(df.limit(0)).count() == 0


def test_equal_rows_and_null_ids_reach_their_target(spark):
    rows = [(None, f"text {i}", "null") for i in range(3000)] + [(i, "t", "other") for i in range(1000)] + [(7_000, "same", "same")] * 4000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("k"), F.col("text")))
    got = mixing.mix(df, weights={"null": 2, "other": 1, "same": 1})
    per = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(per["null"] / 4000 - 1) < 0.05 and abs(per["other"] / 2000 - 1) < 0.07 and abs(per["same"] / 2000 - 1) < 0.07
    assert got.columns == [*df.columns, "copy", "n_copies"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in mixing.mix(df).where("source = 'same'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)
    copies = mixing.mix(df).where("source = 'null'").groupBy("text").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.countDistinct("copy").alias("d"))
    assert copies.where("n <> m OR n <> d").count() == 0


def test_no_python_in_plans(spark):
    for df in (registry.op4_url_filter(spark, SF), registry.op6_mixing(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
