"""Operator 4, URL filter: rules on host and path, and a character language-model ratio, in SQL functions only.

Rules decide the urls they fit (the longest rule wins). The others are judged by two smoothed variable-order Markov
models over characters, one of accepted and one of rejected urls: the verdict compares the log-likelihood difference
per character with a calibrated threshold.

* Training urls are those that rules decide. All of them are counted (nothing is sampled), but for one in five, by a
  hash of the url, which is left for calibration: the threshold is the quantile of the accepted ones' scores that
  lets ``RECALL`` of them pass, read off the running counts of their values.
* Characters are taken as they are, in every script. Counts are kept for all contexts of up to ``ORDER`` characters that
  stand ``SUPPORT`` times in the training urls, so the tables grow with them. Every order is interpolated with the next
  shorter one (Witten-Bell); a context that is not kept falls back to its longest suffix that is.
* A character's log ratio is a sum over orders: what each kept context adds to the ratio of the next shorter one, by
  the character if it was seen there, else by the weight that the context leaves to shorter ones. So a url's score is a
  plain sum over its (context, character) pairs, which meet the tables by 64-bit hashes. The tables are broadcast up to
  ``BROADCAST_ROWS``, and the sums fold on the map side; beyond, the pairs are added up by url first and then shuffled.

Distinct urls are scored once. Defined cases: NULL urls and urls without ``://`` have an empty host and path and fit no
rule; an empty url scores 0; without accepted or without rejected training urls the models are equal where one is
missing, and without accepted calibration urls the threshold is 0; very long urls are scored whole; repeated rows are
judged alike; only id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators.iterate import shared_table
from odweave.operators.windows import value_counts

#: (action, rule); a rule is its host, a slash, and the rest of the path's start.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
ORDER, RECALL = 5, 0.95
#: How often a context stands in the training urls at least.
SUPPORT = 4
#: Characters that any could be, for the order below none.
CHARACTERS = 1 << 16
BROADCAST_ROWS = 1_000_000
#: Pairs of context and character that one task scores.
TASK_PAIRS = 1_000_000
#: Stands before a url's first character.
_START = "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for NULL and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and action; NULL if none does."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def _grams(url: Column, order: int) -> Column:
    """``(ctx, sym)`` of every character and every context of up to ``order`` characters before it."""
    padded = F.concat(F.lit(_START), url)
    at = lambda i, k: F.struct(F.substr(padded, i + 1 - k, k).alias("ctx"), F.substr(padded, i + 1, F.lit(1)).alias("sym"))
    pairs = lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(order), i)), lambda k: at(i, k))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(url)), pairs))


def _key(*parts: str) -> Column:
    return F.xxhash64(*parts)


def log_ratios(labelled: DataFrame, order: int, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Tables ``(key, add)`` of kept contexts with a character seen there, and ``(key, leave)`` of kept contexts, from
    rows ``(url, action)``: what each adds to the log ratio of the next shorter context."""
    yes, no = (F.sum(F.when(F.col("action") == a, 1).otherwise(0)) for a in ("allow", "block"))
    rows = labelled.where("url <> ''").select("action", F.explode(_grams(F.col("url"), order)).alias("g"))
    counts = shared_table(rows.groupBy("g.ctx", "g.sym").agg(yes.alias("yes"), no.alias("no")), "grams")
    sums = [F.sum(c).alias(f"n_{c}") for c in ("yes", "no")] + [F.sum((F.col(c) > 0).cast("int")).alias(f"t_{c}") for c in ("yes", "no")]
    contexts = shared_table(counts.groupBy("ctx").agg(*sums).where((F.col("n_yes") + F.col("n_no") >= support) | (F.col("ctx") == "")), "contexts")
    kept = shared_table(counts.join(contexts, "ctx"), "kept")

    def mixed(c: str, shorter: Column) -> Column:
        seen = F.col(f"n_{c}") + F.col(f"t_{c}")
        return F.when(seen > 0, (F.col(c) + F.col(f"t_{c}") * shorter) / seen).otherwise(shorter)

    def left(c: str) -> Column:
        return F.when(F.col(f"n_{c}") > 0, F.col(f"t_{c}") / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(1.0)

    every, below = None, None
    for k in range(order + 1):
        own = kept.where(F.char_length("ctx") == k)
        if below is None:
            own = own.withColumn("b_yes", F.lit(1 / CHARACTERS)).withColumn("b_no", F.lit(1 / CHARACTERS))
        else:  # whatever stands in a context stands in its suffix, too
            own = own.withColumn("suffix", F.substr("ctx", F.lit(2), F.lit(k))).join(below, ["suffix", "sym"])
        own = own.withColumns({"p_yes": mixed("yes", F.col("b_yes")), "p_no": mixed("no", F.col("b_no"))})
        own = shared_table(own.select("ctx", "sym", "p_yes", "p_no", (F.log("p_yes") - F.log("p_no") - F.log("b_yes") + F.log("b_no")).alias("add")), "order")
        every = own if every is None else every.unionByName(own)
        below = own.select(F.col("ctx").alias("suffix"), "sym", F.col("p_yes").alias("b_yes"), F.col("p_no").alias("b_no"))
    return every.select(_key("ctx", "sym").alias("key"), "add"), contexts.select(_key("ctx").alias("key"), (F.log(left("yes")) - F.log(left("no"))).alias("leave"))


def scored(urls: DataFrame, tables: tuple[DataFrame, DataFrame], order: int) -> DataFrame:
    """``(url, score)`` of each distinct url: its log-likelihood difference per character, rounded to 9 digits."""
    numbered = shared_table(urls.where("url <> ''").select("url").distinct().withColumn("n", F.monotonically_increasing_id()), "urls")
    size = numbered.agg(F.sum(F.char_length("url"))).first()[0] or 0  # few bytes of urls make many pairs, so they are dealt out
    dealt = numbered.repartition(max(1, -(-size * (order + 1) // TASK_PAIRS)), "n")
    pairs = dealt.select("n", F.explode(_grams(F.col("url"), order)).alias("g")).select("n", _key("g.ctx", "g.sym").alias("key"), _key("g.ctx").alias("at"))
    adds, leaves = (shared_table(t, "model") for t in tables)
    if adds.count() <= BROADCAST_ROWS:
        adds, leaves = F.broadcast(adds), F.broadcast(leaves)
    else:
        pairs = pairs.groupBy("n", "key", "at").agg(F.count(F.lit(1)).alias("m"))
    rows = pairs.join(adds, "key", "left").join(leaves.withColumnRenamed("key", "at"), "at", "left")
    value = F.coalesce("add", "leave", F.lit(0.0)) * (F.col("m") if "m" in pairs.columns else F.lit(1))
    sums = rows.groupBy("n").agg(F.sum(value.cast("decimal(28,12)")).cast("double").alias("total"))
    return numbered.join(sums, "n").select("url", F.round(F.col("total") / F.char_length("url"), 9).alias("score"))


def fit(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER, recall: float = RECALL) -> tuple[tuple[DataFrame, DataFrame], float]:
    """Tables of the models, and the threshold."""
    rows = pages.select(F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("action", fitting_rule(host, path, rules)["action"]).where("action IS NOT NULL")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    tables = tuple(shared_table(t, "model") for t in log_ratios(rows.where(~F.col("held")), order))
    calibration = rows.where(F.col("held") & (F.col("action") == "allow")).select("url")
    values = value_counts(calibration.join(scored(calibration, tables, order), "url"), "score", descending=False)
    place = int((1 - recall) * max(0, (values.agg(F.sum("n")).first()[0] or 0) - 1))
    threshold = values.where((F.col("before") <= place) & (F.col("before") + F.col("n") > place)).select("v").first()
    return tables, float(threshold[0]) if threshold else 0.0


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER, recall: float = RECALL) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every url."""
    tables, threshold = fit(pages, url_col, rules, order, recall)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(scored(rows, tables, order), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", by_model).alias("verdict"), F.round("score", 4).alias("score")
    )
