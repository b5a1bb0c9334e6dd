"""The queries of the operators in this subpackage, by name, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from odweave.llm import chaining, decontaminate, exact_dedup, minhash, mixing, pii, quality, secrets, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(_table(spark, sf_dir, "documents"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, similarity=0.8)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))

#: One Poisson part a source, which holds while rates are at most 32; the thresholds are summed up to 72 copies.
OP6_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c)::DOUBLE * n) AS rate FROM c),
d AS (
  SELECT documents.*, r.rate,
    ('0x' || substr(md5('mix:1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
t AS (
  SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cut FROM (
    SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 73) AS g(k))),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
    (SELECT count(*) FROM t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cut <= d.u)::INT AS n_copies FROM d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1))::INT AS copy, n_copies FROM n WHERE n_copies > 0
"""

#: All pairs that share a shingle, by brute force.
OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.id)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept
FROM documents JOIN r ON r.id = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_pii": op3_pii,
        "op4_url_filter": op4_url_filter,
        "op5_quality_gam": op5_quality_gam,
        "op6_mixing": op6_mixing,
        "op7_decontaminate": op7_decontaminate,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_mixing": OP6_SQL, "op8_minhash_near_dedup": OP8_SQL}
