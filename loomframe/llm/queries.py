"""The queries of this subpackage, each with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import decontaminate, langid, licences, mixing, neardup, pii, ppm, quality, secretscan, tokencount


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.group(_table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(_table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(leaks)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key of spark.loomframe.pseudonym.key; one without secrecy where that is unset, as in tests."""
    key = spark.conf.get("spark.loomframe.pseudonym.key", None) or "no secret"
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_language_id,
        op3_licence_scan,
        op4_near_duplicates,
        op5_lm_scores,
        op6_secret_scan,
        op7_decontamination,
        op8_quality_rules,
        op9_pseudonyms,
        op10_token_counts,
    )
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACE}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
             ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS ss FROM w),
x AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least_b FROM r GROUP BY a)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, coalesce(least(s.doc_id, m.least_b), s.doc_id) AS component_id,
       coalesce(least(s.doc_id, m.least_b), s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN m ON m.a = s.doc_id""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM p),
v AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, v.k, item_id FROM v JOIN p ON v.k = p.k AND v.g = p.g),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_quality_rules": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {_SPACE})) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(ls) AS raw FROM d),
n AS (SELECT doc_id, source, t, len(regexp_extract_all(raw, {_SPACE})) AS words,
             {_LOW.replace("coalesce(text, '')", f"array_to_string(regexp_extract_all(raw, {_SPACE}), ' ')")} AS line FROM l),
hosts AS (SELECT source, greatest(30.0, 0.02 * count(DISTINCT t)) AS most FROM d GROUP BY source),
f AS (SELECT n.source, line FROM n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, line, most HAVING count(DISTINCT t) > most),
gone AS (SELECT doc_id, sum(words) AS k FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line GROUP BY doc_id),
b AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.k, 0) AS k
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - k >= 0.5 * n_words AS kept FROM b""",
}
