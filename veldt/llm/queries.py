"""The registered queries of the training-data operators and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import decontaminate, mixing, quality_rules, sharding, simhash, substring_dedup, suffix_array, token_counts, toxicity, warc
from veldt.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids name records: rows that repeat the least id of a payload are all its response."""
    folder, _ = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count(docs, token_counts.seeded_edits(F.col("doc_id"), F.col("text")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("k")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", quality_rules.metrics(F.col("text")).alias("m"))
    m = F.col("m")
    return rows.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality_rules.base_failed(m).alias("base_failed"),
        (~quality_rules.base_failed(m) & quality_rules.verdict(m)).alias("kept"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {}

ORACLE["op2_suffix_array_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS s FROM documents),
g AS (
  SELECT rid, i, md5_number(substr(s, 2 * i + 1, 400)) AS h
  FROM (SELECT rid, s, unnest(range(0, length(s) // 2 - 199)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
q AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM r),
m AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM q),
f AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM m GROUP BY rid, run),
e AS (SELECT rid, a, b, coalesce(lead(a) OVER (PARTITION BY rid ORDER BY a), 1073741824) AS next FROM f),
k AS (
  SELECT rid, sum(b - a)::BIGINT AS removed, count(*)::BIGINT AS spans, min(a) AS first,
         string_agg(substr(s, 2 * b + 1, 2 * (next - b)), '' ORDER BY a) AS tail
  FROM e JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(s) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN first IS NULL THEN s ELSE substr(s, 1, 2 * first) || tail END)) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

ORACLE["op3_substring_dedup"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
g AS (
  SELECT rid, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, i AS a, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 35) AS b FROM r),
x AS (SELECT rid, sum(least(b - a, 35))::BIGINT AS n FROM p GROUP BY rid),
o AS (SELECT rid, unnest(range(a, least(b, a + 35))) AS i FROM p),
k AS (
  SELECT u.rid, string_agg(u.x, ' ' ORDER BY u.i) AS kept
  FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) u
  LEFT JOIN o ON o.rid = u.rid AND o.i = u.i WHERE o.i IS NULL GROUP BY u.rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (rid) LEFT JOIN k USING (rid)
"""

ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first,
         list_transform(range(0, 8), lambda k: ('0x' || substr(h, 5 * k + 1, 5))::BIGINT) AS bits
  FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((bits[1 + k // 4] // [32768, 1024, 32, 1][1 + k % 4]) % 32)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

ORACLE["op1_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap,
         1.5 * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS room,
         (sum(weight) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights
  FROM s),
g AS (SELECT *, weight * room >= cap * weights AS clamped FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN clamped OR NOT EXISTS (SELECT 1 FROM g WHERE NOT clamped) THEN cap
              ELSE weight * (SELECT room FROM g WHERE NOT clamped ORDER BY weights DESC LIMIT 1) / (SELECT weights FROM g WHERE NOT clamped ORDER BY weights DESC LIMIT 1) END AS target
  FROM g),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole,
         round(e.target)::BIGINT - e.whole * e.source_size AS extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken
FROM r
"""


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    checks = []
    for rule in quality_rules.DEFAULT_RULES:
        checks += [f"{rule.metric} >= {rule.low}"] * (rule.low is not None) + [f"{rule.metric} <= {rule.high}"] * (rule.high is not None)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
l AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g),
q AS (SELECT rid, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words
  FROM d JOIN l USING (rid) LEFT JOIN q USING (rid)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS mean_word_chars,
         coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) AS symbol_ratio,
         coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_ratio,
         coalesce(n_stop_words / nullif(n_words, 0)::DOUBLE, 0) AS stop_word_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(checks)} AS kept
FROM v
"""


ORACLE["op10_quality_rules"] = _quality_sql()
