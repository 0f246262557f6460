"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, html_extract, line_crf, mixing, pii, quality, sentencepieces, simhash, substring_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in seekable bundles, read back."""
    return warc.archived(table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    return pii.found_in(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    return fingerprint.edited_and_next(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether decoding them gives it back."""
    return sentencepieces.encoded(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all documents that stand in other documents too."""
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels are learned outside the held-out fold only."""
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict."""
    docs = table(spark, sf_dir, "documents")
    return line_crf.judged(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def base3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op3_pii that SQL can tell."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4_fingerprints, what SQL can tell: the edited texts and which fingerprints are equal to the next."""
    f = op4_fingerprints(spark, sf_dir)
    return f.select("doc_id", "n_chars", "edited_sha256", (F.col("fingerprint") == F.col("edited_fingerprint")).alias("equal_edited"))


def base8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8_mixing, the sizes and targets."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def base9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9_quality_rules, all but the field's verdict."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_warc, op2_html_extraction, op3_pii, op4_fingerprints, op5_sentencepiece, op6_substring_dedup, op7_quality, op8_mixing, op9_quality_rules, op10_simhash, base3_pii, base4_fingerprints, base8_mixing, base9_quality_rules)}

WORD = "[^\\x20\\x09-\\x0D]+"

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS low FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((((
    (instr('0123456789abcdef', substr(hex, CAST(i * 5 // 4 + 1 AS INT), 1)) - 1) * 16
    + CASE WHEN i * 5 // 4 + 2 > 40 THEN 0 ELSE instr('0123456789abcdef', substr(hex, CAST(i * 5 // 4 + 2 AS INT), 1)) - 1 END)
    >> CAST(3 - (i * 5) % 4 AS INT)) & 31)) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM h
""",
    "base3_pii": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len(list_filter(ip, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || left(ltrim(p, '0'), 4) AS INTEGER) <= 255)))) AS BIGINT) AS n_ip,
  CAST(len(list_filter(card, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, 20), lambda k: CASE WHEN k > length(x) THEN 0
    WHEN k % 2 = 1 THEN CAST(x[CAST(length(x) - k + 1 AS INTEGER)] AS INTEGER) ELSE CAST(x[CAST(length(x) - k + 1 AS INTEGER)] AS INTEGER) * 2 - CASE WHEN x[CAST(length(x) - k + 1 AS INTEGER)] > '4' THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM m
""",
    "base4_fingerprints": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC)) AS following, length(text) AS n_chars FROM t WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, left(text, n_chars - n_chars // 2) || CASE WHEN n_chars < 2 THEN '' ELSE left(following, n_chars // 2) END AS edited FROM n)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, list_sort(string_split(edited, chr(10))) = list_sort(string_split(text, chr(10))) AS equal_edited FROM e
""",
    "base8_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words, 2.0 * sum(size) AS cap, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER w AS k, 1.5 * sum(words) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT min(k) AS k FROM o WHERE rest * weight / open <= cap), r AS (SELECT o.rest, o.open, o.k FROM o JOIN f USING (k))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(words AS BIGINT) AS source_size, CAST(CASE WHEN o.k < r.k THEN cap ELSE r.rest * weight / r.open END AS DOUBLE) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source CROSS JOIN r
""",
    "base9_quality_rules": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM t),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM w), g AS (SELECT doc_id, k, array_to_string(words[k : k + 4], ' ') AS gram FROM i),
a AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1), c AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM a, range(5) AS x(j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(words) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(words) AS base_failed FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
""",
}
