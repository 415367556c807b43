"""The corpus operators as queries over the test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import chunks, classifier, divergence, fingerprints, mixing, neardup, quality, runs, secrets, sharding, simhash, tokens, warc
from geoloom.llm.common import read_table


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good."""
    return read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights = quality.bucket_weights(docs, trusted_ids(spark, sf_dir))
    return quality.judge_by_labels(docs.select("doc_id", "text"), weights, read_table(spark, sf_dir, "labels"), ["doc_id", *quality.MEASURES, "kept"])


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op9_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica in which every 97th page is damaged."""
    pages = read_table(spark, sf_dir, "pages")
    return warc.audit(warc.archive(pages), warc.archive(warc.damaged(pages)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_audit(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_spotsigs": op1_spotsigs,
    "op2_secret_scans": op2_secret_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_source_mix": op8_source_mix,
    "op9_fixity_audit": op9_fixity_audit,
    "op10_sharding": op10_sharding,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

#: Sizes in bytes of UTF-8 and the layout of records are plain SQL; `chr(13) || chr(10)` ends a line.
OP9_SQL = """
WITH laid AS (
  SELECT page_id, CAST(floor(page_id / 512.0) AS BIGINT) AS file,
         'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e
         || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e AS head,
         coalesce(html, '') AS body, e || e AS tail, page_id % 97 = 13 AND length(html) > 0 AS hit
  FROM pages, (SELECT chr(13) || chr(10) AS e)
), records AS (
  SELECT *, sha256(head || body || tail) AS digest, strlen(head || body || tail) AS length,
         'WARC/1.1' AS version, CASE WHEN hit THEN '?' || substr(body, 2) ELSE body END AS replica_body
  FROM laid
), placed AS (
  SELECT *, row_number() OVER w - 1 AS record_no, CAST(sum(length) OVER w - length AS BIGINT) AS record_offset
  FROM records WINDOW w AS (PARTITION BY file ORDER BY page_id)
), replica AS (
  SELECT page_id, replace(head, 'Content-Length: ' || strlen(body), 'Content-Length: ' || strlen(replica_body)) || replica_body || tail AS bytes FROM placed
), shifted AS (
  SELECT page_id, sha256(bytes) AS other, sum(strlen(bytes)) OVER (PARTITION BY CAST(floor(page_id / 512.0) AS BIGINT) ORDER BY page_id) AS other_end, strlen(bytes) AS other_length FROM replica
)
SELECT p.page_id, p.file, p.record_no, p.record_offset, p.length, p.digest,
       p.digest = s.other AND p.record_offset = s.other_end - s.other_length AS intact,
       CASE WHEN NOT (p.digest = s.other AND p.record_offset = s.other_end - s.other_length) THEN s.other END AS found_digest
FROM placed p JOIN shifted s USING (page_id)
"""

#: The water level of the targets, and a running sum along the ranks in place of the histogram.
OP8_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, avg(size) AS mean_size,
         [5.0e0, 2.0e0, 1.0e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source
), risen AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER w AS at_,
         (1.5e0 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST)
), lev AS (
  SELECT arg_min(level, at_) AS level FROM risen WHERE level <= cap / weight
), targets AS (
  SELECT source, source_size, mean_size, CASE WHEN lev.level IS NULL THEN cap ELSE least(cap, lev.level * weight) END AS target FROM risen, lev
), shares AS (
  SELECT *, floor(target / source_size) AS whole, target / source_size - floor(target / source_size) AS rest, target - floor(target / source_size) * source_size AS need FROM targets
), ranked AS (
  SELECT d.doc_id, d.size, s.*, (CAST('0x' || substr(md5('mix:' || d.doc_id), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656.0e0 AS u
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
), ordered AS (
  SELECT *, CASE WHEN rest > 0 AND size > 0 THEN u / (1 - u) / (rest / (1 - rest) * greatest(0.5e0, least(2.0e0, size / mean_size))) END AS rank FROM ranked
), along AS (
  SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM ordered
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(size * (whole + CASE WHEN rank IS NOT NULL AND before < need AND 2 * (need - before) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM along
"""

#: A table of CRC-32 by byte, then one step a digit; runs are islands of words that are equal q places apart.
OP12_SQL = """
WITH RECURSIVE bits(b, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc(doc_id, s, i, c) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), 0, 4294967295 FROM documents
  UNION ALL SELECT doc_id, s, i + 1, xor(crc.c >> 8, bits.c) FROM crc JOIN bits ON k = 8 AND b = xor(crc.c & 255, ascii(s[i + 1])) WHERE i < length(s)
), drawn AS (
  SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE i = length(s)
), worded AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents JOIN drawn USING (doc_id)
), tailed AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) ELSE len(w) END AS a FROM worded
), asked AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM tailed
), tokens AS (
  SELECT doc_id, i, n, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM asked)
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, s, m, min(q) AS q FROM islands GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m / CAST(q AS DOUBLE) DESC, s, q) AS place FROM runs
), said AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         max(s) FILTER (WHERE place = 1) AS "start", max(m) FILTER (WHERE place = 1) AS length, max(q) FILTER (WHERE place = 1) AS period FROM ranked GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM tokens ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, "start", length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Every term of every pair of sources, one by one.
OP13_SQL = """
WITH plain AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), each AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, source, unnest(terms) AS term FROM plain) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS n FROM each GROUP BY ALL HAVING sum(docs) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(e.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM plain) g
  LEFT JOIN (SELECT each.* FROM each SEMI JOIN kept USING (lang, term)) e ON e.lang = g.lang AND e.source = g.source GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(e.n, 0) AS n, 1 + 1000000000 * CAST(coalesce(e.n, 0) + 5 AS HUGEINT) // (g.total + 5 * v) AS p, 1 + 1000000000 * CAST(k.n + 5 AS HUGEINT) // (l.total + 5 * v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN each e ON e.lang = g.lang AND e.source = g.source AND e.term = k.term
), costs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(c.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN costs c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR place <= 50
"""

ORACLE_SQL: dict[str, str] = {"op8_source_mix": OP8_SQL, "op9_fixity_audit": OP9_SQL, "op12_periodic_runs": OP12_SQL, "op13_source_divergence": OP13_SQL}
