"""The registered queries of the training-data operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, language_id, licenses, lines, media, mixing, prefix_trie, repeats, secrets, sentence_pieces, simhash, surrogates

#: Of a deployment's own choosing; surrogates cannot be traced back without it.
PII_KEY = "example-key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, plan = mixing.mix(documents(spark, sf_dir))
    mixed = mixing.with_copies(sizes, plan)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language_id.held_out()
    model = language_id.fit(docs.where(~held))
    return language_id.with_language(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(documents(spark, sf_dir))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(documents(spark, sf_dir))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("detections")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_secret_scan, op4_language_id, op5_sentence_pieces, op6_surrogates, op7_repeated_bytes, op8_fuzzy_lines, op9_media, op10_simhash, op11_prefix_trie, op12_source_audit, op13_license_scan)}

ORACLES = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
""",
    "op2_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sums
), filled AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER b, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest
  FROM weighted WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (SELECT *, 4 * source_size * rest <= lft * weight AS at_cap FROM filled),
lvl AS (SELECT lft, rest FROM marked WHERE NOT at_cap ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN at_cap THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (CAST((SELECT lft FROM lvl) AS DOUBLE) / CAST(2 * (SELECT rest FROM lvl) AS DOUBLE)) END AS target FROM marked
), drawn AS (
  SELECT s.*, t.source_size, t.target, least(2.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS e,
    CAST(CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), split AS (SELECT *, floor(e) AS whole, e - floor(e) AS p FROM drawn),
odds AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q FROM split),
ordered AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, target - whole * source_size AS need FROM odds)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN p > 0 AND 2 * upto - size < 2 * need THEN 1 ELSE 0 END) * size AS BIGINT) AS taken, source,
  CAST(whole + CASE WHEN p > 0 AND 2 * upto - size < 2 * need THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM ordered
""",
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS b,
    -- CRC-32 of the decimal id, bit by bit: a byte is xored in, then eight shifts (-1) follow
    CAST(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 4 AS INTEGER) AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (SELECT c.conv_id, 0 AS own, o.nth, o.role, o.text FROM c JOIN o ON o.conv_id = c.b AND o.nth <= c.h
  UNION ALL SELECT c.conv_id, 1, o.nth, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.nth > c.h),
r AS (SELECT conv_id, row_number() OVER w AS i, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY own, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path,
    CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words, count(*) OVER (PARTITION BY conv_id) AS len FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, nth)
  UNION ALL SELECT c.conv_id, 0, '', 0, (SELECT count(*) FROM parts p WHERE p.conv_id = c.conv_id) FROM c),
n AS (SELECT path, min(conv_id) AS conv_id, min(i) AS depth, count(*) AS n_convs, min(words) AS words,
    coalesce(string_agg(CASE WHEN i = len THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM r GROUP BY path),
f AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND starts_with(k.path, n.path)) AS n_children FROM n LEFT JOIN n p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)),
s AS (SELECT a.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((b.n_convs - 1) * b.words) AS saved FROM f a JOIN f b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM f JOIN s USING (path)
""",
    "op12_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(list_prepend(NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM d WHERE term IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) >= 10),
vocab AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n_lang), 0) AS n_all FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
c AS (SELECT g.lang, g.source, k.term, k.n_lang, count(d.term) AS n FROM g JOIN kept k USING (lang) LEFT JOIN d ON d.lang = g.lang AND d.source = g.source AND d.term = k.term GROUP BY ALL),
p AS (SELECT c.*, CAST(1 + 1000000000::HUGEINT * (n + 2) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + 2 * v) AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (n_lang + 2) // (CAST(n_all AS HUGEINT) + 2 * v) AS BIGINT) AS q FROM c JOIN vocab USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS s FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(s, 0) AS BIGINT) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
""",
}
