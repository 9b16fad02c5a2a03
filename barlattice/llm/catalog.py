"""Queries op1 to op10 over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.llm import (bpe, exact_dedup, html_main, license_scan, line_dedup, media, merkle, mixing, pii, quality, resample, secret_scan,
                            shingle_join)
from barlattice.llm.common import table, written

QueryFn = Callable[[SparkSession, str], DataFrame]

#: Where the tokenizer file is; set it to use another.
TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_columns(media.media_column(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.n_words("text").alias("words")))
    mixed = mixing.mix(sized, source="source", row_id="doc_id", size="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_columns(bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER_FILE, decoded=True))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
             (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER below, 0)) /
             (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
      FROM w WINDOW below AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             least(cap, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.digest) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
             CAST('0x' || substr(md5('7:' || coalesce('0' || source, '1')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS offs
      FROM r)
SELECT doc_id, size, source_size, target,
       CAST(floor(rank * rate + offs) - floor((rank - 1) * rate + offs) AS BIGINT) * size AS taken FROM o
"""

QUERIES: dict[str, QueryFn] = {
    "op3_media_columns": op3_media_columns,
    "op6_exact_dedup": op6_exact_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_bpe": op10_bpe,
}
SQL: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op9_source_mix": OP9_SQL}


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked_components(table(spark, sf_dir, "documents"))


QUERIES["op8_jaccard_join"] = op8_jaccard_join


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(table(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.find(table(spark, sf_dir, "documents")))


QUERIES["op1_pii"] = op1_pii
QUERIES["op7_secrets"] = op7_secrets


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op4_quality"] = op4_quality


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


QUERIES["op5_main_text"] = op5_main_text


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_summary(table(spark, sf_dir, "documents"))


QUERIES["op2_line_dedup"] = op2_line_dedup


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest_columns(license_scan.find(table(spark, sf_dir, "documents")))


QUERIES["op11_licenses"] = op11_licenses


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_columns(docs: DataFrame) -> DataFrame:
    """Digests of the proofs, and whether each row proves itself; rows that were tampered with do not."""
    found = merkle.manifest(docs, carry=merkle.tampered_leaf())
    folded = merkle.folded(F.coalesce("carry", "leaf"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_sha256(F.col("proof")).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_columns(table(spark, sf_dir, "documents"))


QUERIES["op12_resample"] = op12_resample
QUERIES["op13_merkle"] = op13_merkle

#: CRC-32 by table: (i, c) for the byte i.
CRC_TABLE_SQL = """
bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT i, c FROM bits WHERE k = 8)"""

OP12_SQL = r"""
WITH RECURSIVE """ + CRC_TABLE_SQL + r""",
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
words AS (SELECT side, r, doc_id, regexp_extract_all(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
names AS (SELECT DISTINCT f FROM feats),
crc(f, hexed, k, reg) AS (SELECT f, hex(f), 0, 4294967295 FROM names
  UNION ALL SELECT f, hexed, k + 1, xor(reg >> 8, c) FROM crc JOIN crc_table
    ON i = xor(reg, CAST('0x' || substr(hexed, 2 * k + 1, 2) AS BIGINT)) & 255 WHERE 2 * k < length(hexed)),
buckets AS (SELECT f, xor(reg, 4294967295) % 10000 AS b FROM crc WHERE 2 * k = length(hexed)),
used AS (SELECT side, r, b FROM feats JOIN buckets USING (f)),
uses AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM used GROUP BY b),
total AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM uses),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS g FROM uses, total),
weights AS (SELECT r, count(*) AS n_features, floor(sum(g) / count(*)) AS weight FROM used JOIN gain USING (b) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ranked
"""

_ENCODED = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_ENCODED.format(f) for f in merkle.FIELDS)
OP13_SQL = """
WITH RECURSIVE """ + CRC_TABLE_SQL + """,
crc(id, s, k, reg) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT id, s, k + 1, xor(reg >> 8, c) FROM crc JOIN crc_table ON i = xor(reg, ascii(substr(s, k + 1, 1))) & 255 WHERE k < length(s)),
marked AS (SELECT id FROM crc WHERE k = length(s) AND xor(reg, 4294967295) % 7 = 0),
hashed AS (SELECT doc_id, lang, sha256(""" + _LEAF + """) AS leaf, CASE WHEN id IS NOT NULL THEN sha256(""" + _LEAF.replace(
    "n_chars::", "(n_chars + 1)::") + """) ELSE sha256(""" + _LEAF + """) END AS shown
  FROM documents LEFT JOIN marked ON doc_id = id),
leaves AS (SELECT *, coalesce('0' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM hashed),
lower(tree, level, idx, h, n) AS (SELECT tree, 0, idx, leaf, n FROM leaves
  UNION ALL SELECT tree, any_value(level) + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2)
    FROM lower WHERE n > 1 GROUP BY tree, idx // 2),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM lower WHERE n = 1),
upper(level, idx, h, n) AS (SELECT 0, idx, h, n FROM subroots
  UNION ALL SELECT any_value(level) + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2)
    FROM upper WHERE n > 1 GROUP BY idx // 2),
nodes AS (SELECT tree, level, idx, h FROM lower UNION ALL SELECT NULL, level, idx, h FROM upper),
climb(doc_id, leaf, own, tree, level, idx, n, sibs, h, step) AS (
  SELECT l.doc_id, l.leaf, l.tree, l.tree, 0, l.idx, l.n, '', l.shown, 0 FROM leaves l
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own, CASE WHEN c.n = 1 THEN NULL ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.n = 1 THEN s.idx ELSE c.idx // 2 END, CASE WHEN c.n = 1 THEN s.n ELSE (c.n + 1) // 2 END,
    CASE WHEN c.n = 1 THEN c.sibs ELSE c.sibs || coalesce(b.h, '') END,
    CASE WHEN c.n = 1 THEN c.h WHEN c.idx % 2 = 1 THEN sha256(b.h || c.h) ELSE sha256(c.h || coalesce(b.h, '')) END, c.step + 1
  FROM climb c LEFT JOIN nodes b ON b.tree IS NOT DISTINCT FROM c.tree AND b.level = c.level AND b.idx = xor(c.idx, 1::BIGINT)
    LEFT JOIN subroots s ON c.n = 1 AND s.tree = c.tree
  WHERE c.n > 1 OR c.tree IS NOT NULL),
ended AS (SELECT * FROM climb WHERE tree IS NULL AND n = 1)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, e.h AS folded_root,
  e.h = (SELECT h FROM upper WHERE n = 1) AS verified FROM ended e JOIN subroots s ON s.tree = e.own
"""
SQL |= {"op12_resample": OP12_SQL, "op13_merkle": OP13_SQL}
