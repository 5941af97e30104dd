"""The registered queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, language, line_dedup, media, mixing, packing, pii, quality, simhash, substring_dedup, variants, warc, wavelet
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *quality.FIELDS, "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"), tensors=True)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(spark, warc.archived(table(spark, sf_dir, "pages")))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelet.shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.documents(files)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=line_dedup.FINE)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), misspell=97)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def queries() -> dict:
    some = (op1_substring_dedup, op2_best_fit_packing, op3_mix_sources, op4_simhash, op5_quality, op6_language_id, op7_media, op8_warc, op9_wavelet, op10_line_dedup, op11_variants, op12_hard_negatives, op13_personal_data)
    return {f.__name__: f for f in some}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that it can express over whole tables."""
    return {
        "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p
                                        FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents))),
     x AS (SELECT doc_id, p, string_agg(word, ' ') OVER v AS k, count(*) OVER v AS n FROM w
           WINDOW v AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
     f AS (SELECT k, min(doc_id) AS least FROM x WHERE n = 13 GROUP BY k),
     c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM x JOIN f USING (k) WHERE n = 13 AND least < doc_id),
     r AS (SELECT doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (c.p IS NULL) AS kept
           FROM w LEFT JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)""",
        "op5_quality": r"""
WITH w AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p
                                        FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents))),
     x AS (SELECT doc_id, p, string_agg(word, ' ') OVER three AS k3, count(*) OVER three AS n3, string_agg(word, ' ') OVER ten AS k10, count(*) OVER ten AS n10 FROM w
           WINDOW three AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
                  ten AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
     t3 AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM x WHERE n3 = 3
            QUALIFY count(*) OVER (PARTITION BY doc_id, k3) > 1) GROUP BY doc_id),
     t10 AS (SELECT doc_id, p, k10 FROM x WHERE n10 = 10 QUALIFY count(*) OVER (PARTITION BY doc_id, k10) > 1),
     c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 10)) AS q FROM t10) GROUP BY doc_id),
     -- places that repeat at one distance and follow each other make one repeat
     g AS (SELECT doc_id, apart, p - row_number() OVER (PARTITION BY doc_id, apart ORDER BY p) AS island
           FROM (SELECT a.doc_id, a.p, b.p - a.p AS apart FROM t10 a JOIN t10 b ON a.doc_id = b.doc_id AND a.k10 = b.k10 AND a.p < b.p)),
     m AS (SELECT doc_id, max(n) + 9 AS n FROM (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id, apart, island) GROUP BY doc_id),
     l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
     s AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY doc_id),
     a AS (SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.word_chars, 0) AS word_chars, coalesce(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols,
                  coalesce(l.n, 0) AS n_dup_lines, coalesce(t3.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS covered_words, coalesce(m.n, 0) AS longest_repeat
           FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN t3 USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)),
     b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT (base_failed OR covered_words > 0.25 * n_words OR (longest_repeat > 30 AND longest_repeat > 0.1 * n_words)) AS kept FROM b""",
        "op12_hard_negatives": """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
           FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS "rank", s.b AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5""",
        "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     m AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.last IS NOT NULL AND m.last <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last <> d.page_id THEN m.last END AS refers_to
FROM d LEFT JOIN m USING (payload_digest, payload_bytes)""",
    }
