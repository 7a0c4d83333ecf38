"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, divergence, exact_dedup, fingerprints, jaccard_join, language_id, license_scan, lm_scoring, mixing, packing, piece_encoding, warc, whitening
from .common import table


def op1_sentencepiece(spark, sf_dir):
    return piece_encoding.round_trip(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_warc(spark, sf_dir):
    return warc.page_digests(table(spark, sf_dir, "pages"))


#: A conversation beside the table whose texts are the template's own control strings.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return chat.digest(chat.format_conversations(rows.unionByName(probe)))


def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_license_scan, op3_lm_scoring, op4_source_mixing, op5_warc, op6_language_id, op7_chat_formatting, op8_ngram_jaccard_join, op9_exact_dedup, op10_document_fingerprints, op11_source_divergence, op12_packing, op13_whitening)}

ORACLE_SQL = {
    "op5_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
     f AS (SELECT page_id, h, n, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     k AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
     v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
     n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
     g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source)),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v)::HUGEINT)::BIGINT AS p,
                  (1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v)::HUGEINT)::BIGINT AS q
           FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
           UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM e QUALIFY part = 'pair' OR rank <= 200""",
}
