"""Registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm import license_rules
from churnlake.llm.common import read
from churnlake.llm.conversation_glr import damage, repair_conversations, repair_report
from churnlake.llm.exact_dedup import exact_duplicates
from churnlake.llm.html_mincut import extract_main_text
from churnlake.llm.jaccard_join import near_duplicate_components
from churnlake.llm.lang_crf import identify_languages
from churnlake.llm.packing import pack_documents
from churnlake.llm.piece_suffix import decode_pieces, encode_pieces
from churnlake.llm.quality_rules import quality_verdicts
from churnlake.llm.simhash_anchors import simhash_components
from churnlake.llm.spelling_gram import spelling_variants, vocabulary
from churnlake.llm.toxicity_knn import score_toxicity
from churnlake.llm.warc import archive_round_trip


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the package is installed where tasks run."""
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return add


@register()
def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by forward-backward over its words."""
    return identify_languages(spark, read(spark, sf_dir, "documents"))


@register("""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
   AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 190 >= (a.n + b.n) * 90),
r AS (SELECT a AS doc_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(min(r.c), s.doc_id) AS component_id
FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(g)
""")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 3-word-shingle Jaccard of at least 0.9."""
    return near_duplicate_components(spark, read(spark, sf_dir, "documents"), width=3, percent=90,
                                     keep_signatures=True).select("doc_id", "n_shingles", "component_id")


@register()
def op3_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    return score_toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(spark, read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@register(license_rules.oracle_sql())
def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence rules found in every document."""
    return license_rules.scan_licenses(read(spark, sf_dir, "documents"))


@register("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
t AS (SELECT x, max(page_id) AS top FROM h GROUP BY x),
v AS (SELECT page_id, n, top, list_reduce(list_prepend('', [
        lpad(bin(CAST(instr('0123456789abcdef', c) - 1 AS INTEGER)), 4, '0') FOR c IN string_split(h.x, '')]),
        lambda a, c: a || c) AS bits FROM h JOIN t ON t.x = h.x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(
         [CASE WHEN substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) = '1' THEN 1 << CAST(4 - j AS INTEGER) ELSE 0 END
          FOR j IN range(5)]) AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM v
""")
def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC, normalised to a member a record, and read back by offset."""
    return archive_round_trip(spark, read(spark, sf_dir, "pages"))


@register()
def op7_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and the verdict of the base rules and the robust distance."""
    return quality_verdicts(spark, read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h FROM documents),
k AS (SELECT h, count(*) AS n, arg_min(doc_id, (-length(t), doc_id)) AS keep FROM d GROUP BY h)
SELECT doc_id, keep AS keep_id, n AS group_size, doc_id = keep AS kept, d.h AS text_sha256
FROM d JOIN k ON k.h = d.h
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; the longest original stays."""
    return exact_duplicates(spark, read(spark, sf_dir, "documents"))


@register()
def op9_piece_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by suffix-array matching, decoded again."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.replace(
        F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" ")).alias("plain"))
    ids = encode_pieces(docs, model, keep=("plain",))
    out = decode_pieces(ids.withColumn("n_ids", F.size("ids").cast("long")), model,
                        keep=("n_ids", "ids_crc32", "plain"))
    return out.select("doc_id", "n_ids", "ids_crc32", F.char_length("text").cast("long").alias("n_chars"),
                      (F.col("text") == F.col("plain")).alias("round_trip"))


@register()
def op10_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(spark, read(spark, sf_dir, "pages"))


@register()
def op11_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word SimHash fingerprints differ in at most 4 bits."""
    found = simhash_components(spark, read(spark, sf_dir, "documents"), width=4, bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register()
def op12_conversation_glr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a hash, and their cheapest repair."""
    return repair_report(repair_conversations(damage(read(spark, sf_dir, "conversations"))))


@register()
def op13_spelling_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, damaged by a hash, with their near words, form and root."""
    return spelling_variants(spark, vocabulary(read(spark, sf_dir, "documents"), typos=True))
