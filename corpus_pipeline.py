"""Corpus pipeline: quality rules, language ID, exact dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes every stage's result and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import MAX_BROADCAST_IDS, read, stage
from churnlake.llm.exact_dedup import exact_duplicates
from churnlake.llm.jaccard_join import near_duplicate_components
from churnlake.llm.lang_crf import UNKNOWN, identify_languages
from churnlake.llm.packing import pack_documents
from churnlake.llm.quality_rules import quality_verdicts
from churnlake.llm.queries import tokenizer_path

#: Documents whose words' posteriors agree less on one language are rejected.
LEAST_LANGUAGE_SCORE = 0.5


#: Names a row by its content: rows of one id differ in it, and only rows equal in all columns share it.
ROW = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a 64-bit hash of all columns; nulls count, which xxhash64 passes over."""
    return docs.withColumn(ROW, F.xxhash64(*[F.col(f"`{c}`").isNull() for c in docs.columns],
                                           *[F.col(f"`{c}`") for c in docs.columns]))


def _matching(docs: DataFrame, keys: DataFrame, few: bool) -> DataFrame:
    """Rows of keyed ``docs`` whose id and content are in ``keys``; a null id matches a null id."""
    keys = keys.select(F.col("doc_id").alias("__id"), F.col(ROW).alias("__key"))
    return docs.join(F.broadcast(keys) if few else keys, (F.col(ROW) == F.col("__key"))
                     & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")


def _only(spark: SparkSession, docs: DataFrame, kept: DataFrame, single: bool = False) -> DataFrame:
    """Rows of ``docs`` named in ``kept`` (doc_id, __row, n: how many rows are equal); ``single``: one of equal rows.

    Only rows that have an equal one are exchanged to leave a single one.
    """
    keys = stage(spark, kept.select("doc_id", ROW, "n"), "pipeline_kept")
    few = keys.count() <= MAX_BROADCAST_IDS // 2  # 16 bytes each
    rows = _keyed(docs)
    if not single or (repeated := keys.where("n > 1")).isEmpty():
        return _matching(rows, keys, few).drop(ROW)
    one = _matching(rows, repeated, few).dropDuplicates(["doc_id", ROW])
    return _matching(rows, keys.where("n = 1"), few).unionByName(one).drop(ROW)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", ROW).agg(F.count(F.lit(1)).alias("n"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the robust distance of their language and source."""
    return _only(spark, docs, _counted(quality_verdicts(spark, _keyed(docs), keep=(ROW,)).where("kept")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    found = identify_languages(spark, _keyed(docs), keep=(ROW,))
    return _only(spark, docs, _counted(
        found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: one row, also where rows repeat, share an id or have none."""
    return _only(spark, docs, _counted(exact_duplicates(spark, _keyed(docs), row_col=ROW).where("kept")), single=True)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by five-word shingles with a Jaccard of 0.8 or more.

    Rows are linked by their content, so a shared or null id links nothing; a null id stays only among null ids.
    """
    keyed = _keyed(docs)
    rows = stage(spark, _counted(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), ROW)), "pipeline_rows")
    found = near_duplicate_components(spark, keyed, id_col=ROW, width=5, percent=80).select(ROW, "component_id").distinct()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW, "n")).alias("best")
    return _only(spark, docs, rows.join(found, ROW).groupBy("component_id").agg(best).select("best.*"), single=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 4096 tokens."""
    return pack_documents(spark, docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]
#: Language ID, the robust distance and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
