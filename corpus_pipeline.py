"""The corpus pipeline: documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.

1. ``quality_rules``: documents that fail the base or the repetition rule go.
2. ``simhash_near_dedup``: of each group of near copies the document with the smallest doc_id stays. Documents link by SimHash over 5-word shingles, within 3 bits, by pigeonring. An exact
   search then adds the pairs that share 0.8 of their 5-word shingles (Jaccard) but differ in more bits, as most such pairs do; groups are what links of either kind reach.
3. ``substring_dedup``: words in windows of 50 that start in an earlier document too are taken out; a text that loses words comes back with
   single spaces, and n_chars is counted anew. No document goes, even one that keeps no word.
4. ``benchmark_decontamination``: documents that hold a test item go.
5. ``packing``: what is left becomes sequences of 2048 tokens; one row per piece.

Edge cases, by stage. Null and empty texts have fewer than 50 words, so the first stage rejects them; a later stage that is run alone keeps one null or empty text of all (2), leaves such
texts as they are (3, 4) or packs their end token (5). Very long texts are worked on whole in every stage. Repeated rows are judged alike (1, 4), one of them stays (2), they take no words from
each other (3), and each is packed (5). A null doc_id loses to any other (2, 3). Ties between rows of one doc_id are decided by a hash of the row (2). Further columns, whatever their names, are kept by all
stages but the last; n_chars is counted anew if it is there. Empty tables, also an empty benchmark, give no rows or leave all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import decontaminate, near_copies, packing, quality_rules, simhash_dedup, substring_dedup
from quotemill.llm.common import importable, shared

#: SQL has no suffix array, SimHash or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return simhash_dedup.keep_one(docs, grouping=near_copies.near_copies, simhash=True)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    importable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
