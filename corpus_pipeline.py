"""A corpus from raw documents to token ids, in stages that each work on what the
one before has kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``. All but the last return
the columns of ``documents``.

Rules for odd input: a NULL text is empty and fails the quality rules. Repeated
rows are one document from the third stage on; rows with one ``doc_id`` and
different texts are judged each by its text. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperic.llm.bpe import bpe_encode
from amperic.llm.common import documents, prepared, staged, whole_text
from amperic.llm.lines import line_dedup
from amperic.llm.mixing import mix_sources
from amperic.llm.near import near_duplicates
from amperic.llm.quality import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as they are."""
    prepared(spark)
    return quality_rules(docs, carry=COLUMNS).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; ``n_chars`` follows."""
    prepared(spark)
    kept = line_dedup(docs.select(*COLUMNS))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, and of
    several texts under that id the one with the least hash."""
    prepared(spark)
    groups = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    keepers = groups.groupBy("group_hash").agg(first.alias("k")).select(F.col("k.doc_id").alias("_keep"), F.col("k.text_hash").alias("_text"))
    rows = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64(whole_text()))
    same = F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_hash") == F.col("_text"))
    return rows.join(keepers, same, "left_semi").dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order: files hold ranges of slots in turn."""
    prepared(spark)
    mixed = staged(mix_sources(docs.select(*COLUMNS)))
    return mixed.repartitionByRange("slot", "begin").sortWithinPartitions("slot", "begin", "doc_id").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the digests of ids and decoded bytes, and ``slot`` and ``begin``.

    A reader of Parquet files does not keep their order, so the place of a row in
    the mixed order is worked out again from the rows, which the mixing left whole.
    """
    prepared(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    placed = mix_sources(docs.select(*COLUMNS))
    return bpe_encode(placed, vocabulary_path=path, pattern=public_tokenizers.PATTERN, carry=("slot", "begin"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("source mixing", mixing_stage),
    ("byte-pair encoding", encoding_stage),
]

# Divergence, signatures and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and reread."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
