"""The corpus pipeline: toxicity, near-duplicates, PII, mixing, sampled segmentation, over documents.

Every stage takes and, but for the last, returns the columns of documents; columns besides these are dropped at its start, so none
clashes with an operator's. Defined results, by stage:

* null or empty texts: not toxic, unless empty ones are by the labels; duplicates of nothing; nothing to replace; of size 0, so that
  the mix takes none of them and they end there;
* null doc_ids: each row stays through near-duplicates; null sources are a source of their own; a null lang stays;
* repeated rows and rows that share a doc_id: near-duplicates keep one of those kept; ties go to the smaller doc_id;
* very long texts are read whole; an empty table gives an empty table of the same columns at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basecairn.llm import mixing, near_dedup, pii, sampled_pieces, toxicity
from basecairn.llm.common import drop, prepare, table, written
from basecairn.llm.queries import pii_key, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on the labelled ones among them, does not reject; nothing else changes."""
    model = toxicity.trained(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(spark, docs.select(*COLUMNS), model).where(F.col("toxic_score") < toxicity.THRESHOLD).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id."""
    return near_dedup.deduplicated(spark, docs.select(*COLUMNS))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; n_chars follows."""
    prepare(spark)
    return pii.pseudonymised(docs.select(*COLUMNS), pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last of a source perhaps in part."""
    prepare(spark)
    return mixing.copies(mixing.mixed(spark, docs.select(*COLUMNS, mixing.size_of(F.col("text")).alias("size"))), COLUMNS)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text: doc_id, source, n_chars, pieces."""
    return sampled_pieces.sampled(spark, docs.select("doc_id", "source", "n_chars", "text"), tokenizer_path("piece_bpe_32k.model"), F.col("doc_id"), keep=["doc_id", "source", "n_chars"])


STAGES = [("toxicity", clean_of_toxic), ("near_dedup", deduplicated), ("pii", pseudonymised), ("mixing", mixed), ("sampled_pieces", segmented)]

#: The fitted classifier and the sampled segmentations are beyond SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(spark, stage(spark, docs, sf_dir), name)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
