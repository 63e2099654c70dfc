"""From raw documents to token ids in five stages, each written as Parquet and read again.

1. The quality classifier is trained on the labels and drops documents below its threshold.
2. Quality rules with adaptive thresholds drop documents outside them.
3. Near-duplicates (5-word shingles, similarity 0.8 or more): one document of each group stays.
4. Sources are mixed to their target weights; documents leave or repeat as the mix takes them.
5. Whole texts are encoded to token ids and decoded again.

All stages but the last return the columns of documents. Stages hold no state between
runs; what they store goes to the shared folder of the cluster and is removed when the
stage's result is written, as is that result once the next stage has been written.

Defined cases: each stage follows its operator. A null or empty text has no words, so the
quality rules drop it; without labels every score is 0.5 and the classifier drops all; a
null doc_id, label, language or source is handled as such in every stage; repeated rows
are one group of copies; texts of any length are taken whole; empty tables give no rows;
further columns of documents pass through to the fourth stage whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import bpe, mixing, neardup, quality_model, quality_rules
from rankloom.llm.queries import table, tokenizer_path
from rankloom.llm.storage import kept, new_path, remove


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix),
    ("encode_decode", encode),
]

#: The classifier is trained by gradient descent, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: doc_id, ids, decoded."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        docs = kept(spark, path, lambda: stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return docs
