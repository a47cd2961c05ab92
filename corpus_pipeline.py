"""From raw documents to packed training sequences, in five stages that each write their result.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetgraph.llm import decontaminate, neardup, packing, pii, quality
from assetgraph.llm.jobs import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are more likely junk than sound.

    Null and empty texts have no features and go or stay together, by the prior. Repeated rows are judged alike; further columns stay; no rows give none.
    """
    return quality.select(docs, quality.fit(docs, quality.graded(table(spark, sf_dir, "labels"))))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the smallest doc_id: five-word shingles, similarity of 0.8 or more.

    Null and empty texts are like nothing and stay. Rows that repeat a doc_id are reduced to one; rows without doc_id stay. Further columns stay; no rows give none.
    """
    return neardup.keep_first(docs, shingle=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none and stay; repeated rows go or stay together; further columns stay; no rows, or no items, change nothing.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and counts their characters anew.

    A null text stays null; every row stays, repeated ones too, and so do further columns; no rows give none.
    """
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences: a row for each piece of a document.

    A null or empty text has one token, the end mark. Repeated rows, and rows without doc_id, are documents of their own; further columns are left out; no rows give none.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dup_stage),
    ("decontamination", decontaminate_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: The classifier, the tokenizer and the near-duplicate groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
