"""The corpus pipeline: toxicity, line dedup, near dedup, decontamination, packing.

Each stage reads what the one before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litmill.llm import decontamination, lines, minhash, packing, toxicity
from litmill.llm.common import Workspace, table
from litmill.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic.

    Documents without a word get the rate of labelled ones without words, so null and empty texts stay unless those are
    mostly toxic; without labels of both classes none is scored by its words. Equal rows stay or go together; an empty
    table stays empty; very long texts are scored whole; other columns stay as they are.
    """
    return toxicity.remove(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; documents that were nothing else go.

    Null and empty texts stay as they are; rows equal in doc_id and text are treated alike; of ties the least doc_id
    keeps its lines, null ids last; an empty table stays empty; n_chars is counted anew, other columns stay.
    """
    return lines.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates (five words, 0.8).

    Documents without a word are alike with none and stay; of repeated rows one stays; a row with a null id stays only
    if its group has no other id; an empty table stays empty; other columns stay as they are.
    """
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more is benchmark text.

    Null and empty texts have no words and stay; equal rows stay or go together; without a benchmark, or one without
    words, all stay; an empty table stays empty; very long texts are searched whole; other columns stay as they are.
    """
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 tokens.

    A null or empty text is one piece that holds the end id; a null id stays null; an empty table gives no pieces; a
    very long text is full windows and a remainder; other columns are ignored.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages train a model, verify similarity and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again, and goes when the next one has been written."""
    work, before = Workspace(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
