"""From raw documents to packed training sequences: five stages, each one of the text operators on all that is left.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder before
the next stage reads it, so that a lost executor costs no more than its own tasks.

Defined cases of all stages: a null text counts as empty and stays null; a null doc_id is kept, and is neither learnt
from nor linked; rows that repeat are treated each, but for near_duplicates, which keeps one; an empty table gives none;
other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import discard, fresh, stored, table
from spritespark.llm.decontamination import drop_contaminated
from spritespark.llm.jaccard import keep_one_of_each
from spritespark.llm.packing import pack_pieces
from spritespark.llm.pii import redact, train_selector
from spritespark.llm.quality import THRESHOLD, score_quality, train_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, repeated ones each; a null or empty text has a score, too."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return score_quality(docs, model, score).filter(F.col(score) >= THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest doc_id. Empty texts and null doc_ids are linked to none."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item; null and empty texts hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced by its kind; null texts stay null."""
    return redact(docs, train_selector(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null or empty text is its end id alone."""
    return pack_pieces(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: SQL can't express the stages: they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
