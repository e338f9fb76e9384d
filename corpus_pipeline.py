"""Corpus pipeline: quality filter, line deduplication, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haplomill.llm import line_dedup, near_copies, packing, quality
from haplomill.llm.common import table
from haplomill.llm.tokens import vocabulary
from haplomill.storage import WRITTEN, clean, written


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are, with all their columns.

    Null and empty texts score alike and stay or go together, as equal texts and repeated rows do; texts of any length
    are read whole; columns of any name pass through (an own score too); an empty table gives an empty result.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, site by site; n_chars, where there is one, follows the text.

    Every row stays: a null text as null, an emptied one as empty; texts of any length are split whole; repeated rows
    each count as a page; columns of any name pass through; an empty table gives an empty result.
    """
    found = line_dedup.cleaned(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays, the one with the smallest doc_id, as it is.

    Null and empty texts are copies of one another; repeated rows leave one; rows with a null doc_id stay only where a
    group has no other; texts of any length are compared whole; columns of any name pass through; an empty table gives
    an empty result.
    """
    return near_copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; one row per piece, with its ids.

    Null text counts as empty (its end id alone), a null source as ''; a null doc_id stays null; long texts are cut
    freely; repeated rows are packed as often as they occur; other columns are ignored; an empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary())


STAGES = [("quality classifier", filter_quality), ("line dedup", drop_boilerplate), ("SimHash near-dedup", drop_copies), ("packing", pack)]

#: Classifier, near-duplicates and token ids are beyond SQL; a test on the smallest tables holds line and near-copy
#: removal against brute force, the classifier against its labels, and the packed ids against those kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote for itself goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        since = len(WRITTEN)
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{i}")
        clean(spark, since - (before is not None), (path,))
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
