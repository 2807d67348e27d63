"""A training corpus from raw documents: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, linededup, mixing, quality, simhash
from sieveline.llm.common import discard, read, scope, store


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts get the score of an empty one; other cases
    as in quality.quality."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; those of which nothing is left go. Null and empty texts stay as they
    are; other cases as in linededup.dedup_lines."""
    return linededup.drop_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id. Null and empty
    texts are one group; other cases as in simhash.keep_one."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; without items all stay."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each, repeats counted. Texts without words have nothing to take
    and go; columns of docs called size, source_size, target or taken give way to those of the mix."""
    own = ("doc_id", "source", "size", "source_size", "target", "taken")
    return mixing.mix(docs, keep=[c for c in docs.columns if c not in own]).where(F.col("taken") > 0)


STAGES = [
    ("quality classifier", good),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean),
    ("mixing sources", mixed),
]

#: The first stage's network can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope() as keep:
            made = store(stage(spark, docs, sf_dir))
            keep(made)
        if "stored_at" in vars(docs):
            discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
