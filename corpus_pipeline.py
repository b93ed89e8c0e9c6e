"""Corpus pipeline: language, near-duplicates, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and applies its decision. All
but the last return the columns of ``documents`` with their values, whatever further columns there are and whatever these are
called. Empty inputs give empty outputs. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millwatch.llm import decontaminate, langid, minhash, mixing, shards
from millwatch.llm.common import stored, table

SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (NULL and empty texts too), whose language is a guess, or whose text is too unlike any learned one, go.

    Rows without id or language are judged like others. Repeated rows are judged alike; of equally likely languages the smaller name counts.
    """
    return langid.accepted(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document of the smallest id stays.

    Rows without id, and texts without words, are near-duplicates of nothing and stay. Rows that repeat an id and text are one document: all stay or go.
    """
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty stands in a benchmark window go.

    Texts without words stay. Items that are NULL, empty or repeated change nothing; rows without id are judged like others.
    """
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source comes near its target.

    Texts without words go: no slot reads them. NULL is a source of its own. Equal rows are repeated alike, and rows without id are told
    apart by text and source.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its shard, and its slot in the shard, besides its size and checksum; columns of these names are replaced.

    Rows of equal texts, NULL and empty ones among them, are one group and share a shard; ties within it are in the order of the ids, NULL last.
    """
    return shards.assign(docs, SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: The language model and the hash order of the mix have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
