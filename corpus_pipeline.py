"""Training corpus from raw documents: score, deduplicate, mix and pack.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and read again, so a lost
executor never sends the work back further than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from songloom.llm.exact_dedup import without_copies
from songloom.llm.mixing import mixed_documents
from songloom.llm.ngram_join import without_near_copies
from songloom.llm.packing import pack
from songloom.llm.queries import WEIGHTS, table, tokenizer_path
from songloom.llm.toxicity import without_toxic
from songloom.session import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return without_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id."""
    return without_near_copies(docs)


def cube_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once or twice."""
    return mixed_documents(docs, WEIGHTS)


def bin_slack_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and offsets."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("cube_mixing", cube_mixing),
    ("bin_slack_packing", bin_slack_packing),
]

#: Several stages cannot be said in SQL; tests hold each one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
