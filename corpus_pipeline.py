"""A corpus pipeline of five stages; every stage reads what its predecessor wrote.

STAGES is a list of (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, jaccard, mixing, quality_rules, sharding, simhash
from ledgerlark.llm.common import arrow_rows, discard, stash, table

SHARDS = 40

#: Jaccard components and the binomial thresholds have no form in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


#: Columns of documents that the operators read; all others are out of their sight while a stage runs.
READ = ("doc_id", "text", "lang", "source")


def aside(docs: DataFrame) -> DataFrame:
    """The documents with names that no operator uses for the columns that none reads."""
    return docs.select(*[F.col(c) if c in READ else F.col(c).alias(f"own {c}") for c in docs.columns])


def back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``found``, which came from ``aside(docs)``, with the columns of ``docs``."""
    return found.select(*[F.col(c) if c in READ else F.col(f"own {c}").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled cutoffs reject go.

    Columns keep their values, also those named like a measure; repeated rows are judged alike; null texts go.
    """
    with arrow_rows(spark, jaccard.TEXTS):
        judged = quality_rules.apply_rules(aside(docs), table(spark, sf_dir, "labels"))
    return back(judged.filter("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles with a Jaccard similarity of 0.8 or more.

    Multi-index hashing of SimHash fingerprints gives the first links, a prefix filter those that it misses. The smallest
    key of a group stays (null last); of repeated rows one stays; documents without words are one group.
    """
    found = aside(docs)
    return back(simhash.first_of_each(found, jaccard.near_copies(found)), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return back(decontaminate.decontaminate(aside(docs), table(spark, sf_dir, "benchmark")), docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them: not at all, once or twice."""
    mixed = mixing.mix(aside(docs), weights=mixing.label_weights(table(spark, sf_dir, "labels")))
    return back(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("copies")))).filter("__copy > 0"), docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: 40 shards of near-equal bytes with gapless slots."""
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared scratch folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
