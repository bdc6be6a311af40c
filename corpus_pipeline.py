"""Training-corpus pipeline: toxicity, near-duplicates, benchmark leaks,
secrets, packing.  Each stage works on all that its predecessor kept.

Rows are taken as they come: a null or empty text is never toxic, is a near
duplicate of the others without words (one of them stays), holds no benchmark
item and no secret, and is packed as its end id; a null id keeps its row, and
loses to a row of its group that has one; of repeated rows one stays, in the
second stage; no rows give none.  Other columns, whatever their names, are
carried by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windlass.llm import decontaminate, packing, secret_scan, simhash, toxicity
from windlass.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the ordinal model calls toxic go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (4-word shingles, 4 bits) the smallest id stays."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind; every document stays."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the documents that are left."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_copies), ("decontamination", drop_leaks),
          ("secrets", redact_secrets), ("packing", pack)]

# No SQL trains a model, decodes secrets or tokenizes; tests/llm/test_pipeline.py
# compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again: the pieces
    of :func:`pack`.  What unusual rows come to is said at the top."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
