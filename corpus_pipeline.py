"""A corpus from raw documents: toxic texts go, near copies go, benchmark passages go, sources are mixed, rows are sharded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  Between stages the documents are
written as Parquet to the shared folder and read again, so that a lost executor costs a stage no more than its own
tasks.  Null and empty texts are clean, one of the empty ones stays, and those without words go where sources are mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontamination, mixing, sharding, simhash, toxicity
from kindred.llm.common import own_name, table, tidy, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what scores 0.5 or more; learns from the labels of the documents at hand."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = own_name(docs, "toxicity")
    return toxicity.score(docs, model, score_col=name).filter(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8 or more, the smallest id stays."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a window of ten words of a benchmark item, or a whole shorter item, occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents of each source, some twice, as its target weight asks."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]


@tidy
def _stage(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str, f) -> DataFrame:
    """The stage's documents, written and reread; what else the stage wrote is removed."""
    return written(f(spark, docs, sf_dir), f"pipeline-{name}")


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = _stage(spark, docs, sf_dir, name, f)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted classifier and fingerprints decide what stays: no SQL gives these rows.
ORACLE_SQL = None
