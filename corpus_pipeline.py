"""The corpus pipeline: stages over ``documents``, each by one operator.

Every stage works on all that the one before it kept; the last adds the shard and the
position in it. ``ORACLE_SQL`` is None: the toxicity stage is a trained classifier,
which SQL cannot express; ``tests/llm`` hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metalith.llm import decontaminate, jaccard, mixing, sharding
from metalith.llm import toxicity as tox
from metalith.llm.common import free, new_path, read, removed

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay, the null and empty ones and each of
    repeated rows too; an empty table stays empty."""
    model, score = tox.model_of(spark, sf_dir), free(docs, "_toxicity")
    return tox.scored(docs, model, name=score).where(F.col(score) < tox.THRESHOLD).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8. Null,
    empty and blank texts all stay; of repeated rows one."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), "documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null sources are one source; null and
    empty texts have no words; rows of one id and size are taken alike."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, shard and slot, which replace columns of these names;
    null texts are one group, repeated rows are placed each."""
    return sharding.shards(docs, added=("size", None, "shard", "slot"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", benchmark),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again but the last. What a
    stage has read goes once its own output is written, so two outputs lie on disk at most."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out, at = stage(spark, docs, sf_dir), new_path(spark, f"stage-{name}")
        out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
        if before:
            removed(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
