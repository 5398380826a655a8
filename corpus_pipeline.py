"""The corpus pipeline: toxic documents go, near copies go but one, benchmark leaks go, sources are mixed, shards are cut.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``,
the last adds shard and place. A stage's result is written and read again before the next one.

Defined cases, at every stage: a null or empty text is no toxic one, is a near copy of the other texts without words,
holds no benchmark item, has size 0 and is not taken by the mix; a null doc_id or source is a row like others, and a
doc_id that repeats names two rows, each judged by its own text; of near copies the row of the smallest doc_id stays,
null last; texts of any length are read whole; an empty table goes through as one; further columns are kept, whatever
their names but tessera_* (the operators' own). Without labels of both kinds no text is toxic unless all labels are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, mixing, sharding, simhash, toxicity
from tessera.llm.common import scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs, scratch(spark, "shards"))


STAGES = [("toxicity", toxic), ("near-dedup", near_duplicate), ("decontamination", contaminated), ("mixing", mixed), ("sharding", sharded)]

#: The stages hash, train and search in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
