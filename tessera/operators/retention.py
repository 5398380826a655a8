"""Reference counts by retain and release, and what garbage collection evicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.changes import KEY


def counts(ops: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """ops (seq, key, op retain or release) -> n of each key that was ever retained; releases stop at zero.

    The clamped count after a prefix is its plain sum less the least plain sum up to there, if that is below zero. A
    release before the first retain is no entry, which the clamp says too.
    """
    in_order = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    steps = ops.withColumn("step", F.when(F.col("op") == "retain", 1).otherwise(-1)).withColumn("plain", F.sum("step").over(in_order))
    ends = steps.groupBy(*key).agg(F.max_by("plain", "seq").alias("plain"), F.min("plain").alias("least"), F.count(F.when(F.col("op") == "retain", 1)).alias("retained"))
    return ends.where("retained > 0").select(*key, (F.col("plain") - F.least(F.lit(0), F.col("least"))).cast("long").alias("n"))


def held(retentions: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Counts from one row per holder."""
    return retentions.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def evictable(entities: DataFrame, counted: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Resident keys whose count has come down to zero; keys never retained are immune."""
    return entities.select(*key).join(counted.where("n <= 0").select(*key), list(key))


def collected(counted: DataFrame) -> DataFrame:
    """Counts after a collection."""
    return counted.where("n > 0")
