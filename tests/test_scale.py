"""Plans that have to hold at scale: what is pushed down, read, shuffled and combined before it is."""

import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions.matcher import M
from tessera.operators import changes
from tessera.plans.compile import matching


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def log(spark, tmp_path):
    rows = spark.range(1_000).select(F.col("id").alias("seq"), F.lit("set").alias("op"), F.lit("t").alias("entity_type"), (F.col("id") % 3).cast("string").alias("id"), F.col("id").alias("a"), F.col("id").alias("unused"))
    rows.write.parquet(f"{tmp_path}/log")
    return spark.read.parquet(f"{tmp_path}/log")


def test_filters_reach_the_scan_and_columns_are_pruned(log):
    found = plan(matching(log, M.and_(M.eq("op", "set"), M.not_(M.gt("a", 5)))).select("id"))
    assert "EqualTo(op,set)" in found and "LessThanOrEqual(a,5)" in found and "unused" not in found.partition("ReadSchema")[2].split("\n")[0]


def test_folds_combine_before_they_shuffle(log):
    found = plan(changes.fold(log, ["a"]))
    assert "partial_max_by" in found and "partial_max(" in found and "Window" not in found and "unused" not in found


def test_no_cross_joins(spark):
    for name, query in queries.queries().items():
        if name not in ("live_view_stream", "surface_answers"):
            found = plan(query(spark, "/root/testdata/sf0.001"))
            assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found, name
