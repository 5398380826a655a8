import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.matcher import M
from tessera.plans.compile import compile_node, documents, matches, matching, typed

DOCUMENT = '{"id":"1","status":"active","age":30,"score":0,"nick":null,"tags":"b","a.b":2,"flag":true,"big":1e300,"obj":{"x":1},"emoji":"\U0001f511"}'
# a filter, and whether the document matches
CASES = [
    (M.eq("status", "active"), True), (M.eq("status", "Active"), False), (M.eq("age", 30), True), (M.eq("age", 30.0), True), (M.eq("age", "30"), False), (M.eq("score", False), False),
    (M.eq("flag", True), True), (M.eq("flag", 1), False), (M.eq("nick", None), True), (M.eq("missing", None), False), (M.neq("status", "x"), True), (M.neq("missing", "x"), False),
    (M.neq("nick", 1), True), (M.neq("age", "30"), True), (M.neq("obj", 1), True), (M.eq("obj", None), False), (M.gt("age", 29), True), (M.gt("age", 30), False), (M.gte("age", 30), True),
    (M.gt("age", "1"), False), (M.lt("status", "b"), True), (M.gt("tags", "B"), True), (M.lt("tags", "c"), True), (M.lt("nick", 1), False), (M.lt("missing", 1), False), (M.gt("big", 10**9), True),
    (M.in_("age", [1, 30]), True), (M.in_("age", ["30", True]), False), (M.in_("age", []), False), (M.in_("nick", [None]), True), (M.in_("missing", [None]), False), (M.in_("status", [None, "active", 1]), True),
    (M.nin("age", [1]), True), (M.nin("age", [30]), False), (M.nin("age", []), True), (M.nin("missing", []), False), (M.nin("missing", [1]), False), (M.nin("nick", [None]), False), (M.nin("flag", [1]), True),
    (M.exists("nick"), True), (M.exists("missing"), False), (M.exists("missing", False), True), (M.exists("nick", False), False), (M.not_(M.eq("missing", 1)), True), (M.not_(M.gt("age", 1)), False),
    (M.and_(), True), (M.or_(), False), (M.not_(M.or_()), True), (M.eq("a.b", 2), True), (M.exists("a"), False), (M.exists('q"uote'), False), (M.exists("both\"'"), False), (M.eq("it's", 1), False), (M.exists("back\\slash"), False), (M.lt("emoji", "～"), True), (M.gt("emoji", "z"), True),
]


@pytest.fixture(scope="module")
def told(spark):
    df = spark.createDataFrame([(DOCUMENT,)], "text string").select(F.parse_json("text").alias("data"))
    row = df.select(*(compile_node(node, documents("data")).alias(f"c{i}") for i, (node, _) in enumerate(CASES))).first()
    return list(row)


@pytest.mark.parametrize("i", range(len(CASES)))
def test_documents(told, i):
    assert told[i] is CASES[i][1], CASES[i][0]


def test_typed_rows(spark):
    nan = math.nan
    df = spark.createDataFrame([(1, "a", 1.0, True), (2, None, nan, False), (3, "b", None, None), (4, "\U0001f511", -1.0, True)], "n long, s string, v double, b boolean")
    ask = lambda node, **k: [r.n for r in matching(df, node, **k).orderBy("n").collect()]
    assert ask(M.eq("v", 1)) == [1] and ask(M.neq("v", 1)) == [2, 4] and ask(M.nin("v", [1])) == [2, 4]
    assert ask(M.gt("v", -5)) == [1, 4] and ask(M.not_(M.lte("v", 5))) == [2, 3] and ask(M.in_("v", [1, -1, None])) == [1, 4]
    assert ask(M.exists("v", False)) == [3] and ask(M.exists("v", False), null_as="null") == [] and ask(M.eq("v", None), null_as="null") == [3]
    assert ask(M.neq("s", "a"), null_as="null") == [2, 3, 4] and ask(M.in_("s", [None, "a"]), null_as="null") == [1, 2]
    assert ask(M.eq("b", 1)) == [] and ask(M.neq("b", 1)) == [1, 2, 4] and ask(M.eq("n", True)) == [] and ask(M.gt("s", 1)) == []
    assert ask(M.lt("s", "～")) == [1, 3, 4] and ask(M.gt("s", "a")) == [3, 4] and ask(M.eq("nothing", None)) == [] and ask(M.nin("nothing", [])) == []


def test_mismatches_fold_and_predicates_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.col("id").cast("string").alias("s"), (F.col("id") * 1.5).alias("v")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda node: matching(df, node)._jdf.queryExecution().toString()
    assert "LocalTableScan <empty>" in plan(M.eq("s", 1)) or "EmptyRelation" in plan(M.eq("s", 1))
    pushed = plan(M.and_(M.gt("id", 5), M.gte("s", "5"), M.in_("s", ["6", "7"])))
    assert "GreaterThan(id,5)" in pushed and "GreaterThanOrEqual(s,5)" in pushed and "In(s" in pushed


def test_long_lists_become_semi_joins(spark):
    df = spark.range(1_000).withColumn("s", F.col("id").cast("string"))
    wanted = list(range(0, 900, 3))
    assert "LeftSemi" in matching(df, M.in_("id", wanted))._jdf.queryExecution().toString()
    assert matching(df, M.in_("id", [*wanted, "x", 1.5])).count() == len(wanted)
    assert matching(df, M.in_("s", [str(x) for x in wanted])).count() == len(wanted)


def test_opaque(spark):
    df = spark.range(10)
    assert [r.id for r in matching(df, lambda row: 6 // row["id"] == 2).collect()] == [3]
    assert matching(df, lambda row: row["id"]).count() == 0  # not exactly True
    assert [r.id for r in matching(df, lambda d: d["id"] > 7).collect()] == [8, 9]
    for bad in ({"op": "like", "field": "id", "value": "x"}, None, 3):
        with pytest.raises(ValueError, match="unusable"):
            matches(df, bad)


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` long, `c``d` long")
    assert df.where(compile_node(M.and_(M.eq("a.b", 1), M.eq("c`d", 2)), typed(df))).count() == 1


def test_long_lists_on_any_column(spark):
    """Longer lists than LONG_LIST find what short ones do."""
    values = [i / 2 for i in range(-50, 250)] + [float(2**70)]
    df = spark.range(200).selectExpr("id", "cast(id / 2 as decimal(12, 2)) AS d", "cast(id as double) / 2 AS f", "cast(id as int) AS i", "cast(id as string) AS s")
    for column, expected in (("d", 200), ("f", 200), ("i", 125), ("id", 125)):
        assert matching(df, M.in_(column, values)).count() == matching(df, M.and_(M.in_(column, values))).count() == expected
    assert matching(df, M.in_("s", [str(i) for i in range(500)])).count() == 200
