import pytest
from pyspark.sql import functions as F

from tessera.operators import pagination as pg

ITEM = "array<struct<id:string,v:int>>"


def run(spark, columns, schema, expression):
    row = spark.createDataFrame([columns], schema).select(expression.alias("x")).first()
    return row.x


def items(*ids):
    return [(i, n) for n, i in enumerate(ids)]


def ids(rows):
    return [r.id for r in rows]


@pytest.mark.parametrize(
    ("a", "b", "ca", "cb", "backward", "key", "out"),
    [
        ("ab", "cd", "1", "2", False, None, "abcd"), ("ab", "cd", "1", "2", True, None, "cdab"), ("ab", "xy", "1", "1", False, None, "xy"), ("ab", "cd", None, None, False, None, "abcd"),
        ("abc", "bd", "1", "2", False, "id", "acbd"), ("abc", "bd", "1", "2", True, "id", "dabc"), (None, "ab", None, "1", False, None, "ab"), ("ab", None, "1", "2", False, None, "ab"), ("aa", "a", "1", "2", False, "id", "a"),
    ],
)
def test_cursor(spark, a, b, ca, cb, backward, key, out):
    row = (items(*a) if a else None, items(*b) if b else None, ca, cb)
    merged = pg.merge_cursor(F.col("a"), F.col("b"), F.col("ca"), F.col("cb"), backward=backward, key=key)
    assert ids(run(spark, row, f"a {ITEM}, b {ITEM}, ca string, cb string", merged)) == list(out)


def test_items_without_key_stay(spark):
    rows = [(None, 1), ("a", 2), (None, 3), ("a", 4)]
    assert [r.v for r in run(spark, (rows,), f"a {ITEM}", pg.keep_last(F.col("a"), "id"))] == [1, 3, 4]


@pytest.mark.parametrize(
    ("a", "oa", "b", "ob", "key", "out"),
    [("ab", 0, "cd", 2, None, "abcd"), ("abcd", 0, "xy", 1, None, "axyd"), ("ab", 0, "ef", 4, None, "abef"), ("cd", 2, "ab", 0, None, "abcd"), ("ab", 0, "xy", 0, None, "xy"), ("abc", 0, "a", 3, "id", "bca"), (None, 0, "ab", 2, None, "ab")],
)
def test_offset(spark, a, oa, b, ob, key, out):
    row = (items(*a) if a else None, oa, items(*b), ob)
    merged = pg.merge_offset(F.col("a"), F.col("b"), F.col("oa"), F.col("ob"), key=key)
    assert ids(run(spark, row, f"a {ITEM}, oa int, b {ITEM}, ob int", merged)) == list(out)


EDGE = "array<struct<node:string,cursor:string>>"
INFO = "struct<hasNextPage:boolean,hasPreviousPage:boolean,startCursor:string,endCursor:string>"


@pytest.mark.parametrize(
    ("a", "b", "backward", "dedupe", "out"),
    [("", "ab", False, True, "ab"), ("ab", "", False, True, "ab"), ("ab", "cd", False, True, "abcd"), ("ab", "cd", True, True, "cdab"), ("abc", "b", False, True, "acb"), ("abc", "b", False, False, "abcb")],
)
def test_edges(spark, a, b, backward, dedupe, out):
    edge = lambda s: [(x, x) for x in s]
    merged = pg.merge_edges(F.col("a"), F.col("b"), backward=backward, dedupe=dedupe)
    assert [r.cursor for r in run(spark, (edge(a), edge(b)), f"a {EDGE}, b {EDGE}", merged)] == list(out)


@pytest.mark.parametrize(("backward", "out"), [(False, (False, False, "a", "d")), (True, (True, True, "c", "b"))])
def test_page_info(spark, backward, out):
    row = ((True, False, "a", "b"), (False, True, "c", "d"), [("x", "x")], [("y", "y")])
    merged = pg.merge_page_info(F.col("i"), F.col("j"), F.col("a"), F.col("b"), backward=backward)
    schema = f"i {INFO}, j {INFO}, a {EDGE}, b {EDGE}"
    assert tuple(run(spark, row, schema, merged)) == out
    assert tuple(run(spark, (row[0], row[1], [], row[3]), schema, merged)) == row[1]
    assert tuple(run(spark, (None, (None, None, None, None), row[2], row[3]), schema, merged)) == (False, False, None, None)


def test_whole_lists_from_three_pages(spark):
    """Where pairwise merging of a third page loses the middle, the list by absolute places keeps it."""
    pages = [("l", 0, 1, items("a", "b")), ("l", 2, 2, items("c", "d")), ("l", 4, 3, items("e", "f")), ("l", 2, 4, items("c", "x")), ("m", 0, 1, items("a", "b", "a"))]
    df = spark.createDataFrame(pages, f"k string, o int, n int, items {ITEM}")
    found = {r.k: ids(r.items) for r in pg.assemble(df, ["k"], items="items", offset="o", arrival="n", dedupe="id").collect()}
    assert found == {"l": list("abcxef"), "m": list("ba")}
