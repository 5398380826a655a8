import re

import pytest

from tessera.llm.decontamination import blocks, containments, without_leaks

ITEM = "one two three four five six seven eight nine ten eleven twelve"
PAIRS = ("doc_id", "item_id", "n_shingles", "n_shared")


@pytest.fixture
def items(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "item_id bigint, text string")


def brute(documents, benchmark, threshold=0.8, width=5):
    def words(x):
        return re.findall(r"[^\W_]+", (x or "").lower())

    found = []
    for doc_id, text in documents:
        w = words(text)
        for item_id, item in benchmark:
            v = words(item)
            k = min(width, len(v))
            if not k:
                continue
            want = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
            have = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            if len(want & have) >= threshold * len(want):
                found.append((doc_id, item_id, len(want), len(want & have)))
    return sorted(found, key=repr)


def test_against_brute_force(docs, items, rows):
    filler = " ".join(f"w{i % 977}" for i in range(20_000))
    benchmark = [(1, ITEM), (2, "Only Three words"), (3, None), (4, ""), (5, ITEM + " and more of it than that"), (1, ITEM), (6, "same same same same same same same")]
    documents = [
        (1, f"{filler} {ITEM.upper()}! {filler}"), (2, ITEM.replace("twelve", "dozen")), (3, ITEM.replace("six", "6")), (4, "only, three. words"), (5, None), (6, ""),
        (7, "only three"), (8, "same " * 50), (None, ITEM), (1, ITEM), (9, "one two three four five x six seven eight nine ten eleven twelve"),
    ]
    assert rows(containments(docs(*documents), items(*benchmark)), *PAIRS) == brute(documents, benchmark)


def test_blocks_change_nothing(docs, items, rows):
    benchmark = [(i, f"{ITEM} {i} {i + 1} {i + 2}") for i in range(40)]
    documents = [(i, f"x {ITEM} {i} {i + 1} {i + 2} y") for i in range(40)]
    df, one = docs(*documents), rows(containments(docs(*documents), items(*benchmark)), *PAIRS)
    assert one == rows(containments(df, items(*benchmark), block_words=60), *PAIRS) == brute(documents, benchmark)
    assert len(list(blocks(items(*benchmark), 60))) > 3


def test_clean_documents_stay_whole(docs, items, rows):
    df = docs((1, f"a {ITEM} b"), (2, "clean"), (3, None), (None, "clean"), (2, "clean"))
    left = without_leaks(df, items((1, ITEM)))
    assert left.columns == df.columns
    assert rows(left, "doc_id", "text") == sorted([(2, "clean"), (3, None), (None, "clean"), (2, "clean")], key=repr)


def test_empty_tables(docs, items):
    assert containments(docs(), items((1, ITEM))).count() == 0
    assert containments(docs((1, ITEM)), items()).count() == 0
    assert without_leaks(docs((1, ITEM)), items()).count() == 1


def test_the_sql_finds_short_items_too(spark, docs, items, rows):
    import duckdb

    from tessera.llm.decontamination import ORACLE

    benchmark = [(1, ITEM), (2, "Only Three words"), (3, None), (4, ""), (5, "two words"), (6, "word")]
    documents = [(1, f"x {ITEM} y"), (2, "only three, WORDS and two words"), (3, None), (4, "a word"), (5, "words two")]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", documents)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", benchmark)
    found = sorted(tuple(r[:4]) for r in con.sql(ORACLE).fetchall())
    assert found == rows(containments(docs(*documents), items(*benchmark)), *PAIRS) == brute(documents, benchmark)
    assert {i for _, i, *_ in found} == {1, 2, 5, 6}
