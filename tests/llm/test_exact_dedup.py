import hashlib

from pyspark.sql import functions as F

from tessera.llm.exact_dedup import DigestIndex, exact_dedup

COLUMNS = ("doc_id", "keep_id", "group_size", "kept")


def test_groups_and_ties(docs, rows):
    df = docs((1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "b" * 300_000), (7, "b" * 300_000), (8, "b" * 299_999 + "c"))
    assert rows(exact_dedup(df, keep="largest"), *COLUMNS) == sorted(
        [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True)], key=repr
    )
    assert {r[:2] for r in rows(exact_dedup(df), *COLUMNS)} >= {(1, 1), (2, 1), (5, 4)}


def test_repeated_rows_and_null_ids_leave_one(docs, rows):
    df = docs((1, "a"), (1, "a"), (None, "a"), (None, "z"), (None, "z"))
    found = rows(exact_dedup(df, keep="largest"), *COLUMNS)
    assert [r for r in found if r[1] == 1 and r[3]] == [(1, 1, 3, True)]
    assert sorted(r[3] for r in found if r[1] is None) == [False, True]
    assert len(found) == 5


def test_collisions_are_told_apart_by_bytes(docs, rows):
    df = docs((1, "aa"), (2, "ab"), (3, "aa"), (4, "ba"), (5, "ab"), (6, "c"))
    weak = lambda c: F.encode(F.length(c).cast("string"), "UTF-8")
    assert rows(exact_dedup(df, keep="largest", digest=weak), *COLUMNS) == rows(exact_dedup(df, keep="largest"), *COLUMNS)


def test_hot_group_is_salted(docs, rows):
    df = docs(*((i, "hot") for i in range(500)), *((1000 + i, f"t{i}") for i in range(50)))
    found = rows(exact_dedup(df, keep="largest", hot=7), *COLUMNS)
    assert sum(r[3] for r in found) == 51 and {r[1] for r in found if r[2] == 500} == {499}


def test_empty_table(docs, rows):
    assert rows(exact_dedup(docs()), *COLUMNS) == []


def test_digest_is_sha256(docs):
    row = exact_dedup(docs((1, "äß"))).first()
    assert bytes(row.digest) == hashlib.sha256("äß".encode()).digest()


def test_index_over_several_flushes(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/lsm", "smallest")
    key = lambda *x: spark.createDataFrame([(d.encode(), i, i) for d, i in x], "digest binary, doc_id bigint, row bigint")
    index.flush(key(("x", 5), ("y", 2)), 2)
    index.flush(key(("x", 3), ("z", 9)), 2)
    assert len(index.runs) == 2
    assert sorted((bytes(r.digest), r.best.doc_id, r.copies) for r in index.compact().collect()) == [(b"x", 3, 2), (b"y", 2, 1), (b"z", 9, 1)]
    assert len(index.runs) == 1


def test_levels_filters_and_probes(spark, tmp_path):
    """Memtables one after the other: hits, tiers and lookups against a dictionary."""
    import random

    chosen, index, held = random.Random(3), DigestIndex(spark, f"file://{tmp_path}/lsm", "smallest", fanout=2), {}
    for k in range(5):
        rows = [(hashlib.sha256(str(chosen.randrange(4_000)).encode()).digest(), chosen.randrange(10_000), 10_000 * k + i) for i in range(1_000)]
        own = {}
        for d, i, r in rows:
            own.setdefault(d, []).append((i, r))
        hits = index.flush(spark.createDataFrame(rows, "digest binary, doc_id bigint, row bigint"))
        assert sorted(bytes(r.digest) for r in hits.collect()) == sorted(d for d in own if len(own[d]) > 1 or d in held)
        for d, at in own.items():
            held.setdefault(d, []).extend(at)
        index.tier()
        assert sorted(r.level for r in index.runs) == [[0], [1], [0, 1], [2], [0, 2]][k]
    absent = [(hashlib.sha256(f"no{i}".encode()).digest(),) for i in range(2_000)]
    asked = spark.createDataFrame([*absent, *((d,) for d in held)], "digest binary")
    found = {bytes(r.digest): (tuple(r.best), r.copies) for r in index.lookup(asked).collect()}
    assert found == {d: (min(at), len(at)) for d, at in held.items()}
    for run in index.runs:  # filters let all pass that a run holds, and few others
        passed = {bytes(r.digest) for r in index.maybe(asked, run).collect()}
        inside = {bytes(r.digest) for r in spark.read.parquet(f"file://{tmp_path}/lsm/{run.name}").collect()}
        assert inside <= passed and len(passed - inside) < 0.02 * asked.count()


def test_an_empty_memtable_makes_no_run(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/lsm")
    assert index.flush(spark.createDataFrame([], "digest binary, doc_id bigint, row bigint")).isEmpty() and index.runs == []
    index.tier()
    assert index.lookup(spark.createDataFrame([(b"x",)], "digest binary")).isEmpty()
