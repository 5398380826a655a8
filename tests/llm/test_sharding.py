import pytest

from tessera.llm.sharding import Conflict, ShardStore, sharded


def test_rows_stay_whole_and_in_order(docs, rows, spark, tmp_path):
    given = [(i, "x" * (i % 50)) for i in range(2_000)] + [(None, None), (7, "again"), (7, "again")]
    df = docs(*given).repartition(6)
    found = sharded(df, f"file://{tmp_path}/s", target=4_000).cache()
    assert rows(found, "doc_id", "text") == sorted(given, key=repr)
    assert found.columns == [*df.columns, "shard", "place"]
    held = {r.shard: r["count"] for r in found.groupBy("shard").count().collect()}
    assert sum(held.values()) == len(given) and len(held) > 5
    places = sorted((r.shard, r.place) for r in found.collect())
    assert places == [(s, p) for s in sorted(held) for p in range(held[s])]


def test_order_of_files(docs, spark, tmp_path):
    docs(*((i, f"t{i}") for i in range(1_000))).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/in")
    found = sharded(spark.read.parquet(f"{tmp_path}/in"), f"file://{tmp_path}/s", target=1_500).orderBy("shard", "place").collect()
    assert [r.doc_id for r in found] == list(range(1_000))


def test_versions_commit_once(docs, spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target=1_000, fanout=3)
    assert store.version() == 0 and store.read() is None
    for k in range(3):
        assert store.append(docs(*((k * 100 + i, "y" * 20) for i in range(100)))) == k + 1
    assert len(store.runs()) == 3 and store.read(2).count() == 200
    assert store.compact() == 4 and len(store.runs()) == 1 and store.read().count() == 300
    assert store.read(3).count() == 300  # older versions stay readable
    with pytest.raises(Conflict):
        store.commit([], 4)
    store.vacuum()
    assert store.read().count() == 300


def test_large_document_and_empty_table(docs, tmp_path):
    found = sharded(docs((1, "z" * 100_000), (2, "small")), f"file://{tmp_path}/a", target=10)
    assert found.count() == 2
    empty = sharded(docs(), f"file://{tmp_path}/b")
    assert empty.count() == 0 and empty.columns[-2:] == ["shard", "place"]


def test_two_writers_lose_no_rows(docs, spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    one, two = (ShardStore(spark, path, target=1_000, fanout=2) for _ in range(2))
    one.append(docs((1, "a")))
    commit, between = ShardStore.commit, [lambda: two.append(docs(*((i, "b") for i in range(5))))]

    def interleaved(self, runs, version):
        if between and self is one:
            between.pop()()  # the second writer comes after the first has read, and before it commits
        return commit(self, runs, version)

    monkeypatch.setattr(ShardStore, "commit", interleaved)
    assert one.append(docs(*((i, "c") for i in range(9)))) == 3
    assert one.read().count() == 15 and len(one.runs()) == 3
    between.append(lambda: two.append(docs((90, "x" * 5_000))))
    one.compact()
    assert one.read().count() == 16 and not between
    between.append(two.compact)  # nothing to merge, no version
    one.append(docs((91, "y")))
    assert one.read().count() == 17


def test_a_merge_of_runs_that_another_has_merged_is_left(docs, spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    one, two = (ShardStore(spark, path, target=1_000, fanout=2) for _ in range(2))
    for k in range(2):
        one.append(docs(*((k * 10 + i, "a" * 9) for i in range(10))))
    merge, between = ShardStore._merge, [two.compact]

    def interleaved(self, runs):
        made = merge(self, runs)
        if between and self is one:
            between.pop()()
        return made

    monkeypatch.setattr(ShardStore, "_merge", interleaved)
    assert one.compact() == 3 and one.read().count() == 20 and len(one.runs()) == 1


def test_columns_with_clashing_names_are_kept(docs, rows, tmp_path):
    from pyspark.sql import functions as F

    df = docs(*((i, "x" * i) for i in range(300))).withColumns({"piece": F.col("doc_id") * 2, "Shard": F.lit("mine"), "place": F.lit(7), "offset": F.lit(1), "held": F.lit(2), "within": F.lit(3)})
    found = sharded(df.repartition(8), f"file://{tmp_path}/s", target=2_000)
    assert found.columns == [*df.columns, "tessera_shard", "tessera_place"]
    assert rows(found, "doc_id", "piece", "Shard", "place") == sorted(((i, 2 * i, "mine", 7) for i in range(300)), key=repr)
    with pytest.raises(ValueError, match="tessera_run"):
        sharded(df.withColumn("tessera_run", F.lit(1)), f"file://{tmp_path}/t")


def test_a_store_that_is_used_again_gives_all_its_rows(docs, tmp_path):
    for k in range(4):
        found = sharded(docs(*((100 * k + i, "z" * 30) for i in range(100))).repartition(4), f"file://{tmp_path}/s", target=1_000)
        assert sorted(r.doc_id for r in found.collect()) == list(range(100 * (k + 1)))
        places = [(r.shard, r.place) for r in found.collect()]
        assert len(set(places)) == len(places)


@pytest.mark.parametrize("jobs", [4_096, 3])
def test_shards_against_brute_force(docs, spark, tmp_path, monkeypatch, jobs):
    """Pieces in the order of arrival fill shards up to the target, whatever number of jobs writes them."""
    from tessera.llm import sharding

    monkeypatch.setattr(sharding, "PIECE", 3)
    monkeypatch.setattr(sharding, "MERGE_SHARDS", jobs)
    texts = {i: "x" * (i * 37 % 101) for i in range(400)}
    docs(*texts.items()).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/in")
    given = spark.read.parquet(f"{tmp_path}/in").select("*", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    expected, total, piece, at = {}, 0, None, 0
    for r in given:
        if (own := (r.file_path, r.row_index // 3)) != piece:
            piece, at = own, total // 700
        expected[r.doc_id] = at
        total += len(r.text)
    found = sharded(spark.read.parquet(f"{tmp_path}/in"), f"file://{tmp_path}/s", target=700, fanout=2)
    assert {r.doc_id: r.shard for r in found.collect()} == expected and len(set(expected.values())) > 20


def test_runs_of_other_sizes_are_not_merged(docs, spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target=100_000, fanout=3)
    for k, n in enumerate((10, 1_000, 11, 40_000, 12)):
        store.append(docs((k, "x" * n)))
    assert store.compact() == 6
    assert sorted(x.n_bytes for x in store.runs()) == [33, 1_000, 40_000]
