import pytest
from pyspark.sql import functions as F

from tessera.functions.matcher import M
from tessera.operators import changes, views
from tessera.streaming.live import Boundary, Coalescer, folding_view, guarded, live_view, rescanned, with_store
from tests_support import event_rows

SCHEMA = "seq bigint, op string, entity_type string, id string, a int"


@pytest.fixture
def files(spark, tmp_path):
    """Events in files, one micro-batch each."""
    rows = event_rows(400)
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    return rows, f"{tmp_path}/in/*"


def run(df, tmp_path, sink):
    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def test_live_view_equals_the_batch(spark, files, tmp_path):
    rows, path = files
    node = M.gte("a", 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    found = []
    run(live_view(stream, node), tmp_path, lambda batch, _: found.extend(map(tuple, batch.select("seq", "id", "delta").collect())))
    log = spark.createDataFrame(rows, SCHEMA).withColumn("op", F.when(F.col("op") == "set", "replace").otherwise(F.col("op")))
    batch = views.deltas(changes.images(log, ["a"]), node, ["a"])
    assert sorted(found) == sorted((r.seq, r.id, r.delta) for r in batch.collect()) and len(found) > 100


def test_unusable_filters_fail_at_once(spark, files):
    with pytest.raises(ValueError, match="unusable"):
        live_view(spark.readStream.schema(SCHEMA).parquet(files[1]), {"op": "regex", "field": "a", "value": "x"})


def test_listeners(spark, files, tmp_path):
    rows, path = files
    order, errors = [], []
    boundary = Boundary(errors.append)
    boundary.subscribe(lambda b, n: order.append(("key", b.count())), "t", "1")
    boundary.subscribe(lambda b, n: 1 / 0)
    boundary.subscribe(lambda b, n: order.append(("all", b.count())))
    stop = boundary.subscribe(lambda b, n: order.append(("gone", 0)))
    boundary.subscribe(lambda b, n: order.append(("type", b.count())), "t")
    stop()
    run(spark.readStream.schema(SCHEMA).parquet(path), tmp_path, boundary.sink)
    assert order == [("all", 400), ("type", 400), ("key", sum(r[3] == "1" for r in rows))] and len(errors) == 1


def test_coalescer(spark):
    now, flushed = [0.0], []
    one = Coalescer(lambda b: flushed.append(b.count()), delay=1, clock=lambda: now[0])
    one.flush()
    one.add(spark.range(3))
    one.add(spark.range(2))
    assert flushed == []
    now[0] = 2
    one.add(spark.range(1))
    assert flushed == [6]
    one.add(spark.range(4))
    one.flush()
    one.flush()
    assert flushed == [6, 4]


def test_opaque_views_scan_again_once_a_batch(spark):
    rows = spark.createDataFrame([("t", "1", 1), ("t", "2", 5), ("u", "3", 9)], "entity_type string, id string, a int")
    out, scans = [], []
    sink = rescanned(lambda: scans.append(1) or rows, lambda row: row["a"] > 2, ["t"], lambda df: out.append(sorted(r.id for r in df.collect())))
    sink(rows.where("entity_type = 'u'"), 0)
    sink(rows, 1)
    assert out == [["2"]] and len(scans) == 1


def test_guard_reports_what_differs(spark):
    rows = spark.createDataFrame([("t", "1"), ("t", "2")], "entity_type string, id string")
    told = []
    guarded(lambda: rows, lambda: rows.where("id = '1'"), lambda df: told.append(df.collect()))(rows, 0)
    guarded(lambda: rows, lambda: rows, lambda df: told.append(df.collect()))(rows, 1)
    assert [[(r.id, r.divergence) for r in x] for x in told] == [[("2", "missing")]]


def test_a_view_that_folds_patches_in_the_stream(spark, tmp_path):
    import json
    import random

    chosen, rows = random.Random(8), []
    for seq in range(300):
        op = chosen.choice(["set", "set", "set", "replace", "remove", "evict"])
        data = {f: chosen.randrange(4) for f in "ab" if chosen.random() < 0.6} if op in ("set", "replace") else None
        rows.append((seq, op, "t", str(chosen.randrange(12)), data))
    schema = "seq bigint, op string, entity_type string, id string, data string"
    for k in range(3):
        part = [(*r[:4], None if r[4] is None else json.dumps(r[4])) for r in rows[k * 100 : (k + 1) * 100]]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    node = M.and_(M.gte("a", 2), M.neq("b", 1))
    memory, held, expected = {}, set(), []
    for seq, op, _, id, data in rows:
        memory[id] = {**((memory.get(id) if op == "set" else None) or {}), **data} if data is not None else None
        member = memory[id] is not None and memory[id].get("a", -1) >= 2 and "b" in memory[id] and memory[id]["b"] != 1
        if member != (id in held):
            expected.append((seq, id, "add" if member else "remove"))
            (held.add if member else held.discard)(id)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = []
    with with_store(spark):
        run(folding_view(stream, node), tmp_path, lambda batch, _: found.extend(map(tuple, batch.select("seq", "id", "delta").collect())))
    assert sorted(found) == expected and len(expected) > 40
    with pytest.raises(ValueError, match="unusable"):
        folding_view(stream, lambda row: True)


def test_with_store_leaves_the_session_as_it_was(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "other")
    with with_store(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == "other"
    spark.conf.set(key, before)


def test_coalescer_flushes_by_itself(spark):
    import threading

    told, flushed = threading.Event(), []
    one = Coalescer(lambda b: (flushed.append(b.count()), told.set()), delay=0.2)
    one.add(spark.range(3))
    assert told.wait(20) and flushed == [3] and one.held is None


def test_guard_has_the_truth_adopted(spark):
    rows = spark.createDataFrame([("t", "1"), ("t", "2")], "entity_type string, id string")
    view = [rows.where("id = '1'")]
    sink = guarded(lambda: rows, lambda: view[0], lambda df: None, lambda right: view.__setitem__(0, right))
    sink(rows, 0)
    assert sorted(r.id for r in view[0].collect()) == ["1", "2"]
