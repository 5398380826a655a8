"""The store on disk, its persistence handle, and the coordinator over a store."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.matcher import M
from tessera.operators.coordinator import Coordinator, Entry, changes_nothing
from tessera.operators.transactions import Transactions
from tessera.persistence import Persistence
from tessera.sources.durable import ParquetBackend
from tessera.sources.rest import WireError
from tessera.store import Conflict, EntityStore
from test_store import Server, keys, page

NONE = "entity_type string, id string"


def data(rows):
    return {f"{r.entity_type}:{r.id}": json.loads(r.data) for r in rows.select("entity_type", "id", F.col("data") if dict(rows.dtypes)["data"] == "string" else F.to_json("data").alias("data")).collect()}


def test_a_store_opens_again(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one = EntityStore(spark, path)
    one.set("t", "1", {"a": 1})
    one.compact()
    one.set("t", "1", {"b": 2})
    one.retain(keys(spark, "t:1"))
    again = EntityStore(spark, path)
    assert again.get("t", "1") == {"a": 1, "b": 2} and again.ref_count("t", "1") == 1 and again.seq == one.seq
    again.set("t", "2", {})
    with pytest.raises(Conflict):
        one.set("t", "3", {})
    assert sorted(data(EntityStore(spark, path).entities())) == ["t:1", "t:2"]


def test_no_nested_delivery(spark):
    store, order = EntityStore(spark), []

    def first(batch):
        ids = [r.id for r in batch.collect()]
        order.append(("first", ids))
        if ids == ["1"]:
            store.set("t", "2", {})

    store.subscribe(first)
    store.subscribe(lambda batch: order.append(("second", [r.id for r in batch.collect()])))
    store.set("t", "1", {})
    assert order == [("first", ["1"]), ("second", ["1"]), ("first", ["2"]), ("second", ["2"])]


def test_transactions_of_a_store(spark):
    store, told = EntityStore(spark), []
    store.set("t", "1", {"n": 0, "k": 1})
    tx = Transactions(store)
    one, two = tx.begin(), tx.begin()
    tx.set(one, "t", "1", {"n": 1})
    tx.set(two, "t", "1", {"m": 2})
    tx.remove(one, "t", "9")
    assert store.get("t", "1") == {"n": 1, "k": 1, "m": 2} and store.open_transactions() == [one, two]
    store.subscribe(lambda b: told.extend((r.op, r.id, r.tx_id, r.d) for r in b.select("op", "id", "tx_id", F.to_json("data").alias("d")).collect()))
    tx.rollback(one)
    assert store.get("t", "1") == {"n": 0, "k": 1, "m": 2}
    assert {(o, i, t, d and tuple(sorted(json.loads(d).items()))) for o, i, t, d in told} == {("replace", "1", one, (("k", 1), ("m", 2), ("n", 0))), ("remove", "9", one, None)}
    store.compact()  # up to the open transaction
    assert store.get("t", "1") == {"n": 0, "k": 1, "m": 2} and len(store.batches) == 1
    tx.commit(two)
    store.compact()
    assert store.batches == [] and EntityStore(spark, store.path).get("t", "1") == {"n": 0, "k": 1, "m": 2}


def test_watch(spark):
    store, seen = EntityStore(spark), []
    stop = store.watch("t", M.gt("n", 1), lambda rows: seen.append(sorted(r.id for r in rows.collect())))
    store.set("t", "1", {"n": 2})
    store.set("t", "2", {"n": 0})
    store.set("u", "3", {"n": 9})
    store.set("t", "2", {"n": 5})
    stop()
    store.remove("t", "1")
    assert seen == [[], ["1"], ["1", "2"]]


@pytest.fixture
def backend(spark, tmp_path):
    return ParquetBackend(spark, f"file://{tmp_path}/disk", buckets=4)


def test_persists_images_and_boots(spark, backend):
    store = EntityStore(spark)
    with Persistence(store, backend) as kept:
        store.set("t", "1", {"x": 1})
        assert kept.flush()
        store.set("t", "1", {"y": 2})
        store.set("t", "2", {"z": 0})
        store.evict("t", "2")
        tx = Transactions(store)
        one, two, open_ = tx.begin(), tx.begin(), tx.begin()
        tx.set(one, "t", "3", {"a": 1})
        tx.set(two, "t", "4", {"a": 1})
        tx.set(open_, "t", "5", {"a": 1})
        assert kept.flush() and "t:3" not in data(backend.load_all())
        tx.commit(one)
        tx.rollback(two)
    rows = data(backend.load_all())
    assert rows == {"t:1": {"x": 1, "y": 2}, "t:2": {"z": 0}, "t:3": {"a": 1}}
    fresh = EntityStore(spark)
    fresh.set("t", "1", {"fresh": True})
    with Persistence(fresh, backend) as kept:
        assert kept.booted == 2 and data(fresh.entities()) == {**rows, "t:1": {"fresh": True}}
        assert kept.behind.dirty is None or kept.flush()
    assert data(backend.load_all()) == {**rows, "t:1": {"x": 1, "y": 2}}


def test_commits_take_their_place_in_order(spark, backend):
    store = EntityStore(spark)
    with Persistence(store, backend):
        tx = Transactions(store)
        one, two = tx.begin(), tx.begin()
        tx.set(one, "t", "1", {"n": 1})
        tx.set(two, "t", "1", {"n": 2})
        tx.commit(two)
        tx.commit(one)
        store.set("t", "1", {"m": 0})
    assert data(backend.load_all()) == {"t:1": {"n": 1, "m": 0}}


def test_manifests(spark, backend):
    store = EntityStore(spark)
    with Persistence(store, backend) as kept:
        store.set_many(spark.createDataFrame([("t", str(i), f'{{"n":{i}}}') for i in range(6)], "entity_type string, id string, data string"))
        kept.set_manifest("a", keys(spark, "t:0", "t:1"))
        kept.set_manifest("a", keys(spark, "t:1", "t:2"))
        kept.set_manifest("b", keys(spark, "t:2", "t:3", "t:99"))
        assert store.ref_count("t", "2") == 2 and store.ref_count("t", "0") == 0
    assert store.ref_count("t", "2") == 0  # pins end with the handle
    fresh = EntityStore(spark)
    with Persistence(fresh, backend, hydration="manifest") as kept:
        assert kept.booted == 3 and sorted(data(fresh.entities())) == ["t:1", "t:2", "t:3"] and kept.scopes() == ["a", "b"]
        assert fresh.ref_count("t", "2") == 2
        fresh.evict("t", "3")
        fresh.evict("t", "1")
        assert kept.hydrate_scope("b") == 1 and kept.preload() == 1 and kept.preload() == 0
        fresh.set("t", "99", {"pending": 1})
        fresh.evict("t", "99")
        assert kept.hydrate_scope("b") == 1 and fresh.get("t", "99") == {"pending": 1}  # never flushed
        tx = Transactions(fresh)
        one = tx.begin()
        fresh.evict("t", "3")
        tx.remove(one, "t", "3")
        assert kept.hydrate_scope("b") == 0  # a transaction holds it
        tx.rollback(one)
        assert kept.remove_manifest("b") == ["t:99"] and kept.scopes() == ["a"] and fresh.has("t", "2")
    assert sorted(k for k in data(backend.load_all()) if k.startswith("t:")) == ["t:0", "t:1", "t:2", "t:3", "t:4", "t:5", "t:99"]


def test_a_failure_is_told_and_kept(spark, backend, monkeypatch):
    store, errors = EntityStore(spark), []
    kept = Persistence(store, backend, on_error=errors.append)
    store.set("t", "1", {"a": 1})
    monkeypatch.setattr(backend, "write_batch", lambda *a: 1 / 0)
    assert not kept.flush() and len(errors) == 1 and store.get("t", "1") == {"a": 1}
    monkeypatch.undo()
    store.compact()  # flushes first
    assert data(backend.load_all()) == {"t:1": {"a": 1}}
    assert kept.close() and kept.close()
    store.set("t", "2", {})
    assert len(data(backend.load_all())) == 1


# ---- the coordinator over a store ----


def synced(spark, server, **settings):
    store = EntityStore(spark)
    return store, Coordinator(spark, server, store=store, client_id="me", chance=lambda: 0.5, pause=lambda ms: None, **settings)


def ack(mutation, **more):
    return {"mutationId": mutation, "status": "ack", **more}


def test_the_tap(spark):
    store, one = synced(spark, Server(), local_types=frozenset(["local"]), mint_auth=lambda: "token")
    store.set("t", "0", {"a": 0})
    with store.run_with("local-mutation"):
        store.set("t", "1", {"a": 1})
        store.set("t", "1", {"a": 1})  # changes nothing
        store.set("t", "1", {"b": [1]})
        store.replace("t", "1", {"c": 1})
        store.evict("t", "1")
        store.set("local", "1", {})
        store.remove("t", "1")
    assert [(e.op, e.seq, e.data, e.previous) for e in one.outbox] == [
        ("set", 1, {"a": 1}, None), ("set", 2, {"a": 1, "b": [1]}, {"a": 1}), ("set", 3, {"c": 1}, {"a": 1, "b": [1]}), ("remove", 4, None, None),
    ]
    assert one.outbox[0].auth == "token" and one.outbox[0].mutation_id == "0-1-me" and "data" not in one.outbox[3].as_change()
    tx = Transactions(store)
    mine = tx.begin()
    tx.set(mine, "t", "5", {"x": 1})
    tx.rollback(mine)
    assert [(e.tx_id, e.id) for e in one.outbox[4:]] == [(mine, "5")]
    one.stop()
    with store.run_with("local-mutation"):
        store.set("t", "6", {})
    assert one.pending_count() == 5


def test_changes_nothing():
    assert changes_nothing({"a": 1, "b": None}, {"a": 1.0, "b": None}) and changes_nothing({}, {})
    assert not changes_nothing(None, {}) and not changes_nothing({"a": 1}, {"a": True}) and not changes_nothing({"a": [1]}, {"a": [1]}) and not changes_nothing({}, {"a": None})


def test_rejects_go_back(spark):
    server = Server(verdicts=[[{"mutationId": "0-1-me", "status": "reject"}, ack("0-2-me", version=3)], [{"mutationId": "0-3-me", "status": "reject"}], [{"mutationId": "0-4-me", "status": "reject"}]])
    store, one = synced(spark, server)
    store.set("t", "1", {"a": 0})
    with store.run_with("local-mutation"):
        store.set("t", "1", {"a": 1})
        store.set("t", "2", {"n": 1})
    assert one.push() and store.get("t", "1") == {"a": 0} and one.versions["t", "2"] == "3" and [e.id for e in one.outbox] == ["2"]
    # the server has written since: its truth, patch over patch, and not what was before
    with store.run_with("local-mutation"):
        store.set("t", "1", {"a": 5})
    server.pages = [page(("set", "t", "1", 7, {"b": 1}), ("set", "t", "1", 8, {"c": 2}), cursor="c1")]
    one.poke()
    assert store.get("t", "1") == {"a": 5, "b": 1, "c": 2}
    assert one.push() and store.get("t", "1") == {"b": 1, "c": 2}
    with store.run_with("local-mutation"):
        store.set("t", "1", {"b": 9})
    server.verdicts = [WireError("transient", "x"), [{"mutationId": "0-4-me", "status": "reject"}]]
    assert not one.push() and one.retry_state()["attempt"] == 1
    with store.run_with("local-mutation"):
        store.set("t", "1", {"d": 4})
    assert one.run() == 1 and store.get("t", "1") == {"b": 9, "c": 2, "d": 4}  # the sibling holds the image that it was made on
    assert [e.mutation_id for e in one.outbox] == ["0-2-me", "0-5-me"] and server.pushed[-1] == ["0-4-me", "0-5-me"]


def test_transforms(spark):
    server = Server(verdicts=[[{"mutationId": "0-1-me", "status": "transform", "data": {"a": 1, "server": True}, "remappedId": "s1", "version": 2}]])
    store, one = synced(spark, server)
    with store.run_with("local-mutation"):
        store.set("t", "tmp", {"a": 1})
        store.set("t", "tmp", {"b": 2})
    server_push = server.push

    def first_only(batch):
        return server_push(batch[:1])

    server.push = first_only
    assert one.push()
    assert not store.has("t", "tmp") and store.get("t", "s1") == {"a": 1, "server": True, "b": 2}
    assert [(e.id, e.pushed, e.base_version) for e in one.outbox] == [("s1", True, None), ("s1", False, None)] and one.versions["t", "s1"] == "2"
    assert one.truth["t", "s1"] == {"a": 1, "server": True} and one.generations["t", "s1"] == 1


def test_runs_come_again(spark):
    slept = []
    server = Server([WireError("transient", "x"), {"type": "reset", "cursor": "r"}, page(("set", "t", "1", 2, {"a": 1}), cursor="c1"), page(("set", "t", "1", 2, {"a": 9}), ("set", "t", "1", 1, {"a": 8}), ("remove", "t", "2", 1, None), cursor="c2", marks={"me": 1})])
    store, one = synced(spark, server, sleep=slept.append)
    one.outbox.append(Entry("m1", "me", 1, "set", "t", "1", pushed=True))
    one.start()
    assert slept == [500] and one.run() == 1 and slept == [500, 15_000] and one.subscriptions[0].cursor == "r"
    assert one.run(5) == 1 and store.get("t", "1") == {"a": 1} and one.subscriptions[0].cursor == "c1" and server.asked[-1][0] == "r"
    one.poll()
    assert one.run() == 1 and store.get("t", "1") == {"a": 1} and one.outbox == [] and one.truth["t", "2"] is None and len(one.due) == 1


def test_one_push_at_a_time_and_recovery(spark):
    store, one = synced(spark, Server([page(cursor="c")]), recover=lambda: [Entry("old", "other", 3, "set", "t", "1", {"a": 1})])
    one.start()
    assert [e.mutation_id for e in one.outbox] == ["old"]
    inner = []

    def push(batch):
        inner.append(one.push())
        return [ack("old")]

    one.adapter.push = push
    assert one.push() and inner == [False] and one.outbox[0].pushed and one.push()
