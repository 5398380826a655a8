import pytest
from pyspark.sql import functions as F

from tessera.functions.matcher import M
from tessera.operators.coordinator import Coordinator, Entry, Subscription, by_priority
from tessera.operators.graph import Definition, merged, walk, write_order
from tessera.operators.pagination import merge_cursor
from tessera.sources.rest import WireError
from tessera.store import EntityStore


@pytest.fixture
def store(spark):
    return EntityStore(spark)


def keys(spark, *own):
    return spark.createDataFrame([tuple(k.split(":", 1)) for k in own], "entity_type string, id string")


def test_writes_and_reads(store, spark):
    store.set("contact", "1", {"name": "a", "age": 1})
    store.set("contact", "1", {"age": 2, "nick": None})
    store.replace("order", "5", {"total": 3})
    assert store.get("contact", "1") == {"name": "a", "age": 2, "nick": None} and store.get("contact", "2") is None
    assert store.has("order", "5") and not store.has("order", "1")
    store.set_many(spark.createDataFrame([("contact", str(i), f'{{"age":{i}}}') for i in range(10, 20)], "entity_type string, id string, data string"))
    assert sorted(r.id for r in store.query("contact", M.gt("age", 16)).collect()) == ["17", "18", "19"]
    store.compact()
    assert store.batches == [] and store.get_by_type("contact").count() == 11
    store.remove("contact", "1")
    store.evict("contact", "10")
    assert store.update("contact", "11", lambda d: {"age": d["age"] + 100}) is not None and store.update("contact", "12", lambda d: None) is None
    assert store.get("contact", "11") == {"age": 111} and not store.has("contact", "1") and not store.has("contact", "10")
    other = EntityStore(spark)
    other.hydrate(store.to_snapshot())
    assert other.to_snapshot().exceptAll(store.to_snapshot()).isEmpty() and other.log().select("origin").distinct().first()[0] == "hydration"
    with pytest.raises(ValueError, match="colon"):
        store.set("a:b", "1", {})


def test_listeners_and_contexts(store):
    seen, typed = [], []
    stop = store.subscribe(lambda df: seen.extend((r.op, r.id, r.origin, r.tx_id) for r in df.collect()))
    store.subscribe(lambda df: typed.extend(r.id for r in df.collect()), "contact")
    with store.run_with("agent", "tx-1"):
        store.set("contact", "1", {})
        with store.run_with("undo"):
            store.remove("order", "2")
        store.set("order", "3", {})
    stop()
    store.set("contact", "4", {})
    assert seen == [("set", "1", "agent", "tx-1"), ("remove", "2", "undo", None), ("set", "3", "agent", "tx-1")] and typed == ["1", "4"]


def test_residency(store, spark):
    for i in range(4):
        store.set("t", str(i), {})
    store.retain(keys(spark, "t:0", "t:1", "t:9"))
    store.retain(keys(spark, "t:1"))
    store.release(keys(spark, "t:0", "t:1", "t:3", "t:9"))
    assert store.ref_count("t", "0") == 0 and store.ref_count("t", "1") == 1 and store.ref_count("t", "2") is None
    assert store.gc() == ["t:0"] and store.gc() == [] and store.has("t", "3") and store.ref_count("t", "0") is None
    store.clear()
    assert store.entities().isEmpty() and store.ref_count("t", "1") is None


def test_custom_merges_apply_last(spark):
    registry = {"feed": Definition(id_field="feedId", merge=lambda a, b: a), "item": Definition(id_field="itemId")}
    _, found = walk({"feedId": 1, "rows": [{"itemId": 1}, {"itemId": 2}]}, registry)
    df = spark.createDataFrame([(1, n, k, i, "{}") for n, (k, i, _) in enumerate(reversed(found))], "seq bigint, place int, entity_type string, id string, data string")
    assert [(r.entity_type, r.op) for r in write_order(df, registry).orderBy("seq").collect()] == [("item", "set"), ("item", "set"), ("feed", "merge")]
    rows = "id string, items array<struct<id:string>>, cursor string"
    old, new = spark.createDataFrame([("f", [("a",)], "1"), ("g", [("z",)], "1")], rows), spark.createDataFrame([("f", [("b",)], "2"), ("h", [("c",)], "1")], rows)
    out = merged(old, new, ["id"], lambda a, b: {"items": merge_cursor(a["items"], b["items"], a["cursor"], b["cursor"], key="id"), "cursor": b["cursor"]})
    assert {r.id: ([x.id for x in r["items"]], r.cursor) for r in out.collect()} == {"f": (["a", "b"], "2"), "g": (["z"], "1"), "h": (["c"], "1")}


class Server:
    """Answers from a script."""

    def __init__(self, pages=(), verdicts=()):
        self.pages, self.verdicts, self.asked, self.pushed = list(pages), list(verdicts), [], []

    def pull(self, cursor, subscription):
        self.asked.append((cursor, subscription))
        page = self.pages.pop(0)
        if isinstance(page, Exception):
            raise page
        return page

    def push(self, batch):
        self.pushed.append([m["mutationId"] for m in batch])
        answer = self.verdicts.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def page(*changes, cursor="c", complete=True, marks=None):
    return {"type": "changes", "changes": [{"type": t, "entityType": k, "id": i, "version": v, "data": d} for t, k, i, v, d in changes], "cursor": cursor, "complete": complete, "confirmedMutations": marks or {}}


def test_pulls_apply_when_complete(spark):
    applied, warned, slept = [], [], []
    server = Server([page(("set", "t", "1", 2, {"a": 1}), cursor="c1", complete=False), page(("set", "t", "1", 1, {"a": 0}), ("set", "local", "9", 1, {}), ("remove", "t", "2", "5", None), cursor="c2", marks={"me": 2}),
                     page(("set", "t", "1", 9, {}), cursor="c3", complete=False), WireError("transient", "x"), {"type": "reset", "cursor": "r0"}])
    one = Coordinator(spark, server, lambda df: applied.append(sorted((r.id, r.op, r.version) for r in df.collect())), local_types=frozenset(["local"]), warn=warned.append, sleep=slept.append, chance=lambda: 0.5)
    one.outbox += [Entry(f"m{i}", "me", i, "set", "t", "1") for i in (1, 2, 3)]
    one.start()
    assert applied == [[("1", "set", "2"), ("2", "remove", "5")]] and len(warned) == 1 and one.pending_count() == 1
    sub = one.subscriptions[0]
    assert sub.cursor == "c2"
    one.poke()
    assert sub.cursor == "c2" and len(applied) == 1 and slept == [500]
    one.poke()
    assert sub.cursor == "r0" and slept == [500, 15_000]
    one.stop()
    assert not one.pull(sub)
    sub.cursor = None


def test_runs_without_end_are_dropped(spark):
    server = Server([page(complete=False)] * 300)
    one = Coordinator(spark, server, lambda df: 1 / 0, subscriptions=[Subscription()])
    assert not one.pull(one.subscriptions[0]) and len(server.asked) == 200
    assert [s.name for s in by_priority([Subscription("a"), Subscription("b", 5), Subscription("c")])] == ["b", "a", "c"]


def test_pushes(spark):
    told, slept = [], []
    server = Server(verdicts=[WireError("transient", "x"), [{"mutationId": "m1", "status": "reject"}, {"mutationId": "m2", "status": "transform", "remappedId": "s9", "data": {}, "version": 4}], WireError("schema", "y"), [{"mutationId": "m3", "status": "ack", "version": 7}, {"mutationId": "m4", "status": "ack"}]])
    one = Coordinator(spark, server, lambda df: None, on_verdict=lambda e, v: told.append((e.mutation_id, v["status"])), sleep=slept.append, chance=lambda: 0.5, clock=lambda: 100.0)
    one.outbox += [Entry(f"m{i}", "me", i, "set", "t", own, {}, "b") for i, own in ((1, "x"), (2, "tmp"), (3, "tmp"), (4, "y"))]
    assert not one.push() and one.retry_state() == {"attempt": 1, "nextRetryAt": 600.0, "suspendedForSchema": False} and slept == [500]
    assert one.push() and told == [("m1", "reject"), ("m2", "transform")]
    assert [(e.mutation_id, e.id, e.base_version, e.pushed) for e in one.outbox] == [("m2", "s9", None, True), ("m3", "s9", None, False), ("m4", "y", "b", False)]
    assert not one.push() and one.retry_state()["suspendedForSchema"] and not one.push() and len(server.pushed) == 3
    one.resume()
    assert all(e.pushed for e in one.outbox) and one.outbox[1].base_version == "7" and server.pushed[-1] == ["m3", "m4"] and one.push()
    one.adopt([Entry("m0", "old", 1, "set", "t", "1"), Entry("m3", "me", 3, "set", "t", "1")])
    assert [e.mutation_id for e in one.outbox] == ["m0", "m2", "m3", "m4"]
