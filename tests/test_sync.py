import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import wire
from tessera.operators import sync
from tessera.sources.rest import RestAdapter, WireError, checked_page, push_sink

KEYED = "entity_type string, id string"


@pytest.mark.parametrize(
    ("a", "b", "answer"),
    [
        ("10", "9", "newer"), ("9", "10", "older"), ("1.0", "1", "same"), ("1e2", "100", "same"), ("", "0", "same"), ("0x10", "16", "same"), ("0b11", "3", "same"), ("0o17", "15", "same"), ("a", "b", "older"),
        ("b", "10", "newer"), ("v10", "v9", "older"), ("Infinity", "1", "newer"), (".5", "0.5", "same"), ("5.", "5", "same"), ("1_0", "10", "newer"), ("\U0001f511", "～", "older"), ("-1", "1", "older"), ("NaN", "1", "newer"),
    ],
)
def test_version_order(spark, a, b, answer):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(wire.compare_versions(F.col("a"), F.col("b"))).first()[0] == answer
    assert sync._default_order(a, b) == answer


def test_statuses_and_backoff(spark):
    asked = {200: "verdict", 204: "verdict", 301: "transient", 400: "permanent", 404: "permanent", 408: "transient", 409: "schema", 429: "transient", 500: "transient", 0: "transient"}
    df = spark.createDataFrame([(s,) for s in asked], "s int")
    assert {r.s: r.o for r in df.select("s", wire.status_class(F.col("s")).alias("o")).collect()} == asked
    waits = spark.range(0, 100).select(wire.backoff(F.col("id")).alias("w"), wire.backoff_limit(F.col("id")).alias("m")).collect()
    assert all(0 <= r.w < r.m <= 60_000 for r in waits) and waits[1].m == 1_000 and waits[3].m == 4_000 and waits[99].m == 60_000
    assert spark.range(1).select(wire.mutation_id(F.lit(5), F.lit(2), F.lit("c"))).first()[0] == "5-2-c"


def brute(changes):
    known, kept, state = {}, [], {}
    for arrival, key, version, data in changes:
        if key in known and sync._default_order(version, known[key]) != "newer":
            continue
        known[key] = version
        kept.append(arrival)
        if data is None:
            state.pop(key, None)
        else:
            state[key] = {**state.get(key, {}), **data}
    return kept, state


@pytest.mark.parametrize("texts", [False, True])
def test_version_aware_apply(spark, texts):
    chosen = random.Random(5)
    version = lambda: chosen.choice(["a", "b", "10", "9", "2.0", "z"]) if texts else str(chosen.randrange(40))
    changes = [(n, str(chosen.randrange(15)), version(), {f: chosen.randrange(5) for f in "xy" if chosen.random() < 0.7} if chosen.random() < 0.8 else None) for n in range(400)]
    rows = [(n, "t", k, v, "remove" if d is None else "set", (d or {}).get("x"), (d or {}).get("y")) for n, k, v, d in changes]
    df = spark.createDataFrame(rows, f"arrival bigint, {KEYED}, version string, op string, x int, y int")
    kept, state = brute(changes)
    assert sorted(r.arrival for r in sync.accepted(df).collect()) == kept
    found = {r.id: {f: r[f] for f in "xy" if r[f] is not None} for r in sync.applied(df, ["x", "y"]).collect()}
    assert found == state


def test_own_comparator_may_find_versions_concurrent(spark):
    df = spark.createDataFrame([(1, "t", "a", "5"), (2, "t", "a", "~3"), (3, "t", "a", "1")], f"arrival bigint, {KEYED}, version string")
    order = lambda a, b: "concurrent" if "~" in a else "older"
    assert [r.arrival for r in sync.accepted(df, compare=order).collect()] == [1, 2]


def test_outbox_and_verdicts(spark):
    events = [(1, "set", "t", "1", "local-mutation"), (2, "set", "t", "1", "sync-pull"), (3, "evict", "t", "1", "local-mutation"), (4, "remove", "t", "1", "local-mutation"), (5, "set", "local", "1", "local-mutation"), (6, "set", "t", "2", None)]
    df = spark.createDataFrame(events, f"seq bigint, op string, {KEYED}, origin string").withColumn("client_id", F.lit("c"))
    out = sync.outbox(df, ["local"])
    assert [(r.seq, r.client_seq) for r in out.orderBy("seq").collect()] == [(1, 1), (4, 2)]
    pending = spark.createDataFrame([(f"m{i}", "c", i, "t", own, "b") for i, own in enumerate(["1", "1", "2", "3", "1"])], "mutation_id string, client_id string, client_seq int, entity_type string, id string, base_version string")
    verdicts = spark.createDataFrame([("m0", "transform", "v1", "99"), ("m2", "ack", "v2", None), ("m3", "reject", None, None)], "mutation_id string, status string, version string, remapped_id string")
    found = {r.mutation_id: (r.id, r.pushed, r.base_version) for r in sync.after_verdicts(pending, verdicts).collect()}
    assert found == {"m0": ("99", True, None), "m1": ("99", False, None), "m2": ("2", True, "v2"), "m4": ("99", False, None)}
    marks = spark.createDataFrame([("c", 2), ("d", 9)], "client_id string, seq bigint")
    assert sorted(r.mutation_id for r in sync.unconfirmed(pending, marks).collect()) == ["m3", "m4"]
    assert sync.adopted(pending, pending).count() == 10


def test_server_rules(spark):
    pushes = spark.createDataFrame([(1, "a", "c", 1), (2, "a", "c", 1), (3, "b", "c", 3), (4, "d", "e", 1)], "arrival int, mutation_id string, client_id string, client_seq int")
    once = sync.replayed_once(pushes)
    assert sorted(r.arrival for r in once.collect()) == [1, 3, 4]
    assert [(r.client_id, r.client_seq, r.expected) for r in sync.gaps(once).collect()] == [("c", 3, 2)]
    assert {r.client_id: r.last_seen for r in sync.last_seen(once).collect()} == {"c": 3, "e": 1}
    pages = spark.createDataFrame([("s", 1, 1, "changes", False), ("s", 1, 2, "changes", True), ("s", 2, 3, "changes", False), ("s", 3, 4, "error", True), (None, 1, 5, "changes", True)], "subscription string, run int, page int, type string, complete boolean")
    assert sorted(r.page for r in sync.staged(pages).collect()) == [1, 2, 5]
    assert sorted(r.page for r in sync.staged(pages, most=1).collect()) == [5]


PAGE = {"type": "changes", "changes": [{"type": "set", "entityType": "t", "id": "1", "version": 3, "data": {}}], "cursor": "c", "complete": True, "confirmedMutations": {"a": 1}}


@pytest.mark.parametrize(
    "broken",
    [None, [], {}, {"type": "x"}, {**PAGE, "changes": None}, {**PAGE, "changes": [{"type": "set", "entityType": "t", "id": 1, "version": 1, "data": {}}]}, {**PAGE, "changes": [{"type": "set", "entityType": "t", "id": "1", "version": True, "data": {}}]},
     {**PAGE, "changes": [{"type": "set", "entityType": "t", "id": "1", "version": 1}]}, {**PAGE, "cursor": 1}, {**PAGE, "complete": 1}, {**PAGE, "confirmedMutations": {"a": "1"}}],
)
def test_malformed_pages_are_refused(broken):
    with pytest.raises(WireError):
        checked_page(broken)


def test_adapter_and_sink(spark):
    asked, status = [], [200]

    def transport(url, headers, body):
        asked.append((url, json.loads(body), headers))
        found = PAGE if url.endswith("pull") else {"results": [{"mutationId": m["mutationId"], "status": "ack", "version": 1} for m in asked[-1][1]["changes"]]}
        return status[0], json.dumps(found).encode()

    adapter = RestAdapter("http://x/", transport=transport, headers={"Authorization": "a", "Content-Type": "application/x"})
    assert adapter.pull(None, "s") == PAGE and asked[-1][:2] == ("http://x/sync/v1/pull", {"cursor": None, "subscription": "s"})
    assert asked[-1][2] == {"authorization": "a", "content-type": "application/x"}
    batch = spark.createDataFrame([(f"m{i}", "c", i, "set", "t", str(i), '{"a":1}') for i in range(4)] + [("m4", "c", 4, "remove", "t", "4", None)], f"mutation_id string, client_id string, client_seq int, op string, {KEYED}, data string")
    push_sink(adapter, most=2)(batch, 0)
    assert [[m["seq"] for m in body["changes"]] for _, body, _ in asked[1:]] == [[0, 1], [2, 3], [4]] and "data" not in asked[-1][1]["changes"][0]
    tokens = iter("ab")
    versioned = RestAdapter("http://x", transport=transport, headers=lambda: {"Authorization": next(tokens)}, schema_version="7", limit=50)
    versioned.pull("c1")
    assert asked[-1][1:] == ({"cursor": "c1", "limit": 50, "schemaVersion": "7"}, {"content-type": "application/json", "authorization": "a"})
    versioned.push([])
    assert asked[-1][1:] == ({"changes": [], "schemaVersion": "7"}, {"content-type": "application/json", "authorization": "b"})
    for code, kind in ((409, "schema"), (404, "permanent"), (429, "transient"), (503, "transient")):
        status[0] = code
        with pytest.raises(WireError) as error:
            adapter.pull("c")
        assert error.value.outcome == kind
        assert wire.class_of(code) == kind


def test_a_real_server():
    """Statuses and bodies over HTTP, and no answer at all."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    answers, seen = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["content-length"])))))
            code, body = answers.pop(0)
            self.send_response(code)
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    adapter = RestAdapter(f"http://127.0.0.1:{server.server_port}")
    try:
        answers += [(200, json.dumps(PAGE).encode()), (409, b"{}"), (503, b"busy"), (401, b""), (200, b"<html>")]
        assert adapter.pull(None) == PAGE and seen == [("/sync/v1/pull", {"cursor": None})]
        for kind in ("schema", "transient", "permanent", "transient"):
            with pytest.raises(WireError) as error:
                adapter.push([{"mutationId": "m"}])
            assert error.value.outcome == kind
        assert seen[-1] == ("/sync/v1/push", {"changes": [{"mutationId": "m"}]})
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(WireError) as error:
        adapter.pull("c")
    assert error.value.outcome == "transient"


@pytest.mark.parametrize("broken", [{}, {"results": [{"status": "ack"}]}, {"results": [{"mutationId": "m", "status": "maybe"}]}, {"results": [{"mutationId": "m", "status": "ack", "version": None}]}, {"results": [{"mutationId": "m", "status": "transform", "data": []}]}, {"results": [{"mutationId": "m", "status": "transform", "remappedId": ""}]}])
def test_malformed_verdicts_are_refused(broken):
    from tessera.sources.rest import checked_verdicts

    with pytest.raises(WireError):
        checked_verdicts(broken)
