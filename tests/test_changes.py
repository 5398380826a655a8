import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, history, views
from tessera.functions.matcher import M

FIELDS = ("a", "b", "v")
OPS = ["set", "set", "set", "replace", "remove", "evict"]


def logs(n=300, seed=0):
    """Random logs of many runs at once; a run is an entity type."""
    chosen, rows = random.Random(seed), []
    for run in range(n):
        for _ in range(chosen.randrange(1, 25)):
            op = chosen.choice(OPS)
            data = {} if op in ("remove", "evict") else {f: chosen.randrange(3) for f in ("a", "b") if chosen.random() < 0.6} | ({"v": chosen.choice([0.5, math.nan])} if chosen.random() < 0.3 else {})
            rows.append((len(rows), op, f"t{run}", str(chosen.randrange(3)), data))
    return rows


class Store:
    """The dict oracle."""

    def __init__(self):
        self.memory, self.disk, self.events = {}, {}, []

    def apply(self, seq, op, kind, id, data):
        key, old = (kind, id), self.memory.get((kind, id))
        if op == "set":
            if old is not None and all(f in old and old[f] == x for f, x in data.items()):
                return
            self.memory[key] = {**(old or {}), **data}
        elif op == "replace":
            self.memory[key] = dict(data)
        elif op == "remove":
            self.memory.pop(key, None)
            self.disk.pop(key, None)
        elif old is None:
            return
        else:
            self.memory.pop(key)
        if op in ("set", "replace"):
            self.disk[key] = (dict(self.memory[key]), self.disk.get(key, ({}, 0))[1] + 1)
        self.events.append((seq, op, kind, id, old, self.memory.get(key)))


@pytest.fixture(scope="module")
def rows():
    return logs()


@pytest.fixture(scope="module")
def oracle(rows):
    store = Store()
    for r in rows:
        store.apply(*r)
    return store


@pytest.fixture(scope="module")
def log(spark, rows):
    flat = [(s, o, k, i, d.get("a"), d.get("b"), d.get("v")) for s, o, k, i, d in rows]
    return spark.createDataFrame(flat, "seq bigint, op string, entity_type string, id string, a long, b long, v double").cache()


def shown(data):
    return repr({f: x for f in FIELDS if (x := (data or {}).get(f)) is not None})


def test_fold(log, oracle):
    found = {(r.entity_type, r.id): shown(r.asDict()) for r in changes.fold(log, FIELDS).collect()}
    assert found == {k: shown(x) for k, x in oracle.memory.items()}


def test_images_and_events(log, oracle):
    imaged = changes.images(log, FIELDS)
    found = {r.seq: (r.op, shown({f: r[f"prev_{f}"] for f in FIELDS}), shown({f: r[f"now_{f}"] for f in FIELDS})) for r in changes.emitted(imaged, FIELDS).collect()}
    assert found == {s: (o, shown(old), shown(new)) for s, o, _, _, old, new in oracle.events}


def test_durable_fold(log, oracle):
    found = {(r.entity_type, r.id): shown(r.asDict()) for r in changes.durable_fold(log, FIELDS).collect()}
    assert found == {k: shown(x) for k, (x, _) in oracle.disk.items()}


def test_row_versions_count_writes(spark):
    log = spark.createDataFrame([(1, "set", "t", "a", 1), (2, "set", "t", "a", 2), (3, "evict", "t", "a", None), (4, "set", "t", "b", 1), (5, "remove", "t", "b", None), (6, "replace", "t", "b", 7)], "seq long, op string, entity_type string, id string, x long")
    assert sorted((r.id, r.x, r.row_version) for r in changes.durable_fold(log, ["x"]).collect()) == [("a", 2, 2), ("b", 7, 1)]


def test_fold_of_documents(spark, rows, monkeypatch):
    monkeypatch.setattr(changes, "PIECE", 7)  # pieces of a key's log meet
    plain = [(s, o, k, i, json.dumps({"n": None, **{f: x for f, x in d.items() if f != "v"}}) if o in ("set", "replace") else None) for s, o, k, i, d in rows]
    found = changes.fold_documents(spark.createDataFrame(plain, "seq bigint, op string, entity_type string, id string, t string").withColumn("data", F.parse_json("t")))
    memory = {}
    for _, o, k, i, t in plain:
        if o in ("set", "replace"):
            memory[k, i] = {**(memory.get((k, i), {}) if o == "set" else {}), **json.loads(t)}
        else:
            memory.pop((k, i), None)
    assert {(r.entity_type, r.id): json.loads(r.t) for r in found.select("entity_type", "id", F.to_json("data").alias("t")).collect()} == memory


def test_replay_of_events_gives_the_same_state(log, oracle):
    """Each event's image as a replace, in order, rebuilds memory."""
    imaged = changes.emitted(changes.images(log, FIELDS), FIELDS)
    again = imaged.select("seq", F.when(F.col("op") == "set", "replace").otherwise(F.col("op")).alias("op"), "entity_type", "id", *(F.col(f"now_{f}").alias(f) for f in FIELDS))
    assert {(r.entity_type, r.id): shown(r.asDict()) for r in changes.fold(again, FIELDS).collect()} == {k: shown(x) for k, x in oracle.memory.items()}


def test_view_deltas_and_members(log, oracle):
    node = M.and_(M.gte("a", 1), M.not_(M.eq("b", 2)))
    member = lambda d: d is not None and d.get("a") is not None and d["a"] >= 1 and d.get("b") != 2
    held, expected, order = set(), [], []
    for s, _, k, i, _, new in oracle.events:
        key = (k, i)
        if member(new) != (key in held):
            expected.append((s, k, i, "add" if member(new) else "remove"))
            (held.add if member(new) else held.discard)(key)
            if member(new):
                order.append(key)
            else:
                order.remove(key)
    found = views.deltas(changes.images(log, FIELDS), node, FIELDS)
    assert sorted((r.seq, r.entity_type, r.id, r.delta) for r in found.collect()) == expected
    assert [(r.entity_type, r.id) for r in views.members(found).orderBy("entered").collect()] == order
    truth = views.after(changes.images(log, FIELDS), FIELDS)
    assert views.healed(views.members(found), views.members(found))[1] and truth.count() == log.count()


def test_history(log, oracle):
    events = history.write_ids(changes.emitted(changes.images(log, FIELDS), FIELDS))
    found = history.rows(events, FIELDS)
    expected, n = [], 0
    for s, o, k, i, old, new in oracle.events:
        if o == "evict":
            continue
        n += 1
        if o == "remove":
            expected.append((s, f"w-{n}", None, "remove"))
            continue
        for f in FIELDS:
            a, b = (old or {}).get(f), (new or {}).get(f)
            if not (a == b or (a != a and b != b)):
                expected.append((s, f"w-{n}", f, "set"))
    assert sorted(((r.seq, r.mutation_id, r.field, r.type) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert history.purged(found).where("type = 'set'").join(found.where("type = 'remove'").select("entity_type", "id", F.col("seq").alias("s")), ["entity_type", "id"]).where("seq < s").isEmpty()


@pytest.mark.parametrize(("sizes", "left"), [([10] * 8, [5, 6, 7]), ([10, 10, 100, 10, 10], [3, 4]), ([10, 10, 100], []), ([40, 10, 10], [1, 2]), ([], [])])
def test_history_caps(spark, sizes, left):
    """Three rows and 50 bytes: a row that alone is too large clears the log with itself."""
    kept = []
    for i, size in enumerate(sizes):
        kept.append((i, size))
        while kept and (len(kept) > 3 or sum(s for _, s in kept) > 50):
            kept.pop(0)
    df = spark.createDataFrame(list(enumerate(sizes)), "seq bigint, n bigint").withColumn("field", F.lit("f"))
    found = sorted(r.seq for r in history.capped(df, max_rows=3, max_bytes=50, size=F.col("n")).collect())
    assert found == [i for i, _ in kept] == left


def test_keys(spark):
    kind, own = changes.split_key()
    df = spark.createDataFrame([("contact:a:b",), ("nocolon",), ("x:",), ("é:🔑",)], "key string").select(kind.alias("k"), own.alias("i"))
    assert [tuple(r) for r in df.collect()] == [("contact", "a:b"), (None, None), ("x", ""), ("é", "🔑")]


def test_stamps_shadow(spark):
    df = changes.stamped(changes.stamped(spark.range(1), "undo", "tx-1"), "agent")
    assert tuple(df.select("origin", "tx_id").first()) == ("agent", None)


@pytest.mark.parametrize("piece", [1, 7, 50])
def test_images_in_pieces(log, oracle, monkeypatch, piece):
    monkeypatch.setattr(changes, "IMAGE_PIECE", piece)
    monkeypatch.setattr(views, "IMAGE_PIECE", piece)
    imaged = changes.images(log, FIELDS)
    assert sorted(imaged.columns) == sorted([*log.columns, "exists", "existed", *(f"{w}_{f}" for w in ("now", "prev") for f in FIELDS)])
    events = changes.emitted(imaged, FIELDS)
    found = {r.seq: (r.op, shown({f: r[f"prev_{f}"] for f in FIELDS}), shown({f: r[f"now_{f}"] for f in FIELDS}), r.existed) for r in events.collect()}
    assert found == {s: (o, shown(old), shown(new), old is not None) for s, o, _, _, old, new in oracle.events}
    ticks, expected = {}, {}
    for s, _, k, *_ in oracle.events:
        ticks[k] = expected[s] = ticks.get(k, 0) + 1
    assert {r.seq: r.version_tick for r in views.version_ticks(events).collect()} == expected


def test_clear_numbers_in_the_order_of_keys(spark):
    keys = [("t" if i % 3 else "s", f"k{i:03}") for i in range(200)]
    found = changes.clear(spark.createDataFrame(keys, "entity_type string, id string").repartition(5), 1_000).collect()
    assert [(r.seq, r.op, r.entity_type, r.id) for r in sorted(found, key=lambda r: r.seq)] == [(1_000 + n, "remove", *k) for n, k in enumerate(sorted(keys))]


def test_folds_leave_the_session_as_it_is(spark, log):
    before = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    changes.fold_documents(log.select("seq", "op", "entity_type", "id", F.parse_json(F.to_json(F.struct("a", "b"))).alias("data"))).count()
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == before
