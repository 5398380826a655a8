"""Residency, hydration, durability, transactions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import hydration, retention, transactions
from tessera.sources import durable, entities
from tessera.sources.scratch import commit_file

KEYED = "entity_type string, id string"


def test_counts_clamp_at_zero(spark):
    chosen, rows, counts = random.Random(1), [], {}
    for seq in range(3_000):
        key, op = str(chosen.randrange(60)), chosen.choice(["retain", "release"])
        rows.append((seq, "t", key, op))
        if op == "retain":
            counts[key] = counts.get(key, 0) + 1
        elif counts.get(key, 0) > 0:
            counts[key] -= 1
    df = spark.createDataFrame([*rows, (5_000, "t", "never", "release")], f"seq bigint, {KEYED}, op string")
    found = retention.counts(df)
    assert {r.id: r.n for r in found.collect()} == counts
    residents = spark.createDataFrame([("t", str(i)) for i in range(0, 100, 2)], KEYED)
    assert {r.id for r in retention.evictable(residents, found).collect()} == {k for k, n in counts.items() if n == 0 and int(k) % 2 == 0}


def test_overlay_precedence(spark):
    """Every combination of dirty, in-flight, engine, open transaction and memory, against the rule."""
    rows = {"dirty": [], "inflight": [], "engine": [], "masked": [], "memory": []}
    expected = {}
    ops = (None, "put", "delete")
    n = 0
    for d in ops:
        for f in ops:
            for e in (False, True):
                for m in (False, True):
                    for r in (False, True):
                        key, n = str(n), n + 1
                        rows["dirty"] += [("t", key, d, "d")] if d else []
                        rows["inflight"] += [("t", key, f, "f")] if f else []
                        rows["engine"] += [("t", key, "e")] if e else []
                        rows["masked"] += [("t", key)] if m else []
                        rows["memory"] += [("t", key)] if r else []
                        top = (d, "dirty") if d else (f, "inflight") if f else ("put", "engine") if e else (None, None)
                        if top[0] == "put" and not m and not r:
                            expected[key] = top[1]
    make = lambda k, s: spark.createDataFrame(rows[k], s)
    overlay = hydration.overlaid(make("engine", f"{KEYED}, v string"), make("dirty", f"{KEYED}, op string, v string"), make("inflight", f"{KEYED}, op string, v string"), make("masked", KEYED), ["v"])
    found = hydration.hydrated(overlay, make("memory", KEYED))
    assert {r.id: r.source for r in found.collect()} == expected
    assert all(r.v == r.source[0].replace("i", "f") for r in found.collect())


def test_manifests(spark):
    m = spark.createDataFrame([("s1", "t", "1"), ("s1", "t", "2"), ("s2", "t", "2")], f"scope_id string, {KEYED}")
    assert hydration.scope_keys(m).count() == 2 and hydration.scope_keys(m, []).count() == 0
    new, gone = hydration.set_manifest(m, "s1", spark.createDataFrame([("t", "2"), ("t", "3")], KEYED))
    assert sorted((r.scope_id, r.id) for r in new.collect()) == [("s1", "2"), ("s1", "3"), ("s2", "2")] and [r.id for r in gone.collect()] == ["1"]
    left, pinned = hydration.remove_manifest(m, "s1")
    assert left.count() == 1 and pinned.count() == 2
    rows = spark.createDataFrame([("t", "1"), ("__cdb_manifest__", "s1"), ("t", "9")], KEYED)
    assert sorted(r.id for r in hydration.boot_all(rows, spark.createDataFrame([("t", "9")], KEYED)).collect()) == ["1"]


@pytest.fixture(params=["memory", "parquet"])
def backend(request, spark, tmp_path):
    found = durable.MemoryBackend(spark) if request.param == "memory" else durable.ParquetBackend(spark, f"file://{tmp_path}/store", buckets=4)
    found.open()
    yield found
    found.close()


ODD = ["5", "a:b:c", "ünïcode", "with space", "🔑"]


class TestBackends:
    """The engine contract, for every backend."""

    def puts(self, spark, *rows):
        return spark.createDataFrame([("t", i, d) for i, d in rows], f"{KEYED}, data string")

    def keys(self, spark, *own):
        return spark.createDataFrame([("t", i) for i in own], KEYED)

    def all(self, backend):
        return {r.id: (r.data, r.row_version) for r in backend.load_all().collect()}

    def test_contract(self, backend, spark):
        none, no_keys = self.puts(spark), self.keys(spark)
        assert self.all(backend) == {} and backend.load_many(self.keys(spark, "1")).count() == 0
        backend.write_batch(self.puts(spark, *((i, '{"x":1}') for i in ODD)), no_keys)
        assert set(self.all(backend)) == set(ODD)
        backend.write_batch(self.puts(spark, ("5", "new"), ("6", "six")), self.keys(spark, "a:b:c", "unknown"))
        found = self.all(backend)
        assert found["5"] == ("new", 2) and found["6"] == ("six", 1) and "a:b:c" not in found and len(found) == 5
        backend.write_batch(none, no_keys)
        backend.write_batch(none, self.keys(spark, "5"))
        backend.write_batch(self.puts(spark, ("5", "again")), no_keys)
        assert self.all(backend)["5"] == ("again", 1)
        assert sorted(r.id for r in backend.load_many(self.keys(spark, "5", "nope", "🔑")).collect()) == ["5", "🔑"]
        assert backend.load_many(no_keys).count() == 0

    def test_bulk(self, backend, spark):
        backend.write_batch(self.puts(spark, *((str(i), str(i)) for i in range(1_200))), self.keys(spark))
        assert backend.load_all().count() == 1_200


def test_snapshots_outlive_a_writer(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one = durable.ParquetBackend(spark, path)
    one.open()
    one.write_batch(spark.createDataFrame([("t", "1", "x")], f"{KEYED}, data string"), spark.createDataFrame([], KEYED))
    again = durable.ParquetBackend(spark, path)
    again.open()
    assert again.version() == 1 and again.format_version() == 1 and again.load_all().first().data == "x" and again.persistent


def test_a_version_is_committed_once(spark, tmp_path):
    path = f"file://{tmp_path}/v/1.json"
    commit_file(spark, path, "one")
    with pytest.raises(FileExistsError):
        commit_file(spark, path, "two")
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if not p.name.endswith(".crc")) == ["1.json"] and (tmp_path / "v/1.json").read_text() == "one"


def test_write_behind(spark):
    backend = durable.MemoryBackend(spark)
    backend.open()
    rows = [(1, "set", "t", "a", "1", "x"), (2, "set", "t", "a", "2", "x"), (3, "set", "t", "b", "1", "hydration"), (4, "set", "t", "c", "1", None), (5, "remove", "t", "c", None, None), (6, "evict", "t", "a", None, None)]
    with durable.WriteBehind(backend) as behind:
        behind.add(spark.createDataFrame(rows, f"seq bigint, op string, {KEYED}, data string, origin string"))
    assert [(r.id, r.data) for r in backend.load_all().collect()] == [("a", "2")]

    class Broken(durable.MemoryBackend):
        def write_batch(self, puts, deletes):
            raise OSError("disk")

    told = []
    broken = durable.WriteBehind(Broken(spark), told.append)
    broken.add(spark.createDataFrame(rows, f"seq bigint, op string, {KEYED}, data string, origin string"))
    assert not broken.flush() and not broken.enabled and len(told) == 1 and broken.pending().count() == 2
    broken.backend = backend
    assert broken.flush() and broken.enabled and broken.pending() is None


def test_lookups(spark):
    rows = spark.createDataFrame([("t", "1", "x", 2), ("t", "2", "y", 1), ("u", "1", "z", 0)], f"{KEYED}, v string, seed_pos int")
    keys = spark.createDataFrame([("t", "1"), ("t", "1"), ("t", "9")], KEYED)
    assert [r.id for r in entities.entries(rows, "t").collect()] == ["2", "1"]
    assert sorted((r.id, r.v) for r in entities.lookup(rows, keys).collect()) == [("1", "x"), ("9", None)]
    assert entities.lookup(rows, keys, phantoms=False).count() == 1
    assert sorted((r.id, r.found) for r in entities.has(rows, keys).collect()) == [("1", True), ("1", True), ("9", False)]
    snapshot = spark.createDataFrame([("t:a:b", '{"n":null}'), ("nokey", "{}")], "key string, data string")
    back = entities.from_snapshot(snapshot).first()
    assert (back.entity_type, back.id, back.op, back.origin) == ("t", "a:b", "set", "hydration")


FIELDS = ("a", "b")


def runs(n=150, seed=3):
    """Interleaved transactions on few keys, and what the rules leave of them."""
    chosen, log, settle, base, expected, truth = random.Random(seed), [], [], [], {}, {}
    seq = 0
    for run in range(n):
        kind = f"t{run}"
        start = {str(k): {"a": 9} for k in range(3) if chosen.random() < 0.5}
        base += [(kind, k, d["a"], None) for k, d in start.items()]
        writes, outcome = [], {}
        for _ in range(chosen.randrange(1, 16)):
            tx, key, seq = f"{kind}-{chosen.randrange(4)}", str(chosen.randrange(3)), seq + 1
            if tx in outcome:
                continue
            if chosen.random() < 0.2:
                outcome[tx] = (chosen.choice(["commit", "rollback"]), seq)
                continue
            data = {f: chosen.randrange(4) for f in FIELDS if chosen.random() < 0.6} if chosen.random() < 0.75 else None
            writes.append((tx, seq, key, data))
        log += [(tx, s, "remove" if d is None else "set", kind, k, (d or {}).get("a"), (d or {}).get("b")) for tx, s, k, d in writes]
        settle += [(tx, o, s) for tx, (o, s) in outcome.items()]

        def replay(chain, start=start):
            state = {k: dict(d) for k, d in start.items()}
            for _, _, k, d in chain:
                if d is None:
                    state.pop(k, None)
                else:
                    state[k] = {**state.get(k, {}), **d}
            return state

        for k, d in replay([w for w in writes if outcome.get(w[0], ("open",))[0] != "rollback"]).items():
            expected[kind, k] = (d.get("a"), d.get("b"))
        done = [w for w in writes if outcome.get(w[0], ("open",))[0] == "commit"]
        for k, d in replay(sorted(done, key=lambda w: (outcome[w[0]][1], w[1]))).items():
            truth[kind, k] = (d.get("a"), d.get("b"))
    return log, settle, base, expected, truth


def test_transactions_against_replay(spark):
    log, settle, base, expected, truth = runs()
    tx = spark.createDataFrame(log, f"tx_id string, seq bigint, op string, {KEYED}, a int, b int")
    done = spark.createDataFrame(settle, "tx_id string, outcome string, settle_seq bigint")
    rows = spark.createDataFrame(base, f"{KEYED}, a int, b int")
    told = lambda df: {(r.entity_type, r.id): (r.a, r.b) for r in df.collect()}
    assert told(transactions.rolled_back(rows, tx, done, FIELDS)) == expected
    assert told(transactions.truth_after(rows, tx, done, FIELDS)) == truth


def test_net_changes_and_gates(spark):
    log = [("x", 1, "set", "t", "1", 1, None), ("x", 2, "remove", "t", "1", None, None), ("x", 3, "set", "t", "1", None, 5), ("x", 4, "set", "t", "2", 1, 1), ("x", 5, "remove", "t", "2", None, None), ("y", 6, "set", "t", "1", 2, 2)]
    tx = spark.createDataFrame(log, f"tx_id string, seq bigint, op string, {KEYED}, a int, b int")
    net = transactions.net_changes(tx, FIELDS)
    assert sorted((r.tx_id, r.id, r.op, r.a, r.b) for r in net.collect()) == [("x", "1", "set", None, 5), ("x", "2", "remove", None, None), ("y", "1", "set", 2, 2)]
    assert {r.tx_id: r.verdict for r in transactions.commit_gate(net, F.col("op") != "remove").collect()} == {"x": "rollback", "y": "commit"}
    good, bad = transactions.gated(tx, [F.col("a") < 2, F.col("b").isNotNull()])
    assert [r.seq for r in good.collect()] == [4] and {r.seq: r.vetoed_by for r in bad.collect()} == {1: 1, 2: 0, 3: 0, 5: 0, 6: 0}


def test_handle():
    store, told = object(), []
    tx = transactions.Transactions(store)
    assert transactions.Transactions(store) is tx
    tx.on_settled(lambda t, o: told.append((t, o)))
    first = tx.begin()
    tx.set(first, "t", "1", {"a": 1})
    tx.remove(first, "t", "2")
    tx.commit(first)
    with pytest.raises(ValueError, match="settled"):
        tx.set(first, "t", "1", {})
    assert tx.apply([("set", "t", "1", {"a": 2})]) == "tx-2"
    with pytest.raises(ValueError, match="not enough|unpack"):
        tx.apply([("set", "t")])
    assert told == [("tx-1", "commit"), ("tx-2", "commit"), ("tx-3", "rollback")]


def test_gates():
    class Store:
        pass

    store = Store()
    tx = transactions.Transactions(store)
    off = tx.use_gate(will_apply=lambda w: w[0] != "remove" or "no removals", will_commit=lambda net: all(d is None or d.get("n", 0) < 10 for d in net.values()))
    one = tx.begin()
    tx.set(one, "t", "1", {"n": 1})
    with pytest.raises(transactions.PolicyVeto, match="no removals") as error:
        tx.remove(one, "t", "1")
    assert error.value.phase == "apply" and len(tx.writes) == 1
    tx.set(one, "t", "1", {"m": 2})
    assert tx.net(one) == {("t", "1"): {"n": 1, "m": 2}}
    tx.commit(one)
    two = tx.begin()
    tx.set(two, "t", "1", {"n": 10})
    tx.set(two, "t", "1", {"m": 0})
    with pytest.raises(transactions.PolicyVeto) as error:
        tx.commit(two)
    assert error.value.phase == "commit" and tx.outcomes[two][0] == "rollback"
    with pytest.raises(transactions.PolicyVeto):
        tx.apply([("set", "t", "1", {}), ("remove", "t", "1", None)])
    assert tx.outcomes["tx-3"][0] == "rollback"
    tx.use_gate(will_apply=lambda w: 1 / 0)
    with pytest.raises(transactions.PolicyVeto, match="division"):
        tx.set(tx.begin(), "t", "1", {})
    off()
    assert tx.will_commit == [] and len(tx.will_apply) == 1


def test_handles_go_with_their_stores():
    import gc

    class Store:
        pass

    handles = set()
    for _ in range(50):
        store = Store()
        tx = transactions.Transactions(store)
        assert tx.begin() == "tx-1" and transactions.Transactions(store) is tx
        handles.add(id(store))
        del store, tx
    gc.collect()
    assert len(transactions.Transactions._handles) < 50


def test_write_behind_merges_patches(spark):
    """What rows hold after flushes at random, against the images at each key's last write."""
    import json

    chosen = random.Random(6)
    backend = durable.MemoryBackend(spark)
    failed = []
    behind = durable.WriteBehind(backend, failed.append)
    memory, disk, seq = {}, {}, 0
    for _ in range(4):
        rows = []
        for _ in range(25):
            seq += 1
            id, op = str(chosen.randrange(6)), chosen.choice(["set", "set", "set", "replace", "remove", "evict", "hydrate"])
            data = {f: chosen.randrange(9) for f in "xyz" if chosen.random() < 0.5}
            if op == "hydrate":  # an evicted row comes back as it is on disk
                if id in memory or id not in disk:
                    continue
                memory[id] = dict(disk[id])
                rows.append((seq, "set", "t", id, json.dumps(disk[id]), "hydration"))
                if id not in backend_ids(backend):
                    rows.pop()
                    memory.pop(id)
                continue
            if op in ("set", "replace"):
                memory[id] = {**(memory.get(id, {}) if op == "set" else {}), **data}
                disk[id] = dict(memory[id])
            else:
                memory.pop(id, None)
                if op == "remove":
                    disk.pop(id, None)
            rows.append((seq, op, "t", id, json.dumps(data) if op in ("set", "replace") else None, "local-mutation"))
        behind.add(spark.createDataFrame(rows, f"seq bigint, op string, {KEYED}, data string, origin string"))
        assert behind.flush(), [str(e.java_exception.getCause() or e.java_exception)[:800] for e in failed]
        assert {r.id: json.loads(r.data) for r in backend.load_all().collect()} == disk


def backend_ids(backend):
    return {r.id for r in backend.load_all().collect()}


def test_two_writers_of_a_durable_store(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    one, two = (durable.ParquetBackend(spark, path, buckets=4) for _ in range(2))
    put = lambda i: spark.createDataFrame([("t", i, "x")], f"{KEYED}, data string")
    none = spark.createDataFrame([], KEYED)
    one.write_batch(put("0"), none)
    upserted = durable.upserted

    def slow(*args):
        monkeypatch.setattr(durable, "upserted", upserted)
        two.write_batch(put("1"), none)
        return upserted(*args)

    monkeypatch.setattr(durable, "upserted", slow)
    with pytest.raises(durable.Conflict):
        one.write_batch(put("2"), none)
    assert {r.id for r in one.load_all().collect()} == {"0", "1"}
    other = durable.ParquetBackend(spark, path, buckets=99)  # the store's own number counts
    other.write_batch(put("3"), none)
    assert other._pointer()[1]["n"] == 4 and {r.id for r in one.load_all().collect()} == {"0", "1", "3"}
    read = []
    monkeypatch.setattr(other, "_read", lambda folders: read.append(len(folders)) or durable.ParquetBackend._read(other, folders))
    assert [r.id for r in other.load_many(spark.createDataFrame([("t", "3")], KEYED)).collect()] == ["3"] and other.load_many(none).count() == 0
    assert read == [1, 0]


def test_tries_and_deadlines():
    import time

    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "open"

    assert durable.attempted(flaky, attempts=3, gap=0.5, pause=waits.append) == "open" and waits == [0.5, 0.5]
    with pytest.raises(OSError, match="never"):
        durable.attempted(lambda: (_ for _ in ()).throw(OSError("never")), pause=waits.append)
    with pytest.raises(TimeoutError):
        durable.attempted(lambda: time.sleep(5), attempts=1, deadline=0.05)

    class Slow(durable.WriteBehind):
        def flush(self):
            time.sleep(5)

    assert not Slow(None).close(deadline=0.05)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from tessera.sources.scratch import checkpoint_root

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

            class _jsc:
                sc = staticmethod(lambda: type("x", (), {"getCheckpointDir": staticmethod(lambda: type("y", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="share"):
        checkpoint_root(Session)
