"""The sync coordinator: a control loop over an adapter, with the data work left to ``tessera.operators.sync``.

It pulls pages until a run is complete and applies them at once, pushes the outbox in order with one push in flight,
backs off with full jitter and no ceiling of attempts, suspends on a schema conflict until resumed, takes a reset's
cursor and pulls again. What is to be tried again waits in ``due`` until ``run`` comes to it. Time, chance, sleep and
pause are injected.

With a ``store`` it fills its outbox by what the store tells of local mutations, and writes to the store what the
server says: pulled changes merge, a transformed write is replaced by the server's entity, a rejected one goes back to
what was before it, or to the server's truth where that has changed since; other waiting writes to the key are replayed.

The outbox, and the server's truth about keys it has told of in this session, are in the driver; ``sync`` has the same
rules for tables.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.matcher import scalar_class
from tessera.operators import sync
from tessera.sources.rest import WireError
from tessera.store import EntityStore

# Pages of a run, and milliseconds of the waits.
MOST_PAGES, RESET_JITTER_MS, BASE_MS, MOST_MS, POLL_MS = 200, 30_000, 1_000, 60_000, 30_000
REMOTE = "arrival bigint, entity_type string, id string, op string, version string, data string"
WRITES = "place bigint, op string, entity_type string, id string, data string"
Key = tuple[str, str]


@dataclass
class Subscription:
    name: str | None = None
    priority: int = 0
    cursor: str | None = None
    attempt: int = 0


@dataclass
class Entry:
    """A write that waits for the server."""

    mutation_id: str
    client_id: str
    seq: int
    op: str
    entity_type: str
    id: str
    data: dict | None = None
    base_version: str | None = None
    pushed: bool = False
    tx_id: str | None = None
    auth: object = None
    #: The entity before the write, None for none, and how often the server had written to it then.
    previous: dict | None = None
    base_gen: int = 0

    def as_change(self) -> dict:
        told = {
            "mutationId": self.mutation_id, "clientId": self.client_id, "seq": self.seq, "op": self.op, "entityType": self.entity_type, "id": self.id,
            "data": self.data, "baseVersion": self.base_version, "transactionId": self.tx_id,
        }
        return {k: v for k, v in told.items() if v is not None}


def by_priority(subscriptions: Sequence[Subscription]) -> list[Subscription]:
    """Highest first; ties keep their order."""
    return sorted(subscriptions, key=lambda s: -s.priority)


def changes_nothing(before: dict | None, patch: Mapping) -> bool:
    """Whether a merging write is no event: each of its values is a scalar that is there already."""
    if before is None:
        return False
    return all(k in before and scalar_class(v) is not None and scalar_class(v) == scalar_class(before[k]) and v == before[k] for k, v in patch.items())


@dataclass
class Coordinator:
    """``apply`` gets the accepted changes of a complete run; ``on_verdict`` an entry and the server's word on it."""

    spark: SparkSession
    adapter: sync.Adapter
    apply: Callable[[DataFrame], None] = lambda changes: None
    subscriptions: Sequence[Subscription] = (Subscription(),)
    local_types: frozenset[str] = frozenset()
    on_verdict: Callable[[Entry, dict], None] = lambda entry, verdict: None
    warn: Callable[[str], None] = lambda text: None
    clock: Callable[[], float] = lambda: 0.0
    sleep: Callable[[float], None] = lambda ms: None
    chance: Callable[[], float] = random.random
    outbox: list[Entry] = field(default_factory=list)
    attempt: int = 0
    next_retry: float | None = None
    suspended: bool = False
    stopped: bool = False
    arrivals: int = 0
    store: EntityStore | None = None
    client_id: str = "client"
    mint_auth: Callable[[], object] | None = None
    recover: Callable[[], Sequence[Entry]] | None = None
    pause: Callable[[float], None] = lambda ms: time.sleep(ms / 1_000)

    def __post_init__(self) -> None:
        self.due: list[tuple[float, Callable[[], object]]] = []
        self.pushing = False
        self.counter = 0
        self.versions: dict[Key, str] = {}
        self.generations: dict[Key, int] = {}
        #: The server's entity of each key it has told of: patches merged, None for a removal.
        self.truth: dict[Key, dict | None] = {}
        self._untap = self.store.subscribe(self._tap) if self.store is not None else lambda: None

    # ---- handle ----

    def start(self) -> None:
        if self.recover is not None:
            self.adopt(self.recover())
        for subscription in by_priority(self.subscriptions):
            self.pull(subscription)

    def stop(self) -> None:
        """No new work; the outbox stays."""
        self.stopped = True
        self._untap()

    def poke(self, name: str | None = None) -> None:
        """What a live channel says: come and pull."""
        for subscription in self.subscriptions:
            if subscription.name == name:
                self.pull(subscription)

    def pending_count(self) -> int:
        return len(self.outbox)

    def retry_state(self) -> dict:
        return {"attempt": self.attempt, "nextRetryAt": self.next_retry, "suspendedForSchema": self.suspended}

    def _backoff(self, attempt: int) -> float:
        return int(self.chance() * min(MOST_MS, BASE_MS * 2 ** min(max(0, attempt - 1), 16)))

    def _later(self, wait: float, action: Callable[[], object]) -> None:
        self.sleep(wait)
        self.due.append((self.clock() + wait, action))

    def run(self, most: int = 1) -> int:
        """Does what is due next, after a pause until it is, up to ``most`` times; how often it did."""
        for done in range(most):
            if self.stopped or not self.due:
                return done
            at, action = min(self.due, key=lambda x: x[0])
            self.due.remove((at, action))
            if (wait := at - self.clock()) > 0:
                self.pause(wait)
            action()
        return most

    def poll(self) -> None:
        """Has every subscription pull again after the poll interval, from now on."""
        for subscription in by_priority(self.subscriptions):
            self._poll(subscription)

    def _poll(self, subscription: Subscription) -> None:
        def again() -> None:
            self.pull(subscription)
            self._poll(subscription)

        self.due.append((self.clock() + POLL_MS, again))

    # ---- outbox ----

    def _images(self, keys: DataFrame, before: int) -> dict[Key, dict]:
        """What the store held of some keys before a place in its log: as many rows as keys."""
        log = self.store.counted().where(F.col("seq") < before)
        found = self.store._folded(log).join(F.broadcast(keys), ["entity_type", "id"], "left_semi")
        return {(r.entity_type, r.id): json.loads(r.data) for r in found.select("entity_type", "id", F.to_json("data").alias("data")).toLocalIterator()}

    def _tap(self, batch: DataFrame) -> None:
        """Local mutations of shared types, with the entity before and after each; evictions are not among them."""
        if self.stopped:
            return
        own = batch.where((F.col("origin") == "local-mutation") & F.col("op").isin("set", "replace", "remove"))
        if self.local_types:
            own = own.where(~F.col("entity_type").isin(sorted(self.local_types)))
        rows = own.select("seq", "op", "entity_type", "id", F.to_json("data").alias("data"), "tx_id").orderBy("seq").collect()  # a user's writes
        if not rows or rows[0].tx_id is not None and self.store.outcomes.get(rows[0].tx_id) == "rollback":
            return
        keys = self.spark.createDataFrame(sorted({(r.entity_type, r.id) for r in rows}), "entity_type string, id string")
        now = self._images(keys, rows[0].seq)
        for r in rows:
            key, patch = (r.entity_type, r.id), None if r.op == "remove" else json.loads(r.data)
            before = now.get(key)
            if r.op == "set" and changes_nothing(before, patch):
                continue
            after = None if patch is None else patch if r.op == "replace" else {**(before or {}), **patch}
            if after is None:
                now.pop(key, None)
            else:
                now[key] = after
            self.counter += 1
            self.outbox.append(Entry(
                f"{int(self.clock())}-{self.counter}-{self.client_id}", self.client_id, self.counter, "remove" if after is None else "set", *key, after,
                self.versions.get(key), tx_id=r.tx_id, auth=self.mint_auth() if self.mint_auth else None, previous=before, base_gen=self.generations.get(key, 0),
            ))

    def adopt(self, stranded: Sequence[Entry]) -> None:
        """Another session's writes, as they are; at start only."""
        known = {e.mutation_id for e in self.outbox}
        self.outbox[:0] = [e for e in stranded if e.mutation_id not in known]

    # ---- pull ----

    def pull(self, subscription: Subscription) -> bool:
        """One run. Nothing applies, and the cursor stays, unless the run completes within its pages; else it is due again."""
        staged, marks, cursor = [], {}, subscription.cursor
        again = lambda: self.pull(subscription)
        for _ in range(MOST_PAGES):
            if self.stopped:
                return False
            try:
                page = self.adapter.pull(cursor, subscription.name)
            except WireError:
                break
            if page["type"] == "reset":
                subscription.cursor, subscription.attempt = page.get("cursor"), 0
                self._later(int(self.chance() * RESET_JITTER_MS), again)
                return False
            staged += page["changes"]
            for client, seq in page.get("confirmedMutations", {}).items():
                marks[client] = max(seq, marks.get(client, seq))
            cursor = page["cursor"]
            if page["complete"]:
                self._apply(staged)
                self._confirm(marks)
                subscription.cursor, subscription.attempt = cursor, 0
                return True
        subscription.attempt += 1
        self._later(self._backoff(subscription.attempt), again)
        return False

    def _newer(self, key: Key, version: str) -> bool:
        known = self.versions.get(key)
        compare = getattr(self.adapter, "compare_versions", None) or sync._default_order
        return known is None or compare(version, known) in ("newer", "concurrent")

    def _server_wrote(self, key: Key, data: dict | None, merge: bool) -> None:
        self.generations[key] = self.generations.get(key, 0) + 1
        self.truth[key] = {**(self.truth.get(key) or {}), **data} if merge and data is not None else data

    def _apply(self, changes: Sequence[Mapping]) -> None:
        rows = []
        for change in changes:
            key = (change["entityType"], change["id"])
            if key[0] in self.local_types:
                self.warn(f"a change of the local type {key[0]} is left out ({key[1]})")
                continue
            version = str(change["version"])
            self.arrivals += 1
            if not self._newer(key, version):
                continue
            self.versions[key] = version
            data = change.get("data") if change["type"] == "set" else None
            self._server_wrote(key, data, merge=True)
            rows.append((self.arrivals, *key, change["type"], version, None if data is None else json.dumps(data)))
        if rows:
            accepted = self.spark.createDataFrame(rows, REMOTE)
            if self.store is not None:
                self._write([(op, *key, data) for _, *key, op, _, data in rows], "sync-pull")
            self.apply(accepted)

    def _write(self, rows: Sequence[tuple[str, str, str, str | None]], origin: str, tx_id: str | None = None) -> None:
        """Writes (op, key, data text) to the store, in their order."""
        if rows:
            with self.store.run_with(origin, tx_id):
                self.store.write(self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], WRITES))

    def _confirm(self, marks: Mapping[str, int]) -> None:
        self.outbox[:] = [e for e in self.outbox if e.client_id not in marks or marks[e.client_id] < e.seq]

    # ---- push ----

    def push(self) -> bool:
        """All that isn't pushed, in order. False if there was no answer to it, or while another push is in flight."""
        waiting = [e for e in self.outbox if not e.pushed]
        if not waiting or self.suspended or self.stopped or self.pushing:
            return not waiting
        self.pushing = True
        try:
            verdicts = {v["mutationId"]: v for v in self.adapter.push([e.as_change() for e in waiting])}
        except WireError as error:
            if error.outcome == "schema":
                self.suspended = True
                return False
            self.attempt += 1
            wait = self._backoff(self.attempt)
            self.next_retry = self.clock() + wait
            self._later(wait, self.push)
            return False
        finally:
            self.pushing = False
        self.attempt, self.next_retry = 0, None
        for entry in waiting:
            if (verdict := verdicts.get(entry.mutation_id)) is not None:
                self._settle(entry, verdict)
        return True

    def _siblings(self, entry: Entry, id: str) -> list[tuple[str, str, str, str | None]]:
        """The other waiting writes to a key, to be replayed over what the server says of it."""
        return [
            (e.op, e.entity_type, e.id, None if e.data is None else json.dumps(e.data))
            for e in self.outbox
            if e is not entry and not e.pushed and (e.entity_type, e.id) == (entry.entity_type, id)
        ]

    @staticmethod
    def _as_write(key: Key, data: dict | None) -> tuple[str, str, str, str | None]:
        return ("remove", *key, None) if data is None else ("replace", *key, json.dumps(data))

    def _settle(self, entry: Entry, verdict: Mapping) -> None:
        self.on_verdict(entry, dict(verdict))
        key = (entry.entity_type, entry.id)
        if verdict["status"] == "reject":
            if self.store is not None:
                right = entry.previous if self.generations.get(key, 0) == entry.base_gen else self.truth[key]
                self._write([self._as_write(key, right), *self._siblings(entry, entry.id)], "undo", entry.tx_id)
            self.outbox.remove(entry)
            return
        entry.pushed = True
        new_id = verdict.get("remappedId") or entry.id
        if verdict["status"] == "transform":
            target, rows = (entry.entity_type, new_id), []
            if verdict.get("data"):
                rows.append(self._as_write(target, verdict["data"]))
                self._server_wrote(target, verdict["data"], merge=False)
            if new_id != entry.id:
                rows.append(("remove", *key, None))
                for other in self.outbox:
                    if (other.entity_type, other.id) == key:
                        other.id, other.base_version = new_id, None
            if self.store is not None:
                self._write([*rows, *self._siblings(entry, new_id)], "sync-pull")
        if verdict.get("version") is not None:
            self.versions[entry.entity_type, new_id] = str(verdict["version"])
            if verdict["status"] == "ack":
                entry.base_version = str(verdict["version"])

    def resume(self) -> None:
        """After the schema conflict is dealt with."""
        self.suspended = False
        self.push()
