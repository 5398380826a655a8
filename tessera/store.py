"""An entity store over a change log in Parquet: the writes, reads and lifecycle of the engine in one handle.

Every write call appends one batch of changes; reads fold the log over the last compaction. Batches are what a driver
hands over (any DataFrame of keys and JSON or VARIANT data); single writes are batches of one row. What belongs to the
store stands in numbered version files that only one writer can make: a handle that is opened on the same path has all
of it, and of two handles that write at once the second is refused.

Writes of a transaction bear its id. They count until it is rolled back; then reads leave them out, which is the truth
with all other writes replayed. Listeners get whole batches after they are stored, in the order of the writes: one that
writes itself is told of its own batch after all have been told of the first.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retention, views
from tessera.operators.changes import fold_documents, stamped
from tessera.plans.compile import documents, matching
from tessera.sources import entities as scans
from tessera.sources.scratch import commit_file, hadoop_path, read_text, scratch, stored

LOG = "seq bigint, op string, entity_type string, id string, data variant, origin string, tx_id string"
HOLDS = "seq bigint, entity_type string, id string, op string, holder string"
KEY = ["entity_type", "id"]


class Conflict(Exception):
    """Another handle has written to the store; open it anew."""


class EntityStore:
    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, (path or scratch(spark, "store")).rstrip("/")
        self.meta: tuple[str | None, str | None] = (None, None)
        self.listeners: list[tuple[str | None, Callable[[DataFrame], None]]] = []
        self.queue: deque[DataFrame] = deque()
        self.delivering = False
        self.before_compaction: list[Callable[[], object]] = []
        self.version = self._last()
        state = json.loads(read_text(spark, self._file(self.version))) if self.version else {}
        self.seq: int = state.get("seq", 0)
        self.batches: list[str] = state.get("batches", [])
        self.holds: list[str] = state.get("holds", [])
        self.base: str | None = state.get("base")
        self.outcomes: dict[str, str] = state.get("outcomes", {})

    # ---- versions ----

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _last(self) -> int:
        fs, folder = hadoop_path(self.spark, f"{self.path}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _commit(self, **changes: object) -> None:
        state = {k: getattr(self, k) for k in ("seq", "batches", "holds", "base", "outcomes")} | changes
        try:
            commit_file(self.spark, self._file(self.version + 1), json.dumps(state))
        except FileExistsError as error:
            raise Conflict(f"version {self.version + 1} exists") from error
        self.version += 1
        for name, value in state.items():
            setattr(self, name, value)

    # ---- writes ----

    def write(self, rows: DataFrame, op: str | None = None) -> int:
        """Appends rows (key, data; op unless given; place for their order) and tells listeners; returns the last seq."""
        data = F.parse_json("data") if dict(rows.dtypes).get("data") == "string" else F.col("data") if "data" in rows.columns else F.lit(None).cast("variant")
        kind = F.lit(op) if op else F.col("op")
        order = F.col("place") if "place" in rows.columns else F.monotonically_increasing_id()
        own = stamped(rows.select((order + self.seq).alias("seq"), kind.alias("op"), *KEY, data.alias("data")), *self.meta)
        name = f"log/{self.seq:012d}-{uuid.uuid4().hex}"
        own.write.parquet(f"{self.path}/{name}")
        batch = self._batch(name)
        last = batch.agg(F.max("seq")).first()[0]
        self._commit(seq=(self.seq if last is None else last) + 1, batches=[*self.batches, name])
        done = self.seq - 1
        self._deliver(batch)
        return done

    def _batch(self, *names: str) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/{x}" for x in names))

    def _deliver(self, batch: DataFrame) -> None:
        """Tells all listeners of one batch before the next; a batch that comes meanwhile waits for its turn."""
        self.queue.append(batch)
        if self.delivering:
            return
        self.delivering = True
        try:
            while self.queue:
                now = self.queue.popleft()
                for entity_type, listener in list(self.listeners):
                    listener(now if entity_type is None else now.where(F.col("entity_type") == entity_type))
        finally:
            self.delivering = False
            self.queue.clear()

    def tx_write(self, tx_id: str, op: str, entity_type: str, id: str, data: Mapping | None) -> None:
        """A write of a transaction."""
        with self.run_with(self.meta[0] or "local-mutation", tx_id):
            self._one(op, entity_type, id, data)

    def tx_settled(self, tx_id: str, outcome: str) -> None:
        """Settles a transaction; after a rollback listeners are told what its keys hold again."""
        own = self.log().where(F.col("tx_id") == tx_id)
        keys = stored(own.select(*KEY).distinct(), "settled")
        # as many numbers as the transaction has writes, which become durable in the order of the commits
        self._commit(outcomes={**self.outcomes, tx_id: outcome}, seq=self.seq + own.count())
        if outcome == "rollback" and self.listeners:
            now = keys.join(self.entities(), KEY, "left")
            place = F.lit(self.seq).cast("long") + F.monotonically_increasing_id()
            told = now.select(place.alias("seq"), F.when(F.col("data").isNull(), "remove").otherwise("replace").alias("op"), *KEY, "data")
            self._deliver(stored(stamped(told, "local-mutation", tx_id), "rolled-back"))

    def _one(self, op: str, entity_type: str, id: str, data: Mapping | None = None) -> int:
        if ":" in entity_type:
            raise ValueError("a type name holds no colon")
        return self.write(self.spark.createDataFrame([(entity_type, str(id), None if data is None else json.dumps(data))], "entity_type string, id string, data string"), op)

    def set(self, entity_type: str, id: str, data: Mapping) -> int:
        return self._one("set", entity_type, id, data)

    def replace(self, entity_type: str, id: str, data: Mapping) -> int:
        return self._one("replace", entity_type, id, data)

    def set_many(self, rows: DataFrame) -> int:
        return self.write(rows, "set")

    def remove(self, entity_type: str, id: str) -> int:
        return self._one("remove", entity_type, id)

    def evict(self, entity_type: str, id: str) -> int:
        return self._one("evict", entity_type, id)

    def update(self, entity_type: str, id: str, updater: Callable[[dict | None], Mapping | None]) -> int | None:
        """Replaces the entity by what ``updater`` makes of it; None leaves it."""
        found = updater(self.get(entity_type, id))
        return None if found is None else self.replace(entity_type, id, found)

    def clear(self) -> int:
        """Removes what is there now, and every hold on it."""
        now = stored(self.entities().select(*KEY), "cleared")
        self._hold(now, "clear", None)
        return self.write(now, "remove")

    @contextmanager
    def run_with(self, origin: str | None = None, tx_id: str | None = None) -> Iterator[EntityStore]:
        """Writes inside bear these; an inner context replaces the outer one."""
        before, self.meta = self.meta, (origin, tx_id)
        try:
            yield self
        finally:
            self.meta = before

    def subscribe(self, listener: Callable[[DataFrame], None], entity_type: str | None = None) -> Callable[[], None]:
        entry = (entity_type, listener)
        self.listeners.append(entry)
        return lambda: self.listeners.remove(entry) if entry in self.listeners else None

    # ---- reads ----

    def log(self) -> DataFrame:
        return self._batch(*self.batches) if self.batches else self.spark.createDataFrame([], LOG)

    def counted(self) -> DataFrame:
        """The log without transactions that were rolled back."""
        gone = [tx for tx, outcome in self.outcomes.items() if outcome == "rollback"]
        return self.log().where(~F.coalesce(F.col("tx_id").isin(gone), F.lit(False))) if gone else self.log()

    def open_transactions(self) -> list[str]:
        """Those with writes in the log that are not settled."""
        found = self.log().where("tx_id IS NOT NULL").select("tx_id").distinct()
        return sorted(r[0] for r in found.toLocalIterator() if r[0] not in self.outcomes)

    def _folded(self, log: DataFrame) -> DataFrame:
        rows = log.select("seq", "op", *KEY, "data")
        if self.base is not None:
            base = self.spark.read.schema("entity_type string, id string, data variant").parquet(f"{self.path}/{self.base}")
            rows = base.select(F.lit(-1).cast("long").alias("seq"), F.lit("replace").alias("op"), *KEY, "data").unionByName(rows)
        return fold_documents(rows)

    def entities(self) -> DataFrame:
        """Key and data VARIANT of everything in memory."""
        return self._folded(self.counted())

    def compact(self) -> None:
        """Folds the log into a base that later reads start from, up to the first write of an open transaction."""
        for prepare in list(self.before_compaction):
            prepare()
        log, open_ = self.counted(), self.open_transactions()
        cut = log.where(F.col("tx_id").isin(open_)).agg(F.min("seq")).first()[0] if open_ else None
        name = f"base/{self.seq:012d}-{uuid.uuid4().hex}"
        self._folded(log if cut is None else log.where(F.col("seq") < cut)).write.parquet(f"{self.path}/{name}")
        if cut is None:
            self._commit(base=name, batches=[], outcomes={})
            return
        rest = f"log/{self.seq:012d}-{uuid.uuid4().hex}"
        log.where(F.col("seq") >= cut).write.parquet(f"{self.path}/{rest}")
        self._commit(base=name, batches=[rest], outcomes={k: v for k, v in self.outcomes.items() if v == "commit"})

    def watch(self, entity_type: str, filter: object, listener: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Tells the rows that match, now and after each batch that changes which they are or what they hold."""
        held = [stored(self.query(entity_type, filter), "watched")]
        listener(held[0])

        def look(batch: DataFrame) -> None:
            if batch.isEmpty():
                return
            now = stored(self.query(entity_type, filter), "watched")
            as_text = lambda df: df.select(*KEY, F.to_json("data").alias("data"))
            if not views.same(as_text(held[0]), as_text(now)):
                held[0] = now
                listener(now)

        return self.subscribe(look, entity_type)

    def get_by_type(self, entity_type: str) -> DataFrame:
        return scans.of_type(self.entities(), entity_type)

    def query(self, entity_type: str, filter: object) -> DataFrame:
        return matching(self.get_by_type(entity_type), filter, fields=documents("data"))

    def get(self, entity_type: str, id: str) -> dict | None:
        row = self.get_by_type(entity_type).where(F.col("id") == str(id)).select(F.to_json("data").alias("data")).first()
        return None if row is None else json.loads(row[0])

    def has(self, entity_type: str, id: str) -> bool:
        return not self.get_by_type(entity_type).where(F.col("id") == str(id)).isEmpty()

    def to_snapshot(self) -> DataFrame:
        return scans.to_snapshot(self.entities())

    def hydrate(self, snapshot: DataFrame) -> int:
        """Merging writes of (key, data JSON text)."""
        with self.run_with("hydration"):
            return self.write(scans.from_snapshot(snapshot).select("op", *KEY, "data"))

    # ---- residency ----

    def _hold(self, keys: DataFrame, op: str, holder: str | None) -> None:
        name = f"holds/{len(self.holds):012d}-{uuid.uuid4().hex}"
        keys.select(F.lit(len(self.holds)).cast("long").alias("seq"), *KEY, F.lit(op).alias("op"), F.lit(holder).cast("string").alias("holder")).write.parquet(f"{self.path}/{name}")
        self._commit(holds=[*self.holds, name])

    def retain(self, keys: DataFrame, holder: str | None = None) -> None:
        self._hold(keys, "retain", holder)

    def release(self, keys: DataFrame, holder: str | None = None) -> None:
        self._hold(keys, "release", holder)

    def counts(self) -> DataFrame:
        """n of each key that is or was held since its last wipe."""
        if not self.holds:
            return self.spark.createDataFrame([], "entity_type string, id string, n bigint")
        ops = self.spark.read.schema(HOLDS).parquet(*(f"{self.path}/{x}" for x in self.holds))
        wiped = ops.where("op = 'clear'").groupBy(*KEY).agg(F.max("seq").alias("wiped"))
        return retention.counts(ops.where("op != 'clear'").join(wiped, KEY, "left").where("wiped IS NULL OR seq > wiped"))

    def ref_count(self, entity_type: str, id: str) -> int | None:
        row = self.counts().where((F.col("entity_type") == entity_type) & (F.col("id") == str(id))).first()
        return None if row is None else row.n

    def gc(self) -> list[str]:
        """Evicts what was released by all; returns the keys. What was never held stays."""
        counted = self.counts()
        idle = stored(counted.where("n <= 0").select(*KEY), "idle")
        if idle.isEmpty():
            return []
        gone = stored(retention.evictable(self.entities(), counted).select(*KEY), "evictable")
        keys = [f"{r.entity_type}:{r.id}" for r in gone.toLocalIterator()]
        if keys:
            self.write(gone, "evict")
        self._hold(idle, "clear", None)
        return sorted(keys)
