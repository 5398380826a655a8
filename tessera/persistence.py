"""Durability for a store: one handle over its changes, transactions, scope manifests and a durable engine.

Changes are collected as the store tells them and written behind it, as images. What was hydrated isn't written back;
writes of a transaction wait for its end, and take their place in the order of the commits. A scope's manifest lists
the keys that it pins: a row of the engine for each, beside the entities.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import hydration
from tessera.operators.hydration import MANIFEST_PREFIX
from tessera.operators.transactions import Transactions
from tessera.sources.durable import StorageBackend, WriteBehind
from tessera.sources.scratch import stored
from tessera.store import EntityStore

KEY = ["entity_type", "id"]
MANIFEST = "scope_id string, entity_type string, id string"


class Persistence:
    """Opens the engine and boots the store from it: 'all' rows, or those that 'manifest's name."""

    def __init__(self, store: EntityStore, backend: StorageBackend, *, hydration: str = "all", on_error: Callable[[Exception], None] | None = None) -> None:
        if hydration not in ("all", "manifest"):
            raise ValueError("hydration must be 'all' or 'manifest'")
        self.store, self.backend, self.spark = store, backend, store.spark
        backend.open()
        self.behind = WriteBehind(backend, on_error)
        self.transactions = Transactions(store)
        self.waiting: dict[str, list[DataFrame]] = {}
        self.closed = False
        self.manifests = stored(self._read_manifests(), "manifests")
        self._stop = store.subscribe(self._saw)
        self.transactions.on_settled(self._settled)
        store.before_compaction.append(self.flush)
        rows = backend.load_all()
        booted = self._boot_all(rows) if hydration == "all" else self._boot_manifest(rows)
        self.booted = self._hydrate(booted)
        if hydration == "manifest":
            for scope in self.scopes():
                store.retain(self._keys(scope), f"scope:{scope}")

    # ---- boot and hydration ----

    def _read_manifests(self) -> DataFrame:
        rows = self.backend.load_all().where(F.col("entity_type") == MANIFEST_PREFIX)
        return rows.select(F.from_json("data", "scope string, entityType string, id string").alias("m")).select(F.col("m.scope").alias("scope_id"), F.col("m.entityType").alias("entity_type"), "m.id")

    def _boot_all(self, rows: DataFrame) -> DataFrame:
        return hydration.boot_all(rows, self.store.entities())

    def _boot_manifest(self, rows: DataFrame) -> DataFrame:
        return hydration.boot_all(hydration.boot_manifest(rows, self.manifests), self.store.entities())

    def _hydrate(self, rows: DataFrame) -> int:
        """Puts rows (key, data text) into memory; how many."""
        found = stored(rows.select(F.lit("set").alias("op"), *KEY, "data"), "hydrated")
        n = found.count()
        if n:
            with self.store.run_with("hydration"):
                self.store.write(found)
        return n

    def scopes(self) -> list[str]:
        return sorted(r[0] for r in self.manifests.select("scope_id").distinct().collect())

    def _keys(self, scope: str) -> DataFrame:
        return self.manifests.where(F.col("scope_id") == scope).select(*KEY)

    def _overlay(self, keys: DataFrame) -> DataFrame:
        """What hydrating the keys would give: pending writes before the engine's rows, nothing for keys that a transaction holds."""
        keys = stored(keys.select(*KEY).distinct(), "asked")
        durable = self.backend.load_many(keys).select(*KEY, "data")
        pending = self.behind.pending()
        dirty = self.spark.createDataFrame([], "entity_type string, id string, op string, data string")
        if pending is not None:
            op = F.when(F.col("op") == "remove", "delete").otherwise("put").alias("op")
            dirty = pending.join(keys, KEY, "left_semi").select(*KEY, op, "data")
        held = self.store.log().where(F.col("tx_id").isin(list(self.waiting))).select(*KEY).distinct() if self.waiting else keys.limit(0)
        return hydration.overlaid(durable, dirty, dirty.limit(0), held, ["data"])

    def hydrate_scope(self, scope: str) -> int:
        """Brings a scope's missing entities into memory; how many came."""
        return self.preload([scope])

    def preload(self, scopes: Sequence[str] | None = None) -> int:
        """The same for some scopes at once, or for all."""
        missing = hydration.to_load(self.manifests, self.store.entities(), scopes)
        return self._hydrate(self._overlay(missing))

    # ---- manifests ----

    def _change_manifest(self, scope: str, new: DataFrame, added: DataFrame, gone: DataFrame) -> None:
        row = lambda df, op: df.select(
            F.lit(op).alias("op"), F.lit(MANIFEST_PREFIX).alias("entity_type"), F.to_json(F.array(F.lit(scope), *KEY)).alias("id"),
            F.to_json(F.struct(F.lit(scope).alias("scope"), F.col("entity_type").alias("entityType"), "id")).alias("data"),
        )
        changes = row(added, "set").unionByName(row(gone, "remove"))
        seq = F.lit(self.store.seq).cast("long")
        self.behind.add(stored(changes.select(seq.alias("seq"), "op", *KEY, "data", F.lit("local-mutation").alias("origin")), "manifest-changes"))
        self.manifests = stored(new, "manifests")
        self.store.retain(added, f"scope:{scope}")
        self.store.release(gone, f"scope:{scope}")

    def set_manifest(self, scope: str, keys: DataFrame) -> None:
        """Makes ``keys`` what a scope pins."""
        keys, old = stored(keys.select(*KEY).distinct(), "scope"), self._keys(scope)
        new, gone = hydration.set_manifest(self.manifests, scope, keys)
        self._change_manifest(scope, new, keys.join(old, KEY, "left_anti"), stored(gone, "unpinned"))

    def remove_manifest(self, scope: str) -> list[str]:
        """Forgets a scope; what only it held is flushed and then evicted. Returns the evicted keys."""
        new, gone = hydration.remove_manifest(self.manifests, scope)
        self._change_manifest(scope, new, gone.limit(0), stored(gone, "unpinned"))
        return self.store.gc() if self.flush() else []

    # ---- changes ----

    def _saw(self, batch: DataFrame) -> None:
        """Adds a batch of the store to what is to be written, but for what waits for its transaction."""
        if self.closed:
            return
        rows = batch.select("seq", "op", *KEY, F.to_json("data").alias("data"), "origin", "tx_id")
        ids = [r[0] for r in rows.where("tx_id IS NOT NULL").select("tx_id").distinct().collect()]
        for tx_id in ids:
            if tx_id not in self.store.outcomes:  # else they say what a rollback has left
                self.waiting.setdefault(tx_id, []).append(rows.where(F.col("tx_id") == tx_id))
        self.behind.add(rows.where("tx_id IS NULL").drop("tx_id"))

    def _settled(self, tx_id: str, outcome: str) -> None:
        held = self.waiting.pop(tx_id, [])
        if self.closed or outcome != "commit" or not held:
            return
        rows = held[0]
        for more in held[1:]:
            rows = rows.unionByName(more)
        # one transaction's writes; numbered in the order of the commits
        place = F.row_number().over(Window.partitionBy("tx_id").orderBy("seq"))
        last = F.lit(self.store.seq).cast("long")
        n = F.count(F.lit(1)).over(Window.partitionBy("tx_id"))
        self.behind.add(stored(rows.withColumn("seq", last - n + place - 1).drop("tx_id"), "committed"))

    def flush(self) -> bool:
        """Whether everything written and settled before is durable."""
        return self.behind.flush()

    def close(self, deadline: float | None = None) -> bool:
        """Writes what is left, forgets what is not committed and gives up all pins; whether it was all written."""
        if self.closed:
            return True
        self._stop()
        self.store.before_compaction.remove(self.flush)
        self.waiting.clear()
        done = self.behind.close(deadline)
        self.closed = True
        for scope in self.scopes():
            self.store.release(self._keys(scope), f"scope:{scope}")
        return done

    def __enter__(self) -> Persistence:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
