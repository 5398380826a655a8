"""Streaming: live membership by keyed state, fan-out to listeners, coalescing sinks, integrity checks."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.matcher import Encodable, Node, classify, holds
from tessera.plans.compile import matches
from tessera.sources.scratch import stored

KEY = ["entity_type", "id"]
DELTAS = "entity_type string, id string, seq bigint, delta string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Membership(StatefulProcessor):
    """Keeps for each entity whether it is in the view; gives a row where that changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("member", StructType([StructField("member", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        was = bool(held) and held[0] == "y"
        every = pd.concat(list(rows)).sort_values("seq")  # a micro-batch gives no order
        member = every["member"].to_numpy(bool)
        turns = member != np.append(was, member[:-1])
        self.state.update(("y" if member[-1] else "n",))
        told = np.where(member[turns], "add", "remove").astype(object)
        yield pd.DataFrame({"entity_type": key[0], "id": key[1], "seq": every["seq"].to_numpy()[turns], "delta": told}, columns=["entity_type", "id", "seq", "delta"])

    def close(self) -> None:
        pass


class FoldingMembership(StatefulProcessor):
    """Keeps each entity as its changes leave it, and whether it is in the view; gives a row where that changes."""

    def __init__(self, node: Node) -> None:
        self.node = node

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entity", StructType([StructField("data", StringType()), StructField("member", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() or (None, "n")
        data, was = None if held[0] is None else json.loads(held[0]), held[1] == "y"
        out = []
        every = pd.concat(list(rows)).sort_values("seq")  # a micro-batch gives no order
        for seq, op, text in zip(every["seq"], every["op"], every["data"], strict=True):
            if op in ("set", "replace"):
                data = {**((data if op == "set" else None) or {}), **json.loads(text)}
            else:
                data = None
            member = data is not None and holds(self.node, data)
            if member != was:
                was = member
                out.append((*key, int(seq), "add" if was else "remove"))
        if data is None and not was:
            self.state.clear()
        else:
            self.state.update((None if data is None else json.dumps(data), "y" if was else "n"))
        yield pd.DataFrame(out, columns=["entity_type", "id", "seq", "delta"])

    def close(self) -> None:
        pass


def folding_view(log: DataFrame, filter: object) -> DataFrame:
    """Deltas of a stream of changes (seq, op, key, data as JSON text or VARIANT), which are folded in the stream.

    The changes of what is there when the view starts come first in it, as its seeds. A state is one entity, whatever
    its history; only a filter that can be encoded works here. Runs under ``with_store``.
    """
    found = classify(filter)
    if not isinstance(found, Encodable):
        raise ValueError(f"unusable filter: {found.reason}")
    data = F.col("data") if dict(log.dtypes)["data"] == "string" else F.to_json("data")
    told = log.select(*KEY, "seq", "op", data.alias("data"))
    return told.groupBy(*KEY).transformWithStateInPandas(FoldingMembership(found.node), DELTAS, "Append", "None")


@contextmanager
def with_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store provider that keyed state needs; as it was, after that."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def live_view(events: DataFrame, filter: object) -> DataFrame:
    """Deltas of a stream of events (seq, op, key, fields after the event). No event is scanned twice.

    A filter that can't be used is refused here, when the view is built. The session that runs it has to have STORE
    as its state store provider (``with_store``).
    """
    member = F.col("op").isin("set", "replace") & matches(events, filter)
    told = events.select(*KEY, "seq", member.alias("member"))
    return told.groupBy(*KEY).transformWithStateInPandas(Membership(), DELTAS, "Append", "None")


@dataclass
class Boundary:
    """Listeners on a stream: all events, those of a type, or of a key. One that fails doesn't stop the others."""

    on_error: Callable[[Exception], None] | None = None
    listeners: list[tuple[str | None, str | None, Callable[[DataFrame, int], None]]] = field(default_factory=list)

    def subscribe(self, listener: Callable[[DataFrame, int], None], entity_type: str | None = None, id: str | None = None) -> Callable[[], None]:
        entry = (entity_type, id, listener)
        self.listeners.append(entry)
        return lambda: self.listeners.remove(entry)

    def sink(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: first the listeners of everything, then of types, then of keys."""
        batch = batch.persist()
        try:
            for kind, own, listener in sorted(self.listeners, key=lambda x: (x[0] is not None) + (x[1] is not None)):
                rows = batch if kind is None else batch.where(F.col("entity_type") == kind)
                try:
                    listener(rows if own is None else rows.where(F.col("id") == own), number)
                except Exception as error:
                    if self.on_error is not None:
                        self.on_error(error)
        finally:
            batch.unpersist()


class Coalescer:
    """Gathers batches and hands them on together after a delay, or when asked; nothing gathered, no call.

    A batch is written to a table of its own, since what ``foreachBatch`` gives doesn't outlive its call. With the real
    clock a timer flushes what no later batch does.
    """

    def __init__(self, flush: Callable[[DataFrame], None], delay: float = 0.05, clock: Callable[[], float] = time.monotonic) -> None:
        self.on_flush, self.delay, self.clock, self.held, self.since = flush, delay, clock, None, 0.0
        self.lock, self.timer = threading.RLock(), None

    def add(self, batch: DataFrame, _: int = 0) -> None:
        kept = stored(batch, "coalesced")
        with self.lock:
            if self.held is None:
                self.since = self.clock()
                if self.clock is time.monotonic:
                    self.timer = threading.Timer(self.delay, self.flush)
                    self.timer.daemon = True
                    self.timer.start()
            self.held = kept if self.held is None else self.held.unionByName(kept)
            due = self.clock() - self.since >= self.delay
        if due:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            held, self.held = self.held, None
            if self.timer is not None:
                self.timer.cancel()
                self.timer = None
        if held is not None and not held.isEmpty():
            self.on_flush(held)


def rescanned(entities: Callable[[], DataFrame], predicate: object, types: Sequence[str], emit: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a view by an opaque predicate, scanned anew once for a batch that touches its types."""

    def sink(batch: DataFrame, _: int) -> None:
        if batch.where(F.col("entity_type").isin(list(types))).isEmpty():
            return
        rows = entities().where(F.col("entity_type").isin(list(types)))
        emit(rows.where(matches(rows, predicate)).select(*KEY))

    return sink


def guarded(
    truth: Callable[[], DataFrame], held: Callable[[], DataFrame], report: Callable[[DataFrame], None], adopt: Callable[[DataFrame], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: compares what a view holds with a scan, reports what differs, and has the truth adopted."""
    from tessera.operators.views import divergence

    def sink(_: DataFrame, __: int) -> None:
        right = truth()
        found = divergence(held(), right)
        if not found.isEmpty():
            report(found)
            if adopt is not None:
                adopt(right.select(*KEY))

    return sink


def event_filter(entity_type: str | None = None) -> Column:
    return F.lit(True) if entity_type is None else F.col("entity_type") == entity_type
