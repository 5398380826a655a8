"""Optimistic transactions over a change log: net changes, commit, rollback by replay, and gates.

tx_log rows are writes (tx_id, seq, op, key, fields); tx_settle has (tx_id, outcome 'commit' or 'rollback', settle_seq).
A transaction without a row there is open.
"""

from __future__ import annotations

import json
import weakref
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.changes import KEY, fold

OUTCOMES = ("commit", "rollback", "open")


def settled(tx_log: DataFrame, tx_settle: DataFrame) -> DataFrame:
    """Each write with its transaction's outcome and, where that is a commit, the place it takes in the log."""
    return tx_log.join(tx_settle, "tx_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("open")))


def graduated(tx_log: DataFrame, tx_settle: DataFrame) -> DataFrame:
    """What becomes durable: the writes of committed transactions, in the order of the commits, then of the writes.

    ``seq`` becomes struct(settle_seq, seq).
    """
    done = settled(tx_log, tx_settle).where("outcome = 'commit'")
    return done.withColumn("seq", F.struct("settle_seq", "seq")).drop("outcome", "settle_seq")


def rolled_back(base: DataFrame, tx_log: DataFrame, tx_settle: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """The projection after all rollbacks: server truth with the remaining transactions replayed in order.

    ``base`` has one row per entity (key and fields). The log holds merging sets and removals.
    """
    active = settled(tx_log, tx_settle).where("outcome != 'rollback'").select("seq", "op", *key, *fields)
    truth = base.select(F.lit(-(2**62)).alias("seq"), F.lit("replace").alias("op"), *key, *fields)
    return fold(truth.unionByName(active), fields, key).select(*key, *fields)


def net_changes(tx_log: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """What a transaction comes to for each key: op 'set' with the merged fields since a removal, or 'remove'."""
    whole = ["tx_id", *key]
    last_removal = tx_log.where("op = 'remove'").groupBy(*whole).agg(F.max("seq").alias("removed"))
    marked = tx_log.join(last_removal, whole, "left")
    live = F.col("removed").isNull() | (F.col("seq") > F.col("removed"))
    values = [F.max_by(F.col(f), F.when(live & (F.col("op") != "remove") & F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return marked.groupBy(*whole).agg(F.max_by("op", "seq").alias("last_op"), *values).select(
        *whole, F.when(F.col("last_op") == "remove", "remove").otherwise("set").alias("op"), *fields
    )


def truth_after(base: DataFrame, tx_log: DataFrame, tx_settle: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Server truth with committed transactions folded in, in the order of their commits."""
    done = graduated(tx_log, tx_settle).select("seq", "op", *key, *fields)
    log = base.select(F.struct(F.lit(-(2**62)).cast("long").alias("settle_seq"), F.lit(0).cast("long").alias("seq")).alias("seq"), F.lit("replace").alias("op"), *key, *fields)
    ordered = log.unionByName(done.select(F.struct(*(F.col(f"seq.{x}").cast("long").alias(x) for x in ("settle_seq", "seq"))).alias("seq"), "op", *key, *fields))
    resets = F.col("op").isin("replace", "remove")
    last = ordered.groupBy(*key).agg(F.max(F.when(resets, F.struct("seq", "op"))).alias("last"))
    marked = ordered.join(last, list(key))
    live = F.col("last").isNull() | (F.col("seq") > F.col("last.seq")) | ((F.col("seq") == F.col("last.seq")) & (F.col("op") == "replace"))
    own = marked.where(live & (F.col("op") != "remove"))
    return own.groupBy(*key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def gated(writes: DataFrame, gates: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, vetoed): a gate's Column is true, or else a veto; the first that isn't true is told in ``vetoed_by``."""
    verdict = F.coalesce(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(i)) for i, g in enumerate(gates)], F.lit(None).cast("int"))
    told = writes.withColumn("vetoed_by", verdict)
    return told.where("vetoed_by IS NULL").drop("vetoed_by"), told.where("vetoed_by IS NOT NULL")


def commit_gate(net: DataFrame, allowed: Column) -> DataFrame:
    """tx_id and verdict 'commit' or 'rollback': a transaction goes through if its whole net set is allowed."""
    good = F.min(F.coalesce(allowed, F.lit(False)).cast("int")) == 1
    return net.groupBy("tx_id").agg(F.when(good, "commit").otherwise("rollback").alias("verdict"))


def affected(tx_log: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return tx_log.select("tx_id", *key).distinct()


class PolicyVeto(ValueError):
    """A gate has refused a write ('apply') or a whole transaction ('commit')."""

    def __init__(self, phase: str, tx_id: str, reason: str) -> None:
        super().__init__(f"{tx_id}: vetoed at {phase}: {reason}")
        self.phase, self.tx_id, self.reason = phase, tx_id, reason


#: A gate for one write (op, entity type, id, data) or for a transaction's net changes: exactly True lets it through.
Gate = Callable[[object], object]


class Transactions:
    """Builds a log: ``begin`` a transaction, ``set`` and ``remove`` in it, settle it once. One handle for each store.

    ``will_apply`` gates see each write before it takes place, ``will_commit`` gates the net changes of a transaction,
    {(entity type, id): merged data, or None for a removal}. A vetoed write leaves no trace; a vetoed commit settles as
    a rollback. A store that takes part (``tx_write`` and ``tx_settled``) gets writes and outcomes as they come;
    listeners are told after it.
    """

    _handles: weakref.WeakKeyDictionary[object, Transactions] = weakref.WeakKeyDictionary()
    #: Of stores that nothing can refer to weakly; kept with them, so that no other store gets their number.
    _fixed: dict[int, tuple[object, Transactions]] = {}

    def __new__(cls, store: object) -> Transactions:
        weak = type(store).__weakrefoffset__ != 0
        found = cls._handles.get(store) if weak else cls._fixed.get(id(store), (None, None))[1]
        if found is None:
            found = super().__new__(cls)
            found.store = weakref.ref(store) if weak else lambda: store
            found.writes, found.outcomes, found.count, found.seq, found.listeners = [], {}, 0, 0, []
            found.will_apply, found.will_commit = [], []
            if weak:
                cls._handles[store] = found
            else:
                cls._fixed[id(store)] = (store, found)
        return found

    def use_gate(self, will_apply: Gate | None = None, will_commit: Gate | None = None) -> Callable[[], None]:
        """Adds gates; the function that is returned takes them away."""
        pairs = [(gates, gate) for gates, gate in ((self.will_apply, will_apply), (self.will_commit, will_commit)) if gate is not None]
        for gates, gate in pairs:
            gates.append(gate)

        def remove() -> None:
            for gates, gate in pairs:
                if gate in gates:
                    gates.remove(gate)

        return remove

    @staticmethod
    def _ask(gates: Sequence[Gate], phase: str, tx_id: str, proposed: object) -> None:
        for gate in list(gates):
            try:
                verdict = gate(proposed)
            except Exception as error:  # a gate that fails doesn't let through
                verdict = str(error)
            if verdict is not True:
                raise PolicyVeto(phase, tx_id, verdict if isinstance(verdict, str) else "refused")

    def begin(self) -> str:
        self.count += 1
        return f"tx-{self.count}"

    def _write(self, tx_id: str, op: str, entity_type: str, id: str, data: dict | None) -> None:
        if tx_id in self.outcomes:
            raise ValueError(f"{tx_id} is settled")
        self._ask(self.will_apply, "apply", tx_id, (op, entity_type, id, None if data is None else dict(data)))
        self.seq += 1
        self.writes.append((tx_id, self.seq, op, entity_type, id, data))
        if (write := getattr(self.store(), "tx_write", None)) is not None:
            write(tx_id, op, entity_type, id, data)

    def set(self, tx_id: str, entity_type: str, id: str, data: dict) -> None:
        self._write(tx_id, "set", entity_type, id, data)

    def remove(self, tx_id: str, entity_type: str, id: str) -> None:
        self._write(tx_id, "remove", entity_type, id, None)

    def net(self, tx_id: str) -> dict[tuple[str, str], dict | None]:
        """What a transaction comes to: merged data since a removal, or None."""
        found: dict[tuple[str, str], dict | None] = {}
        for own, _, op, kind, id, data in self.writes:
            if own == tx_id:
                found[kind, id] = None if op == "remove" else {**(found.get((kind, id)) or {}), **data}
        return found

    def _settle(self, tx_id: str, outcome: str) -> None:
        if tx_id in self.outcomes:
            raise ValueError(f"{tx_id} is settled")
        self.seq += 1
        self.outcomes[tx_id] = (outcome, self.seq)
        if (settled := getattr(self.store(), "tx_settled", None)) is not None:
            settled(tx_id, outcome)
        for listener in self.listeners:
            listener(tx_id, outcome)

    def commit(self, tx_id: str) -> None:
        if tx_id not in self.outcomes and self.will_commit:
            try:
                self._ask(self.will_commit, "commit", tx_id, self.net(tx_id))
            except PolicyVeto:
                self._settle(tx_id, "rollback")
                raise
        self._settle(tx_id, "commit")

    def rollback(self, tx_id: str) -> None:
        self._settle(tx_id, "rollback")

    def apply(self, writes: Sequence[tuple[str, str, str, dict | None]]) -> str:
        """A transaction of (op, entity_type, id, data) in one; it settles itself if a write is refused."""
        tx_id = self.begin()
        try:
            for op, entity_type, id, data in writes:
                self._write(tx_id, op, entity_type, id, data)
        except Exception:
            self.rollback(tx_id)
            raise
        self.commit(tx_id)
        return tx_id

    def on_settled(self, listener) -> None:
        self.listeners.append(listener)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The log (tx_id, seq, op, key, data text) and the outcomes (tx_id, outcome, settle_seq)."""
        log = [(t, s, o, k, i, None if d is None else json.dumps(d)) for t, s, o, k, i, d in self.writes]
        done = [(t, o, s) for t, (o, s) in self.outcomes.items()]
        return spark.createDataFrame(log, "tx_id string, seq bigint, op string, entity_type string, id string, data string"), spark.createDataFrame(done, "tx_id string, outcome string, settle_seq bigint")
