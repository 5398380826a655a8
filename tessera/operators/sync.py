"""Sync with a server: the outbox, verdicts, version-aware apply, confirmations, and the server's feed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.wire import compare_versions, version_number
from tessera.operators.changes import KEY


class Adapter(Protocol):
    """What a transport gives: pages of changes, and verdicts on pushed writes."""

    def pull(self, cursor: str | None, subscription: str | None) -> dict: ...

    def push(self, batch: Sequence[dict]) -> Sequence[dict]: ...


def outbox(events: DataFrame, local_types: Sequence[str] = (), client: str = "client_id") -> DataFrame:
    """The events to push: local mutations of shared types, no evictions; numbered for each client."""
    own = events.where((F.col("origin") == "local-mutation") & F.col("op").isin("set", "replace", "remove"))
    if local_types:
        own = own.where(~F.col("entity_type").isin(list(local_types)))
    return own.withColumn("client_seq", F.row_number().over(Window.partitionBy(client).orderBy("seq")).cast("long"))


def shared(changes: DataFrame, registry: DataFrame) -> DataFrame:
    """Without changes of types that stay on the device."""
    return changes.join(registry.where("local").select("entity_type"), "entity_type", "left_anti")


def unconfirmed(pending: DataFrame, marks: DataFrame) -> DataFrame:
    """The outbox without what the pull channel confirmed: client_seq up to the client's mark. No mark, no drop."""
    return pending.join(marks.select("client_id", F.col("seq").alias("confirmed")), "client_id", "left").where("confirmed IS NULL OR confirmed < client_seq").drop("confirmed")


def judged(pending: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each pending write with its verdict: ack, reject or transform; none yet is NULL."""
    told = verdicts.select("mutation_id", "status", F.col("version").alias("server_version"), "remapped_id")
    return pending.join(told, "mutation_id", "left")


def after_verdicts(pending: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The outbox after verdicts: acked and transformed ones are pushed, rejected ones go, remapped ids follow.

    A write to a remapped id gets the new one and loses its base version, whoever wrote it.
    """
    told = judged(pending, verdicts)
    renames = told.where("remapped_id IS NOT NULL AND remapped_id != id").select("entity_type", F.col("id").alias("old_id"), F.col("remapped_id").alias("new_id")).distinct()
    left = told.where("status IS NULL OR status != 'reject'")
    moved = left.join(renames, (left.entity_type == renames.entity_type) & (left.id == renames.old_id), "left").drop(renames.entity_type)
    return moved.select(
        "mutation_id", "client_id", "client_seq", "entity_type", F.coalesce("new_id", "id").alias("id"),
        F.coalesce(F.col("status").isin("ack", "transform"), F.lit(False)).alias("pushed"),
        F.when(F.col("status") == "ack", F.col("server_version")).when(F.col("new_id").isNull(), F.col("base_version")).alias("base_version"),
    )


def reverted(rejected: DataFrame, truth: DataFrame, siblings: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """The entities of rejected writes: what was before, or server truth that came since, with siblings replayed.

    rejected (key, existed, prev_*, base_gen), truth (key, gen, removed, fields), siblings (key, seq, op, fields) are the
    other outstanding writes.
    """
    names = {f: f"truth_{f}" for f in fields}
    joined = rejected.join(truth.select(*key, "gen", "removed", *[F.col(f).alias(n) for f, n in names.items()]), list(key), "left")
    same = F.coalesce(F.col("gen"), F.lit(0)) == F.col("base_gen")
    alive = F.when(same, F.col("existed")).otherwise(~F.coalesce(F.col("removed"), F.lit(True)))
    back = joined.select(*key, alive.alias("alive"), *[F.when(alive, F.when(same, F.col(f"prev_{f}")).otherwise(F.col(n))).alias(f) for f, n in names.items()])
    log = back.select(F.lit(-1).cast("long").alias("seq"), F.when(F.col("alive"), "replace").otherwise("remove").alias("op"), *key, *fields)
    later = siblings.join(back.select(*key), list(key), "left_semi").select("seq", "op", *key, *fields)
    from tessera.operators.changes import fold

    return fold(log.unionByName(later), fields, key).select(*key, *fields)


def accepted(remote: DataFrame, key: Sequence[str] = KEY, arrival: str = "arrival", compare: Callable[[str, str], str] | None = None) -> DataFrame:
    """The remote changes that apply, in order of arrival: those newer than all of their key that applied before.

    With the default order a change applies if its version exceeds the greatest before it, which is a running maximum
    for numbers; texts are compared one by one, as are versions under ``compare``.
    """
    if compare is None:
        numeric = remote.withColumn("version_no", version_number(F.col("version")))
        before = Window.partitionBy(*key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
        mixed = F.max(F.col("version_no").isNull().cast("int")).over(Window.partitionBy(*key)) == 1
        told = numeric.withColumn("top", F.max("version_no").over(before)).withColumn("mixed", mixed)
        plain = told.where("NOT mixed AND (top IS NULL OR version_no > top)").drop("version_no", "top", "mixed")
        return plain.unionByName(_accepted_one_by_one(told.where("mixed").drop("version_no", "top", "mixed"), key, arrival, _default_order))
    return _accepted_one_by_one(remote, key, arrival, compare)


def _default_order(a: str, b: str) -> str:
    def number(x: str) -> float | None:
        text = x.strip()
        try:
            found = 0.0 if not text else float(int(text, 0)) if text[:2].lower() in ("0x", "0o", "0b") else float(text) if "_" not in text else None
        except ValueError:
            return None
        return found if found is not None and abs(found) != float("inf") and found == found else None

    x, y = number(a), number(b)
    if x is None or y is None:
        x, y = a.encode("utf-16-be"), b.encode("utf-16-be")
    return "same" if x == y else "newer" if x > y else "older"


def _accepted_one_by_one(remote: DataFrame, key: Sequence[str], arrival: str, compare: Callable[[str, str], str]) -> DataFrame:
    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, str] = {}
        for rows in groups:  # sorted by key and arrival within the partition
            kept = []
            for i, (own, version) in enumerate(zip(rows[list(key)].itertuples(index=False, name=None), rows["version"], strict=True)):
                if own not in known:
                    known = {own: version}
                elif compare(version, known[own]) in ("newer", "concurrent"):
                    known[own] = version
                else:
                    continue
                kept.append(i)
            yield rows.iloc[kept]

    return remote.repartition(*key).sortWithinPartitions(*key, arrival).mapInPandas(run, remote.schema)


def applied(remote: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY, arrival: str = "arrival") -> DataFrame:
    """Entities after pulled changes: accepted sets merge, accepted removals delete."""
    from tessera.operators.changes import fold

    log = accepted(remote, key, arrival).withColumnRenamed(arrival, "seq")
    versions = log.groupBy(*key).agg(F.max_by("version", "seq").alias("version"))
    return fold(log, fields, key).select(*key, *fields).join(versions, list(key))


def shadow(changes: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY, order: str = "seq") -> DataFrame:
    """The server's truth as it has told it, patch over patch: key, gen (its writes), removed, fields.

    changes (key, op, ``order``, fields): accepted pulls are 'set' and 'remove', transformed entities 'replace'.
    """
    from tessera.operators.changes import fold

    log = changes.withColumnRenamed(order, "seq") if order != "seq" else changes
    told = log.groupBy(*key).agg(F.count(F.lit(1)).alias("gen"), (F.max_by("op", "seq") == "remove").alias("removed"))
    return told.join(fold(log, fields, key).select(*key, *fields), list(key), "left")


def staged(pages: DataFrame, most: int = 200) -> DataFrame:
    """Pages of runs that came to an end: a run's changes apply only at ``complete``, within ``most`` pages, no error."""
    run = Window.partitionBy("subscription", "run")
    told = pages.withColumns({"ends": F.max(F.col("complete").cast("int")).over(run), "fails": F.max((F.col("type") == "error").cast("int")).over(run), "n": F.count(F.lit(1)).over(run)})
    return told.where((F.col("ends") == 1) & (F.col("fails") == 0) & (F.col("n") <= most)).drop("ends", "fails", "n")


def feed_page(rows: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The server's changes after ``cursor`` by version, tombstones included; never more than ``limit``."""
    return rows.where(F.col("version") > cursor).orderBy("version").limit(limit)


def replayed_once(pushes: DataFrame) -> DataFrame:
    """Pushed writes without repeats of a mutation: the first arrival counts."""
    first = Window.partitionBy("mutation_id").orderBy("arrival")
    return pushes.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def gaps(pushes: DataFrame) -> DataFrame:
    """Writes that leave a hole in their client's sequence, which a server answers with 409."""
    in_order = Window.partitionBy("client_id").orderBy("client_seq")
    return pushes.withColumn("expected", F.coalesce(F.lag("client_seq").over(in_order), F.lit(0)) + 1).where("client_seq != expected")


def last_seen(pushes: DataFrame) -> DataFrame:
    """Per client the highest sequence number that was dealt with; rejected ones count."""
    return pushes.groupBy("client_id").agg(F.max("client_seq").alias("last_seen"))


def version_order(a: Column, b: Column) -> Column:
    return compare_versions(a, b)


def adopted(pending: DataFrame, stranded: DataFrame) -> DataFrame:
    """The outbox with another session's stranded writes, as they are."""
    return pending.unionByName(stranded, allowMissingColumns=True)
