"""Hydration: scope manifests, what to load, and which version of a row wins.

manifests has (scope_id, key columns); overlays are dirty and in-flight writes (key, op 'put' or 'delete', data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.changes import KEY

# Fixed value: rows with keys like this hold manifests.
MANIFEST_PREFIX = "__cdb_manifest__"


def scope_keys(manifests: DataFrame, scopes: Sequence[str] | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """The distinct keys of some scopes, or of all."""
    asked = manifests if scopes is None else manifests.where(F.col("scope_id").isin(list(scopes)))
    return asked.select(*key).distinct()


def to_load(manifests: DataFrame, entities: DataFrame, scopes: Sequence[str] | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Keys of the scopes that aren't in memory."""
    return scope_keys(manifests, scopes, key).join(entities.select(*key), list(key), "left_anti")


def boot_manifest(durable: DataFrame, manifests: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The durable rows that manifests name."""
    return durable.join(manifests.select(*key), list(key), "left_semi")


def boot_all(durable: DataFrame, entities: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """All durable rows but manifests' own and those that memory already has, which are fresher."""
    rows = durable.where(~F.col("entity_type").startswith(MANIFEST_PREFIX)) if "entity_type" in key else durable
    return rows.join(entities.select(*key), list(key), "left_anti")


def overlaid(durable: DataFrame, dirty: DataFrame, inflight: DataFrame, masked: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """The row that a hydration of each key gives: + source 'dirty', 'inflight' or 'engine'.

    An open transaction on a key vetoes it, then a dirty write decides (a deletion vetoes), then one in flight, then
    the engine's row. One aggregation over the union; keys that were never written to the engine appear too.
    """
    part = lambda rows, rank, source: rows.select(*key, F.lit(rank).alias("rank"), F.lit(source).alias("source"), *(F.col("op") if "op" in rows.columns else F.lit("put").alias("op"),), *fields)
    every = part(dirty, 1, "dirty").unionByName(part(inflight, 2, "inflight")).unionByName(part(durable, 3, "engine"))
    best = every.groupBy(*key).agg(F.min_by(F.struct("source", "op", *fields), "rank").alias("best"))
    won = best.where("best.op != 'delete'").select(*key, "best.source", *[f"best.{f}" for f in fields])
    return won.join(masked.select(*key), list(key), "left_anti")


def hydrated(overlay: DataFrame, entities: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What a hydration adds to memory: fresh data there wins."""
    return overlay.join(entities.select(*key), list(key), "left_anti")


def set_manifest(manifests: DataFrame, scope: str, keys: DataFrame, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(manifests with the scope replaced, keys that the scope no longer pins)."""
    old = manifests.where(F.col("scope_id") == scope)
    new = keys.select(F.lit(scope).alias("scope_id"), *key).distinct()
    return manifests.where(F.col("scope_id") != scope).unionByName(new), old.select(*key).join(new, list(key), "left_anti")


def remove_manifest(manifests: DataFrame, scope: str, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(manifests without the scope, keys that it pinned)."""
    return manifests.where(F.col("scope_id") != scope), manifests.where(F.col("scope_id") == scope).select(*key)


def pins(manifests: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One retention row per scope and key."""
    return manifests.select(*key, F.concat(F.lit("scope:"), "scope_id").alias("holder")).distinct()


def totals(hydrated_rows: DataFrame) -> DataFrame:
    return hydrated_rows.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n_hydrated"))
