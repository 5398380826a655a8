"""Scans and snapshots of entities: by type, by key, existence, JSON export and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.changes import key_text, split_key

KEY = ["entity_type", "id"]


def of_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.where(F.col("entity_type") == entity_type)


def entries(entities: DataFrame, entity_type: str, order: str = "seed_pos") -> DataFrame:
    """Entities of a type in the order of insertion."""
    return of_type(entities, entity_type).orderBy(order)


def lookup(entities: DataFrame, keys: DataFrame, phantoms: bool = True) -> DataFrame:
    """The entities of the keys; with ``phantoms`` a key without one gives a row of NULLs that a later write fills."""
    return keys.select(*KEY).distinct().join(entities, KEY, "left" if phantoms else "inner")


def has(entities: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key and whether it exists."""
    there = entities.select(*KEY).distinct().withColumn("there", F.lit(True))
    return keys.select(*KEY).join(there, KEY, "left").withColumn("found", F.coalesce("there", F.lit(False))).drop("there")


def is_null_path(column: str, field: str) -> Column:
    return F.is_variant_null(F.try_variant_get(F.col(column), f'$["{field}"]', "variant"))


def to_snapshot(entities: DataFrame) -> DataFrame:
    """key and data as JSON text; references are in their wire form already."""
    data = F.to_json("data") if dict(entities.dtypes)["data"] != "string" else F.col("data")
    return entities.select(key_text().alias("key"), data.alias("data"))


def from_snapshot(snapshot: DataFrame, first_seq: int = 0, order: str = "key") -> DataFrame:
    """Merging writes from (key, data JSON text); keys without a colon are left out."""
    kind, own = split_key()
    rows = snapshot.where(F.instr("key", ":") > 0)
    return rows.select(
        (F.monotonically_increasing_id() + first_seq).alias("seq"), F.lit("set").alias("op"), kind.alias("entity_type"), own.alias("id"),
        F.parse_json("data").alias("data"), F.lit("hydration").alias("origin"),
    )


def durable_storage() -> bool:
    """A browser may be asked to keep storage; a file system keeps it."""
    return True
