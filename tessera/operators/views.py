"""Live views over change events: membership deltas, members, order, divergence, retention by views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.changes import IMAGE_PIECE, KEY, offsets
from tessera.plans.compile import matches


def after(imaged: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The images after each change under the fields' own names, to compile filters on."""
    rest = [c for c in imaged.columns if c not in fields]
    return imaged.select(*rest, *(F.col(f"now_{f}").alias(f) for f in fields))


def deltas(imaged: DataFrame, filter: object, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """A row for each change that takes an entity into the view or out of it: + delta 'add' or 'remove'.

    ``remove`` and ``evict`` both end membership.
    """
    states = after(imaged, fields)
    told = states.withColumn("member", F.col("exists") & matches(states, filter))
    was = F.coalesce(F.lag("member").over(Window.partitionBy(*key).orderBy("seq")), F.lit(False))
    return told.withColumn("was", was).where("member != was").withColumn("delta", F.when(F.col("member"), "add").otherwise("remove")).drop("member", "was")


def members(found: DataFrame, key: Sequence[str] = KEY, seeds: DataFrame | None = None) -> DataFrame:
    """The ids in the view, with the seq of their last entry; a view lists them in that order.

    ``seeds`` (key, seed_pos) were in the view when it was made: they come first, in the order of their scan, unless
    they left since; one that came back stands where it came back.
    """
    if seeds is not None:
        low = F.lit(-(2**62)).cast("long") + F.col("seed_pos")
        found = seeds.select(*key, low.alias("seq"), F.lit("add").alias("delta")).unionByName(found.select(*key, F.col("seq").cast("long").alias("seq"), "delta"))
    last = found.groupBy(*key).agg(F.max_by("delta", "seq").alias("delta"), F.max(F.when(F.col("delta") == "add", F.col("seq"))).alias("entered"))
    return last.where("delta = 'add'").drop("delta")


def divergence(held: DataFrame, truth: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What a view lacks ('missing') and what it holds wrongly ('extra')."""
    key = list(key)
    lacks = truth.select(*key).join(held, key, "left_anti").withColumn("divergence", F.lit("missing"))
    return lacks.unionByName(held.select(*key).join(truth, key, "left_anti").withColumn("divergence", F.lit("extra")))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of rows are equal, so that what is held needn't be replaced."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def healed(held: DataFrame, truth: DataFrame, key: Sequence[str] = KEY) -> tuple[DataFrame, bool]:
    """The right members and whether the held ones were."""
    return truth.select(*key), divergence(held, truth, key).isEmpty()


def retentions(found: DataFrame, holder: str, key: Sequence[str] = KEY) -> DataFrame:
    """A view retains what is in it: retain on entry, release on exit."""
    return found.select("seq", *key, F.when(F.col("delta") == "add", "retain").otherwise("release").alias("op"), F.lit(holder).alias("holder"))


def version_ticks(events: DataFrame, order: Column | str = "seq") -> DataFrame:
    """Each event with the monotonic version it raises its type to; by ``seq`` pieces of a type's events are counted first."""
    if order != "seq" or not isinstance(events.schema["seq"].dataType, T.IntegralType):
        return events.withColumn("version_tick", F.row_number().over(Window.partitionBy("entity_type").orderBy(order)).cast("long"))
    pieces = events.withColumn("tick_piece", F.floor(F.col("seq") / IMAGE_PIECE))
    within = F.row_number().over(Window.partitionBy("entity_type", "tick_piece").orderBy("seq"))
    counted = pieces.join(offsets(pieces, "tick_piece", "entity_type"), ["entity_type", "tick_piece"])
    return counted.withColumn("version_tick", (F.col("before") + within).cast("long")).drop("tick_piece", "before")
