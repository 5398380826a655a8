"""Field-level history: a row for each field that a write changes, purges on removal, caps, newest-first reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.changes import KEY
from tessera.sources.scratch import stored

MAX_ROWS, MAX_BYTES, FLAT_BYTES = 1_000, 1 << 20, 256


def write_ids(events: DataFrame, prefix: str = "w") -> DataFrame:
    """Adds write_no and mutation_id: every event but ``evict`` takes a number, whether it yields rows or not.

    Numbers run over the whole log: counts of pieces of it are summed first, and rows are numbered within a piece. The
    events are stored for it, so that what they are made of is not made again by each use of them.
    """
    piece = F.floor(F.col("seq") / 10_000)
    counted = stored(events.withColumn("piece", piece).withColumn("takes", (F.col("op") != "evict").cast("long")), "events")
    sums = counted.groupBy("piece").agg(F.sum("takes").alias("in_piece"))
    before = F.coalesce(F.sum("in_piece").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("takes").over(Window.partitionBy("piece").orderBy("seq"))
    numbered = counted.join(sums.select("piece", before.alias("before")), "piece").withColumn("write_no", F.when(F.col("op") != "evict", F.col("before") + within))
    return numbered.withColumn("mutation_id", F.when(F.col("op") != "evict", F.concat_ws("-", F.lit(prefix), F.col("write_no").cast("string")))).drop("piece", "takes", "before")


def same_value(a: Column, b: Column) -> Column:
    """As the log compares: NaN equals NaN, absent equals absent."""
    return a.eqNullSafe(b)


def rows(events: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """The history rows of imaged events: seq, key, write_no, mutation_id, field, old, new (as text), type.

    A removal has one row without field and data; ``evict`` has none.
    """
    kept = ["seq", *key, "write_no", "mutation_id", *[c for c in ("origin", "tx_id") if c in events.columns]]
    entry = [
        F.when(~same_value(F.col(f"prev_{f}"), F.col(f"now_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"prev_{f}").cast("string").alias("old"), F.col(f"now_{f}").cast("string").alias("new")))
        for f in fields
    ]
    changed = events.where(F.col("op").isin("set", "replace")).select(*kept, F.explode(F.array_compact(F.array(*entry))).alias("e"))
    sets = changed.select(*kept, "e.field", "e.old", "e.new", F.lit("set").alias("type"))
    none = F.lit(None).cast("string")
    gone = events.where("op = 'remove'").select(*kept, none.alias("field"), none.alias("old"), none.alias("new"), F.lit("remove").alias("type"))
    return sets.unionByName(gone)


def purged(history: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Without what a later removal of the key erases; its own marker stays."""
    last = history.where("type = 'remove'").groupBy(*key).agg(F.max("seq").alias("erased"))
    return history.join(last, list(key), "left").where("erased IS NULL OR seq >= erased").drop("erased")


def row_bytes(*columns: str) -> Column:
    """Length of a row's JSON in UTF-16 units."""
    return (F.length(F.encode(F.to_json(F.struct(*columns)), "UTF-16BE")) / 2).cast("long")


def newest(history: DataFrame, n: int, order: Sequence[str] = ("seq", "field")) -> DataFrame:
    """The newest n rows. A top-k, so no more than n rows of a task are sent."""
    return history.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)


def capped(history: DataFrame, *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, size: Column | None = None) -> DataFrame:
    """What the caps leave: the newest rows, in number and bytes, by seq and field.

    A row that alone exceeds the byte cap clears the log including itself, so rows at or before the last such row go.
    """
    sized = history.withColumn("row_bytes", size if size is not None else row_bytes(*history.columns))
    top = newest(sized, max_rows + 1)  # what else is older than the row cap
    order = Window.orderBy(F.col("seq").desc(), F.col("field").desc_nulls_last())
    spent = F.sum("row_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = top.withColumn("n", F.row_number().over(order)).withColumn("spent", spent)
    return ranked.where((F.col("n") <= max_rows) & (F.col("spent") <= max_bytes)).drop("n", "spent")


def listed(history: DataFrame, **filters: str | None) -> DataFrame:
    """Rows that agree with all given of entity_type, id, origin, tx_id; those that are None are not asked."""
    asked = [F.col(k).eqNullSafe(F.lit(v)) for k, v in filters.items() if v is not None]
    return history.where(reduce(lambda a, b: a & b, asked)) if asked else history
