"""Merging pages into one list: by cursor, by offset and as connections of edges, and whole lists from their pages.

``merge_*`` are pairwise: Columns for an existing and an incoming page entity. ``assemble`` builds a list from all its
pages at once, by absolute place, and is what to use at scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(items: Column, key: str | None) -> Column:
    """Drops items whose key comes again later; items without a key stay."""
    if key is None:
        return items
    return F.filter(items, lambda x, i: x[key].isNull() | ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y[key].eqNullSafe(x[key])))


def _or_empty(items: Column, like: Column) -> Column:
    return F.coalesce(items, F.filter(like, lambda x: F.lit(False)))


def merge_cursor(existing: Column, incoming: Column, existing_cursor: Column, incoming_cursor: Column, *, backward: bool = False, key: str | None = None) -> Column:
    """Items after a page came in: replaced if it is the same page again, else appended or put in front."""
    a, b = _or_empty(existing, incoming), _or_empty(incoming, existing)
    joined = F.concat(b, a) if backward else F.concat(a, b)
    return F.when(existing_cursor.isNotNull() & (existing_cursor == incoming_cursor), incoming).otherwise(keep_last(joined, key))


def merge_offset(existing: Column, incoming: Column, existing_offset: Column, incoming_offset: Column, *, key: str | None = None) -> Column:
    """Items with the incoming ones laid over from their offset on; gaps close. The same offset again replaces all."""
    a, b = _or_empty(existing, incoming), _or_empty(incoming, existing)
    length = F.greatest(existing_offset + F.size(a), incoming_offset + F.size(b)).cast("int")

    def at(p: Column) -> Column:
        i, j = (p - incoming_offset).cast("int"), (p - existing_offset).cast("int")
        return F.when((i >= 0) & (i < F.size(b)), F.get(b, i)).when((j >= 0) & (j < F.size(a)), F.get(a, j))

    laid = F.when(length > 0, F.filter(F.transform(F.sequence(F.lit(0), length - 1), at), lambda x: x.isNotNull())).otherwise(a)
    return F.when(existing_offset == incoming_offset, incoming).otherwise(keep_last(laid, key))


def merge_edges(existing: Column, incoming: Column, *, backward: bool = False, dedupe: bool = True) -> Column:
    """Edges of a connection; an empty page changes none."""
    a, b = _or_empty(existing, incoming), _or_empty(incoming, existing)
    joined = keep_last(F.concat(b, a) if backward else F.concat(a, b), "cursor" if dedupe else None)
    return F.when(F.size(a) == 0, incoming).when(F.size(b) == 0, existing).otherwise(joined)


def merge_page_info(existing: Column, incoming: Column, existing_edges: Column, incoming_edges: Column, *, backward: bool = False) -> Column:
    """The first page brings its own; an empty page brings its own too; else each end keeps its side's."""
    start, end = (incoming, existing) if backward else (existing, incoming)
    pick = lambda near, far, name, default: F.coalesce(near[name], far[name], F.lit(default)).alias(name)
    stitched = F.struct(
        pick(end, start, "hasNextPage", False), pick(start, end, "hasPreviousPage", False),
        pick(start, end, "startCursor", None), pick(end, start, "endCursor", None),
    )
    plain = F.size(_or_empty(existing_edges, incoming_edges)) == 0
    plain = plain | (F.size(_or_empty(incoming_edges, existing_edges)) == 0)
    both = existing.isNotNull() | incoming.isNotNull()
    return F.when(plain, F.coalesce(incoming, existing)).when(both, stitched)


def assemble(pages: DataFrame, key: Sequence[str], *, items: str, offset: str, arrival: str, dedupe: str | None = None) -> DataFrame:
    """One list per key from all its pages, by absolute offset: of items at one place the page that came last wins.

    The rows of a list are ranked by place and never gathered before the end; with ``dedupe``, an item stays at its
    last place.
    """
    key = list(key)
    spread = pages.select(*key, offset, arrival, F.posexplode(items).alias("at", "item"))
    placed = spread.select(*key, (F.col(offset) + F.col("at")).alias("place"), arrival, "item").where("item IS NOT NULL")
    last = placed.groupBy(*key, "place").agg(F.max_by("item", arrival).alias("item"))
    if dedupe is not None:
        again = Window.partitionBy(*key, F.col("item")[dedupe]).orderBy(F.col("place").desc())
        last = last.withColumn("n", F.row_number().over(again)).where(F.col("item")[dedupe].isNull() | (F.col("n") == 1)).drop("n")
    return last.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias(items))
