"""The ordered change log of entities and its folds.

A log has a row for each write: seq (total order), op, the key columns, and either typed field columns or ``data``
VARIANT. ``set`` merges the fields it carries, ``replace`` starts anew with its own, ``remove`` deletes, ``evict`` drops
the entity from the projection only. In typed rows a NULL field is one that the write doesn't carry.

Typed folds are two aggregations with map-side partial results (where the last reset of a key is, and each field's
last value since), so that a key with a third of all rows costs one row a task in the shuffle. Document folds combine
pieces of a key's log first, since merging is associative. Images carry what earlier pieces of a key's log come to into
each piece, so that a window never holds more than a piece of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import stored

KEY = ("entity_type", "id")
#: Writes of a key that are combined in one piece.
PIECE = 4_096
#: Sequence numbers of a piece whose images one task makes.
IMAGE_PIECE = 1 << 18


def key_text(entity_type: str = "entity_type", id: str = "id") -> Column:
    return F.concat_ws(":", entity_type, id)


def split_key(key: str = "key") -> tuple[Column, Column]:
    """Type and id; the id is what follows the first colon. NULL for a key without one."""
    at = F.instr(key, ":")
    return F.when(at > 0, F.substring(F.col(key), F.lit(1), at - 1)), F.when(at > 0, F.expr(f"substr(`{key}`, instr(`{key}`, ':') + 1)"))


def _resets() -> Column:
    return F.col("op").isin("replace", "remove", "evict")


def _writes() -> Column:
    return F.col("op").isin("set", "replace")


def _states(log: DataFrame, fields: Sequence[str], key: Sequence[str], marks: DataFrame, upto: Column) -> DataFrame:
    """Each field's last value among the writes of its key from ``begin`` on that ``upto`` lets in."""
    own = log.where(_writes()).join(marks, list(key)).where((F.col("seq") >= F.col("begin")) & upto)
    values = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return own.groupBy(*key).agg(*values, F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def fold(log: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """The entities the log leaves in memory: key, fields, first_seq (of the current life), last_seq."""
    last = F.max(F.when(_resets(), F.struct("seq", "op")))
    begin = F.coalesce(F.when(F.col("last.op") == "replace", F.col("last.seq")).otherwise(F.col("last.seq") + 1), F.lit(-(2**62)))
    marks = log.groupBy(*key).agg(last.alias("last")).select(*key, begin.alias("begin"))
    return _states(log, fields, key, marks, F.lit(True))


def durable_fold(log: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """The rows the log leaves on disk: key, fields, row_version, last_seq.

    A row is the memory image at the key's last write: ``evict`` doesn't delete it, but a write after an ``evict``
    merges onto nothing. The version counts the writes since the row last came to be.
    """
    ends = log.groupBy(*key).agg(F.max(F.when(_writes(), F.col("seq"))).alias("written"), F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("removed"))
    alive = ends.where("written IS NOT NULL AND (removed IS NULL OR written > removed)")
    last = log.where(_resets()).join(alive, list(key)).where("seq <= written").groupBy(*key).agg(F.max(F.struct("seq", "op")).alias("last"))
    begin = F.coalesce(F.when(F.col("last.op") == "replace", F.col("last.seq")).otherwise(F.col("last.seq") + 1), F.lit(-(2**62)))
    marks = alive.join(last, list(key), "left").select(*key, "removed", begin.alias("begin"))
    versions = log.where(_writes()).join(alive.select(*key, "removed"), list(key)).where("removed IS NULL OR seq > removed").groupBy(*key).agg(F.count(F.lit(1)).alias("row_version"))
    return _states(log, fields, key, marks.drop("removed"), F.lit(True)).drop("first_seq").join(versions, list(key))


def images(log: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Each change with the entity after it (``now_*``, ``exists``) and before it (``prev_*``, ``existed``).

    Two levels where ``seq`` is a whole number and the log has several pieces: what each piece of a key's log comes to
    is summed up first and carried into the next ones; rows are only ranked within a piece.
    """
    ends = log.agg(F.min("seq"), F.max("seq")).first() if isinstance(log.schema["seq"].dataType, T.IntegralType) else (None, None)
    if ends[0] is None or ends[0] // IMAGE_PIECE == ends[1] // IMAGE_PIECE:
        return _imaged(log, fields, list(key))
    piece = [*key, "image_piece"]
    log = log.withColumn("image_piece", F.floor(F.col("seq") / IMAGE_PIECE))
    reset = F.max(F.when(_resets(), F.col("seq"))).alias("reset")
    last = [F.max(F.when(_writes() & F.col(f).isNotNull(), F.struct("seq", F.col(f).alias("x")))).alias(f) for f in fields]
    sums = log.groupBy(*piece).agg(reset, F.max_by("op", "seq").alias("ended"), *last)
    # what a piece says of a field: its last value since the last reset, NULL after a reset without one, or nothing
    since = lambda f: F.when(F.col("reset").isNull() | (F.col(f"{f}.seq") >= F.col("reset")), F.col(f"{f}.x"))
    said = [F.when(F.col("reset").isNotNull() | F.col(f).isNotNull(), F.struct(since(f).alias("x"))).alias(f) for f in fields]
    earlier = Window.partitionBy(*key).orderBy("image_piece").rowsBetween(Window.unboundedPreceding, -1)
    alive = F.coalesce(F.last("ended").over(earlier).isin("set", "replace"), F.lit(False))
    told = sums.select(*piece, "ended", *said)
    carried = told.select(*piece, alive.alias("alive"), *(F.last(f, ignorenulls=True).over(earlier)["x"].alias(f"carried_{f}") for f in fields))

    alive, before = F.col("alive"), {f: F.when(F.col("alive"), F.col(f"carried_{f}")) for f in fields}
    return _imaged(log.join(carried, piece), fields, piece, alive, before).drop("image_piece", "alive", *(f"carried_{f}" for f in fields))


def _imaged(log: DataFrame, fields: Sequence[str], part: Sequence[str], alive: Column | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """The images within each part, at whose start an entity is there if ``alive``, with the fields ``before``."""
    in_order = Window.partitionBy(*part).orderBy("seq")
    epoch = F.coalesce(F.sum(_resets().cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    life = Window.partitionBy(*part, "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    now = log.withColumn("epoch", epoch).withColumn("exists", _writes())
    own = {f: F.last(F.when(_writes(), F.col(f)), ignorenulls=True).over(life) for f in fields}
    if before is not None:
        own = {f: F.coalesce(c, F.when(F.col("epoch") == 0, before[f])) for f, c in own.items()}
    now = now.withColumns({f"now_{f}": F.when(F.col("exists"), c) for f, c in own.items()})
    prev = {f: F.lag(f"now_{f}").over(in_order) for f in fields}
    if before is not None:
        first = F.lag("exists").over(in_order).isNull()
        prev = {f: F.when(first, before[f]).otherwise(c) for f, c in prev.items()}
    existed = F.coalesce(F.lag("exists").over(in_order), F.lit(False) if alive is None else alive)
    return now.withColumns({**{f"prev_{f}": c for f, c in prev.items()}, "existed": existed}).drop("epoch")


def _strictly_differs(a: Column, b: Column, floating: bool) -> Column:
    differs = ~a.eqNullSafe(b)
    return differs | F.coalesce(F.isnan(a), F.lit(False)) if floating else differs


def emitted(imaged: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The changes that are events: no ``set`` that changes no field it carries, no ``evict`` of what isn't there.

    Every ``replace`` and ``remove`` is an event, the latter even for an absent entity. NaN always differs; so do
    nested values, which arrive as new objects.
    """
    kinds = dict(imaged.dtypes)
    nested = lambda f: kinds[f].startswith(("array", "map", "struct", "variant"))
    touched = [
        F.col(f).isNotNull() & (F.lit(True) if nested(f) else _strictly_differs(F.col(f), F.col(f"prev_{f}"), kinds[f] in ("double", "float")))
        for f in fields
    ]
    changed = F.greatest(*touched) if len(touched) > 1 else touched[0]
    event = F.when(F.col("op") == "set", ~F.col("existed") | changed).when(F.col("op") == "evict", F.col("existed")).otherwise(True)
    return imaged.where(event)


def fold_documents(log: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The fold over ``data`` VARIANT: key and data. Absent keys and JSON null stay apart.

    A piece of a key's log becomes (whether it resets, fields or NULL for none); two pieces combine to the later one
    if it resets, else to the merge of both.
    """
    step = log.select(
        *key, "seq", F.floor(F.col("seq") / PIECE).alias("piece"), _resets().alias("resets"),
        F.when(_writes(), F.expr("cast(data AS map<string, variant>)")).alias("fields"),
    )
    folded = """aggregate(
        array_sort(collect_list(struct({at} AS at, resets, fields)), (x, y) -> CASE WHEN x.at < y.at THEN -1 WHEN x.at > y.at THEN 1 ELSE 0 END),
        named_struct('resets', false, 'fields', cast(NULL AS map<string, variant>)),
        (a, e) -> CASE WHEN e.resets THEN named_struct('resets', true, 'fields', e.fields)
                       WHEN e.fields IS NULL THEN a
                       WHEN a.fields IS NULL THEN named_struct('resets', a.resets, 'fields', e.fields)
                       ELSE named_struct('resets', a.resets, 'fields', map_concat(map_filter(a.fields, (k, v) -> NOT map_contains_key(e.fields, k)), e.fields)) END)"""
    pieces = step.groupBy(*key, "piece").agg(F.expr(folded.format(at="seq")).alias("f")).select(*key, "piece", "f.resets", "f.fields")
    whole = pieces.groupBy(*key).agg(F.expr(folded.format(at="piece")).alias("f"))
    return whole.where("f.fields IS NOT NULL").select(*key, F.expr("to_variant_object(f.fields)").alias("data"))


def update(entities: DataFrame, changes: dict[str, Column], key: Sequence[str] = KEY) -> DataFrame:
    """Read-modify-write of current entities as ``replace`` ops."""
    return entities.withColumns(changes).withColumn("op", F.lit("replace"))


def clear(entities: DataFrame, seq: int, key: Sequence[str] = KEY) -> DataFrame:
    """``remove`` ops for exactly the given snapshot, in one block of sequence numbers from ``seq`` on."""
    ranged = entities.select(*key).repartitionByRange(*key).withColumn("piece", F.spark_partition_id())
    numbered = stored(ranged, "cleared")  # a table, so that rows keep their pieces
    place = F.row_number().over(Window.partitionBy("piece").orderBy(*key)) - 1
    return numbered.join(offsets(numbered, "piece"), "piece").select((F.lit(seq) + F.col("before") + place).alias("seq"), F.lit("remove").alias("op"), *key)


def offsets(rows: DataFrame, piece: str, *by: str, takes: Column | None = None) -> DataFrame:
    """For each piece (within ``by``) how many rows earlier pieces hold: (by, piece, before)."""
    sums = rows.groupBy(*by, piece).agg(F.sum(F.lit(1) if takes is None else takes).cast("long").alias("held"))
    earlier = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, piece, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))


def stamped(rows: DataFrame, origin: str | None = None, tx_id: str | None = None) -> DataFrame:
    """Writes under a context: origin and transaction are set as given, and not given ones are taken away."""
    return rows.withColumn("origin", F.lit(origin).cast("string")).withColumn("tx_id", F.lit(tx_id).cast("string"))
