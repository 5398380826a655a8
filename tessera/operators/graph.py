"""Normalizing nested payloads to entity tables, and resolving references back with joins.

A registry says which structs are entities and how they relate. Payloads with a schema are normalized declaratively:
each relation is one projection (and one explode where it is to many), so that Catalyst prunes what isn't asked.
Payloads without one go through a walker in Python that finds entities where they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.matcher import canonical_json, number_text
from tessera.sources.scratch import stored

# Fixed value: the key that marks a reference in stored data.
REF_MARK = "__cdb_ref"


@dataclass(frozen=True)
class Relation:
    """``path`` in the payload holds entities of ``entity``; ``key`` is the column that refers to them."""

    entity: str
    many: bool = False
    description: str | None = None


@dataclass(frozen=True)
class Definition:
    id_field: str | None = None
    get_id: Callable | None = None
    relations: Mapping[str, Relation] = field(default_factory=dict)
    fields: Mapping[str, object] = field(default_factory=dict)
    merge: Callable | None = None
    local: bool = False
    description: str | None = None


def id_text(c: Column, kind: T.DataType) -> Column:
    """An id as text; whole numbers have no fraction."""
    if isinstance(kind, T.DoubleType | T.FloatType | T.DecimalType):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def ref(entity_type: str, id: Column) -> Column:
    """A reference, NULL for a NULL id."""
    return F.when(id.isNotNull(), F.struct(F.lit(entity_type).alias("entity_type"), id.alias("id"), F.concat(F.lit(entity_type + ":"), id).alias("key")))


def _id_of(row: Column, kind: T.StructType, definition: Definition) -> Column:
    if definition.get_id is not None:
        return definition.get_id(row).cast("string")
    return id_text(row[definition.id_field], kind[definition.id_field].dataType)


def _refer(entity: str, kind: T.StructType, definition: Definition) -> Callable[[Column], Column]:
    return lambda x: ref(entity, _id_of(x, kind, definition))


def normalize(payloads: DataFrame, root: str, registry: Mapping[str, Definition], order: str = "seq") -> dict[str, DataFrame]:
    """Tables of the entities in ``payloads`` by type: the order column, id, own fields, and references for relations.

    ``payloads`` has one row per payload with the root entity's fields as columns. Entities come once per occurrence;
    a later row merges over an earlier one in the fold. A row without an id is no entity and stays with its parent.
    """
    found: dict[str, DataFrame] = {}

    def visit(rows: DataFrame, entity: str) -> None:
        definition, kind = registry[entity], rows.schema["node"].dataType
        node = F.col("node")
        columns = []
        for f in kind.fields:
            relation = definition.relations.get(f.name)
            if relation is None:
                columns.append(node[f.name].alias(f.name))
                continue
            target = registry[relation.entity]
            if relation.many:
                columns.append(F.transform(node[f.name], _refer(relation.entity, f.dataType.elementType, target)).alias(f.name))
                below = rows.select(order, F.explode(node[f.name]).alias("node"))
            else:
                columns.append(ref(relation.entity, _id_of(node[f.name], f.dataType, target)).alias(f.name))
                below = rows.select(order, node[f.name].alias("node")).where("node IS NOT NULL")
            visit(below, relation.entity)
        own = _id_of(node, kind, definition)
        table = rows.select(order, own.alias("entity_id"), *columns).where("entity_id IS NOT NULL")
        found[entity] = table if entity not in found else found[entity].unionByName(table, allowMissingColumns=True)

    fields = [c for c in payloads.columns if c != order]
    visit(payloads.select(order, F.struct(*[F.col(f"`{c}`") for c in fields]).alias("node")), root)
    return found


def identify(value: dict, registry: Mapping[str, Definition], default_id: str = "id") -> tuple[str, str] | None:
    """Type and id of a plain object: by the definitions in order, else by a typename and the default id field."""

    def text(x: object) -> str | None:
        if x is None or isinstance(x, dict | list):
            return None
        return number_text(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else str(x)

    for name, definition in registry.items():
        found = definition.get_id(value) if definition.get_id else value.get(definition.id_field) if definition.id_field else None
        if (own := text(found)) is not None:
            return name, own
    kind = value.get("__typename")
    return (kind, own) if isinstance(kind, str) and kind and (own := text(value.get(default_id))) is not None else None


def walk(value: object, registry: Mapping[str, Definition], default_id: str = "id") -> tuple[object, list[tuple[str, str, dict]]]:
    """(value with references in place of entities, the entities below it, inner ones first)."""
    found: list[tuple[str, str, dict]] = []

    def visit(x: object) -> object:
        if isinstance(x, list):
            return [visit(y) for y in x]
        if not isinstance(x, dict) or x.get(REF_MARK) is True:
            return x
        own = {k: visit(v) for k, v in x.items()}
        if (key := identify(x, registry, default_id)) is None:
            return own
        found.append((*key, own))
        return {REF_MARK: True, "entityType": key[0], "id": key[1], "key": f"{key[0]}:{key[1]}"}

    return visit(value), found


def normalize_documents(payloads: DataFrame, registry: Mapping[str, Definition], *, order: str = "seq", text: str = "payload", default_id: str = "id") -> DataFrame:
    """JSON payloads of any shape -> order, place (in the payload), entity_type, id, data (JSON text)."""
    static = {k: Definition(id_field=v.id_field, get_id=v.get_id) for k, v in registry.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (seq, place, kind, own, canonical_json(data))
                for seq, payload in zip(batch[order], batch[text], strict=True)
                if payload is not None
                for place, (kind, own, data) in enumerate(walk(json.loads(payload), static, default_id)[1])
            ]
            yield pd.DataFrame(out, columns=[order, "place", "entity_type", "id", "data"])

    return payloads.select(order, text).mapInPandas(run, f"{order} bigint, place int, entity_type string, id string, data string")


def write_order(found: DataFrame, registry: Mapping[str, Definition], *, order: str = "seq") -> DataFrame:
    """Extracted documents as writes in the order they apply: first those that merge plainly, then those of types with a
    merge of their own, each in the order of payload and place. Adds op, origin and struct ``seq``."""
    custom = [name for name, d in registry.items() if d.merge is not None]
    own = F.col("entity_type").isin(custom) if custom else F.lit(False)
    return found.select(
        F.struct(own.cast("int").alias("wave"), F.col(order).alias("payload"), "place").alias("seq"), F.when(own, "merge").otherwise("set").alias("op"),
        "entity_type", "id", "data", F.lit("query-response").alias("origin"),
    )


def merged(existing: DataFrame, incoming: DataFrame, key: Sequence[str], merge: Callable[[Column, Column], Mapping[str, Column]]) -> DataFrame:
    """Entities of a type with a merge of its own: ``merge`` gets both structs (NULL where there is none) and gives the
    fields; an incoming entity without an existing one stays as it is."""
    fields = [c for c in incoming.columns if c not in key]
    a = existing.select(*key, F.struct(*[c for c in existing.columns if c not in key]).alias("existing_entity"))
    b = incoming.select(*key, F.struct(*fields).alias("incoming_entity"))
    told = merge(F.col("existing_entity"), F.col("incoming_entity"))
    both = a.join(b, list(key), "full")
    pick = lambda f: (
        F.when(F.col("existing_entity").isNull(), F.col("incoming_entity")[f]).when(F.col("incoming_entity").isNull(), F.col("existing_entity")[f]).otherwise(told[f])
    )
    return both.select(*key, *(pick(f).alias(f) for f in fields))


def is_ref(document: Column) -> Column:
    """Whether a VARIANT is a whole reference: the mark and three texts. Anything else is plain data."""
    texts = [F.schema_of_variant(F.try_variant_get(document, f"$.{k}", "variant")) == "STRING" for k in ("entityType", "id", "key")]
    mark = F.try_variant_get(document, f'$["{REF_MARK}"]', "variant")
    marked = (F.schema_of_variant(mark) == "BOOLEAN") & F.try_variant_get(document, f'$["{REF_MARK}"]', "boolean")
    return F.coalesce(marked & texts[0] & texts[1] & texts[2], F.lit(False))


def decode_ref(document: Column) -> Column:
    """A whole reference as a struct (entity_type, id, key); NULL for plain data, which a marked object of another shape is."""
    part = lambda k: F.try_variant_get(document, f"$.{k}", "string")
    return F.when(is_ref(document), F.struct(part("entityType").alias("entity_type"), part("id").alias("id"), part("key").alias("key")))


def encode_ref(reference: Column) -> Column:
    """The stored form of a struct (entity_type, id, key): a marked VARIANT object; NULL for NULL or a part that is."""
    whole = reference["entity_type"].isNotNull() & reference["id"].isNotNull() & reference["key"].isNotNull()
    shape = F.struct(F.lit(True).alias(REF_MARK), reference["entity_type"].alias("entityType"), reference["id"].alias("id"), reference["key"].alias("key"))
    return F.when(whole, F.to_variant_object(shape))


def ref_key(value: object) -> str | None:
    """The key of a whole reference in a document, else None."""
    if isinstance(value, dict) and value.get(REF_MARK) is True and all(isinstance(value.get(k), str) for k in ("entityType", "id", "key")):
        return f"{value['entityType']}:{value['id']}"
    return None


def ref_keys(value: object) -> list[str]:
    """The keys of all references in a document, each once."""
    found: dict[str, None] = {}
    stack = [value]
    while stack:
        x = stack.pop()
        if (key := ref_key(x)) is not None:
            found[key] = None
        elif isinstance(x, dict | list):
            stack += x.values() if isinstance(x, dict) else x
    return list(found)


def resolved(value: object, entities: Mapping[str, object]) -> object:
    """A document with entities in place of references, and of theirs, all the way down.

    A missing entity is a missing field, and an empty place in a list. An entity inside itself is left as it is stored.
    """
    missing, open_ = object(), set()

    def visit(x: object) -> object:
        if (key := ref_key(x)) is not None:
            if key not in entities:
                return missing
            if key in open_:
                return entities[key]
            open_.add(key)
            try:
                return visit(entities[key])
            finally:
                open_.discard(key)
        if isinstance(x, list):
            return [None if (y := visit(v)) is missing else y for v in x]
        if isinstance(x, dict):
            return {k: y for k, v in x.items() if (y := visit(v)) is not missing}
        return x

    found = visit(value)
    return None if found is missing else found


def _mapped(rows: DataFrame, text: str, make: Callable[[str], object], schema: str, *kept: str) -> DataFrame:
    """Rows with what ``make`` gives for their JSON text as the last column."""
    name = schema.split(" ")[0]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(kept)].copy()
            out[name] = [make(x) for x in batch[text]]
            yield out

    return rows.select(*kept, text).mapInPandas(run, f"{kinds}, {schema}")


def denormalize_documents(documents: DataFrame, entities: DataFrame, *, row: str = "row", depth: int = 1_000) -> DataFrame:
    """documents (``row``, unique; data as JSON text) -> row and data with entities in place of references.

    ``entities`` has key columns and data as JSON text. What a document's references lead to is found by joins, a
    round for each step of up to ``depth``; then each document meets the entities that are its own.
    """
    stated = entities.select(F.concat_ws(":", "entity_type", "id").alias("key"), "data")
    keys = lambda x: [] if x is None else ref_keys(json.loads(x))
    edges = stored(_mapped(stated, "data", keys, "refs array<string>", "key").select(F.col("key").alias("a"), F.explode("refs").alias("b")), "edges")
    starts = _mapped(documents, "data", keys, "refs array<string>", row).select(F.col(row).alias("node"), F.explode("refs").alias("reached"))
    front = stored(starts, "reached")
    parts = [front]
    for _ in range(depth):
        if front.isEmpty():
            break
        seen = parts[0]
        for part in parts[1:]:
            seen = seen.unionByName(part)
        nexts = front.join(edges, F.col("reached") == F.col("a")).select("node", F.col("b").alias("reached")).distinct()
        front = stored(nexts.join(seen, ["node", "reached"], "left_anti"), "reached")
        parts.append(front)
    reached = parts[0]
    for part in parts[1:]:
        reached = reached.unionByName(part)
    met = reached.join(stated, F.col("reached") == F.col("key")).groupBy("node").agg(F.collect_list(F.struct("key", "data")).alias("entities"))
    joined = documents.select(row, "data").join(met, F.col(row) == F.col("node"), "left")
    body = joined.select(row, F.to_json(F.struct("data", "entities")).alias("body"))

    def make(body: str) -> str | None:
        told = json.loads(body)
        if told.get("data") is None:
            return None
        found = resolved(json.loads(told["data"]), {x["key"]: json.loads(x["data"]) for x in told.get("entities") or [] if x.get("data") is not None})
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return _mapped(body, "body", make, "data string", row)


def denormalize(tables: Mapping[str, DataFrame], root: str, registry: Mapping[str, Definition], *, depth: int = 16) -> DataFrame:
    """The rows of ``root`` with entities in place of references, along the registry's relations and theirs.

    A table has entity_id (unique), own fields and, for relations, reference structs or arrays of them, as
    ``normalize`` makes them. A missing entity is NULL, in a list a NULL in its place. A type within itself, or beyond
    ``depth`` levels, keeps its references.
    """

    def expand(entity: str, path: tuple[str, ...]) -> DataFrame:
        rows = tables[entity]
        for name, relation in registry[entity].relations.items():
            if name not in rows.columns or relation.entity not in tables or relation.entity in path or len(path) > depth:
                continue
            target = expand(relation.entity, (*path, relation.entity))
            right = target.select(F.col("entity_id").alias("resolved_id"), F.struct(*[f"`{c}`" for c in target.columns]).alias("resolved"))
            columns = [F.col("resolved" if c == name else f"`{c}`").alias(c) for c in rows.columns]
            if not relation.many:
                rows = rows.join(right, F.col(f"`{name}`.id") == F.col("resolved_id"), "left").select(*columns)
                continue
            spread = rows.select("entity_id", F.posexplode(F.col(f"`{name}`")).alias("at", "wanted"))
            found = spread.join(right, F.col("wanted.id") == F.col("resolved_id"), "left").groupBy(F.col("entity_id").alias("owner"))
            found = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "resolved"))), lambda x: x["resolved"]).alias("resolved"))
            empty = F.when(F.col(f"`{name}`").isNotNull(), F.array().cast(found.schema["resolved"].dataType))
            columns = [(F.coalesce("resolved", empty) if c == name else F.col(f"`{c}`")).alias(c) for c in rows.columns]
            rows = rows.join(found, F.col("entity_id") == F.col("owner"), "left").select(*columns)
        return rows

    return expand(root, (root,))


def resolve_one(rows: DataFrame, column: Column | str, target: DataFrame, id: str, name: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Adds the entity that ``column`` refers to as a struct; NULL where there is none, as for a dangling reference."""
    fields = list(fields or [c for c in target.columns if c != id])
    right = target.select(F.col(id).alias("resolved_id"), F.struct(id, *fields).alias(name))
    return rows.join(right, F.col(column) == F.col("resolved_id") if isinstance(column, str) else column == F.col("resolved_id"), "left").drop("resolved_id")


def resolve_many(rows: DataFrame, key: Sequence[str], refs: str, target: DataFrame, id: str, name: str) -> DataFrame:
    """Adds the entities an array of ids refers to, in its order; a dangling one is a NULL in its place."""
    spread = rows.select(*key, F.posexplode_outer(refs).alias("at", "wanted"))
    right = target.select(F.col(id).alias("resolved_id"), F.struct(*target.columns).alias("entity"))
    joined = spread.join(right, F.col("wanted") == F.col("resolved_id"), "left").where("at IS NOT NULL")
    found = joined.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity"))), lambda x: x["entity"]).alias(name))
    return rows.join(found, list(key), "left").withColumn(name, F.when(F.col(refs).isNotNull(), F.coalesce(name, F.array().cast(found.schema[name].dataType))))


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, reached, steps): what references lead to from ``start`` within ``depth`` steps.

    Each step is a table of its own, and what was reached before is left out, so that cycles end by themselves.
    """
    found = stored(start.select("node", F.col("node").alias("reached"), F.lit(0).alias("steps")), "front")
    front = found
    for step in range(1, depth + 1):
        nexts = front.select("node", "reached").join(edges, F.col("reached") == F.col("a")).select("node", F.col("b").alias("reached")).distinct()
        front = stored(nexts.join(found, ["node", "reached"], "left_anti").withColumn("steps", F.lit(step)), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
