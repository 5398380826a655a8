"""Schema export of a registry, its scrubbing for a reader, and the StructType it stands for."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import types as T

from tessera.operators.graph import Definition

VERSION = 1
TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "date": T.TimestampType()}


def export_schema(registry: Mapping[str, Definition], default_id: str = "id") -> dict:
    """The registry as JSON: functions become flags, an id that is computed has no field."""

    def entity(d: Definition) -> dict:
        relations = {name: {"entity": r.entity, "many": r.many, **({"description": r.description} if r.description is not None else {})} for name, r in d.relations.items()}
        told = {"description": d.description} if d.description is not None else {}
        return {
            "idField": None if d.get_id else d.id_field, "computedId": d.get_id is not None, "customMerge": d.merge is not None, "local": d.local,
            **told, "fields": {n: {"type": s} if isinstance(s, str) else dict(s) for n, s in d.fields.items()}, "relations": relations,
        }

    return {"version": VERSION, "defaultIdField": default_id, "entities": {name: entity(d) for name, d in registry.items()}}


def scrub(schema: dict, allowed: Collection[str]) -> dict:
    """Only the allowed types, and no relation to another, whose name would give it away."""
    kept = {
        name: {**e, "relations": {n: r for n, r in e["relations"].items() if r["entity"] in allowed}}
        for name, e in schema["entities"].items()
        if name in allowed
    }
    return {**schema, "entities": kept}


def struct_type(entity: dict) -> T.StructType:
    """The typed row of an exported entity; types that aren't known are text."""
    return T.StructType([T.StructField(n, TYPES.get(f.get("type"), T.StringType())) for n, f in entity["fields"].items()])


def exported(kind: T.StructType) -> dict[str, dict]:
    """Field descriptions of a typed row."""
    return {f.name: {"type": next((n for n, t in TYPES.items() if isinstance(f.dataType, type(t))), "number" if isinstance(f.dataType, T.NumericType) else "string")} for f in kind.fields}
