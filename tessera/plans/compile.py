"""Compiles filters to Columns that are never NULL, for typed rows and for VARIANT documents.

Strict semantics: no coercion between classes; an absent field fails everything but ``exists: false`` and what a
``not`` turns round; null is a present value; NaN equals nothing; strings order by UTF-16 code units. On typed rows a
SQL NULL is an absent field (``null_as="absent"``) or a present null (``null_as="null"``), and a literal whose class
differs from the column's folds to a constant, so that Catalyst prunes it. The other predicates on typed columns stay
plain comparisons, which Parquet scans push down.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.matcher import Encodable, Node, classify, scalar_class

#: Longer lists on columns of texts or whole numbers become a semi join with a table of their values.
LONG_LIST = 200


def _utf16(c: Column) -> Column:
    """Orders strings by code unit."""
    return F.hex(F.encode(c, "UTF-16BE"))


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def _basic(text: str) -> bool:
    """Whether code units, code points and UTF-8 bytes order the text alike against any other text."""
    return all(ord(x) < 0xD800 for x in text)


class TypedField:
    """A column of a known class."""

    def __init__(self, column: Column, kind: T.DataType, null_as: str) -> None:
        self.column, self.null_as = column, null_as
        self.floating = isinstance(kind, T.FloatType | T.DoubleType)
        self.listable = isinstance(kind, T.IntegralType | T.StringType)
        self.cls = "number" if isinstance(kind, T.NumericType) else "string" if isinstance(kind, T.StringType) else "boolean" if isinstance(kind, T.BooleanType) else "other"

    def present(self) -> Column:
        return F.lit(True) if self.null_as == "null" else self.column.isNotNull()

    def _sure(self, told: Column) -> Column:
        """False for NULL and NaN, in a form that scans push down."""
        told = self.column.isNotNull() & told
        return told & ~F.isnan(self.column) if self.floating else told

    def equals(self, value: object) -> Column:
        if value is None:
            return self.column.isNull() if self.null_as == "null" else F.lit(False)
        if scalar_class(value) != self.cls:
            return F.lit(False)
        return self._sure(self.column == F.lit(value))

    def among(self, values: tuple) -> Column:
        own = [x for x in values if x is not None and scalar_class(x) == self.cls]
        found = self._sure(self.column.isin(own)) if own else F.lit(False)
        return found | self.column.isNull() if None in values and self.null_as == "null" else found

    def compares(self, op: str, value: object) -> Column:
        if scalar_class(value) != self.cls:
            return F.lit(False)
        if self.cls == "number" or _basic(value):
            return self._sure(_ordered(op, self.column, F.lit(value)))
        return self._sure(_ordered(op, _utf16(self.column), _utf16(F.lit(value))))


class DocumentField:
    """A key of a VARIANT object; keys are flat, dots and quotes included."""

    def __init__(self, document: Column, key: str) -> None:
        quote = next((q for q in "\"'" if q not in key), None)
        if quote:
            self.value = F.try_variant_get(document, f"$[{quote}{key}{quote}]", "variant")
        else:  # a path can't name it
            self.value = F.try_element_at(document.cast("map<string,variant>"), F.lit(key))
        self.kind = F.schema_of_variant(self.value)

    def present(self) -> Column:
        return self.value.isNotNull()

    def _is(self, cls: str) -> Column:
        if cls == "number":
            return F.coalesce(self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL"), F.lit(False))
        return F.coalesce(self.kind == {"string": "STRING", "boolean": "BOOLEAN"}[cls], F.lit(False))

    def _as(self, cls: str) -> Column:
        return F.try_variant_get(self.value, "$", {"number": "double"}.get(cls, cls))

    def equals(self, value: object) -> Column:
        if value is None:
            return F.coalesce(F.is_variant_null(self.value), F.lit(False))
        cls = scalar_class(value)
        literal = F.lit(float(value)) if cls == "number" else F.lit(value)
        return self._is(cls) & F.coalesce(self._as(cls) == literal, F.lit(False))

    def among(self, values: tuple) -> Column:
        found = self.equals(None) if None in values else F.lit(False)
        for cls in ("number", "string", "boolean"):
            if own := [float(x) if cls == "number" else x for x in values if scalar_class(x) == cls]:
                found = found | (self._is(cls) & F.coalesce(self._as(cls).isin(own), F.lit(False)))
        return found

    def compares(self, op: str, value: object) -> Column:
        cls = scalar_class(value)
        if cls == "number":
            return self._is(cls) & F.coalesce(_ordered(op, self._as(cls), F.lit(float(value))), F.lit(False))
        return self._is(cls) & F.coalesce(_ordered(op, _utf16(self._as(cls)), _utf16(F.lit(value))), F.lit(False))


class AbsentField:
    """A field that the rows don't have."""

    def present(self) -> Column:
        return F.lit(False)

    def equals(self, value: object) -> Column:
        return F.lit(False)

    def among(self, values: tuple) -> Column:
        return F.lit(False)

    def compares(self, op: str, value: object) -> Column:
        return F.lit(False)


Resolver = Callable[[str], "TypedField | DocumentField | AbsentField"]


def typed(df: DataFrame, null_as: str = "absent") -> Resolver:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return lambda name: TypedField(F.col(f"`{name.replace('`', '``')}`"), kinds[name], null_as) if name in kinds else AbsentField()


def documents(column: str = "data") -> Resolver:
    return lambda name: DocumentField(F.col(column), name)


def compile_node(node: Node, fields: Resolver) -> Column:
    """A boolean Column that is never NULL."""
    if node.op in ("and", "or"):
        parts = [compile_node(x, fields) for x in node.children]
        return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts, F.lit(node.op == "and"))
    if node.op == "not":
        return ~compile_node(node.children[0], fields)
    field = fields(node.field)
    if node.op == "exists":
        return field.present() if node.value else ~field.present()
    if node.op == "eq":
        return field.equals(node.value)
    if node.op == "neq":
        return field.present() & ~field.equals(node.value)
    if node.op == "in":
        return field.among(node.value)
    if node.op == "nin":
        return field.present() & ~field.among(node.value)
    return field.compares(node.op, node.value)


def opaque(df: DataFrame, predicate: Callable[[dict], object], on_error: Callable[[Exception], None] | None = None) -> Column:
    """A closure over rows as a vectorized UDF. Only exactly True matches; an error is a row that doesn't match."""
    names = df.columns

    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        reported, found = False, []
        for row in rows.to_dict("records"):
            try:
                found.append(predicate(row) is True)
            except Exception as error:
                found.append(False)
                if on_error is not None and not reported:
                    reported = True
                    on_error(error)
        return pd.Series(found, dtype=bool)

    return run(F.struct(*[F.col(f"`{n}`") for n in names]))


def matches(df: DataFrame, filter: object, *, fields: Resolver | None = None, null_as: str = "absent") -> Column:
    """The Column for a filter: a tree, a function of Columns, or a function of rows. Anything else is refused here."""
    found = classify(filter)
    if isinstance(found, Encodable):
        return compile_node(found.node, fields or typed(df, null_as))
    if not callable(filter):
        raise ValueError(f"unusable filter: {found.reason}")
    try:
        column = filter(df)
        known = isinstance(column, Column) and df.select(column).schema[0].dataType == T.BooleanType()
    except Exception:
        known = False
    return F.coalesce(column, F.lit(False)) if known else opaque(df, filter)


def matching(df: DataFrame, filter: object, **settings) -> DataFrame:
    """The rows that match. A single long ``in`` on a typed column is a semi join with its values instead."""
    found = classify(filter)
    if isinstance(found, Encodable) and found.node.op == "in" and len(found.node.value) > LONG_LIST and "fields" not in settings:
        node = found.node
        field = typed(df, settings.get("null_as", "absent"))(node.field)
        if isinstance(field, TypedField) and field.listable and None not in node.value:
            # a whole number equals no other number
            own = sorted({x for x in node.value if scalar_class(x) == field.cls and (field.cls == "string" or -(2**63) <= x < 2**63 and x == int(x))})
            values = df.sparkSession.createDataFrame([(x if field.cls == "string" else int(x),) for x in own], f"listed {'string' if field.cls == 'string' else 'bigint'}")
            return df.join(F.broadcast(values), F.col(f"`{node.field}`") == F.col("listed"), "left_semi")  # at most MAX_LIST values
    return df.where(matches(df, filter, **settings))
