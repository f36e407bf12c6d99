"""Whole-value JSON tests and typed decoding from built-in functions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The parser's liberties that JSON doesn't have.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; false for null.

    The built-in parser stops after the first value. So the text becomes the first of two elements
    of an array, whose second is the text's own digest: what closes the array early, adds elements or
    trails behind would have to hold the digest of itself. Values nested in over 998 others, and
    numbers of over 1,000 digits, are beyond the parser and count as no JSON.
    """
    own = F.sha2(text, 256)
    read = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), own, F.lit('"]')), "array<string>", _STRICT)
    return F.coalesce((F.size(read) == 2) & (F.get(read, F.lit(1)) == own), F.lit(False))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names a value inside one expression, so that it is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _leaf(v: Column, kind: Column, wanted: T.DataType) -> tuple[Column, Column, Column]:
    """Whether the value fits, its value, and its type's zero."""
    name = wanted.simpleString()
    if isinstance(wanted, T.StringType):
        return kind == "STRING", F.try_variant_get(v, "$", "string"), F.lit("")
    if isinstance(wanted, T.BooleanType):
        return kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"), F.lit(False)
    if type(wanted) in _RANGES:
        # fractions and exponents are decimals and doubles, also where they are whole
        number = F.try_variant_get(v, "$", "bigint")
        most = (1 << _RANGES[type(wanted)]) - 1
        return (kind == "BIGINT") & number.between(-most - 1, most), F.when(number.between(-most - 1, most), number).cast(name), F.lit(0).cast(name)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if isinstance(wanted, (T.DoubleType, T.FloatType)):
        number = F.try_variant_get(v, "$", "double")
        most = 3.4028235677973366e38 if isinstance(wanted, T.FloatType) else float("inf")
        return numeric & (F.abs(number) < most), number.cast(name), F.lit(0).cast(name)
    if isinstance(wanted, T.DecimalType):
        number = F.try_variant_get(v, "$", name)
        return numeric & number.isNotNull(), number, F.lit(0).cast(name)
    raise ValueError(f"no JSON value is decoded to {name}")


def _decoded(v: Column, wanted: T.DataType, path: Column) -> Column:
    """variant -> struct<value, error>: error tells the first place that doesn't fit, in the schema's order.

    Each value and its kind are bound: unbound, each use at each depth would read it anew from the text.
    """
    return _bound(v, lambda v: _bound(F.schema_of_variant(v), lambda kind: _read(v, kind, wanted, path)))


def _read(v: Column, kind: Column, wanted: T.DataType, path: Column) -> Column:
    """``_decoded`` of a bound value of a kind."""
    absent = v.isNull() | (kind == "VOID")

    def wrong(fits: Column) -> Column:
        return F.when(~absent & ~F.coalesce(fits, F.lit(False)), F.concat(path, F.lit(f": not of type {wanted.simpleString()}")))

    def both(value: Column, error: Column) -> Column:
        return F.struct(value.alias("value"), error.cast("string").alias("error"))

    def first(found: Column) -> Column:
        return F.get(F.filter(F.transform(found, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0))

    if isinstance(wanted, T.VariantType):
        return both(v, F.lit(None))
    if isinstance(wanted, T.StructType):
        if any(c in f.name for f in wanted.fields for c in "'\\"):
            raise ValueError("field names with quotes or backslashes aren't decoded")
        inner = F.struct(*(_decoded(F.try_variant_get(v, f"$['{f.name}']", "variant"), f.dataType, F.concat(path, F.lit(f".{f.name}"))).alias(f"f{i}") for i, f in enumerate(wanted.fields)))
        return _bound(inner, lambda d: both(F.struct(*(d[f"f{i}"]["value"].alias(f.name) for i, f in enumerate(wanted.fields))), F.coalesce(wrong(kind.startswith("OBJECT")), *(d[f"f{i}"]["error"] for i in range(len(wanted.fields))))))
    if isinstance(wanted, T.ArrayType):
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _decoded(x, wanted.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return _bound(items, lambda d: both(F.coalesce(F.transform(d, lambda x: x["value"]), F.array().cast(wanted.simpleString())), F.coalesce(wrong(kind.startswith("ARRAY")), first(d))))
    if isinstance(wanted, T.MapType):
        if not isinstance(wanted.keyType, T.StringType):
            raise ValueError("a JSON object's keys are strings")
        items = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), _decoded(e["value"], wanted.valueType, F.concat(path, F.lit("."), e["key"])).alias("d")))
        return _bound(items, lambda d: both(F.coalesce(F.map_from_entries(F.transform(d, lambda x: F.struct(x["key"], x["d"]["value"]))), F.create_map().cast(wanted.simpleString())), F.coalesce(wrong(kind.startswith("OBJECT")), first(F.transform(d, lambda x: x["d"])))))
    fits, value, zero = _leaf(v, kind, wanted)
    return _bound(F.when(F.coalesce(fits, F.lit(False)), F.struct(value.alias("own"))), lambda x: both(F.when(x.isNotNull(), x["own"]).otherwise(zero), wrong(x.isNotNull())))


def decoded(text: Column, schema: str | T.DataType) -> Column:
    """JSON text -> struct<value, error> of a type, however nested.

    Unknown fields are ignored; missing and null ones get their type's zero ('', 0, false, an empty
    array or map, a struct of zeros). Integers take whole numbers in range, written without fraction or
    exponent. ``error`` is null, or names what is wrong: text that isn't JSON, an object that
    repeats a key (it can't be read), or the first place, by the schema's order, whose value doesn't
    fit. A value with an error holds zeros there and isn't meant to be used.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    error = F.when(~is_json(text), "not JSON").when(F.try_parse_json(text).isNull(), "a key is repeated")
    return _bound(_decoded(F.try_parse_json(text), wanted, F.lit("$")), lambda d: F.struct(d["value"].alias("value"), F.coalesce(error, d["error"]).alias("error")))
