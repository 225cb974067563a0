"""JSON schemas compiled to expressions over VARIANT: the paths at which a document breaks one.

The subset: type, const, enum, minLength, minimum, format date-time, required, properties, closed
objects (additionalProperties false), items, minItems, uniqueItems, $ref, oneOf, anyOf, allOf and
if/then. As with the validators that services use, $ref and oneOf replace what stands beside them.
A schema is compiled once on the driver; rows stay in the JVM.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "CAST(array() AS array<string>)"
#: Calendar date, time to the minute or finer, and an offset.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,9})?)?(?:[Zz]|[+-]\d{2}(?::\d{2}(?::\d{2})?)?)$"
KNOWN = {"$ref", "$schema", "$id", "title", "description", "type", "const", "enum", "minLength", "minimum", "format", "required", "properties", "additionalProperties", "items", "minItems", "uniqueItems", "oneOf", "anyOf", "allOf", "if", "then"}
#: $refs that may be followed one inside another; a schema that refers to itself has no end.
DEEPEST = 16


class SchemaError(ValueError):
    """The schema itself can't be used."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _looked_at(v: Column) -> Column:
    """What a variant is, as a struct: its kind, and its fields or items. kind: object, array, string,
    integer, number, boolean or null; null for what isn't JSON."""

    def scalar(s: Column) -> Column:
        wide = F.regexp_extract(s, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int")  # integers beyond 64 bits
        return F.when(s == "STRING", "string").when(s == "BIGINT", "integer").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(wide >= 19, "integer").otherwise("number")

    def named(parts: Column) -> Column:
        kind = F.when(parts["fields"].isNotNull(), "object").when(parts["items"].isNotNull(), "array").when(v.isNotNull(), _let(F.schema_of_variant(v), scalar))
        return F.struct(kind.alias("kind"), parts["fields"].alias("fields"), parts["items"].alias("items"))

    parts = F.struct(F.try_variant_get(v, "$", "map<string,variant>").alias("fields"), F.try_variant_get(v, "$", "array<variant>").alias("items"))
    return _let(parts, named)


def _literal(value: Any) -> Column:
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


class _Compiler:
    def __init__(self, files: Mapping[str, Mapping]):
        self.files = files

    def find(self, schema: Mapping[str, Any], v: Column, path: Column, base: str = "", depth: int = 0) -> Column:
        """Array of the violating paths of v, which is at path."""
        return _let(v, lambda x: _let(_looked_at(x), lambda look: self._at(schema, x, look, path, base, depth)))

    def _at(self, schema: Mapping[str, Any], v: Column, look: Column, path: Column, base: str, depth: int) -> Column:
        """The same of a value that was looked at: schemas of one value share the look."""
        if unknown := {k for k in schema if k not in KNOWN and not k.startswith("x-")}:
            raise SchemaError(f"unknown keywords {sorted(unknown)}")
        if "$ref" in schema:
            name = posixpath.normpath(posixpath.join(base, schema["$ref"]))
            if name not in self.files:
                raise SchemaError(f"no schema {name}")
            if depth >= DEEPEST:
                raise SchemaError(f"$ref {name} is nested too deep")
            return self._at(self.files[name], v, look, path, posixpath.dirname(name), depth + 1)
        return self._node(schema, v, look, path, base, depth)

    def _node(self, schema: Mapping[str, Any], v: Column, look: Column, path: Column, base: str, depth: int) -> Column:
        inner = lambda s: self._at(s, v, look, path, base, depth)
        fits = lambda s: F.size(inner(s)) == 0
        here = lambda bad: F.when(F.coalesce(bad, F.lit(False)), F.array(path)).otherwise(F.expr(_NONE))
        if "oneOf" in schema:
            return here(sum((fits(s).cast("int") for s in schema["oneOf"]), F.lit(0)) != 1)
        is_, text, out = look["kind"], F.try_variant_get(v, "$", "string"), []
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            out.append(here(~is_.isin(*names, *(["integer"] if "number" in names else []))))
        for values in ([schema["const"]] if "const" in schema else None, schema.get("enum")):
            if values and all(isinstance(x, str) for x in values):  # texts are compared as they are
                out.append(here(~((is_ == "string") & text.isin(*values))))
            elif values is not None:
                out.append(here(~F.to_json(v).isin(*[_literal(x) for x in values])))
        if "minLength" in schema:
            out.append(here((is_ == "string") & (F.length(text) < schema["minLength"])))
        if "minimum" in schema:
            out.append(here(is_.isin("integer", "number") & (F.try_variant_get(v, "$", "double") < float(schema["minimum"]))))
        if schema.get("format") == "date-time":
            day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
            out.append(here((is_ == "string") & ~(text.rlike(DATE_TIME) & day.isNotNull())))
        if {"properties", "required"} & set(schema) or schema.get("additionalProperties") is False:
            out.append(F.when(is_ == "object", self._object(schema, look["fields"], path, base, depth)).otherwise(F.expr(_NONE)))
        if {"items", "minItems", "uniqueItems"} & set(schema):
            out.append(F.when(is_ == "array", self._array(schema, look["items"], path, base, depth)).otherwise(F.expr(_NONE)))
        out += [inner(s) for s in schema.get("allOf", ())]
        if "if" in schema and "then" in schema:
            out.append(F.when(fits(schema["if"]), inner(schema["then"])).otherwise(F.expr(_NONE)))
        if "anyOf" in schema:
            any_ = F.lit(False)
            for s in schema["anyOf"]:
                any_ = any_ | fits(s)
            out.append(here(~any_))
        return F.concat(*out) if out else F.expr(_NONE)

    def _object(self, schema: Mapping[str, Any], fields: Column, path: Column, base: str, depth: int) -> Column:
        at = lambda n: F.concat(path, F.lit(f".{n}"))
        has = lambda n: F.map_contains_key(fields, F.lit(n))
        out = [F.when(~has(n), F.array(at(n))).otherwise(F.expr(_NONE)) for n in schema.get("required", ())]
        known = schema.get("properties", {})
        out += [F.when(has(n), self.find(s, fields[n], at(n), base, depth)).otherwise(F.expr(_NONE)) for n, s in known.items()]
        if schema.get("additionalProperties") is False:
            extra = F.filter(F.map_keys(fields), lambda k: ~k.isin(*known)) if known else F.map_keys(fields)
            out.append(F.transform(extra, lambda k: F.concat(path, F.lit("."), k)))
        return F.concat(*out) if out else F.expr(_NONE)

    def _array(self, schema: Mapping[str, Any], items: Column, path: Column, base: str, depth: int) -> Column:
        here = lambda bad: F.when(bad, F.array(path)).otherwise(F.expr(_NONE))
        out = []
        if "minItems" in schema:
            out.append(here(F.size(items) < schema["minItems"]))
        if schema.get("uniqueItems"):
            out.append(here(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items)))
        if "items" in schema:
            each = F.transform(items, lambda x, i: self.find(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), base, depth))
            out.append(F.flatten(each))
        return F.concat(*out)


def violations(text: Column, schema: Mapping[str, Any], files: Mapping[str, Mapping] | None = None) -> Column:
    """Sorted distinct paths at which a JSON text breaks the schema, `$` being the document; a text
    that is null or not JSON breaks it at `$`. files: the schemas that $ref may name."""
    compiler = _Compiler(files or {})
    found = lambda v: F.array_sort(F.array_distinct(compiler.find(schema, v, F.lit("$"))))
    return _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.array(F.lit("$"))).otherwise(found(v)))
