"""JSON schemas: made strict for providers that enforce them, and compiled to expressions that judge JSON rows.

A schema is a tree known when the plan is made; its check is one expression over the parsed row (a variant), so that rows are judged where they
lie, without Python and without a shuffle, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords that strict endpoints may reject, and properties that aren't asked for.
LOOSE = ("minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minItems", "maxItems", "uniqueItems", "format", "default")
OMITTED = ("schema_version",)

#: Keywords that name schemas, hold a list of schemas, or hold one.
_NAMED, _LISTED, _SINGLE = ("properties", "$defs"), ("anyOf",), ("items", "additionalProperties")
_SILENT = ("title", "description", "default", "format", "examples", "$defs", "$schema", "$id")
_PROBLEMS = "array<struct<path:string,problem:string>>"


def strict(schema: dict[str, Any], omit: Sequence[str] = OMITTED) -> dict[str, Any]:
    """A new schema without loose keywords, in which objects with properties require all of them and allow no others; `omit` leaves root properties out.

    Only keywords go: a property that happens to be called like one stays.
    """
    if isinstance(schema.get("properties"), dict):
        schema = {**schema, "properties": {name: sub for name, sub in schema["properties"].items() if name not in omit}}

    def remade(node: Any) -> Any:
        if isinstance(node, list):
            return [remade(x) for x in node]
        if not isinstance(node, dict):
            return node
        made = {key: {name: remade(sub) for name, sub in value.items()} if key in _NAMED and isinstance(value, dict) else value if key in ("enum", "const") else remade(value) for key, value in node.items() if key not in LOOSE}
        if made.get("type") == "object" and "properties" in made:
            made |= {"additionalProperties": False, "required": list(made["properties"])}
        return made

    return remade(schema)


def constants(schema: Any, path: str = "") -> list[str]:
    """Paths of the nodes that hold a `const`, which a provider may not enforce; the root's is <root>."""

    def walk(node: Any, at: str) -> Iterator[str]:
        if isinstance(node, dict):
            if "const" in node:
                yield at or "<root>"
            for key, value in node.items():
                yield from walk(value, f"{at}.{key}" if at else key)
        elif isinstance(node, list):
            for k, value in enumerate(node):
                yield from walk(value, f"{at}[{k}]")

    return sorted(walk(schema, path))


def _kind(v: Column) -> Column:
    """The JSON type of a variant; numbers without a fraction are integers, however they are written."""
    s = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when((s == "BIGINT") | s.endswith(",0)"), "integer").when((s == "DOUBLE") & (number == F.rint(number)) & (F.abs(number) < float("inf")), "integer").otherwise("number")
    )


def _equal(v: Column, kind: Column, value: Any) -> Column:
    """Whether a variant is a given scalar."""
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return (kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, str):
        return (kind == "string") & (F.try_variant_get(v, "$", "string") == value)
    if isinstance(value, (int, float)):
        return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(value))
    raise ValueError("constants and choices have to be scalars")


class _Judge:
    """Makes the expression of a schema's nodes; references are put in place, so they can't be circular."""

    def __init__(self, root: dict[str, Any]):
        self.root, self.open = root, []

    def __call__(self, v: Column, schema: Any, path: Column) -> Column:
        """The problems of a value that is there, as an array."""
        none = F.array().cast(_PROBLEMS)
        if schema is True or schema == {}:
            return none
        if schema is False:
            return self.one(F.lit(True), path, "not allowed")
        if "$ref" in schema:
            name = schema["$ref"]
            if not name.startswith("#/$defs/") or name in self.open:
                raise ValueError(f"reference {name} can't be put in place")
            self.open.append(name)
            found = self(v, self.root["$defs"][name.removeprefix("#/$defs/")], path)
            self.open.pop()
            rest = {k: x for k, x in schema.items() if k != "$ref"}
            return F.concat(found, self(v, rest, path)) if rest else found
        kind, parts = _kind(v), []
        number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        fields, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
        numeric, stringy, listed, keyed = kind.isin("integer", "number"), kind == "string", kind == "array", kind == "object"
        limits = {
            "minimum": lambda x: numeric & (number < x), "maximum": lambda x: numeric & (number > x), "exclusiveMinimum": lambda x: numeric & (number <= x), "exclusiveMaximum": lambda x: numeric & (number >= x),
            "minLength": lambda x: stringy & (F.length(text) < x), "maxLength": lambda x: stringy & (F.length(text) > x), "pattern": lambda x: stringy & ~text.rlike(x), "minItems": lambda x: listed & (F.size(items) < x), "maxItems": lambda x: listed & (F.size(items) > x),
        }
        for key, value in schema.items():
            if key == "type":
                kinds = [value] if isinstance(value, str) else value
                parts.append(self.one(~kind.isin(*kinds, *(["integer"] if "number" in kinds else [])), path, key))
            elif key in ("enum", "const"):
                among = F.lit(False)
                for x in value if key == "enum" else [value]:
                    among = among | F.coalesce(_equal(v, kind, x), F.lit(False))
                parts.append(self.one(~among, path, key))
            elif key in limits:
                parts.append(self.one(limits[key](value), path, key))
            elif key == "required":
                parts += [self.one(keyed & ~F.map_contains_key(fields, name), self.under(path, name), key) for name in value]
            elif key == "properties":
                for name, sub in value.items():
                    field = F.try_element_at(fields, F.lit(name))
                    parts.append(F.when(keyed & F.map_contains_key(fields, name), self(field, sub, self.under(path, name))))
            elif key == "additionalProperties":
                known = [F.lit(name) for name in schema.get("properties", {})]
                others = F.array_sort(F.array_except(F.map_keys(fields), F.array(*known).cast("array<string>")))
                parts.append(F.when(keyed, F.flatten(F.transform(others, lambda name: self(F.try_element_at(fields, name), value, F.concat(path, F.lit("."), name))))))
            elif key == "items":
                parts.append(F.when(listed, F.flatten(F.transform(items, lambda x, k: self(x, value, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")))))))
            elif key == "anyOf":
                fits = F.lit(False)
                for sub in value:
                    fits = fits | (F.size(self(v, sub, path)) == 0)
                parts.append(self.one(~fits, path, key))
            elif key not in _SILENT:
                raise ValueError(f"the keyword {key} isn't known")
        return F.concat(*[F.coalesce(p, none) for p in parts]) if parts else none

    @staticmethod
    def one(broken: Column, path: Column, problem: str) -> Column:
        return F.when(broken, F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem")))).otherwise(F.array()).cast(_PROBLEMS)

    @staticmethod
    def under(path: Column, name: str) -> Column:
        return F.concat(path, F.lit(f".{name}"))


def problems(json: Column, schema: dict[str, Any]) -> Column:
    """What a JSON text breaks of a schema: an array of (path, problem), empty if nothing. The problem is the keyword's name, or "not JSON" (null too).

    Known are type, properties, required, additionalProperties, items, enum and const of scalars, anyOf, limits of numbers, lengths and sizes, pattern,
    and references to $defs that aren't circular; other keywords than descriptive ones are an error, so that no rule is passed over in silence.
    A limit says nothing of values of other types. Order: as the schema has its keywords, additional properties by name, items by place.
    """
    v = F.try_parse_json(json)
    return F.when(v.isNull(), _Judge.one(F.lit(True), F.lit("$"), "not JSON")).otherwise(_Judge(schema)(v, schema, F.lit("$")))


def row_problems(rows: DataFrame, json: str, schema: dict[str, Any], keys: list[str]) -> DataFrame:
    """(keys, path, problem) of each problem of each row; sound rows give none."""
    return rows.select(*keys, F.explode(problems(F.col(json), schema)).alias("_p")).select(*keys, "_p.path", "_p.problem")
