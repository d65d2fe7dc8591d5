"""Schemas made strict, and rows judged by them against a plain walk."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from flowloom.operators import schemas

SCHEMA = {
    "type": "object", "title": "T", "required": ["k"], "additionalProperties": False,
    "properties": {
        "k": {"type": "integer", "minimum": 0, "exclusiveMaximum": 10}, "tags": {"type": "array", "maxItems": 3, "items": {"type": ["string", "null"], "maxLength": 3, "pattern": "^[a-z]*$"}},
        "who": {"$ref": "#/$defs/who"}, "level": {"enum": ["low", 2, None, True]}, "any": {"anyOf": [{"type": "number"}, {"const": "none"}]}, "free": {}, "pattern": {"type": "number", "default": 1},
        "more": {"type": "object", "additionalProperties": {"type": "boolean"}},
    },
    "$defs": {"who": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "minLength": 1}, "at": {"type": "array", "minItems": 1, "items": {"type": "array", "items": {"type": "number"}}}}}},
}


def plain(v, s, path="$"):
    """The same rules, step by step over one value."""
    if s is False:
        return [(path, "not allowed")]
    if "$ref" in s:
        return plain(v, SCHEMA["$defs"][s["$ref"].split("/")[-1]], path)
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "integer" if v == int(v) else "number"
    same = lambda x: type(x) is type(v) and x == v or (number and isinstance(x, (int, float)) and not isinstance(x, bool) and x == v)
    out = []
    if "type" in s:
        kinds = [s["type"]] if isinstance(s["type"], str) else s["type"]
        out += [(path, "type")] if kind not in kinds and not (kind == "integer" and "number" in kinds) else []
    tests = {
        "minimum": lambda x: number and v < x, "exclusiveMaximum": lambda x: number and v >= x, "minLength": lambda x: kind == "string" and len(v) < x, "maxLength": lambda x: kind == "string" and len(v) > x,
        "pattern": lambda x: kind == "string" and not re.search(x, v), "minItems": lambda x: kind == "array" and len(v) < x, "maxItems": lambda x: kind == "array" and len(v) > x, "const": lambda x: not same(x), "enum": lambda x: not any(map(same, x)),
        "anyOf": lambda x: all(plain(v, o, path) for o in x),
    }
    out += [(path, key) for key, test in tests.items() if key in s and test(s[key])]
    if kind == "object":
        out += [(f"{path}.{n}", "required") for n in s.get("required", []) if n not in v]
        for n, x in v.items():
            sub = s.get("properties", {}).get(n, s.get("additionalProperties", {}))
            out += plain(x, sub, f"{path}.{n}")
    if kind == "array" and "items" in s:
        for i, x in enumerate(v):
            out += plain(x, s["items"], f"{path}[{i}]")
    return out


def test_rows_are_judged_like_a_plain_walk(spark):
    rng = random.Random(5)
    leaf = lambda: rng.choice([None, True, False, 0, 3, -1, 12, 2.0, 2.5, 1e30, "", "ab", "abcd", "A1", "low", "none", "ünï"])

    def value(depth=0):
        roll = rng.random()
        if depth > 2 or roll < 0.5:
            return leaf()
        return [value(depth + 1) for _ in range(rng.randint(0, 4))] if roll < 0.75 else {rng.choice(["id", "at", "x"]): value(depth + 1) for _ in range(rng.randint(0, 3))}

    names = [*SCHEMA["properties"], "extra"]
    rows = [{n: value() for n in rng.sample(names, rng.randint(0, 6))} for _ in range(300)]
    rows += [{"k": 1}, {"k": 1, "who": {"id": "a", "at": [[1, 2.5], [3]]}}, {"k": 1, "who": {"id": "a", "at": [[1, "x"], 3]}}, {"k": 1, "more": {"b": 1, "a": True}}, {"k": 1, "tags": ["a", None, "b"]}, [], 5, None, "text"]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, j string")
    got = {i: [] for i in range(len(rows))}
    for r in schemas.row_problems(frame, "j", SCHEMA, ["i"]).collect():
        got[r.i].append((r.path, r.problem))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(plain(r, SCHEMA)) for i, r in enumerate(rows)}
    assert sum(not x for x in got.values()) >= 3 and len({p for x in got.values() for _, p in x}) > 9


def test_what_is_no_json(spark):
    frame = spark.createDataFrame([(0, None), (1, "{"), (2, ""), (3, '{"k": 1}'), (4, '{"k": 1, "k": 2}')], "i int, j string")
    got = {(r.i, r.path, r.problem) for r in schemas.row_problems(frame, "j", SCHEMA, ["i"]).collect()}
    assert {g for g in got if g[0] < 4} == {(k, "$", "not JSON") for k in range(3)}
    assert schemas.row_problems(frame.limit(0), "j", SCHEMA, ["i"]).count() == 0


def test_unknown_rules_are_errors(spark):
    for bad in ({"oneOf": []}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"enum": [[1]]}, {"$ref": "elsewhere"}):
        with pytest.raises(ValueError):
            schemas.problems(F.lit("1"), bad)


def test_strict_schemas():
    before = copy.deepcopy(SCHEMA)
    made = schemas.strict({**SCHEMA, "properties": {"schema_version": {"const": "1"}, **SCHEMA["properties"]}})
    assert SCHEMA == before and "schema_version" not in made["properties"] and made["required"] == list(SCHEMA["properties"]) and made["additionalProperties"] is False
    assert made["properties"]["k"] == {"type": "integer"} and made["properties"]["pattern"] == {"type": "number"} and made["properties"]["tags"]["items"] == {"type": ["string", "null"]}
    who = made["$defs"]["who"]
    assert who["required"] == ["id", "at"] and who["additionalProperties"] is False and who["properties"]["id"] == {"type": "string"}
    assert schemas.constants(made) == ["properties.any.anyOf[1]"] and schemas.constants({"const": 1}) == ["<root>"] and schemas.constants({"type": "object"}) == []
