"""Validation of tool arguments by JSON schema: known keywords are applied, others are refused when a schema is loaded."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from fractions import Fraction

KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == int(v),
}

#: Keywords that say nothing about what is valid.
NOTES = frozenset("$schema $id $comment $defs definitions title description default examples format deprecated readOnly writeOnly".split())
#: Keywords by the kind of their value: numbers, schemas, lists and maps of schemas.
COUNTS = frozenset("minLength maxLength minItems maxItems minProperties maxProperties".split())
BOUNDS = frozenset("minimum maximum exclusiveMinimum exclusiveMaximum multipleOf".split())
SCHEMAS = frozenset("items additionalProperties propertyNames not contains".split())
LISTS = frozenset("anyOf oneOf allOf prefixItems".split())
MAPS = frozenset("properties patternProperties $defs definitions".split())
OTHERS = frozenset("type enum const required pattern uniqueItems $ref".split())


def load(text: str) -> dict | bool:
    """A schema from JSON; ValueError if it isn't one or has keywords that :func:`violations` doesn't apply."""
    schema = json.loads(text)
    _check(schema, schema, "$")
    return schema


def _check(schema, root, at: str) -> None:
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object or a boolean")
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    for key, value in schema.items():
        here, fits = f"{at}.{key}", True
        if key in SCHEMAS:
            _check(value, root, here)
        elif key in LISTS:
            fits = isinstance(value, list) and (bool(value) or key == "prefixItems")
            for i, s in enumerate(value if fits else []):
                _check(s, root, f"{here}[{i}]")
        elif key in MAPS:
            fits = isinstance(value, dict)
            for k, s in value.items() if fits else []:
                _check(s, root, f"{here}.{k}")
                if key == "patternProperties":
                    _pattern(k, here)
        elif key in COUNTS:
            fits = number(value) and value >= 0
        elif key in BOUNDS:
            fits = number(value) and (key != "multipleOf" or value > 0)
        elif key == "type":
            kinds = [value] if isinstance(value, str) else value
            fits = isinstance(kinds, list) and bool(kinds) and all(isinstance(k, str) and k in KINDS for k in kinds)
        elif key == "enum":
            fits = isinstance(value, list)
        elif key == "required":
            fits = isinstance(value, list) and all(isinstance(k, str) for k in value)
        elif key == "uniqueItems":
            fits = isinstance(value, bool)
        elif key == "pattern":
            _pattern(value, here)
        elif key == "$ref":
            seen, target = set(), schema
            while isinstance(target, dict) and "$ref" in target:  # a reference to itself validates nothing
                if target["$ref"] in seen:
                    raise ValueError(f"{here}: refers to itself")
                seen.add(target["$ref"])
                target = _referred(root, target["$ref"], here)
        elif key not in NOTES and key != "const":
            raise ValueError(f"{here}: unknown keyword")
        if not fits:
            raise ValueError(f"{here}: not a value for it")


def _pattern(value, at: str) -> None:
    try:
        re.compile(value)
    except (re.error, TypeError) as e:
        raise ValueError(f"{at}: no pattern") from e


def _referred(root, ref, at: str = "$"):
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        raise ValueError(f"{at}: only references inside the schema are known")
    target = root
    for part in ref.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(target, dict) and part in target:
            target = target[part]
        elif isinstance(target, list) and part.isdigit() and int(part) < len(target):
            target = target[int(part)]
        else:
            raise ValueError(f"{at}: refers to nothing")
    if not isinstance(target, dict | bool):
        raise ValueError(f"{at}: refers to no schema")
    return target


def _is_multiple(value, step) -> bool:
    return Fraction(str(value)) % Fraction(str(step)) == 0


def violations(value, schema: dict | bool, canonical: Callable[[object], str], root=None, at: str = "$") -> list[str]:
    """Where a value breaks a loaded schema, each as a place and a keyword.

    ``canonical`` writes a value as text; values are equal where the texts are, so true
    is not 1. Objects, arrays and what lies in them are visited in order of their keys.
    """
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: never"]
    inner = lambda v, s, where: violations(v, s, canonical, root, where)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(KINDS[k](value) for k in kinds):
        return [f"{at}: type"]
    out: list[str] = []

    def unless(fits: bool, keyword: str) -> None:
        if not fits:
            out.append(f"{at}: {keyword}")

    if "$ref" in schema:
        out += inner(value, _referred(root, schema["$ref"]), at)
    if "enum" in schema:
        unless(canonical(value) in map(canonical, schema["enum"]), "enum")
    if "const" in schema:
        unless(canonical(value) == canonical(schema["const"]), "const")
    if isinstance(value, str):
        unless(len(value) >= schema.get("minLength", 0), "minLength")
        unless(len(value) <= schema.get("maxLength", len(value)), "maxLength")
        unless("pattern" not in schema or re.search(schema["pattern"], value) is not None, "pattern")
    if KINDS["number"](value):
        unless(value >= schema.get("minimum", value), "minimum")
        unless(value <= schema.get("maximum", value), "maximum")
        unless("exclusiveMinimum" not in schema or value > schema["exclusiveMinimum"], "exclusiveMinimum")
        unless("exclusiveMaximum" not in schema or value < schema["exclusiveMaximum"], "exclusiveMaximum")
        unless("multipleOf" not in schema or _is_multiple(value, schema["multipleOf"]), "multipleOf")
    if isinstance(value, list):
        unless(len(value) >= schema.get("minItems", 0), "minItems")
        unless(len(value) <= schema.get("maxItems", len(value)), "maxItems")
        unless(not schema.get("uniqueItems") or len(set(map(canonical, value))) == len(value), "uniqueItems")
        first = schema.get("prefixItems", [])
        for i, v in enumerate(value):
            out += inner(v, first[i] if i < len(first) else schema.get("items", True), f"{at}[{i}]")
        unless("contains" not in schema or any(not inner(v, schema["contains"], at) for v in value), "contains")
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        unless(len(value) >= schema.get("minProperties", 0), "minProperties")
        unless(len(value) <= schema.get("maxProperties", len(value)), "maxProperties")
        out += [f"{at}.{k}: required" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            here = f"{at}.{k}"
            matching = [s for p, s in patterns.items() if re.search(p, k)]
            if "propertyNames" in schema:
                out += inner(k, schema["propertyNames"], here)
            for s in ([known[k]] if k in known else []) + matching:
                out += inner(value[k], s, here)
            if k not in known and not matching:
                rest = schema.get("additionalProperties", True)
                out += [f"{here}: unknown"] if rest is False else inner(value[k], rest, here)
    for s in schema.get("allOf", []):
        out += inner(value, s, at)
    if "anyOf" in schema:
        unless(any(not inner(value, s, at) for s in schema["anyOf"]), "anyOf")
    if "oneOf" in schema:
        unless(sum(not inner(value, s, at) for s in schema["oneOf"]) == 1, "oneOf")
    if "not" in schema:
        unless(bool(inner(value, schema["not"], at)), "not")
    return out
