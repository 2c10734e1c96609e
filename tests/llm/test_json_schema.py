import json

import pytest

from plumage.llm import json_schema as S
from plumage.llm.chat_tools import canonical


def errors(value, **schema):
    return S.violations(value, S.load(json.dumps(schema)), canonical)


@pytest.mark.parametrize(("schema", "good", "bad"), [
    ({"const": 1}, [1, 1.0], [True, 2, "1"]),
    ({"enum": [1, "x", None]}, [1, "x", None], [True, "y"]),
    ({"pattern": "^a.c$"}, ["abc", 5], ["ab", "xabc"]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "abc", 1], ["a", "abcd"]),
    ({"minimum": 1, "exclusiveMaximum": 3}, [1, 2.5, "9"], [0, 3]),
    ({"exclusiveMinimum": 1, "maximum": 3}, [1.01, 3], [1, 3.01]),
    ({"multipleOf": 0.1}, [0.3, 1, 0], [0.35]),
    ({"type": ["integer", "null"]}, [1, 2.0, None], [1.5, "1", True]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 5], [4]),
    ({"oneOf": [{"minimum": 2}, {"maximum": 4}]}, [1, 5], [3]),
    ({"allOf": [{"minimum": 2}, {"maximum": 4}]}, [2, 3], [1, 5]),
    ({"not": {"type": "object"}}, [1, []], [{}]),
    ({"items": {"type": "integer"}, "minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, 2]], [[], [1, 1], ["a"], [1, 2, 3]]),
    ({"prefixItems": [{"type": "string"}], "items": False}, [["a"], []], [[1], ["a", 1]]),
    ({"contains": {"const": 3}}, [[1, 3], "x"], [[1]]),
    ({"properties": {"a": True, "b": False}}, [{"a": 1}, {}], [{"b": 1}]),
    ({"required": ["a"], "additionalProperties": False, "properties": {"a": {}}}, [{"a": 1}], [{}, {"a": 1, "b": 2}]),
    ({"additionalProperties": {"type": "string"}}, [{"a": "x"}], [{"a": 1}]),
    ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, [{"x1": 1}], [{"x1": "a"}, {"y": 1}]),
    ({"propertyNames": {"maxLength": 1}, "minProperties": 1, "maxProperties": 2}, [{"a": 1}], [{}, {"ab": 1}, {"a": 1, "b": 1, "c": 1}]),
    ({"$defs": {"t": {"type": "object", "properties": {"next": {"$ref": "#/$defs/t"}}, "additionalProperties": False}}, "$ref": "#/$defs/t"}, [{}, {"next": {"next": {}}}], [{"next": {"other": 1}}, 1]),
    ({"$ref": "#/definitions/a~1b", "definitions": {"a/b": {"type": "null"}}}, [None], [1]),
])
def test_keywords(schema, good, bad):
    for value in good:
        assert errors(value, **schema) == [], value
    for value in bad:
        assert errors(value, **schema), value


@pytest.mark.parametrize("schema", [
    {"type": "any"}, {"type": []}, {"unevaluatedProperties": False}, {"properties": {"a": {"dependentRequired": {}}}}, {"pattern": "("}, {"minimum": "1"}, {"multipleOf": 0}, {"anyOf": []}, {"items": 5},
    {"$ref": "http://other"}, {"$ref": "#/none"}, {"$ref": "#"}, {"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}}, {"required": "a"}, {"enum": 1}, {"properties": []}, [], 1, {"minLength": True},
])
def test_what_cannot_be_applied_is_refused(schema):
    with pytest.raises(ValueError):
        S.load(json.dumps(schema))


def test_booleans_and_places():
    assert S.violations(1, True, canonical) == [] and S.violations(1, False, canonical) == ["$: never"]
    assert errors({"a": [1, "x"], "b": {}}, properties={"a": {"items": {"type": "integer"}}, "b": {"required": ["c"]}}) == ["$.a[1]: type", "$.b.c: required"]


def test_schemas_in_a_run(spark):
    from plumage.llm import chat_tools as C

    calls = spark.createDataFrame([(1, 0, 0, "i", "t", '{"a": 5}', []), (1, 1, 0, "j", "loop", "1", []), (1, 2, 0, "k", "none", "1", [])], "conv_id long, turn long, index int, id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, index int, id string, content string")
    schemas = {"t": json.dumps({"properties": {"a": {"exclusiveMinimum": 5}}}), "loop": json.dumps({"anyOf": [{"$ref": "#"}, {}]})}
    got = {r.id: list(r.errors) for r in C.formatted(calls, results, schemas).collect()}
    assert got == {"i": ["$.a: exclusiveMinimum"], "j": ["$: schema without end"], "k": ["tool: unknown"]}
    with pytest.raises(ValueError, match="type"):
        C.formatted(calls, results, {"t": '{"type": "any"}'})
