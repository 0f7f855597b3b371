import pytest

from rillstone.functions.shapes import errors

SCHEMA = {
    "$defs": {"id": {"type": "string", "minLength": 1, "pattern": "^[a-z]+$"}}, "type": "object", "required": ["id", "n"], "additionalProperties": False,
    "properties": {"id": {"$ref": "#/$defs/id"}, "n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "uniqueItems": True, "items": {"enum": ["a", 1]}}, "kind": {"const": True}, "x": {"anyOf": [{"type": "null"}, {"type": "number", "maximum": 2}]}, "m": {"type": "object", "propertyNames": {"pattern": "^k"}}},
    "if": {"properties": {"n": {"const": 5}}}, "then": {"required": ["tags"]}, "else": {"not": {"required": ["never"]}},
}


@pytest.mark.parametrize(
    "value,want",
    [
        ({"id": "a", "n": 1}, []), ({"id": "a\n", "n": 1}, ["$.id: pattern"]), ({"id": "", "n": True}, ["$.id: minLength", "$.id: pattern", "$.n: type"]), ({"n": 1.0}, ["$.id: required", "$.n: type"]), ({"id": "a", "n": 5}, ["$.tags: required"]),
        ({"id": "a", "n": 1, "tags": ["a", 1, 1.0]}, ["$.tags[2]: enum"]), ({"id": "a", "n": 1, "tags": ["a", "a"]}, ["$.tags: uniqueItems"]), ({"id": "a", "n": 1, "kind": 1}, ["$.kind: const"]), ({"id": "a", "n": 1, "x": 3}, ["$.x: anyOf"]),
        ({"id": "a", "n": 1, "y": 1}, ["$.y: false"]), ({"id": "a", "n": 1, "m": {"z": 1}}, ["$.m.z: pattern"]), ([], ["$: type"]), ({"id": "a", "n": 0}, ["$.n: minimum"]),
    ],
)
def test_rules(value, want):
    assert sorted(errors(value, SCHEMA)) == sorted(want)


def test_extensions():
    assert errors([{"id": 1}, {"id": 1}], {"x-uniqueBy": "id"}) == ["$: x-uniqueBy"]
    assert errors({"a": [1], "b": {"c": [1, 2]}}, {"x-equalCardinality": ["a", "b.c"]}) == ["$: x-equalCardinality"]
    rule = {"x-derivationCardinality": {"items": "a", "field": "d", "one": "ONE", "many": "MANY"}}
    assert errors({"a": [1], "d": "ONE"}, rule) == [] and errors({"a": [1, 2], "d": "ONE"}, rule) != []
