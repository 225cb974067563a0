"""Compiled schemas against documents and the paths that are wrong in them."""

import json

import pytest
from pyspark.sql import functions as F

from cairnlake.functions.schema import SchemaError, violations
from cairnlake.plans.envelopes import ENVELOPE, FILES

SCHEMA = {
    "type": "object",
    "required": ["n"],
    "properties": {
        "n": {"type": ["integer", "null"], "minimum": 2},
        "x": {"type": "number", "minimum": 0.5},
        "list": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"anyOf": [{"type": "string", "minLength": 2}, {"$ref": "sub/one.json"}]}},
        "at": {"type": "string", "format": "date-time"},
        "pick": {"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 10}, {"const": {"a": [1, "é"]}}]},
    },
    "if": {"properties": {"n": {"const": 5}}, "required": ["n"]},
    "then": {"required": ["x"]},
    "additionalProperties": False,
}
PARTS = {"sub/one.json": {"type": "object", "properties": {"k": {"$ref": "two.json"}}, "required": ["k"]}, "sub/two.json": {"enum": [None, 1, "one", True]}}
CASES = [
    (None, ["$"]), ("", ["$"]), ("{", ["$"]), ("[]", ["$"]), ("{}", ["$.n"]),
    ({"n": 2}, []), ({"n": None}, []), ({"n": 1}, ["$.n"]), ('{"n": 2.0}', ["$.n"]), ('{"n": 123456789012345678901234}', []), ({"n": "2"}, ["$.n"]), ({"n": 5}, ["$.x"]), ({"n": 5, "x": 0}, ["$.x"]), ({"n": 5, "x": 1}, []),
    ({"n": 2, "z": {}, "y": 1}, ["$.y", "$.z"]), ({"n": 2, "list": []}, ["$.list"]), ({"n": 2, "list": ["ab", "a", {"k": 1}, {"k": 2}, {"k": None}, {"j": 1}, True]}, ["$.list[1]", "$.list[3]", "$.list[5]", "$.list[6]"]),
    ('{"n":2,"list":[{"k":1,"j":2},{"j":2,"k":1}]}', ["$.list"]), ({"n": 2, "list": ["éa", "ab"]}, []),
    ({"n": 2, "at": "2024-02-29T23:59Z"}, []), ({"n": 2, "at": "2023-02-29T00:00:00Z"}, ["$.at"]), ({"n": 2, "at": "2024-01-01T24:00:00Z"}, ["$.at"]), ({"n": 2, "at": "2024-01-01 00:00:00Z"}, ["$.at"]), ({"n": 2, "at": "2024-01-01t00:00:00.123456789+01:30"}, []),
    ({"n": 2, "pick": 3}, []), ({"n": 2, "pick": 12}, ["$.pick"]), ({"n": 2, "pick": 10.5}, []), ({"n": 2, "pick": {"a": [1, "é"]}}, []), ({"n": 2, "pick": {"a": ["é", 1]}}, ["$.pick"]),
]


def test_paths(spark):
    texts = [t if t is None or isinstance(t, str) else json.dumps(t, ensure_ascii=False) for t, _ in CASES]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r.i: r.found for r in df.select("i", violations(F.col("t"), SCHEMA, PARTS).alias("found")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_schemas_that_cannot_be_used():
    text = F.lit("{}")
    for schema in ({"pattern": "a"}, {"$ref": "none"}, {"properties": {"a": {"not": {}}}}):
        with pytest.raises(SchemaError):
            violations(text, schema)
    with pytest.raises(SchemaError):
        violations(text, {"$ref": "a"}, {"a": {"$ref": "a"}})
    violations(text, ENVELOPE, FILES)


def test_schemas_of_one_value_share_its_look(spark):
    one, more = (str(violations(F.lit("1"), {"allOf": [{"type": "string"}] * n})) for n in (1, 3))
    assert one.count("schema_of_variant") == more.count("schema_of_variant") > 0
