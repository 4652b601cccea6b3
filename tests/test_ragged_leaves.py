"""Leaves of nested values: numbers, truth values, texts, nulls and objects at any depth."""

import json

import pytest
from pyspark.sql import functions as F

from cellweave.sources import records as L

NUMBERS = [
    ("[1, true, 2, \"3\", [4, null, -5e-1]]", [1, 1, 2, 4, -0.5]), ("[1, null, \"3\", \"x\", true]", [1, None, 3, None, None]), ("[1, null, true, false]", [1, None, 1, 0]),
    ("[[1, 2], [3, [4, [5, {\"a\": 6}, [[7]]]]]]", [1, 2, 3, 4, 5, 7]), ("{\"a\": [1, 2]}", []), ("[{\"a\": 1}, 2]", [2]), ("null", []), ("7", [7]), ("\" 8.5 \"", [8.5]), ("true", [1]), ("[]", []), ("[[], [[]]]", []), ("\"x\"", [None]),
    ("[12345678901234567890, 1e300, 0.1]", [12345678901234567890.0, 1e300, 0.1]), ("[" * 40 + "9" + "]" * 40, [9]),
]
TEXTS = [("[\"A b \", [\" C\", null, {\"x\": \"y\"}], 5, true, 2.50]", ["a b", "c", "5", "true", "2.5"]), ("\"Say \\\"Hi\\\"\\u00e9\"", ["say \"hi\"é"]), ("null", []), ("[]", []), ("{\"a\": \"b\"}", [])]


def made(spark, cases, of):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").withColumn("v", F.parse_json("t"))
    return [r[0] for r in rows.orderBy("i").select(of(F.col("v"))).collect()]


def test_numbers(spark):
    assert made(spark, NUMBERS, L.numeric_leaves) == [w for _, w in NUMBERS]


def test_texts(spark):
    assert made(spark, TEXTS, L.string_leaves) == [w for _, w in TEXTS]


def test_missing_field_and_depth(spark):
    row = spark.range(1).select(F.parse_json(F.lit('{"a": 1}')).alias("v")).select(L.numeric_leaves(F.variant_get("v", "$.b", "variant")), L.string_leaves(F.variant_get("v", "$.b", "variant"))).first()
    assert row[0] is None and row[1] is None
    deep = "[" * 90 + "1" + "]" * 90
    assert json.loads(deep)
    with pytest.raises(Exception, match="too deeply"):
        spark.range(1).select(L.numeric_leaves(F.parse_json(F.lit(deep)))).collect()
