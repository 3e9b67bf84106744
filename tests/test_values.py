import json

import pytest
from pyspark.sql import functions as F

from casetrail.functions import text, values as V


def check(spark, fn, context, name, op_args):
    df = spark.createDataFrame([(json.dumps(context),)], "c string")
    return df.select(fn(V.as_object(F.col("c")), name, *op_args).alias("x")).first()["x"]


RULES = [
    (12000, "gt", 10000, True), (5000, "gt", 10000, False), ("12000", "gt", 10000, True), ("abc", "gt", 1, False),
    ("false", "eq", True, True), ("0", "eq", True, False), ("", "eq", False, True), (1, "eq", "1.0", True), ("1", "eq", "01", True),
    ("a", "eq", "A", False), (0, "eq", "a", False), (5, "neq", 6, True), (1, "in", ["1"], False), (1, "in", [1, 2], True), ("x", "in", ["x"], True),
    ("x", "exists", True, True), (None, "exists", False, True), (None, "neq", 1, False), ([], "eq", False, True),
]


def test_rule_conditions(spark):
    rows = [(json.dumps({"f": a}),) for a, *_ in RULES]
    df = spark.createDataFrame(rows, "c string")
    for (actual, op, expected, want), r in zip(RULES, df.collect()):
        got = spark.createDataFrame([tuple(r)], "c string").select(V.rule_condition(V.as_object(F.col("c")), "f", op, expected)).first()[0]
        assert got is want, (actual, op, expected)


@pytest.mark.parametrize(
    "actual,expected,want",
    [("false", False, True), ("true", 1, True), (0, False, True), (2, True, False), ("yes", True, False), ("1", "true", True), (5.0, "5", True), ("a", "a", True), (None, None, True), (None, "x", False), ([1], [1], True)],
)
def test_loose_equal(spark, actual, expected, want):
    df = spark.createDataFrame([(json.dumps({"f": actual}),)], "c string")
    assert df.select(V.loose_equal(V.field(V.as_object(F.col("c")), "f"), expected)).first()[0] is want


def test_event_time_and_steps(spark):
    df = spark.createDataFrame([("2024-07-01 12:00:00",), ("2024-07-01T12:00:00 02:00",), ("2024-07-01T10:00:00Z",), ("soon",)], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(text.parse_event_time(F.col("t")))).collect()]
    assert got == [1719828000, 1719828000, 1719828000, None]
    s = spark.createDataFrame([("  Prüfung \t der  GRÖSSE ß ",)], "s string").select(text.normalize_step(F.col("s"))).first()[0]
    assert s == "pruefung der groesse ss"
