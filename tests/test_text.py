import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions import text as X


def test_py_str_matches_python(spark):
    values = [0.0, -0.0, 1.5, 23.0, 1e7, 12345678.5, 1e15, 1e16, 1.5e300, 1e-3, 1e-4, 1.25e-4, 1e-5, -2.5e-7,
              123456789012345.0, float("nan"), float("inf"), 0.1, 1e22, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(X.py_str(F.col("v"), T.DoubleType())).collect()]
    assert got == [str(v) for v in values]


def test_py_str_booleans_and_null(one):
    row = one(
        X.py_str(F.lit(True), T.BooleanType()),
        X.py_str(F.lit(None).cast("boolean"), T.BooleanType()),
        X.py_str(F.lit(5), T.IntegerType()),
    )
    assert list(row) == ["True", "None", "5"]


def test_strip_is_unicode_aware(spark):
    samples = ["　a b　", "\x1c\x85x ", "\n\t", " ﻿q ", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(X.strip(F.col("s"))).collect()] == [s.strip() for s in samples]


@pytest.mark.parametrize(
    "value,expected",
    [(3.0, "3"), (-3.0, "-3"), (2.5, "2.5"), (0.125, "0.125"), (1 / 3, "0.333333"), (1e-9, "0"),
     (100.10, "100.1"), (0.0, "0")],
)
def test_numeric_text(one, value, expected):
    assert one(X.numeric_text(F.lit(value)))[0] == expected


@pytest.mark.parametrize(
    "answer,declared,expected",
    [("so #### 1,234", None, "1234"), ("first 3, then 4.50", None, "4.5"), ("#### -7.25 of 9", None, "-7.25"),
     ("nothing", 12.0, "12"), ("答えは１２", None, "12"), ("7", "1,000", "1000")],
)
def test_answer_number(one, answer, declared, expected):
    column = None if declared is None else F.lit(declared)
    assert one(X.answer_number(F.lit(answer), column))[0] == expected


def test_answer_number_missing(one):
    with pytest.raises(Exception, match="numeric answer is missing"):
        one(X.answer_number(F.lit("none here")))


@pytest.mark.parametrize(
    "value,options,expected",
    [("b", "wxyz", 1), (" C ", "wxyz", 2), ("1", "xy", 0), ("2", "xy", 1), ("0", "xy", 0), ("４", "wxyz", 3),
     ("y", "xy", 1), ("zz", ["aa", "zz"], 1)],
)
def test_answer_index(one, value, options, expected):
    array = F.array(*[F.lit(o) for o in options])
    assert one(X.answer_index(F.lit(value), T.StringType(), array))[0] == expected


def test_answer_index_typed_and_unknown(one):
    two = F.array(F.lit("x"), F.lit("y"))
    assert one(X.answer_index(F.lit(1), T.IntegerType(), two))[0] == 1
    assert one(X.answer_index(F.lit(True), T.BooleanType(), two))[0] == 1
    with pytest.raises(Exception, match="cannot map answer"):
        one(X.answer_index(F.lit("q!"), T.StringType(), two))


def test_template(spark):
    df = spark.createDataFrame([("a", None, 2.0)], "s string, `x.y` string, n double")
    assert df.select(X.fill_template(df, "{s}: {n}")).first()[0] == "a: 2.0"
    with pytest.raises(KeyError):
        X.fill_template(df, "{missing}")


def test_value_text(one):
    row = one(
        X.value_text(F.lit(None).cast("string"), T.StringType()),
        X.value_text(F.lit(True), T.BooleanType()),
        X.value_text(F.lit(1.0), T.DoubleType()),
        X.value_text(F.array(F.lit("a")), T.ArrayType(T.StringType())),
    )
    assert list(row) == ["", "true", "1.0", '["a"]']
