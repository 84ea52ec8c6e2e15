"""Column functions on literal values, including the deliberate differences from number-prefix parsing."""

import pytest
from pyspark.sql import functions as F

from concord.functions import fingerprints, formulas, numbers, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    frame = spark.createDataFrame([tuple(values.values()) or (None,)], schema)
    return frame.select(column.alias("r")).first().r


@pytest.mark.parametrize("rule, value, wanted", [
    ("NONE", "  a ", "a"), ("NONE", "   ", None), ("NONE", None, None),
    ("STRIP_LEADING_ZEROS", "00123", "123"), ("STRIP_LEADING_ZEROS", "000", "0"), ("STRIP_LEADING_ZEROS", "", None),
    ("STRIP_SPECIAL_CHARS", "A-1/b 2", "A1b2"),
    ("DATE_TO_DATETIME", "2021-02-05T00:00:00.000+07:00", "2021-02-05"), ("DATE_TO_DATETIME", "2021-02-05 10:00", "2021-02-05"),
    ("DATE_TO_DATETIME", "5/2/2021", "2021-02-05"), ("DATE_TO_DATETIME", "15-12-2021", "2021-12-15"),
    ("DATE_TO_DATETIME", "Feb 2021", "Feb"),
    ("SPLIT_FIRST", "123450002", "12345"), ("SPLIT_SECOND", "123450002", "0002"), ("SPLIT_SECOND", "12", "12"),
    ("CONCAT", " x ", "x"),
])
def test_transforms(spark, rule, value, wanted):
    assert one(spark, text.transform(F.col("v"), rule), v=value) == wanted


@pytest.mark.parametrize("a, b, tolerance, wanted", [
    ("", None, 0, True), (" ", "", 0, True), ("a", None, 0, False), ("Abc ", "aBC", 0, True),
    ("1.00", "1", 0, True), ("1.00", "1.01", 0.01, True), ("1.00", "1.011", 0.01, False),
    ("2024-01-15", "2024-09-30", 0, False), ("12abc", "12xyz", 0, False), ("-.5", "-0.50", 0, True),
])
def test_tolerant_equality(spark, a, b, tolerance, wanted):
    assert one(spark, numbers.tolerant_equal(F.col("a"), F.col("b"), tolerance), a=a, b=b) is wanted


@pytest.mark.parametrize("value, wanted", [
    (".8", "0.8"), ("0.80", "0.8"), ("-.19", "-0.19"), ("100", "100"), ("0.000", "0"), (" x ", "x"), (" ", None), ("2024-01-15", "2024-01-15"),
])
def test_number_text(spark, value, wanted):
    assert one(spark, numbers.normal_number_text(F.col("v")), v=value) == wanted


def test_formulas(spark):
    values = [numbers.to_number(F.col(c)) for c in "abc"]
    given = {"a": "10", "b": "3", "c": "x"}
    for formula, wanted in (("SUM", "13"), ("SUBTRACT", "7"), ("EXACT", "10")):
        assert one(spark, numbers.plain(numbers.formula_of(formula, values)), **given) == wanted
    with pytest.raises(ValueError):
        numbers.formula_of("MEDIAN", values)


@pytest.mark.parametrize("value, wanted", [
    ("2024-01-15T10:00", "DATE:2024-01-15"), ("15/01/2024", "DATE:2024-01-15"), ("20240115", "DATE:2024-01-15"),
    ("$1,234.5", "NUM:1234.5000"), ("N/A", None), ("?", None), ("---", None), ("Foo-Bar 1", "TXT:foobar1"),
])
def test_comparable(spark, value, wanted):
    assert one(spark, text.comparable(F.col("v")), v=value) == wanted


def test_name_similarity(spark):
    similar = text.name_similarity(F.col("a"), F.col("b"))
    assert one(spark, similar, a="ReceiptNumber", b="receiptno") == pytest.approx(1 - 5 / 13)
    assert one(spark, similar, a="X", b="x") == 1.0


def test_fingerprint_parts(spark):
    frame = spark.createDataFrame([("2024-01-15T07:00:00", "Mon Aug 09 2021 00:00:00 GMT+0000", "2009", "10.50", None)],
                                  "a string, b string, c string, d string, e string")
    part = lambda n, y=False: fingerprints.fingerprint_part(frame, n, y)
    row = frame.select(part("a"), part("a", True), part("b"), part("b", True), part("c", True), part("d"), part("e")).first()
    assert list(row) == ["2024-01-15", "2024", "2021-08-09", "2021", "2009", "10.5", ""]


def test_row_formulas_reject_what_they_cannot_read(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, b int")
    assert formulas.row_formula(frame, "MEDIAN(a, b)") is None
    assert formulas.row_formula(frame, "DIFF(a, nope)") is None
    assert frame.select(formulas.row_formula(frame, "avg(a, b)").cast("double")).first()[0] == 1.5
