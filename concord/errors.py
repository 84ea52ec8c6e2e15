"""The one error shape every validator returns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The error vocabulary.
VALUE_MISMATCH = "VALUE_MISMATCH"
ROW_MISSING = "ROW_MISSING"
COLUMN_MISSING = "COLUMN_MISSING"
DATA_MISSING = "DATA_MISSING"
DEFECT_VIOLATION = "DEFECT_VIOLATION"
TRANSFORM_ERROR = "TRANSFORM_ERROR"
MISSING_TYPES = [ROW_MISSING, COLUMN_MISSING, DATA_MISSING]
STRUCTURAL_TYPES = [COLUMN_MISSING, DATA_MISSING, TRANSFORM_ERROR]

_TEXT_FIELDS = [
    "error_type", "group_key", "row_id", "old_column", "new_column",
    "old_value", "new_value", "def_id", "message",
]
FIELDS = ["rule", "source_table", "target_table", *_TEXT_FIELDS, "report_fields"]
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in FIELDS[:-1]]
    + [T.StructField("report_fields", T.MapType(T.StringType(), T.StringType()))]
)
_EMPTY_MAP = "map<string,string>"


def error(error_type: str, report_fields: Column | None = None, **fields) -> Column:
    """Error struct; fields are columns or literals, the rest is null."""
    unknown = set(fields) - set(_TEXT_FIELDS)
    if unknown:
        raise TypeError(f"no such error field: {sorted(unknown)}")
    values = {"error_type": error_type, **fields}
    parts = []
    for name in _TEXT_FIELDS:
        value = values.get(name)
        parts.append((value if isinstance(value, Column) else F.lit(value)).cast("string").alias(name))
    report = F.lit(None) if report_fields is None else report_fields
    return F.struct(*parts, report.cast(_EMPTY_MAP).alias("report_fields"))


# A check is a test and the error to report where it holds.
Check = tuple[Column, Column]


def any_holds(checks: Sequence[Check]) -> Column:
    """Whether any test holds; an undecided one does not."""
    return reduce(lambda a, b: a | b, [F.coalesce(test, F.lit(False)) for test, _ in checks], F.lit(False))


def held(checks: Sequence[Check]) -> Column:
    """Array of the errors whose test holds.

    Pieces of zero or one error are concatenated, which stays in generated code; filtering nulls out of an
    array would evaluate every test in the interpreter.
    """
    pieces = [F.when(test, F.array(made)).otherwise(F.array()) for test, made in checks]
    return F.concat(*pieces) if pieces else F.array()


def explode_errors(df: DataFrame, errors: str, *carry: str) -> DataFrame:
    return df.select(*carry, F.explode(errors).alias("e")).select(*carry, "e.*")


def labelled(errors: DataFrame, rule: str, source: str, target: str) -> DataFrame:
    """Errors in the order of the detail log, with the rule and the two table names."""
    return (
        errors.withColumn("rule", F.lit(rule))
        .withColumn("source_table", F.lit(source))
        .withColumn("target_table", F.lit(target))
        .select(*FIELDS)
    )


def fixed_errors(spark: SparkSession, rows: list[dict], rule: str, source: str, target: str) -> DataFrame:
    """Errors known before any row is read, such as missing columns."""
    full = [
        tuple({"rule": rule, "source_table": source, "target_table": target, **r}.get(n) for n in FIELDS)
        for r in rows
    ]
    return spark.createDataFrame(full, SCHEMA)
