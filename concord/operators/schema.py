"""Checks on column names: they read the schema, never a row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord import errors as E
from concord.functions.text import name_similarity
from concord.rules import Mappings

# Fixed value: how alike an unmapped pair of names must be to be compared without a mapping.
FALLBACK_SIMILARITY = 0.9


def missing_columns(old: Iterable[str], new: Iterable[str], mappings: Mappings, source: str, target: str) -> list[dict]:
    """One error per mapped column that does not exist."""
    old_filter, new_filter = mappings.filter_columns()
    found = []
    for column in dict.fromkeys([*mappings.old_columns(), *old_filter]):
        if column not in set(old):
            found.append({
                "error_type": E.COLUMN_MISSING, "old_column": column,
                "message": f"Column [{column}] not found in source table [{source}]",
            })
    for column in dict.fromkeys([*mappings.new_columns(), *new_filter]):
        if column not in set(new):
            found.append({
                "error_type": E.COLUMN_MISSING, "new_column": column,
                "message": f"Column [{column}] not found in target table [{target}]",
            })
    return found


def usable_mappings(mappings: Mappings, missing: list[dict]) -> Mappings:
    """The mappings left after dropping those that touch a missing column."""
    return mappings.without(
        {e["old_column"] for e in missing if e.get("old_column")},
        {e["new_column"] for e in missing if e.get("new_column")},
    )


def unmapped(old: Iterable[str], new: Iterable[str], mappings: Mappings, keys_old=(), keys_new=()) -> tuple[list[str], list[str]]:
    """Columns of either side that no mapping, filter or key uses."""
    old_filter, new_filter = mappings.filter_columns()
    used_old = {*mappings.old_columns(), *old_filter, *keys_old}
    used_new = {*mappings.new_columns(), *new_filter, *keys_new}
    return [c for c in old if c not in used_old], [c for c in new if c not in used_new]


def unmapped_errors(old, new, mappings: Mappings, source: str, target: str, keys_old=(), keys_new=()) -> list[dict]:
    rest_old, rest_new = unmapped(old, new, mappings, keys_old, keys_new)
    found = []
    for side, table, rest in (("Source", source, rest_old), ("Target", target, rest_new)):
        if rest:
            found.append({
                "error_type": E.DATA_MISSING,
                "message": f"{side} [{table}] has {len(rest)} unmapped column(s): {', '.join(rest)}",
            })
    return found


def columns_of(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name) of a DataFrame."""
    return name_list(df.sparkSession, df.columns, "column_name").select(F.lit(table).alias("table_name"), "column_name")


def name_list(spark: SparkSession, names: Iterable[str], column: str) -> DataFrame:
    schema = T.StructType([T.StructField(column, T.StringType())])
    return spark.createDataFrame([(n,) for n in names], schema)


def name_pairs(spark: SparkSession, old: Iterable[str], new: Iterable[str]) -> DataFrame:
    """Every (old_column, new_column) pair of two lists of names."""
    return (
        name_list(spark, old, "old_column")
        .withColumn("new_column", F.explode(F.array(*[F.lit(n) for n in new]).cast("array<string>")))
    )


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column_name, side) of the columns only one table has."""
    spark = left.sparkSession
    a, b = name_list(spark, left.columns, "column_name"), name_list(spark, right.columns, "column_name")
    return (
        a.subtract(b).withColumn("side", F.lit("left_only"))
        .unionByName(b.subtract(a).withColumn("side", F.lit("right_only")))
    )


def fallback_matches(spark: SparkSession, old: list[str], new: list[str], at_least: float = FALLBACK_SIMILARITY) -> DataFrame:
    """For each unmapped old name the most similar new one, if similar enough."""
    pairs = name_pairs(spark, old, new).withColumn(
        "similarity", name_similarity(F.col("old_column"), F.col("new_column"))
    )
    order = {name: place for place, name in enumerate(new)}
    # Of equally similar names the first one in the table wins.
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("new_column")] if order else F.lit(0)
    best = F.max_by(F.struct("new_column", "similarity"), F.struct("similarity", (-place).alias("place")))
    return (
        pairs.groupBy("old_column").agg(best.alias("best"))
        .select("old_column", "best.new_column", "best.similarity")
        .filter(F.col("similarity") >= at_least)
    )
