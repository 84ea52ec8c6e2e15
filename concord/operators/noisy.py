"""Columns that carry no information: all null, all zero or blank, only 0/1/true/false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.numbers import col

# Fixed values.
ZERO_VALUES = ["0", ""]
BOOLEAN_VALUES = ["0", "1", "true", "false"]


def _text(name: str) -> Column:
    return col(name).cast("string")


def _counts(names: list[str]) -> list[Column]:
    """Per column: values, values that are not zero, values that are not boolean."""
    aggregates = []
    for i, name in enumerate(names):
        text = _text(name)
        aggregates += [
            F.count(col(name)).alias(f"n_{i}"),
            F.count_if(~text.isin(ZERO_VALUES)).alias(f"z_{i}"),
            F.count_if(~text.isin(BOOLEAN_VALUES)).alias(f"b_{i}"),
        ]
    return aggregates


def _kind(n: Column, z: Column, b: Column) -> Column:
    return F.when(n == 0, "NULL").when(z == 0, "ZERO").when(b == 0, "BOOLEAN").otherwise("NORMAL")


def noisy_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column_name, kind, n_values, n_nonzero, n_nonboolean), all columns in one pass."""
    names = list(names or df.columns)
    totals = df.agg(*_counts(names))
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("column_name"),
            _kind(F.col(f"n_{i}"), F.col(f"z_{i}"), F.col(f"b_{i}")).alias("kind"),
            F.col(f"n_{i}").alias("n_values"),
            F.col(f"z_{i}").alias("n_nonzero"),
            F.col(f"b_{i}").alias("n_nonboolean"),
        )
        for i, name in enumerate(names)
    ])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def noisy_names(df: DataFrame, names: list[str]) -> set[str]:
    """Names of the noisy columns, for planning.

    One plain aggregate over the whole table: partial counts per task, one row in the end.
    """
    names = [n for n in dict.fromkeys(names) if n in df.columns]
    if not names:
        return set()
    return {r.column_name for r in noisy_columns(df, names).filter("kind <> 'NORMAL'").select("column_name").collect()}
