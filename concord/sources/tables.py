"""Tables by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.numbers import col

# Fixed value: the bracketed spelling of a table name.
BRACKETED = re.compile(r"\[([^\]]+)\]|([^.\[\]]+)")

Resolver = Callable[[str], DataFrame]


def name_parts(name: str) -> list[str]:
    """'[db].dbo.[table]' -> ['db', 'dbo', 'table']."""
    return [a or b for a, b in BRACKETED.findall(name.strip()) if (a or b).strip()]


def resolver(spark: SparkSession, tables: Mapping[str, DataFrame] | None = None) -> Resolver:
    """DataFrame of a table name: a given one first, else the catalog table of that name."""
    given = dict(tables or {})

    def find(name: str) -> DataFrame:
        name = name.strip()
        if name in given:
            return given[name]
        last = name_parts(name)[-1]
        if last in given:
            return given[last]
        return spark.table(".".join(f"`{p}`" for p in name_parts(name)))

    return find


def parquet_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def jdbc_table(
    spark: SparkSession, url: str, table: str, anchor: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """Database table read in parallel ranges of its anchor column; Spark pushes filters and columns down."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=anchor, lowerBound=lower, upperBound=upper,
        numPartitions=str(partitions), **options,
    )
    return reader.load()


def source_rows(df: DataFrame, source_filter: str | None = None, anchor: str | None = None) -> DataFrame:
    """Rows a rule looks at: those that pass its filter and have an anchor. Both reach the scan."""
    if source_filter:
        df = df.filter(F.expr(source_filter))
    if anchor and anchor in df.columns:
        df = df.filter(col(anchor).isNotNull())
    return df


def repeatable_sample(df: DataFrame, rows: int, by: list[Column] | None = None) -> DataFrame:
    """The same `rows` rows on every run, chosen by a hash of the row, or by the order given."""
    if by:
        return df.orderBy(*by).limit(rows)
    return df.orderBy(F.xxhash64(*[col(c) for c in df.columns]), *[col(c) for c in df.columns]).limit(rows)
