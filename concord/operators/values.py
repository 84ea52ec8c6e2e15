"""Distinct values per group and column, compared between the two sides.

The values stay in long form, one row per (group, set, value), so a group with millions of values is
spread over the cluster instead of being collected into one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_table(old: DataFrame | None, new: DataFrame | None, key: Sequence[str], old_sets: dict[int, list[int]], new_sets: dict[int, list[int]]) -> DataFrame:
    """key, set_id, value, in_old, in_new: which side holds which value.

    `old` and `new` hold key, value_id, value; `old_sets` and `new_sets` say in which sets a value takes part.
    """
    def tagged(rows: DataFrame, sets: dict[int, list[int]], is_old: bool) -> DataFrame:
        of_value = F.create_map(*[part for i, own in sets.items() for part in (F.lit(i), F.array(*map(F.lit, own)))])
        wanted = rows.filter(F.col("value_id").isin(list(sets))).select(*key, F.explode(of_value[F.col("value_id")]).alias("set_id"), "value")
        return wanted.select("*", F.lit(is_old).alias("in_old"), F.lit(not is_old).alias("in_new"))

    parts = [tagged(rows, sets, is_old) for rows, sets, is_old in ((old, old_sets, True), (new, new_sets, False)) if rows is not None and sets]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(*key, "set_id", "value").agg(F.max("in_old").alias("in_old"), F.max("in_new").alias("in_new"))


def set_counts(table: DataFrame, key: Sequence[str], set_ids: Sequence[int]) -> DataFrame:
    """Per group: values of each set in old, in new, only in old, only in new."""
    counts = []
    for i in set_ids:
        mine = F.col("set_id") == i
        counts += [
            F.count_if(mine & F.col("in_old")).alias(f"so_{i}"),
            F.count_if(mine & F.col("in_new")).alias(f"sn_{i}"),
            F.count_if(mine & ~F.col("in_new")).alias(f"xo_{i}"),
            F.count_if(mine & ~F.col("in_old")).alias(f"xn_{i}"),
        ]
    return table.groupBy(*key).agg(*counts)


def differences(table: DataFrame, failing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every value that tells the sides of a failing set apart, one row each: key, mapping, value, side.

    `failing` has key, set_id, mapping and `wanted`: the sides to give. Both inputs of the join are plain shuffles,
    which adaptive execution splits where a group is large.
    """
    side = F.when(F.col("in_old") & F.col("in_new"), "both").when(F.col("in_old"), "old_only").otherwise("new_only")
    found = table.join(failing, [*key, "set_id"]).withColumn("side", side)
    return found.filter(F.array_contains("wanted", F.col("side"))).select(*key, "mapping", "value", "side")
