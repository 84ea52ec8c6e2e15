"""SPLIT: every old value must appear in the target column, and the other way round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import errors as E
from concord.functions.numbers import col
from concord.functions.text import clean, transform
from concord.plans.common import checked_mappings, gather, noisy_of
from concord.plans.outcome import Outcome, nothing_checked
from concord.rules import Rule
from concord.sources.tables import Resolver, source_rows


def value_counts_both(old: DataFrame, new: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """mapping, value, n_old, n_new: rows holding each value. A frequent value is summed before the shuffle."""

    def long(df: DataFrame, values: list[Column], side: str) -> DataFrame:
        held = F.array(*[F.struct(F.lit(i).alias("mapping"), v.alias("value")) for i, v in enumerate(values)])
        return df.select(F.explode(held).alias("p")).select(
            "p.mapping", "p.value", F.lit(int(side == "old")).alias("o"), F.lit(int(side == "new")).alias("n"),
        ).filter(F.col("value").isNotNull())

    both = long(old, [o for o, _ in pairs], "old").unionByName(long(new, [n for _, n in pairs], "new"))
    return both.groupBy("mapping", "value").agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new"))


def validate_split(rule: Rule, find: Resolver) -> Outcome:
    old_table, new_table = find(rule.source), find(rule.target)
    old = source_rows(old_table, rule.source_filter, rule.old_anchor)
    mappings, fixed = checked_mappings(old_table, new_table, rule.mappings, rule.source, rule.target)
    noisy = noisy_of(old, mappings)
    compared = [m for m in mappings.exact if m.old not in noisy]
    if rule.defs:
        fixed = [*fixed, {"error_type": E.TRANSFORM_ERROR, "message": "Business rules need groups; convert the rule to TRANSACTION to evaluate them"}]
    if not compared:
        return Outcome(rule, gather(rule, [], fixed, new_table), nothing_checked(new_table))
    counts = value_counts_both(old, new_table, [
        (transform(col(m.old), m.transform), clean(col(m.new))) for m in compared
    ])
    frames = []
    for i, m in enumerate(compared):
        mine = F.col("mapping") == i
        lost = F.when(F.col("n_new") == 0, E.error(
            E.ROW_MISSING, old_column=m.old, new_column=m.new, old_value=F.col("value"),
            message=F.concat(F.lit("Value ["), F.col("value"), F.lit("] of "), F.col("n_old").cast("string"),
                             F.lit(f" source row(s) not found in {m.new}")),
        )).when((F.col("n_old") == 0) & F.lit(rule.extras_wanted()), E.error(
            E.ROW_MISSING, old_column=m.old, new_column=m.new, new_value=F.col("value"),
            message=F.concat(F.lit("Value ["), F.col("value"), F.lit(f"] not found in source {m.old} (extra in target)")),
        ))
        frames.append(F.when(mine, lost))
    errors = counts.select(F.coalesce(*frames).alias("e")).filter(F.col("e").isNotNull()).select("e.*")
    zero = F.lit(0).cast("long")
    accounting = counts.agg(
        F.coalesce(F.sum("n_old"), zero).alias("rows_checked"),
        F.coalesce(F.sum(F.when(F.col("n_new") > 0, F.col("n_old"))), zero).alias("pass_rows"),
        F.coalesce(F.sum(F.when(F.col("n_new") == 0, F.col("n_old"))), zero).alias("fail_rows"),
    )
    return Outcome(rule, gather(rule, [errors], fixed), accounting, {"values": counts})
