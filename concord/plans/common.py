"""Steps the validators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import errors as E
from concord.functions.numbers import col
from concord.functions.text import transform
from concord.operators.noisy import noisy_names
from concord.operators.schema import missing_columns, unmapped_errors, usable_mappings
from concord.rules import Mappings, Rule
from concord.sources.tables import Resolver, source_rows


def key_text(name: str, rule: str | None = None) -> Column:
    """Group key: trimmed text, or the transformed one; never null."""
    value = F.trim(col(name).cast("string")) if not rule or rule == "NONE" else transform(col(name), rule)
    return F.coalesce(value, F.lit(""))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def checked_mappings(
    old: DataFrame, new: DataFrame, mappings: Mappings, source: str, target: str, keys_old=(), keys_new=()
) -> tuple[Mappings, list[dict]]:
    """Mappings both tables can serve, and the errors about the others and about unmapped columns."""
    missing = missing_columns(old.columns, new.columns, mappings, source, target)
    usable = usable_mappings(mappings, missing)
    rest = unmapped_errors(old.columns, new.columns, usable, source, target, keys_old, keys_new)
    return usable, missing + rest


def noisy_of(old: DataFrame, mappings: Mappings) -> set[str]:
    return noisy_names(old, mappings.old_columns())


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def duplicate_anchor_error(df: DataFrame, anchor: str | None, table: str) -> DataFrame | None:
    """One TRANSFORM_ERROR if the anchor repeats; its smallest repeated value is named."""
    if not anchor or anchor not in df.columns:
        return None
    return repeated_anchor(duplicate_keys(df, anchor).select(col(anchor).cast("string").alias("key")), anchor, table)


def repeated_anchor(keys: DataFrame, anchor: str, table: str) -> DataFrame:
    """One TRANSFORM_ERROR if there are repeated keys (column `key`)."""
    repeated = keys.agg(F.min("key").alias("first"))
    message = F.concat(
        F.lit(f"Anchor key [{anchor}] has duplicate values in [{table}] (first duplicate: \""),
        F.coalesce(F.col("first"), F.lit("")), F.lit("\")"),
    )
    return repeated.filter(F.col("first").isNotNull()).select(E.error(E.TRANSFORM_ERROR, message=message).alias("e")).select("e.*")


def filter_of(rule: Rule, source: str) -> str | None:
    """The filter belongs to the first source; in a UNION, whose sources are alike, to all."""
    return rule.source_filter if rule.table_type == "UNION" or source == rule.sources()[0] else None


def total_mismatch_errors(rule: Rule, find: Resolver) -> DataFrame | None:
    """Cross-check of an amount per code over all sources; None where the rule gives nothing to check."""
    from concord.operators.keys import sums_by_code

    pair = next(
        (m for m in (*rule.mappings.transformed, *rule.mappings.exact)
         if "amount" in m.old.lower() and "amount" in m.new.lower()),
        None,
    )
    if pair is None or rule.grouping is None or rule.skip_aggregate_sum_check:
        return None
    olds = [source_rows(find(s), filter_of(rule, s)) for s in rule.sources()]
    new = find(rule.targets()[0])
    if rule.source_filter and rule.grouping.new_key in new.columns:
        # Other rules own the target rows of groups that the filter leaves out.
        g = rule.grouping
        keys = [o.select(key_text(g.source_key_aliases.get(s, g.old_key), g.transform_key).alias("_group")) for s, o in zip(rule.sources(), olds)]
        new = new.withColumn("_group", key_text(g.new_key, g.transform_key)).join(union_all(keys).distinct(), ["_group"], "left_semi")
    code_names = ["affectcode", "affect_code", "afcode", "affcode", "affect_cd"]
    code = next((c for c in code_names if c in olds[0].columns and c in new.columns), None)
    if code is None or pair.new not in new.columns or any(pair.old not in o.columns for o in olds):
        return None
    tolerance = rule.tolerance if rule.tolerance_set else 0.01
    sums = sums_by_code([(o, code, pair.old) for o in olds], (new, code, pair.new), tolerance)
    text = lambda c: F.col(c).cast("string")
    return sums.filter("mismatch").select(E.error(
        E.VALUE_MISMATCH,
        old_column=F.concat(F.lit(f"SUM({pair.old}) WHERE {code}='"), F.col("code"), F.lit("'")),
        new_column=F.concat(F.lit(f"SUM({pair.new}) WHERE {code}='"), F.col("code"), F.lit("'")),
        old_value=text("old_total"), new_value=text("new_total"),
        message=F.concat(
            F.lit(f"[AGGREGATE] SUM mismatch for {code}="), F.col("code"), F.lit(": old="), text("old_total"),
            F.lit(", new="), text("new_total"),
        ),
    ).alias("e")).select("e.*")


def gather(rule: Rule, frames: list[DataFrame | None], fixed: list[dict], any_table: DataFrame | None = None) -> DataFrame:
    """All errors of a rule in one frame, labelled; `any_table` gives the session where there are no frames."""
    spark = next(f for f in (*frames, any_table) if f is not None).sparkSession
    found = [E.labelled(f, rule.name, rule.source, rule.target) for f in frames if f is not None]
    if fixed or not found:
        found.append(E.fixed_errors(spark, fixed, rule.name, rule.source, rule.target))
    return union_all(found)
