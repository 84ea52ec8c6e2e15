"""HEADER: a long table against its pivoted form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import errors as E
from concord.functions.numbers import col, is_numeric, number_of, plain, tolerant_equal
from concord.operators.joins import first_per_key
from concord.plans.common import checked_mappings, gather, key_text
from concord.plans.grouped import GroupComparison
from concord.plans.outcome import Outcome, nothing_checked
from concord.rules import Mappings, Pivot, PivotConfig, Rule
from concord.sources.tables import Resolver, source_rows

KEY = "identity"


def pivoted(old: DataFrame, config: PivotConfig, pivots: tuple[Pivot, ...]) -> DataFrame:
    """One row per identity: a sum per pivot value, or the largest text where a value is no number."""
    columns: list[Column] = []
    for i, p in enumerate(pivots):
        mine = F.trim(col(config.pivot_key).cast("string")) == p.pivot_value
        number, value = number_of(old, p.value_col), col(p.value_col)
        total = plain(F.sum(F.when(mine, number)))
        if is_numeric(old, p.value_col):
            columns.append(total.alias(f"p{i}"))
        else:
            bad = F.count_if(mine & value.isNotNull() & number.isNull())
            columns.append(F.when(bad == 0, total).otherwise(F.max(F.when(mine, value.cast("string")))).alias(f"p{i}"))
    return old.groupBy(key_text(config.old_identity).alias(KEY)).agg(F.count(F.lit(1)).alias("rows_old"), *columns)


def wide_rows(new: DataFrame, config: PivotConfig, pivots: tuple[Pivot, ...]) -> DataFrame:
    """One target row per identity and how many there are."""
    wide = new.select(key_text(config.new_identity).alias(KEY), *[col(p.new_col).alias(f"w{i}") for i, p in enumerate(pivots)])
    kept = first_per_key(wide, [KEY], [F.col(f"w{i}").asc_nulls_last() for i in range(len(pivots))] or [F.col(KEY)])
    counts = wide.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows_new"))
    return kept.join(counts, [KEY])


def pivot_joined(old: DataFrame, new: DataFrame, config: PivotConfig, pivots: tuple[Pivot, ...]) -> DataFrame:
    return pivoted(old, config, pivots).join(wide_rows(new, config, pivots), [KEY], "full_outer")


def validate_header(rule: Rule, find: Resolver) -> Outcome:
    old_table, new_table = find(rule.source), find(rule.target)
    if rule.pivot is None or not rule.mappings.pivot:
        return _unconfigured(rule, new_table)
    old = source_rows(old_table, rule.source_filter)
    mappings, fixed = checked_mappings(
        old_table, new_table, rule.mappings, rule.source, rule.target,
        [rule.pivot.old_identity, rule.pivot.pivot_key], [rule.pivot.new_identity],
    )
    pivots = mappings.pivot
    if not pivots:
        return Outcome(rule, gather(rule, [], fixed, new_table), nothing_checked(new_table))
    row_id = F.col(KEY)
    both = F.col("rows_new").isNotNull() & F.col("rows_old").isNotNull()
    checks: list[E.Check] = []
    for i, p in enumerate(pivots):
        a, b = F.col(f"p{i}"), F.col(f"w{i}").cast("string")
        name = f"{rule.pivot.pivot_key}='{p.pivot_value}'.{p.value_col}"
        checks.append((both & ~tolerant_equal(a, b, rule.tolerance), E.error(
            E.VALUE_MISMATCH, row_id=row_id, old_column=name, new_column=p.new_col, old_value=a, new_value=b,
            message=F.concat(F.lit(f"Pivot mismatch {name}: "), F.coalesce(a, F.lit("null")), F.lit(" <> "),
                             F.coalesce(b, F.lit("null"))),
        )))
    checks += [
        (F.col("rows_new").isNull(), E.error(
            E.ROW_MISSING, row_id=row_id, message=F.lit("Identity found in source but not in target"))),
        (F.col("rows_old").isNull() & F.lit(rule.extras_wanted()), E.error(
            E.ROW_MISSING, row_id=row_id, message=F.lit("Identity found in target but not in source"))),
        (F.col("rows_new") > 1, E.error(
            E.TRANSFORM_ERROR, row_id=row_id,
            message=F.concat(F.lit("Identity has "), F.col("rows_new").cast("string"), F.lit(" target rows; one is compared")))),
    ]
    joined = pivot_joined(old, new_table, rule.pivot, pivots).withColumn("errors", E.held(checks))
    bad = F.size("errors") > 0
    zero = F.lit(0).cast("long")
    accounting = joined.agg(
        F.coalesce(F.sum("rows_old"), zero).alias("rows_checked"),
        F.coalesce(F.sum(F.when(~bad, F.col("rows_old"))), zero).alias("pass_rows"),
        F.coalesce(F.sum(F.when(bad, F.col("rows_old"))), zero).alias("fail_rows"),
    )
    frames = [E.explode_errors(joined, "errors")]
    if rule.defs:
        found, broken = _rule_errors(rule, old, new_table)
        frames.append(found)
        fixed = fixed + broken
    return Outcome(rule, gather(rule, frames, fixed), accounting, {"identities": joined})


def _rule_errors(rule: Rule, old: DataFrame, new: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Violations of business rules, with an identity's rows as the group."""
    left = old.withColumn(KEY, key_text(rule.pivot.old_identity))
    right = new.withColumn(KEY, key_text(rule.pivot.new_identity))
    groups = GroupComparison(left, right, [KEY], Mappings(), rule.tolerance, defs=rule.defs, known_codes=rule.known_codes, report_extra=False)
    return groups.errors().filter(F.col("error_type") == E.DEFECT_VIOLATION), groups.broken_rules


def _unconfigured(rule: Rule, target: DataFrame) -> Outcome:
    """Without a pivot only an empty target can be noticed."""
    fixed = [{"error_type": E.DATA_MISSING, "message": f"[HEADER] {rule.source}: pivot_config not defined - pivot not checked"}]
    empty = target.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(E.error(
        E.ROW_MISSING, message=F.lit(f"[HEADER] Target table {rule.target} is empty")).alias("e")).select("e.*")
    return Outcome(rule, gather(rule, [empty], fixed), nothing_checked(target))
