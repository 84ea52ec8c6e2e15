"""TRANSACTION: groups of rows on both sides, also with a composite key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import errors as E
from concord.functions.numbers import col
from concord.functions.text import clean
from concord.operators.joins import even_join, lookup_table
from concord.plans.common import (
    checked_mappings, duplicate_anchor_error, gather, key_text, noisy_of, total_mismatch_errors,
)
from concord.plans.grouped import GroupComparison
from concord.plans.outcome import Outcome
from concord.rules import Rule
from concord.sources.tables import Resolver, source_rows

KEY = "group_key_1"
PART = "group_key_2"
OLD_PART = "old_key_2"


def validate_transaction(rule: Rule, find: Resolver) -> Outcome:
    if rule.grouping is None:
        raise ValueError(f"{rule.name}: TRANSACTION needs transaction_grouping")
    if rule.grouping.composite_key:
        return _composite(rule, find)
    g = rule.grouping
    old_table, new_table = find(rule.source), find(rule.target)
    old = source_rows(old_table, rule.source_filter, rule.old_anchor)
    mappings, fixed = checked_mappings(
        old_table, new_table, rule.mappings, rule.source, rule.target, [g.old_key], [g.new_key]
    )
    noisy = noisy_of(old, mappings)
    left = old.withColumn(KEY, key_text(g.old_key, g.transform_key))
    right = new_table.withColumn(KEY, key_text(g.new_key, g.transform_key)).filter(F.col(KEY) != "")
    comparison = GroupComparison(
        left, right, [KEY], mappings, rule.tolerance, noisy, rule.defs, rule.known_codes,
        g.row_fingerprint, rule.extras_wanted(), rule.blank_as_zero,
    )
    errors = gather(
        rule,
        [
            comparison.errors(),
            duplicate_anchor_error(old, rule.old_anchor, rule.source),
            total_mismatch_errors(rule, find),
        ],
        fixed + comparison.broken_rules,
    )
    return Outcome(rule, errors, comparison.accounting(), _details(comparison))


def _details(comparison: GroupComparison) -> dict[str, DataFrame]:
    found = {"groups": comparison.groups()}
    differences = comparison.differences()
    if differences is not None:
        found["differences"] = differences
    return found


def _translation(rule: Rule, find: Resolver) -> Callable[[DataFrame], DataFrame]:
    """Adds the new account to rows with an old one; null where the look-up table has no entry."""
    ck = rule.grouping.composite_key
    if ck.mapping is None:
        return lambda groups: groups.withColumn(PART, F.col(OLD_PART))
    lookup = lookup_table(find(ck.mapping.table), col(ck.mapping.lookup_col), col(ck.mapping.result_col))
    named = lookup.withColumnsRenamed({"lookup_key": OLD_PART, "lookup_value": PART})
    return lambda groups: even_join(groups, named, [OLD_PART], "left")


def _composite(rule: Rule, find: Resolver) -> Outcome:
    """Old rows are aggregated by their own account; accounts are translated on the groups, a row per key and account.

    Groups without a new account fail; rows without an old one are checked, and neither passed nor failed.
    """
    g, ck = rule.grouping, rule.grouping.composite_key
    old_table, new_table = find(rule.source), find(rule.target)
    old = source_rows(old_table, rule.source_filter)
    mappings, fixed = checked_mappings(
        old_table, new_table, rule.mappings, rule.source, rule.target,
        [g.old_key, ck.old_col], [g.new_key, ck.new_col],
    )
    noisy = noisy_of(old, mappings)
    rows = old.withColumn(KEY, key_text(g.old_key)).withColumn(OLD_PART, clean(col(ck.old_col)))
    right = (
        new_table.withColumn(KEY, key_text(g.new_key)).withColumn(PART, clean(col(ck.new_col)))
        .filter(F.col(PART).isNotNull())
    )

    def unmapped(_: Column) -> list[E.Check]:
        return [(F.col(PART).isNull(), E.error(
            E.ROW_MISSING, group_key=F.concat_ws("::", KEY, OLD_PART),
            message=F.concat(F.lit(f"No account mapping found for old [{ck.old_col}="), F.col(OLD_PART), F.lit("]")),
        ))]

    comparison = GroupComparison(
        rows, right, [KEY, PART, OLD_PART], mappings, rule.tolerance, noisy,
        rule.defs, rule.known_codes, (), rule.extras_wanted(), rule.blank_as_zero, new_key=[KEY, PART],
        old_key=[KEY, OLD_PART], translate=_translation(rule, find), more_checks=unmapped, skipped=F.col(OLD_PART).isNull(),
    )
    errors = gather(rule, [comparison.errors(), total_mismatch_errors(rule, find)], fixed + comparison.broken_rules)
    return Outcome(rule, errors, comparison.accounting(), _details(comparison))
