"""MULTIPLE and UNION: several sources, or several pairs of tables."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord import errors as E
from concord.operators.sides import Side
from concord.plans.common import (
    checked_mappings, duplicate_anchor_error, filter_of, gather, key_text, noisy_of, total_mismatch_errors, union_all,
)
from concord.plans.grouped import GroupComparison
from concord.plans.master import RowComparison
from concord.plans.outcome import Outcome
from concord.plans.transaction import KEY
from concord.rules import Mappings, Rule
from concord.sources.tables import Resolver, source_rows


def pairs_of(rule: Rule) -> OrderedDict[tuple[str, str], Mappings]:
    """Mappings per (source, target); those without a route go to the first of each."""
    first = (rule.sources()[0], rule.targets()[0])
    routed: OrderedDict[tuple[str, str], dict[str, list]] = OrderedDict()
    for kind in rule.mappings.__dataclass_fields__:
        for m in getattr(rule.mappings, kind):
            pair = (getattr(m, "source", None) or first[0], getattr(m, "target", None) or first[1])
            routed.setdefault(pair, {}).setdefault(kind, []).append(m)
    return OrderedDict((pair, Mappings(**{k: tuple(v) for k, v in kinds.items()})) for pair, kinds in routed.items())


def _extra_errors(extra: DataFrame) -> DataFrame:
    return extra.select(E.error(
        E.ROW_MISSING, group_key=F.col(KEY),
        message=F.concat(F.lit("Group ["), F.col(KEY), F.lit("] found in target but in no source (extra)")),
    ).alias("e")).select("e.*")


def _source(rule: Rule, find: Resolver, name: str, anchor: str | None = None) -> DataFrame:
    return source_rows(find(name), filter_of(rule, name), anchor)


def _named(differences: DataFrame | None, source: str, target: str) -> DataFrame | None:
    return None if differences is None else differences.select(F.lit(source).alias("source_table"), F.lit(target).alias("target_table"), "*")


def _extra_groups_of(comparisons: list[GroupComparison], others: list[DataFrame]) -> DataFrame:
    """Groups of the target that no source has, from the verdicts of all comparisons with it."""
    held = [c.judged.select(KEY, (F.col("rows_old") > 0).alias("in_source"), (F.col("rows_new") > 0).alias("in_target")) for c in comparisons]
    held += [o.select(KEY, F.lit(True).alias("in_source"), F.lit(False).alias("in_target")) for o in others]
    groups = union_all(held).groupBy(KEY).agg(F.max("in_source").alias("in_source"), F.max("in_target").alias("in_target"))
    return groups.filter("in_target and not in_source").select(KEY)


def validate_multiple(rule: Rule, find: Resolver) -> Outcome:
    """Every pair of a source and a target. A target is aggregated once, for all sources that are held against it."""
    pairs = pairs_of(rule)
    frames: list[DataFrame | None] = []
    differences: list[DataFrame | None] = []
    accounts, fixed, details = [], [], {}
    targets: dict[str, Side] = {}
    grouped: dict[tuple[str, str], GroupComparison] = {}
    several = len({t for _, t in pairs}) < len(pairs)
    for (source, target), wanted in pairs.items():
        old, new = _source(rule, find, source), find(target)
        keys_old = [rule.grouping.source_key_aliases.get(source, rule.grouping.old_key)] if rule.grouping else [rule.old_anchor]
        keys_new = [rule.grouping.new_key] if rule.grouping else [rule.new_anchor]
        mappings, found = checked_mappings(old, new, wanted, source, target, keys_old, keys_new)
        fixed += found
        noisy = noisy_of(old, mappings)
        if rule.grouping:
            g = rule.grouping
            left = old.withColumn(KEY, key_text(keys_old[0], g.transform_key))
            if target not in targets:
                right = new.withColumn(KEY, key_text(g.new_key, g.transform_key)).filter(F.col(KEY) != "")
                targets[target] = Side(right, "new", [KEY], shared=several)
            grouped[source, target] = GroupComparison(
                left, targets[target], [KEY], mappings, rule.tolerance, noisy, rule.defs, rule.known_codes,
                g.row_fingerprint, report_extra=False, blank_as_zero=rule.blank_as_zero,
            )
            fixed += grouped[source, target].broken_rules
        else:
            comparison = RowComparison(old, new, rule.old_anchor, rule.new_anchor, mappings, noisy, rule.tolerance)
            frames += [comparison.extra_errors() if rule.extras_wanted() else None, comparison.errors()]
            accounts.append(comparison.accounting())
    for (source, target), comparison in grouped.items():
        details[f"groups:{source}->{target}"] = comparison.groups()
        differences.append(_named(comparison.differences(), source, target))
        frames.append(comparison.errors())
        accounts.append(comparison.accounting())
    if rule.grouping and rule.extras_wanted():
        frames += [_extra_errors(e) for e in _extras_per_target(rule, find, grouped)]
    frames.append(total_mismatch_errors(rule, find))
    if any(d is not None for d in differences):
        details["differences"] = union_all([d for d in differences if d is not None])
    return Outcome(rule, gather(rule, frames, fixed), union_all(accounts), details)


def _extras_per_target(rule: Rule, find: Resolver, grouped: dict[tuple[str, str], GroupComparison]) -> list[DataFrame]:
    """Extra groups of each target against every listed source, whether or not a mapping names it."""
    g = rule.grouping
    out = []
    for target in dict.fromkeys(t for _, t in grouped):
        others = [
            _source(rule, find, s).select(key_text(g.source_key_aliases.get(s, g.old_key), g.transform_key).alias(KEY))
            for s in rule.sources() if (s, target) not in grouped
        ]
        out.append(_extra_groups_of([c for (_, t), c in grouped.items() if t == target], others))
    return out


def validate_union(rule: Rule, find: Resolver) -> Outcome:
    """Several sources with one schema feed one target."""
    target = find(rule.target)
    sources = rule.sources()
    first = find(sources[0])
    if rule.grouping is None:
        problem = [{"error_type": E.TRANSFORM_ERROR, "message": "UNION needs transaction_grouping to relate rows"}]
        errors = E.fixed_errors(first.sparkSession, problem, rule.name, rule.source, rule.target)
        none = first.sparkSession.range(1).select(
            *[F.lit(0).cast("long").alias(n) for n in ("rows_checked", "pass_rows", "fail_rows")])
        return Outcome(rule, errors, none)
    g = rule.grouping
    fixed: list[dict] = []
    right = Side(target.withColumn(KEY, key_text(g.new_key)).filter(F.col(KEY) != ""), "new", [KEY], shared=len(sources) > 1)
    frames: list[DataFrame | None] = []
    differences: list[DataFrame | None] = []
    accounts, details = [], {}
    compared: dict[str, GroupComparison] = {}
    for name in sources:
        old = _source(rule, find, name, rule.old_anchor)
        old_key = g.source_key_aliases.get(name, g.old_key)
        # Each source is held against its own columns and its own noise.
        mappings, found = checked_mappings(find(name), target, rule.mappings, name, rule.target, [old_key], [g.new_key])
        fixed += [f for f in found if f not in fixed]
        noisy = noisy_of(old, mappings)
        left = old.withColumn(KEY, key_text(old_key))
        comparison = compared[name] = GroupComparison(
            left, right, [KEY], mappings, rule.tolerance, noisy, rule.defs, rule.known_codes,
            report_extra=False, union_mode=True, old_anchor=rule.old_anchor, new_anchor=rule.new_anchor,
        )
        fixed = fixed + comparison.broken_rules
        frames.append(duplicate_anchor_error(old, rule.old_anchor, name))
    for name, comparison in compared.items():
        frames.append(comparison.errors())
        accounts.append(comparison.accounting())
        details[f"groups:{name}"] = comparison.groups()
        differences.append(_named(comparison.differences(), name, rule.target))
    if rule.extras_wanted():
        frames.append(_extra_errors(_extra_groups_of(list(compared.values()), [])))
    frames.append(total_mismatch_errors(rule, find))
    if any(d is not None for d in differences):
        details["differences"] = union_all([d for d in differences if d is not None])
    return Outcome(rule, gather(rule, frames, fixed), union_all(accounts), details)
