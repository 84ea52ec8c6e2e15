"""MASTER and ASSOCIATE: row by row on a unique key."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord import errors as E
from concord.functions.numbers import col, is_numeric
from concord.operators.joins import marked
from concord.operators.rows import RowChecks, RowSide
from concord.operators.schema import fallback_matches
from concord.plans.common import checked_mappings, gather, key_text, noisy_of, repeated_anchor
from concord.plans.outcome import Outcome
from concord.rules import Exact, Mappings, Rule
from concord.sources.scratch import stored
from concord.sources.tables import Resolver, source_rows

KEY = "row_key"


def _first_rows(rows: DataFrame, names: list[str], count: str) -> DataFrame:
    """KEY, how many rows it has, and the columns of its first one: the smallest by the columns in turn, nulls last.

    One aggregation with partial results, so a frequent key is one row per task.
    """
    first = F.min(F.struct(*[part for n in names for part in (F.col(n).isNull().alias(f"{n}_null"), F.col(n))]))
    found = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias(count), first.alias("first"))
    return found.select(KEY, count, *[F.col("first")[n].alias(n) for n in names])


class RowComparison:
    """Old rows with the errors found against their target row.

    Each table is read once and reduced to a row per key; one full outer join of the two gives the errors of rows, what
    is missing, extra or repeated, and the totals. It is stored, and everything else is read from there. Only where old
    keys repeat are their rows read again, to be held one by one against the target row.
    """

    def __init__(self, old: DataFrame, new: DataFrame, old_key: str, new_key: str, mappings: Mappings,
                 noisy: set[str], tolerance: float):
        old_names = list(dict.fromkeys([old_key, *[c for c in mappings.old_columns() if c in old.columns]]))
        new_names = list(dict.fromkeys([new_key, *[c for c in mappings.new_columns() if c in new.columns]]))
        self.old_at = {n: f"o{i}" for i, n in enumerate(old_names)}
        self.new_at = {n: f"n{i}" for i, n in enumerate(new_names)}
        self.left = old.select(key_text(old_key).alias(KEY), *[col(n).alias(a) for n, a in self.old_at.items()])
        self.right = new.select(key_text(new_key).alias(KEY), *[col(n).alias(a) for n, a in self.new_at.items()])
        row_id = F.col(KEY)
        checks = RowChecks(
            mappings, noisy, tolerance,
            RowSide(lambda n: F.col(self.old_at[n]), lambda n: is_numeric(old, n)),
            RowSide(lambda n: F.col(self.new_at[n]), lambda n: is_numeric(new, n)),
            row_id,
        )
        missing = E.error(E.ROW_MISSING, row_id=row_id, message=F.concat(
            F.lit("Row with key ["), row_id, F.lit("] found in source but not in target")))
        found = F.col("rows_new").isNotNull()
        self.prepared = checks.prepared
        self.held = E.held([(~found, missing), *[(found & test, made) for test, made in checks.checks]])

    @cached_property
    def judged(self) -> DataFrame:
        """KEY, rows_old, rows_new, errors of keys with one old row, and the target row of keys with several."""
        old = _first_rows(self.left, list(self.old_at.values()), "rows_old")
        # A repeated target key is an error of its own; the comparison takes one row, always the same.
        new = _first_rows(self.right, list(self.new_at.values()), "rows_new")
        both = old.join(new, [KEY], "full_outer").withColumns(self.prepared)
        one, several = F.col("rows_old") == 1, F.col("rows_old") > 1
        return stored(both.select(
            KEY, "rows_old", "rows_new", F.when(one, self.held).alias("errors"), F.when(several, F.struct(*self.new_at.values())).alias("target")), "judged")

    @cached_property
    def rows(self) -> DataFrame:
        """KEY and errors of every old row."""
        single = self.judged.filter("rows_old = 1").select(KEY, "errors")
        repeated = self.judged.filter("rows_old > 1")
        if repeated.isEmpty():
            return single
        repeated = stored(repeated.select(KEY, "rows_new", "target.*"), "repeated")
        rows = marked(self.left, repeated, [KEY]).filter("seen").drop("seen").join(repeated, [KEY])
        return single.unionByName(rows.withColumns(self.prepared).select(KEY, self.held.alias("errors")))

    def errors(self) -> DataFrame:
        return E.explode_errors(self.rows.filter(F.size("errors") > 0), "errors")

    def extra_keys(self) -> DataFrame:
        """Target keys the source does not have, once each."""
        return self.judged.filter((F.col(KEY) != "") & F.col("rows_old").isNull()).select(KEY)

    def extra_errors(self) -> DataFrame:
        return self.extra_keys().select(E.error(
            E.ROW_MISSING, row_id=F.col(KEY),
            message=F.concat(F.lit("Row with key ["), F.col(KEY), F.lit("] found in target but not in source (extra row)")),
        ).alias("e")).select("e.*")

    def totals(self) -> DataFrame:
        """(old_rows, new_rows) in one row."""
        zero = F.lit(0).cast("long")
        return self.judged.agg(F.coalesce(F.sum("rows_old"), zero).alias("old_rows"), F.coalesce(F.sum("rows_new"), zero).alias("new_rows"))

    def repeated_key_errors(self, rows: str, anchor: str, table: str) -> DataFrame:
        """One error if a key stands in several rows (`rows`: rows_old or rows_new)."""
        repeated = self.judged.filter((F.col(rows) > 1) & (F.col(KEY) != "")).select(F.col(KEY).alias("key"))
        return repeated_anchor(repeated, anchor, table)

    def accounting(self) -> DataFrame:
        bad = F.size("errors") > 0
        return self.rows.agg(
            F.count(F.lit(1)).alias("rows_checked"),
            F.count_if(~bad).alias("pass_rows"),
            F.count_if(bad).alias("fail_rows"),
        )


def row_count_error(totals: DataFrame) -> DataFrame:
    counts = totals.filter(F.col("old_rows") != F.col("new_rows"))
    text = lambda c: F.col(c).cast("string")
    return counts.select(E.error(
        E.ROW_MISSING, old_value=text("old_rows"), new_value=text("new_rows"),
        message=F.concat(F.lit("Row count mismatch: source="), text("old_rows"), F.lit(", target="), text("new_rows")),
    ).alias("e")).select("e.*")


def with_fallbacks(rule: Rule, mappings: Mappings, old: DataFrame, new: DataFrame) -> Mappings:
    """Mappings plus exact ones for unmapped columns with nearly the same name."""
    rest_old = [c for c in old.columns if c not in mappings.old_columns()]
    rest_new = [c for c in new.columns if c not in mappings.new_columns()]
    if not rest_old or not rest_new:
        return mappings
    # Column names only: the result has at most one row per source column.
    pairs = fallback_matches(old.sparkSession, rest_old, rest_new).collect()
    extra = tuple(Exact(p.old_column, p.new_column) for p in sorted(pairs))
    return Mappings(**{**mappings.__dict__, "exact": mappings.exact + extra})


def validate_master(rule: Rule, find: Resolver) -> Outcome:
    old_table, new_table = find(rule.source), find(rule.target)
    old = source_rows(old_table, rule.source_filter, rule.old_anchor)
    mappings, fixed = checked_mappings(
        old_table, new_table, rule.mappings, rule.source, rule.target, [rule.old_anchor], [rule.new_anchor]
    )
    if rule.defs:
        fixed.append({
            "error_type": E.TRANSFORM_ERROR,
            "message": "Business rules need groups; convert the rule to TRANSACTION to evaluate them",
        })
    if mappings.empty():
        spark = old.sparkSession
        errors = E.fixed_errors(spark, fixed, rule.name, rule.source, rule.target)
        none = spark.range(1).select(*[F.lit(0).cast("long").alias(n) for n in ("rows_checked", "pass_rows", "fail_rows")])
        return Outcome(rule, errors, none)
    full = with_fallbacks(rule, mappings, old_table, new_table)
    noisy = noisy_of(old, mappings)
    comparison = RowComparison(old, new_table, rule.old_anchor, rule.new_anchor, full, noisy, rule.tolerance)
    errors = gather(
        rule,
        [
            comparison.errors(),
            comparison.extra_errors() if rule.extras_wanted() else None,
            row_count_error(comparison.totals()) if rule.source_filter is None else None,
            comparison.repeated_key_errors("rows_old", rule.old_anchor, rule.source),
            comparison.repeated_key_errors("rows_new", rule.new_anchor, rule.target),
        ],
        fixed,
    )
    return Outcome(rule, errors, comparison.accounting(), {"rows": comparison.rows})
