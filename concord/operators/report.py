"""Aggregates of error frames: breakdowns, summaries, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import errors as E
from concord.plans.common import union_all
from concord.plans.outcome import Outcome

# The report order of mapping statuses.
STATUS_RANK = {
    "VERIFIED (Schema Mapping)": 0, "VERIFIED": 1, "VERIFIED (Data Match)": 2, "VERIFIED (Set Match)": 3,
    "MANUAL_CHECK": 6, "SCHEMA_MATCH_ONLY": 7, "ZERO_COLUMN": 8, "NO_MATCH": 9, "DATA_LOST": 10, "EMPTY_COLUMN": 11,
}


def _description(message: Column) -> Column:
    line = F.trim(F.substring_index(F.trim(message), "\n", 1))
    return F.trim(F.regexp_replace(line, r"\.\s*$", ""))


def breakdown(errors: DataFrame) -> DataFrame:
    """error_type, def_id, count, description; business rules by id, everything else by type."""
    is_defect = (F.col("error_type") == E.DEFECT_VIOLATION) & F.col("def_id").isNotNull()
    return errors.groupBy("error_type", F.when(is_defect, F.col("def_id")).alias("def_id")).agg(
        F.count(F.lit(1)).alias("count"), F.min(_description(F.col("message"))).alias("description")
    )


def report_order(frame: DataFrame) -> DataFrame:
    """Business rules first, by id; then the other types by name."""
    return frame.orderBy(
        F.when(F.col("error_type") == E.DEFECT_VIOLATION, 0).otherwise(1),
        F.concat(F.coalesce(F.col("def_id"), F.lit("")), F.col("error_type")),
    )


def merged_breakdown(outcomes: list[Outcome]) -> DataFrame:
    """Breakdown over all rules."""
    parts = union_all([breakdown(o.errors) for o in outcomes])
    return parts.groupBy("error_type", "def_id").agg(
        F.sum("count").alias("count"), F.min("description").alias("description")
    )


def error_counts(errors: DataFrame) -> DataFrame:
    """Per rule: errors, missing things, and the joined messages of structural errors.

    Structural messages are a handful per rule: they describe columns and rules, never rows.
    """
    structural = F.when(F.col("error_type").isin(E.STRUCTURAL_TYPES) & F.col("row_id").isNull(), F.col("message"))
    return errors.groupBy("rule").agg(
        F.count(F.lit(1)).alias("total_errors"),
        F.count_if(F.col("error_type").isin(E.MISSING_TYPES)).alias("missing"),
        F.array_join(F.array_sort(F.collect_set(structural)), " | ").alias("remarks"),
    )


def summary_row(outcome: Outcome) -> DataFrame:
    """rule, tables, status, rows and errors of one rule."""
    rule = outcome.rule
    counts = outcome.accounting.agg(
        F.sum("rows_checked").alias("rows_checked"), F.sum("pass_rows").alias("pass"), F.sum("fail_rows").alias("fail")
    ).withColumn("rule", F.lit(rule.name))
    found = counts.join(error_counts(outcome.errors), ["rule"], "left").fillna(0, ["total_errors", "missing"])
    found = found.withColumn("skipped", F.greatest(F.lit(0).cast("long"), F.col("rows_checked") - F.col("pass") - F.col("fail")))
    clean = (F.col("fail") == 0) & (F.col("missing") == 0) & (F.col("skipped") == 0) & (F.col("total_errors") == 0)
    return found.select(
        "rule", F.lit(rule.source).alias("source_table"), F.lit(rule.target).alias("target_table"),
        F.when(clean, "PASS").otherwise("FAIL").alias("status"),
        "rows_checked", "pass", "fail", "skipped", "total_errors", "missing",
        F.coalesce(F.col("remarks"), F.lit("")).alias("remarks"),
    )


def summary(outcomes: list[Outcome]) -> DataFrame:
    return union_all([summary_row(o) for o in outcomes])


def overall(summaries: DataFrame) -> DataFrame:
    """How many rules passed and failed."""
    return summaries.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(F.col("status") == "PASS").alias("overall_pass"),
        F.count_if(F.col("status") == "FAIL").alias("overall_fail"),
    )


def def_report(errors: DataFrame, def_id: str, fields: list[str]) -> DataFrame:
    """Rule, group key and report fields of one business rule, a column per field."""
    return errors.filter((F.col("def_id") == def_id) & F.col("report_fields").isNotNull()).select(
        "rule", "group_key", *[F.col("report_fields")[f].alias(f) for f in fields]
    )


def match_counts(matches: DataFrame) -> DataFrame:
    """Column matches per status."""
    return matches.groupBy("status").agg(F.count(F.lit(1)).alias("n_columns"))


def mapping_order(matches: DataFrame) -> DataFrame:
    """Matches by status rank, then confidence."""
    ranks = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return matches.withColumn("status_rank", F.coalesce(ranks[F.col("status")], F.lit(12))).orderBy(
        "status_rank", F.col("confidence").desc(), "old_column"
    )
