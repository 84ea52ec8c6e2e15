"""Writing reports: every writer is distributed; only the one-row-per-rule summaries are a single file."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.errors import FIELDS
from concord.operators.report import (
    def_report, mapping_order, merged_breakdown, report_order, summary,
)
from concord.plans.outcome import Outcome
from concord.sources.scratch import scratch_path, stored

DETAIL_COLUMNS = [f for f in FIELDS if f != "report_fields"]


def settled(outcome: Outcome) -> Outcome:
    """The outcome with errors and accounting as tables in the shared folder: computed once for all reports.

    Errors lie in a folder per type, so the report of a business rule reads defects only.
    """
    spark = outcome.errors.sparkSession
    path = scratch_path(spark, "errors")
    outcome.errors.write.partitionBy("error_type").parquet(path)
    errors = spark.read.schema(outcome.errors.schema).parquet(path).select(*FIELDS)
    return replace(outcome, errors=errors, accounting=stored(outcome.accounting, "accounting"))


def write_detail(outcome: Outcome, folder: str, form: str = "csv") -> None:
    """Detail log: a folder per error type."""
    writer = outcome.errors.select(*DETAIL_COLUMNS).write.mode("overwrite").partitionBy("error_type").format(form)
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(folder)


def write_def_reports(outcome: Outcome, folder: str) -> None:
    """A folder per business rule that declares report fields."""
    for rule in outcome.rule.defs:
        fields = list(dict.fromkeys(f for a in rule.actions for f in a.report_fields))
        if fields:
            frame = def_report(outcome.errors, rule.def_id, fields)
            frame.write.mode("overwrite").option("header", True).csv(f"{folder}/{rule.def_id}_Detail")


def write_summary(outcomes: list[Outcome], folder: str) -> None:
    """Summary, one row per rule, and the error summary merged over all rules."""
    summary(outcomes).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/Summary_Report")
    report_order(merged_breakdown(outcomes)).coalesce(1).write.mode("overwrite").option("header", True).csv(
        f"{folder}/Error_Summary"
    )


def result_document(target: str, matches: DataFrame, audit: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: target, mapping by status and by column, audit and coverage. All inputs have a row per column or rule."""
    columns = matches.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.array_sort(F.collect_list(F.struct("old_column", "new_column", "status", "confidence"))).alias("columns"),
    )
    by_status = matches.groupBy("status").count().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("by_status")
    )
    rules = audit.agg(F.array_sort(F.collect_list(F.struct(*audit.columns))).alias("defect_report"))
    covered = coverage.agg(F.array_sort(F.collect_list(F.struct(*coverage.columns))).alias("coverage"))
    parts = [columns, by_status, rules, covered]
    keyed = [p.withColumn("target_table", F.lit(target)) for p in parts]
    document = keyed[0]
    for part in keyed[1:]:
        document = document.join(part, ["target_table"])
    return document.select(
        "target_table", F.struct("total_columns", "by_status", "columns").alias("mapping"),
        F.struct("defect_report").alias("validation"), "coverage",
    )


def write_document(document: DataFrame, folder: str) -> None:
    document.coalesce(1).write.mode("overwrite").json(folder)


def write_mapping_report(matches: DataFrame, folder: str) -> None:
    mapping_order(matches).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_run(outcomes: list[Outcome], folder: str, form: str = "csv") -> None:
    """All reports of a run, from one computation of each rule."""
    known = [settled(o) for o in outcomes]
    for outcome in known:
        write_detail(outcome, f"{folder}/Detail_Log/{outcome.rule.name}", form)
        write_def_reports(outcome, f"{folder}/{outcome.rule.name}")
    write_summary(known, folder)
