"""What a validator returns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.rules import Rule


def nothing_checked(any_table: DataFrame) -> DataFrame:
    """The accounting of a rule that looked at no row."""
    return any_table.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(n) for n in ("rows_checked", "pass_rows", "fail_rows")])


@dataclass
class Outcome:
    """Errors of one rule and its row accounting, both lazy.

    `accounting` holds rows_checked, pass_rows and fail_rows, and may have several rows (one per pair of
    tables); reports add them up. `details` holds further frames, such as value differences.
    """

    rule: Rule
    errors: DataFrame
    accounting: DataFrame
    details: dict[str, DataFrame] = field(default_factory=dict)
