"""Row formulas of the audit rules and the comparison they are judged by."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.numbers import NUMBER, col, number_of, to_number

# The formula names, and the share of the mean that is added to the tolerance.
ROW_FORMULA = re.compile(r"^(SUM|DIFF|AVG|CONCAT|COALESCE)\((.+)\)$", re.IGNORECASE)
MEAN_SHARE = "0.001"


def row_formula(df: DataFrame, text: str) -> Column | None:
    """SUM(a,b), DIFF(a,b), AVG(a,b), CONCAT(a,b), COALESCE(a,b) or a column; None if nothing fits."""
    found = ROW_FORMULA.match(text.strip())
    if not found:
        return col(text.strip()) if text.strip() in df.columns else None
    names = [n.strip() for n in found.group(2).split(",") if n.strip() in df.columns]
    if not names:
        return None
    kind = found.group(1).upper()
    if kind == "CONCAT":
        return F.concat(*[F.coalesce(col(n).cast("string"), F.lit("")) for n in names])
    if kind == "COALESCE":
        return F.coalesce(*[col(n) for n in names])
    zero = F.lit(0).cast(NUMBER)
    numbers = [F.coalesce(number_of(df, n), zero) for n in names]
    if kind == "DIFF":
        return numbers[0] - numbers[1] if len(numbers) > 1 else None
    total = numbers[0]
    for number in numbers[1:]:
        total = total + number
    return total / len(numbers) if kind == "AVG" else total


class Likeness:
    """What a pair of columns needs to be compared: a base tolerance widened by the mean size of the left one."""

    def __init__(self, left: Column, right: Column, tolerance: float):
        self.left, self.right = left, right
        self.a, self.b = to_number(left), to_number(right)
        self.numeric = self.a.isNotNull() & self.b.isNotNull()
        self.base = F.lit(str(tolerance)).cast(NUMBER)

    def mean_size(self) -> Column:
        """Aggregate: mean of |left| over the rows where both are numbers."""
        return F.avg(F.when(self.numeric, F.abs(self.a)))

    def allowed(self, mean: Column) -> Column:
        return F.greatest(self.base, F.coalesce(mean, F.lit(0)) * F.lit(MEAN_SHARE).cast("decimal(4,3)"))

    def holds(self, mean: Column) -> Column:
        """Row test; a null on both sides counts as equal text."""
        return F.when(self.numeric, F.abs(self.a - self.b) <= self.allowed(mean)).otherwise(
            F.coalesce(self.left.cast("string"), F.lit("nan")) == F.coalesce(self.right.cast("string"), F.lit("nan"))
        )

    def text_failures(self) -> Column:
        """Aggregate: rows that are not numeric on both sides and differ as text."""
        return F.count_if(
            ~self.numeric
            & (F.coalesce(self.left.cast("string"), F.lit("nan")) != F.coalesce(self.right.cast("string"), F.lit("nan")))
        )

    def widest_gap(self) -> Column:
        """Aggregate: the largest |left - right| over the rows where both are numbers."""
        return F.max(F.when(self.numeric, F.abs(self.a - self.b)))
