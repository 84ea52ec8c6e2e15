"""One side of a group comparison: its group key and the aggregates asked of it.

Every aggregate a rule needs is collected first and computed in one groupBy, with partial aggregation
before the shuffle, so a key that holds a large share of the rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.numbers import NUMBER, col, is_numeric, number_of
from concord.operators.fingerprint_diff import multiset_hash, multisets_hash
from concord.rules import RowFilter
from concord.sources.scratch import stored


def row_test(row_filter: RowFilter) -> Column:
    """Boolean column of a filtered sum; a missing value reads as an empty text."""

    def text(name: str) -> Column:
        return F.coalesce(col(name).cast("string"), F.lit(""))

    test = F.lit(True)
    if row_filter.affectcode_in:
        test = test & text("affectcode").isin(list(row_filter.affectcode_in))
    if row_filter.debitcredit:
        test = test & (text("debitcredit") == row_filter.debitcredit)
    if row_filter.loantranshostcode_in:
        test = test & text("loantranshostcode").isin(list(row_filter.loantranshostcode_in))
    if row_filter.loantranshostcode_not_in:
        test = test & ~text("loantranshostcode").isin(list(row_filter.loantranshostcode_not_in))
    return test


class Side:
    """A table of a comparison. A `shared` one serves several comparisons: it collects what all of them ask, and what
    comes out is computed once and stored."""

    def __init__(self, df: DataFrame, name: str, key: Sequence[str], shared: bool = False):
        self.df, self.name, self.key, self.shared = df, name, list(key), shared
        self._aggregates: dict[str, tuple[str, Column]] = {}
        self._values: dict[str, tuple[int, Column]] = {}
        self._made: dict[str, tuple[str, Column]] = {}
        self._held: dict[str, DataFrame] = {}
        self.rows()

    def _ask(self, label: str, aggregate: Column) -> Column:
        """Register an aggregate once; returns its column in the aggregated frame."""
        if label not in self._aggregates:
            self._aggregates[label] = (f"{self.name}_{len(self._aggregates)}", aggregate)
        return F.col(self._aggregates[label][0])

    def rows(self) -> Column:
        return self._ask("rows", F.count(F.lit(1)))

    def strict_sum(self, column: str, row_filter: RowFilter | None = None) -> Column:
        """Sum; null without values, and null if any value is not a number."""
        test = row_test(row_filter) if row_filter else None
        number = number_of(self.df, column)
        bad = col(column).isNotNull() & number.isNull()
        if test is not None:
            number, bad = F.when(test, number), test & bad
        label = f"{column}|{row_filter}"
        total = self._ask(f"sum|{label}", F.sum(number))
        if is_numeric(self.df, column):
            return total
        return F.when(self._ask(f"bad|{label}", F.count_if(bad)) == 0, total)

    def unsummable(self, column: str, row_filter: RowFilter | None = None) -> Column:
        """Whether a typed number of the group has no place in the sum: not finite, or beyond its digits.

        Text that is no number is another matter: it voids the sum, and the comparison is skipped.
        """
        if not isinstance(self.df.schema[column].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.lit(False)
        bad = col(column).isNotNull() & number_of(self.df, column).isNull()
        if row_filter:
            bad = bad & row_test(row_filter)
        return F.coalesce(self._ask(f"bad|{column}|{row_filter}", F.count_if(bad)) > 0, F.lit(False))

    def filter_hits(self, row_filter: RowFilter) -> Column:
        return self._ask(f"hits|{row_filter}", F.count_if(row_test(row_filter)))

    def lenient_sum(self, column: str, tests: Sequence[tuple[str, str]] = ()) -> Column:
        """Sum where text that is no number counts as zero; tests compare without case."""
        number = number_of(self.df, column)
        for name, value in tests:
            number = F.when(F.upper(F.coalesce(col(name).cast("string"), F.lit(""))) == value.upper(), number)
        total = self._ask(f"lsum|{column}|{tuple(tests)}", F.sum(number))
        return F.coalesce(total, F.lit(0).cast(NUMBER))

    def lenient_min(self, column: str) -> Column:
        least = self._ask(f"lmin|{column}", F.min(F.coalesce(number_of(self.df, column), F.lit(0).cast(NUMBER))))
        return F.coalesce(least, F.lit(0).cast(NUMBER))

    def any_equal(self, column: str, value: str) -> Column:
        hits = self._ask(f"eq|{column}|{value}", F.count_if(F.upper(col(column).cast("string")) == value))
        return F.coalesce(hits, F.lit(0)) > 0

    def count_equal(self, column: str, value: str) -> Column:
        text = F.upper(F.trim(col(column).cast("string")))
        return F.coalesce(self._ask(f"ceq|{column}|{value}", F.count_if(text == value.upper())), F.lit(0))

    def count_matching(self, column: str, pattern: str) -> Column:
        text = F.coalesce(F.trim(col(column).cast("string")), F.lit(""))
        return F.coalesce(self._ask(f"match|{column}|{pattern}", F.count_if(text.rlike(pattern))), F.lit(0))

    def text_values(self, column: str) -> Column:
        """How many values are no number; null counts as one."""
        bad = number_of(self.df, column).isNull()
        return self._ask(f"text|{column}", F.count_if(bad))

    def first_value(self, column: str, anchor: str) -> Column:
        """Text of the row with the smallest anchor."""
        return self._ask(f"first|{column}", F.min_by(col(column).cast("string"), col(anchor)))

    def _once_per_row(self, value: Column) -> Column:
        """A column of the rows that are aggregated: a hash of it is part of several sums, and the value is made once."""
        label = str(value)
        if label not in self._made:
            self._made[label] = (f"_{self.name}_value_{len(self._made)}", value)
        return F.col(self._made[label][0])

    def multiset(self, value: Column) -> list[Column]:
        """The sums that stand for the multiset of a value's texts in the group."""
        return [self._ask(f"multiset|{value}|{i}", part) for i, part in enumerate(multiset_hash(self._once_per_row(value)))]

    def multisets(self, values: Sequence[Column]) -> list[Column]:
        """The sums that stand for the multisets of several values' texts, all of them together."""
        made = [self._once_per_row(v.cast("string")) for v in values]
        return [self._ask(f"multisets|{[str(v) for v in values]}|{i}", part) for i, part in enumerate(multisets_hash(made))]

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.shared:
            return make()
        if name not in self._held:
            self._held[name] = stored(make(), name)
        return self._held[name]

    def aggregated(self) -> DataFrame:
        return self._once("groups", lambda: self._rows().groupBy(*self.key).agg(*[a.alias(n) for n, a in self._aggregates.values()]))

    def _rows(self) -> DataFrame:
        return self.df.withColumns({n: v for n, v in self._made.values()}) if self._made else self.df

    def ask_values(self, value: Column) -> int:
        """Register a value whose different texts per group are wanted; returns its number."""
        label = str(value)
        if label not in self._values:
            self._values[label] = (len(self._values), value)
        return self._values[label][0]

    def values(self, rows: DataFrame) -> DataFrame:
        """key, value_id, value: the texts of all registered values, row by row; `rows` are some of the side's."""
        pairs = F.array(*[F.struct(F.lit(i).alias("value_id"), v.cast("string").alias("value")) for i, v in self._values.values()])
        return rows.select(*self.key, F.explode(pairs).alias("p")).select(*self.key, "p.*").filter(F.col("value").isNotNull())
