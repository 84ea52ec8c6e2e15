"""Row comparison: each source row against the target row with the same key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord import errors as E
from concord.functions.numbers import (
    NUMBER, differs, equal_numbers, equal_texts, formula_of, plain, to_number,
)
from concord.functions.text import clean, concat_columns, date_text, transform
from concord.rules import Mappings

DATE_TRANSFORM = "DATE_TO_DATETIME"


def transformed_equal(old: Column, new: Column, rule: str | None, tolerance: float) -> Column:
    """Old value after its transform against the new one; dates are cut to the day on both sides."""
    right = date_text(new) if rule == DATE_TRANSFORM else clean(new)
    return equal_texts(transform(old, rule), right, tolerance)


@dataclass
class RowSide:
    """Columns of one side in the joined row, and which of them are typed numbers."""

    column: Callable[[str], Column]
    numeric: Callable[[str], bool]

    def number(self, name: str) -> Column:
        return self.column(name).try_cast(NUMBER) if self.numeric(name) else to_number(self.column(name))


class RowChecks:
    """One check per mapping, over values that are prepared once per row.

    `prepared` must be added to the joined rows before the checks are evaluated: a check uses its values
    several times, and an expression repeated inside others would be evaluated, and planned, each time.
    """

    def __init__(self, mappings: Mappings, noisy: set[str], tolerance: float, old: RowSide, new: RowSide, row_id: Column):
        self.old, self.new, self.tolerance, self.row_id = old, new, tolerance, row_id
        self.prepared: dict[str, Column] = {}
        self.checks: list[E.Check] = []
        self._equalities(mappings, noisy)
        self._formulas(mappings, noisy)

    def _keep(self, value: Column) -> Column:
        name = f"v{len(self.prepared)}"
        self.prepared[name] = value
        return F.col(name)

    def _add(self, test: Column, old_column: str, new_column: str, old_value: Column, new_value: Column, what: str) -> None:
        shown_old, shown_new = old_value.cast("string"), new_value.cast("string")
        self.checks.append((test, E.error(
            E.VALUE_MISMATCH, row_id=self.row_id, old_column=old_column, new_column=new_column,
            old_value=shown_old, new_value=shown_new,
            message=F.concat(
                F.lit(f"{what} [{old_column}->{new_column}]: "), F.coalesce(shown_old, F.lit("null")),
                F.lit(" <> "), F.coalesce(shown_new, F.lit("null")),
            ),
        )))

    def _equal(self, old_name: str, new_name: str, rule: str | None) -> Column:
        if rule in (None, "NONE") and self.old.numeric(old_name) and self.new.numeric(new_name):
            return equal_numbers(self.old.number(old_name), self.new.number(new_name), self.tolerance)
        new_value = self.new.column(new_name)
        right = date_text(new_value) if rule == DATE_TRANSFORM else clean(new_value)
        return equal_texts(self._keep(transform(self.old.column(old_name), rule)), self._keep(right), self.tolerance)

    def _equalities(self, mappings: Mappings, noisy: set[str]) -> None:
        for kind, matches in (("Mismatch", mappings.exact), ("Transform mismatch", mappings.transformed)):
            for m in matches:
                if m.old not in noisy:
                    test = ~self._equal(m.old, m.new, m.transform)
                    self._add(test, m.old, m.new, self.old.column(m.old), self.new.column(m.new), kind)
        for m in mappings.concat:
            if not noisy & set(m.old_cols):
                joined = self._keep(F.nullif(F.trim(concat_columns([self.old.column(c) for c in m.old_cols], m.separator)), F.lit("")))
                value = self._keep(clean(self.new.column(m.new)))
                self._add(~equal_texts(joined, value, self.tolerance), "+".join(m.old_cols), m.new, joined, value, "Concat mismatch")

    def _formulas(self, mappings: Mappings, noisy: set[str]) -> None:
        zero = F.lit(0).cast(NUMBER)

        def lenient(side: RowSide, name: str) -> Column:
            """Number, zero for null, null for text that is no number."""
            return F.coalesce(side.number(name), F.when(side.column(name).isNull(), zero))

        for m in mappings.split:
            if m.old not in noisy:
                total = self._keep(lenient(self.old, m.old))
                computed = self._keep(formula_of(m.formula, [self.new.number(c) for c in m.new_cols]).cast("decimal(38,8)"))
                self._add(differs(total, computed, self.tolerance), m.old, "+".join(m.new_cols), plain(total), plain(computed),
                          "Split formula mismatch")
        for m in mappings.formula:
            if not noisy & set(m.old_cols):
                complete = reduce(lambda a, b: a & b, [self.old.column(c).isNotNull() for c in m.old_cols])
                computed = self._keep(formula_of(m.formula, [self.old.number(c) for c in m.old_cols]).cast("decimal(38,8)"))
                value = self._keep(lenient(self.new, m.new))
                name = ("-" if m.formula == "SUBTRACT" else "+").join(m.old_cols)
                self._add(complete & differs(computed, value, self.tolerance), name, m.new, plain(computed), plain(value),
                          "Formula mismatch")
