"""Comparison of two tables group by group.

Each side is aggregated once by the group key, the two aggregates meet in one full outer join on that
key, and every mapping and business rule is one column over the joined row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import errors as E
from concord.functions.numbers import (
    NUMBER, col, differs, formula_of, number_text_of, plain,
)
from concord.functions.text import clean, concat_columns, date_text
from concord.operators import defects, values
from concord.operators.fingerprint_diff import fingerprint_gaps, new_fingerprint, old_fingerprint
from concord.operators.joins import only_keys
from concord.operators.rows import DATE_TRANSFORM, transformed_equal
from concord.operators.sides import Side
from concord.rules import DefRule, Mappings
from concord.sources.scratch import stored


def _unequal(n: dict[str, Column]) -> Column:
    """Both sides have values, and not the same ones."""
    return (n["so"] > 0) & (n["sn"] > 0) & (n["xo"] + n["xn"] > 0)


class GroupComparison:
    def __init__(
        self,
        old: DataFrame,
        new: DataFrame | Side,
        key: list[str],
        mappings: Mappings,
        tolerance: float = 0,
        noisy: set[str] = frozenset(),
        defs: tuple[DefRule, ...] = (),
        known_codes: frozenset[str] | None = None,
        fingerprint: tuple[tuple[str, str, bool], ...] = (),
        report_extra: bool = True,
        blank_as_zero: bool = False,
        new_key: list[str] | None = None,
        union_mode: bool = False,
        old_anchor: str | None = None,
        new_anchor: str | None = None,
        old_key: list[str] | None = None,
        translate: Callable[[DataFrame], DataFrame] | None = None,
        more_checks: Callable[[Column], list[E.Check]] | None = None,
        skipped: Column | None = None,
    ):
        """`new` is a table, or a shared Side of several comparisons. `old_key` and `translate`: the old side is
        aggregated by `old_key`, and `translate` adds the rest of `key` to what comes out. `skipped`: groups that are
        neither passed nor failed. `more_checks`: checks of old groups without a counterpart, given the group's name."""
        self.spark = old.sparkSession
        self.key, self.new_key = key, new_key or key
        self.old = Side(old, "old", old_key or self.key)
        self.new = new if isinstance(new, Side) else Side(new, "new", self.new_key)
        self.translate, self.more_checks, self.skipped = translate, more_checks, F.lit(False) if skipped is None else skipped
        self.mappings, self.tolerance, self.noisy = mappings, tolerance, noisy
        self.defs, self.known_codes = defs, known_codes
        self.fingerprint, self.report_extra = fingerprint, report_extra
        self.blank_as_zero, self.union_mode = blank_as_zero, union_mode
        self.anchors = (old_anchor, new_anchor)
        self.group_key = F.concat_ws("::", *[F.col(k) for k in self.shown_key()])
        self.sets: list[int] = []
        # Per set: when its values tell the sides apart, the mapping's name, and the sides to give.
        self.set_failures: dict[int, tuple[Column, str, list[str]]] = {}
        # Old and new values of the sets that pass where both sides hold the same values; the others' numbers.
        self.alike: list[tuple[Column, Column]] = []
        self.other_sets: list[int] = []
        self.mapping_checks: list[E.Check] = []
        self.def_checks: list[E.Check] = []
        self.extra_columns: dict[str, Column] = {}
        self.broken_rules: list[dict] = []
        self.old_sets: dict[int, list[int]] = {}
        self.new_sets: dict[int, list[int]] = {}
        self._prepare()
        # The values of all such sets as one multiset per group and side: a group that agrees in it needs no sets.
        self.set_hashes: list[tuple[Column, Column]] = []
        if self.alike:
            self.set_hashes = list(zip(*[side.multisets(own) for side, own in zip((self.old, self.new), zip(*self.alike))]))
        self.hashes: list[tuple[Column, Column]] = []
        if fingerprint:
            self.hashes = list(zip(self.old.multiset(old_fingerprint(self.old.df, fingerprint)), self.new.multiset(new_fingerprint(self.new.df, fingerprint))))

    def shown_key(self) -> list[str]:
        return self.new_key

    # ---- checks -----------------------------------------------------------------------------------

    def _prepare(self) -> None:
        if self.union_mode:
            self._union_checks()
        else:
            self._exact()
            self._split()
            self._transformed()
            self._concat()
            self._formula()
            self._filtered_sum()
            self._subset()
        self._defs()

    def _skip(self, *columns: str) -> bool:
        return any(c in self.noisy for c in columns)

    def _mismatch(self, test: Column, old_column, new_column, old_value=None, new_value=None, set_id=None, text=None) -> E.Check:
        """Test and error. For a set of values the error gives their numbers; `differences` gives the values."""
        if set_id is not None:
            old_value, new_value = self._counted(set_id, "o"), self._counted(set_id, "n")
        what = text or f"Value mismatch [{old_column}->{new_column}]"
        message = F.lit(what) if old_value is None else F.concat(
            F.lit(what + ": "), F.coalesce(old_value, F.lit("null")), F.lit(" <> "), F.coalesce(new_value, F.lit("null"))
        )
        made = E.error(
            E.VALUE_MISMATCH, group_key=self.group_key, old_column=old_column, new_column=new_column,
            old_value=old_value, new_value=new_value, message=message,
        )
        return test, made

    @staticmethod
    def _counted(set_id: int, side: str) -> Column:
        all_, only = (F.coalesce(F.col(f"{n}{side}_{set_id}"), F.lit(0)).cast("string") for n in "sx")
        return F.concat(all_, F.lit(" distinct values, "), only, F.lit(" only here"))

    def _set(
        self, old_value: Column | None, new_value: Column | None, test: Callable[[dict[str, Column]], Column], name: str,
        sides: tuple[str, ...] = ("old_only", "new_only"), same_passes: bool = True,
    ) -> tuple[int, Column]:
        """Add a pair of value sets; `test` says from their four counts whether they are worth an error. `same_passes`:
        it never does where both sides hold the same values."""
        i = len(self.sets)
        self.sets.append(i)
        for value, side, sets in ((old_value, self.old, self.old_sets), (new_value, self.new, self.new_sets)):
            if value is not None:
                sets.setdefault(side.ask_values(value), []).append(i)
        if same_passes:
            self.alike.append((old_value, new_value))
        else:
            self.other_sets.append(i)
        fails = test({n: F.coalesce(F.col(f"{n}_{i}"), F.lit(0)) for n in ("so", "sn", "xo", "xn")})
        self.set_failures[i] = (fails, name, list(sides))
        return i, fails

    def _value(self, side: Side, name: str) -> Column:
        text = number_text_of(side.df, name)
        return F.coalesce(text, F.lit("0")) if self.blank_as_zero else text

    def _exact(self) -> None:
        for m in self.mappings.exact:
            if self._skip(m.old):
                continue
            i, test = self._set(self._value(self.old, m.old), self._value(self.new, m.new), _unequal, f"{m.old}->{m.new}")
            self.mapping_checks.append(self._mismatch(test, m.old, m.new, set_id=i))

    def _split(self) -> None:
        for m in self.mappings.split:
            if self._skip(m.old):
                continue
            total = self.old.strict_sum(m.old)
            computed = formula_of(m.formula, [self.new.strict_sum(c) for c in m.new_cols])
            odd = reduce(lambda a, b: a | b, [self.old.unsummable(m.old), *[self.new.unsummable(c) for c in m.new_cols]])
            self.mapping_checks.append(self._mismatch(
                odd | differs(total, computed, self.tolerance), m.old, "+".join(m.new_cols), plain(total), plain(computed),
                text=f"Split formula mismatch [{m.old}]",
            ))

    def _transformed(self) -> None:
        for m in self.mappings.transformed:
            if self._skip(m.old):
                continue
            if m.transform == DATE_TRANSFORM:
                i, test = self._set(date_text(col(m.old)), date_text(col(m.new)), _unequal, f"{m.old}->{m.new}")
                self.mapping_checks.append(self._mismatch(test, m.old, m.new, set_id=i))
                continue
            a, b = self.old.strict_sum(m.old), self.new.strict_sum(m.new)
            odd = self.old.unsummable(m.old) | self.new.unsummable(m.new)
            self.mapping_checks.append(self._mismatch(
                odd | differs(a, b, self.tolerance), m.old, m.new, plain(a), plain(b),
                text=f"Group sum mismatch [{m.old}->{m.new}]",
            ))

    def _concat(self) -> None:
        for m in self.mappings.concat:
            if self._skip(*m.old_cols):
                continue
            left = concat_columns([col(c) for c in m.old_cols], m.separator)
            right = F.coalesce(F.trim(col(m.new).cast("string")), F.lit(""))
            name = "+".join(m.old_cols)
            i, test = self._set(left, right, lambda n: n["xo"] + n["xn"] > 0, f"{name}->{m.new}")
            self.mapping_checks.append(self._mismatch(
                test, name, m.new, set_id=i, text=f"Concat mismatch [{name}->{m.new}]",
            ))

    def _formula(self) -> None:
        for m in self.mappings.formula:
            if self._skip(*m.old_cols):
                continue
            inputs = [self.old.strict_sum(c) for c in m.old_cols]
            complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in inputs])
            computed, total = formula_of(m.formula, inputs), self.new.strict_sum(m.new)
            name = ("-" if m.formula == "SUBTRACT" else "+").join(m.old_cols)
            odd = reduce(lambda a, b: a | b, [self.new.unsummable(m.new), *[self.old.unsummable(c) for c in m.old_cols]])
            self.mapping_checks.append(self._mismatch(
                odd | (complete & differs(computed, total, self.tolerance)), name, m.new, plain(computed), plain(total),
                text=f"Formula mismatch [{m.formula}({','.join(m.old_cols)})->{m.new}]",
            ))

    def _filtered_sum(self) -> None:
        zero = F.lit(0).cast(NUMBER)
        for m in self.mappings.filtered_sum:
            if self._skip(m.old):
                continue
            a = F.coalesce(self.old.strict_sum(m.old, m.old_filter), zero)
            b = F.coalesce(self.new.strict_sum(m.new, m.new_filter), zero)
            test = differs(a, b, self.tolerance) | self.old.unsummable(m.old, m.old_filter) | self.new.unsummable(m.new, m.new_filter)
            if m.skip_if_old_empty:
                test = test & (self.old.filter_hits(m.old_filter) > 0)
            name = f"{m.old}[{m.old_filter.label()}]"
            self.mapping_checks.append(self._mismatch(
                test, name, m.new, plain(a), plain(b), text=f"Filtered sum mismatch [{name}->{m.new}]",
            ))

    def _subset(self) -> None:
        for m in self.mappings.subset:
            if self._skip(m.old):
                continue
            i, test = self._set(
                number_text_of(self.old.df, m.old), number_text_of(self.new.df, m.new), lambda n: n["xo"] > 0,
                f"{m.old}->{m.new}", ("old_only",),
            )
            self.mapping_checks.append(self._mismatch(
                test, m.old, m.new, set_id=i, text=f"Old values missing in new [{m.old}->{m.new}]",
            ))

    def _union_checks(self) -> None:
        """Sums where every value of both sides is a number, else sets of distinct values without case."""
        for m in self.mappings.exact:
            if self._skip(m.old):
                continue
            numeric = (self.old.text_values(m.old) == 0) & (self.new.text_values(m.new) == 0)
            a, b = self.old.strict_sum(m.old), self.new.strict_sum(m.new)
            i, in_sets = self._set(F.lower(clean(col(m.old))), F.lower(clean(col(m.new))), _unequal, f"{m.old}->{m.new}")
            sums = F.when(numeric, differs(a, b, self.tolerance)).otherwise(F.lit(False))
            self.mapping_checks.append(self._mismatch(
                sums, m.old, m.new, plain(a), plain(b), text=f"Group sum mismatch [{m.old}->{m.new}]",
            ))
            as_sets = ~F.coalesce(numeric, F.lit(False)) & in_sets
            self.set_failures[i] = (as_sets, *self.set_failures[i][1:])
            self.mapping_checks.append(self._mismatch(as_sets, m.old, m.new, set_id=i))
        old_anchor, new_anchor = self.anchors
        for m in self.mappings.transformed:
            if self._skip(m.old):
                continue
            a = self.old.first_value(m.old, old_anchor)
            b = self.new.first_value(m.new, new_anchor)
            self.mapping_checks.append(self._mismatch(
                ~transformed_equal(a, b, m.transform, self.tolerance), m.old, m.new, a, b,
                text=f"Transform mismatch [{m.old}->{m.new}]",
            ))

    def _defs(self) -> None:
        for r, rule in enumerate(self.defs):
            fires = defects.trigger_of(rule.trigger, self.old, self.group_key, self.known_codes)
            for a, action in enumerate(rule.actions):
                when = fires & defects.trigger_of(action.trigger, self.old, self.group_key, self.known_codes)
                set_id = None
                try:
                    if action.check_type == "ROW_LEVEL_COHESION":
                        compiled = defects.compile_cohesion(
                            self.spark, rule, action, f"d{r}_{a}", self.old, self.new, when, self.tolerance
                        )
                    elif action.check_type == "FIELD_VALUE_CHECK":
                        compiled = defects.compile_value_check(rule, action, self.old, self.new, when)
                        set_id = self._value_check_set(rule, action)
                    else:
                        continue
                except defects.RuleError as problem:
                    self.broken_rules.append({
                        "error_type": E.TRANSFORM_ERROR, "def_id": rule.def_id,
                        "message": f"rule cannot be evaluated ({rule.def_id}): {problem}",
                    })
                    continue
                self.extra_columns.update(compiled.columns)
                made = compiled.error(self.group_key)
                if set_id is not None:
                    self.set_failures[set_id] = (compiled.broken, *self.set_failures[set_id][1:])
                    made = self._with_counts(made, set_id)
                self.def_checks.append((compiled.broken, made))

    def _with_counts(self, made: Column, set_id: int) -> Column:
        waiting, bad = (F.coalesce(F.col(f"{n}_{set_id}"), F.lit(0)).cast("string") for n in ("so", "sn"))
        text = F.concat(made["message"], F.lit(" - "), waiting, F.lit(" old values, "), bad, F.lit(" new values"))
        return made.withField("message", text).withField("old_value", waiting).withField("new_value", bad)

    def _value_check_set(self, rule: DefRule, action) -> int:
        """Failing new values, and old values that should have been converted; listed, never compared."""
        new_col, old_col, permitted, pattern = defects.value_check_parts(rule, action, self.old, self.new)
        bad = F.when(F.coalesce(F.trim(col(new_col).cast("string")), F.lit("")).rlike(f"(?i){pattern}"), clean(col(new_col)))
        waiting = None
        if old_col:
            waiting = clean(col(old_col))
            if permitted:
                waiting = F.when(F.upper(waiting) != permitted.upper(), waiting)
        return self._set(waiting, bad, lambda n: n["sn"] > 0, rule.def_id, ("old_only", "new_only", "both"), same_passes=False)[0]

    # ---- frames -----------------------------------------------------------------------------------

    @cached_property
    def _old_groups(self) -> DataFrame:
        groups = self.old.aggregated()
        return self.translate(groups) if self.translate else groups

    @cached_property
    def _met(self) -> DataFrame:
        """The groups of both sides with their aggregates, a row per group of either side; stored where they are read again."""
        met = self._old_groups.join(self.new.aggregated(), self.new_key, "full_outer")
        return stored(met, "met") if self.sets else met

    def _described(self, groups: DataFrame) -> DataFrame:
        n_old, n_new = F.coalesce(self.old.rows(), F.lit(0)), F.coalesce(self.new.rows(), F.lit(0))
        groups = groups.withColumns({"rows_old": n_old, "rows_new": n_new})
        return groups.withColumns(self.extra_columns) if self.extra_columns else groups

    @cached_property
    def _unlike(self) -> DataFrame:
        """Keys of the groups whose values have to be listed: groups of both sides that differ as multisets, or fail a
        check that goes by other things."""
        tests = [~F.coalesce(a == b, F.lit(False)) for a, b in self.set_hashes] + [F.coalesce(self.set_failures[i][0], F.lit(False)) for i in self.other_sets]
        both = (F.col("rows_old") > 0) & (F.col("rows_new") > 0)
        return stored(self._described(self._met).filter(both & reduce(lambda a, b: a | b, tests)).select(*self.key), "unlike")

    def _values_of(self, side: Side) -> DataFrame:
        """Values of the groups that are unlike; rows of the others do not move."""
        keys = self._unlike if side.key == self.key else stored(self._unlike.select(*side.key).distinct(), "keys")
        return side.values(only_keys(side.df, keys, side.key))

    @cached_property
    def value_table(self) -> DataFrame | None:
        """The values of the unlike groups of both sides, stored: the counts of the sets and `differences` read them."""
        if not self.sets:
            return None
        old = self._values_of(self.old) if self.old_sets else None
        if old is not None and self.translate:
            old = self.translate(old.distinct())
        new = self._values_of(self.new) if self.new_sets else None
        if new is not None and self.key != self.new_key:
            new = new.distinct().join(self._unlike, self.new_key)
        return stored(values.value_table(old, new, self.key, self.old_sets, self.new_sets), "values")

    @cached_property
    def joined(self) -> DataFrame:
        """A row per group of either side. Built when every comparison that shares a side has asked for what it needs."""
        both = self._met
        if self.sets:
            both = both.join(values.set_counts(self.value_table, self.key, self.sets), self.key, "left")
        both = self._described(both)
        in_old, in_new = F.col("rows_old") > 0, F.col("rows_new") > 0
        alone = in_old & ~in_new & ~self.skipped
        more = [(alone & test, made) for test, made in (self.more_checks(self.group_key) if self.more_checks else [])]
        missing = (
            alone & ~E.any_holds(more),
            E.error(E.ROW_MISSING, group_key=self.group_key, message=F.concat(
                F.lit("Group ["), self.group_key, F.lit("] found in source but not in target"))),
        )
        extra = (
            in_new & ~in_old,
            E.error(E.ROW_MISSING, group_key=self.group_key, message=F.concat(
                F.lit("Group ["), self.group_key, F.lit("] found in target but not in source (extra)"))),
        )
        compared = in_old & in_new
        mapped = [(compared & test, made) for test, made in self.mapping_checks]
        ruled = [(compared & test, made) for test, made in self.def_checks]
        self.checks = [missing, *more, *([extra] if self.report_extra else []), *mapped, *ruled]
        unlike = F.lit(False)
        for a, b in self.hashes:
            unlike = unlike | ~a.eqNullSafe(b)
        return both.withColumns({
            "mapping_failed": E.any_holds(mapped), "failed": E.any_holds([missing, *more, *mapped, *ruled]),
            "rows_differ": unlike, "skipped": self.skipped & in_old,
        })

    @cached_property
    def judged(self) -> DataFrame:
        """The verdict, errors and failing sets of every group, stored: errors, accounting, groups and differences of a
        run come from here, so the tables are compared once however many reports are written."""
        picks = [
            (F.struct(F.lit(i).alias("set_id"), F.lit(name).alias("mapping"), F.array(*map(F.lit, sides)).alias("wanted")), fails)
            for i, (fails, name, sides) in self.set_failures.items()
        ]
        both = (F.col("rows_old") > 0) & (F.col("rows_new") > 0)
        joined = self.joined
        wanted = [E.held([(both & fails, made) for made, fails in picks]).alias("sets")] if picks else []
        return stored(joined.select(
            *self.key, "rows_old", "rows_new", "mapping_failed", "failed", "rows_differ", "skipped", E.held(self.checks).alias("found"), *wanted), "judged")

    def groups(self) -> DataFrame:
        """Key, rows on either side and verdict of every group."""
        return self.judged.select(*self.key, "rows_old", "rows_new", "mapping_failed", "failed")

    def errors(self) -> DataFrame:
        """Error rows without rule and table names."""
        found = E.explode_errors(self.judged.filter(F.size("found") > 0), "found")
        if self.fingerprint:
            found = found.unionByName(self._fingerprint_errors())
        return found

    def _fingerprint_errors(self) -> DataFrame:
        failing = self.judged.filter("mapping_failed and rows_differ").select(*self.key)
        gaps = fingerprint_gaps(self.old.df, self.new.df, self.key, self.fingerprint, failing)
        message = F.concat(
            F.lit("[FP] "), F.col("copies").cast("string"),
            F.when(F.col("side") == "missing_in_target", F.lit("x in source not in target")).otherwise(
                F.lit("x extra in target not in source")),
            F.lit(" | "), F.col("fingerprint"),
        )
        value = F.col("fingerprint")
        is_missing = F.col("side") == "missing_in_target"
        return gaps.select(E.error(
            E.ROW_MISSING, group_key=self.group_key, message=message,
            old_value=F.when(is_missing, value), new_value=F.when(~is_missing, value),
        ).alias("e")).select("e.*")

    def differences(self) -> DataFrame | None:
        """Every value that tells the sides of a failing mapping or value check apart: key, mapping, value, side."""
        if self.value_table is None:
            return None
        failing = self.judged.select(*self.key, F.explode("sets").alias("w")).select(*self.key, "w.*")
        return values.differences(self.value_table, failing, self.key)

    def accounting(self) -> DataFrame:
        """Old rows checked, in groups without and with errors."""
        rows = F.col("rows_old")
        zero = F.lit(0).cast("long")
        return self.judged.agg(
            F.coalesce(F.sum(rows), zero).alias("rows_checked"),
            F.coalesce(F.sum(F.when(~F.col("failed") & ~F.col("skipped"), rows)), zero).alias("pass_rows"),
            F.coalesce(F.sum(F.when(F.col("failed"), rows)), zero).alias("fail_rows"),
        )
