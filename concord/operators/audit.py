"""Row rules: each gives counts of rows (or groups) that pass and fail.

The rules of a run share two aggregations over the table: one for the mean sizes their tolerances need,
one for all counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.formulas import Likeness, row_formula
from concord.functions.numbers import col, number_of
from concord.operators.joins import even_join
from concord.sources.scratch import stored

# Pass rates of a good and of a doubtful rule.
PASS_RATE, WARN_RATE = 0.95, 0.80


@dataclass(frozen=True)
class RowRule:
    rule_id: str
    kind: str = "COMPARE"
    source: str | None = None
    target: str | None = None
    formula: str | None = None
    scope: str = "ROW"
    severity: str = "WARNING"
    name: str | None = None
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class PairRule:
    """Compares a column or formula of one source with one of another."""

    rule_id: str
    a: str
    b: str
    source_a: str
    source_b: str
    severity: str = "WARNING"
    name: str | None = None


def rate_status(rate: Column) -> Column:
    return F.when(rate >= PASS_RATE, "PASS").when(rate >= WARN_RATE, "WARN").otherwise("FAIL")


def likeness_of(df: DataFrame, rule: RowRule, tolerance: float) -> Likeness | None:
    """Both sides of a comparing rule, None if the rule names nothing that exists."""
    if rule.target not in df.columns:
        return None
    if rule.formula:
        left = row_formula(df, rule.formula)
    else:
        left = col(rule.source) if rule.source in df.columns else None
    return None if left is None else Likeness(left, col(rule.target), tolerance)


def row_test(df: DataFrame, rule: RowRule) -> Column | None:
    """Row test of a rule that needs no mean."""
    name = rule.target or rule.source
    if name not in df.columns:
        return None
    if rule.kind == "NOT_NULL":
        return col(name).isNotNull()
    if rule.kind == "RANGE":
        number = number_of(df, name)
        test = F.lit(True)
        if rule.low is not None:
            test = test & F.coalesce(number >= rule.low, F.lit(False))
        if rule.high is not None:
            test = test & F.coalesce(number <= rule.high, F.lit(False))
        return test
    return None


def _entry(rule, scope: str, passed: Column, failed: Column) -> Column:
    rate = F.when(passed + failed > 0, passed / (passed + failed)).otherwise(0.0)
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.name or rule.rule_id).alias("rule_name"), F.lit(scope).alias("scope"),
        F.lit(rule.severity).alias("severity"), passed.cast("long").alias("pass_count"), failed.cast("long").alias("fail_count"),
        rate.alias("pass_rate"), rate_status(rate).alias("status"),
    )


def _exploded(totals: DataFrame, entries: list[Column]) -> DataFrame:
    return totals.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def audit_rows(df: DataFrame, rules: Sequence[RowRule], tolerance: float = 0.01) -> DataFrame:
    """rule_id, rule_name, scope, severity, pass_count, fail_count, pass_rate, status.

    A rule that cannot be evaluated fails every row.
    """
    likes = {r.rule_id: likeness_of(df, r, tolerance) for r in rules if r.kind in ("COMPARE", "EQUAL", "FORMULA")}
    usable = {k: v for k, v in likes.items() if v is not None}
    means = {}
    if usable:
        # One row of means, computed first; every rule reads its own field of it.
        one = df.agg(F.struct(*[v.mean_size().alias(f"m{i}") for i, v in enumerate(usable.values())]).alias("m")).scalar()
        means = {k: one[f"m{i}"] for i, k in enumerate(usable)}
    counts, entries = [F.count(F.lit(1)).alias("n_rows")], []
    uniques = [r for r in rules if r.kind == "UNIQUE"]
    for i, rule in enumerate(rules):
        if rule.kind == "UNIQUE":
            continue
        if rule.rule_id in usable:
            test = usable[rule.rule_id].holds(means[rule.rule_id])
        else:
            test = row_test(df, rule)
        counts.append(F.count_if(F.lit(False) if test is None else test).alias(f"p{i}"))
        entries.append(_entry(rule, "ROW", F.col(f"p{i}"), F.col("n_rows") - F.col(f"p{i}")))
    parts = [_exploded(df.agg(*counts), entries)] if entries else []
    parts += [unique_result(df, r) for r in uniques]
    return _stack(parts)


def _stack(parts: list[DataFrame]) -> DataFrame:
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part)
    return frame


def unique_result(df: DataFrame, rule: RowRule) -> DataFrame:
    """UNIQUE: the first row of each value passes, so as many rows pass as there are values (null is one)."""
    name = rule.target or rule.source
    groups = df.groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return _exploded(totals, [_entry(rule, "ROW", F.col("values"), F.col("n_rows") - F.col("values"))])


def repeated_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after the first of their key, in the order of a column: all but the kept ones.

    The kept row is found by its smallest order value; no group is sorted in one task.
    """
    first = df.groupBy(col(key).alias("k")).agg(F.min(col(order)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keep = first.select(F.col("k").alias(key), "first")
    return even_join(df, keep, [key], "inner").filter(col(order) != F.col("first")).drop("first")


def audit_groups(df: DataFrame, key: str, rules: Sequence[RowRule], tolerance: float = 0.01) -> DataFrame:
    """GROUP rules: a group passes if all its rows do; the tolerance follows the mean of the group.

    The tolerance is one number per group, so all rows hold exactly when the widest gap does: one
    aggregation, no second look at the rows. Rules of ROW scope are judged by row.
    """
    grouped = [r for r in rules if r.scope == "GROUP" and r.formula and r.target]
    by_row = [r for r in rules if r not in grouped]
    parts = []
    if grouped:
        likes = [likeness_of(df, r, tolerance) for r in grouped]
        known = [(r, v) for r, v in zip(grouped, likes) if v is not None]
        aggregates = []
        for i, (_, like) in enumerate(known):
            aggregates += [like.mean_size().alias(f"m{i}"), like.widest_gap().alias(f"g{i}"), like.text_failures().alias(f"t{i}")]
        groups = df.filter(col(key).isNotNull()).groupBy(col(key)).agg(*aggregates)
        counts = [F.count(F.lit(1)).alias("n_groups")]
        entries = []
        for i, (rule, like) in enumerate(known):
            good = (F.col(f"t{i}") == 0) & (F.col(f"g{i}").isNull() | (F.col(f"g{i}") <= like.allowed(F.col(f"m{i}"))))
            counts.append(F.count_if(good).alias(f"p{i}"))
            entries.append(_entry(rule, "GROUP", F.col(f"p{i}"), F.col("n_groups") - F.col(f"p{i}")))
        parts.append(_exploded(groups.agg(*counts), entries))
    if by_row:
        parts.append(audit_rows(df, by_row, tolerance))
    return _stack(parts)


def aligned(sources: dict[str, DataFrame], key: str, values: Sequence[tuple[str, Column]]) -> DataFrame:
    """align_key, v0, v1...: all values (source and column) of all sources, a row per key; and s0, s1...: whether a
    source has the key.

    One aggregation of the tagged sources, whatever their number: each is reduced to a row per key before the shuffle.
    Of a repeated key the smallest value counts, for every value by itself.
    """
    names, tagged = list(dict.fromkeys(s for s, _ in values)), []
    for name in names:
        df = sources[name]
        own = {f"v{i}": value.alias(f"v{i}") for i, (s, value) in enumerate(values) if s == name}
        own |= {f"s{names.index(name)}": F.lit(True).alias(f"s{names.index(name)}")}
        tagged.append(df.filter(col(key).isNotNull()).select(col(key).alias("align_key"), *own.values()))
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    columns = [f"v{i}" for i in range(len(values))]
    flags = [F.coalesce(F.max(f"s{i}"), F.lit(False)).alias(f"s{i}") for i in range(len(names))] if len(names) > 1 else [F.lit(True).alias("s0")]
    return rows.groupBy("align_key").agg(*[F.min(c).alias(c) for c in columns], *flags)


def audit_pairs(sources: dict[str, DataFrame], key: str, rules: Sequence[PairRule], tolerance: float = 0.01) -> DataFrame:
    """Rules between aligned sources; keys only one source of a rule has are left out.

    The sources are aligned once, for all rules; two more aggregations over the aligned rows give the means that the
    tolerances follow and the counts.
    """
    values: list[tuple[str, Column]] = []
    places: dict[tuple[str, str], int] = {}
    for rule in rules:
        for source, formula in ((rule.source_a, rule.a), (rule.source_b, rule.b)):
            value = row_formula(sources[source], formula)
            if value is None:
                raise ValueError(f"{rule.rule_id}: cannot evaluate {rule.a!r} or {rule.b!r}")
            if (source, formula) not in places:
                places[source, formula] = len(values)
                values.append((source, value))
    names = list(dict.fromkeys(s for s, _ in values))
    rows = stored(aligned(sources, key, values), "aligned")
    likes = []
    for rule in rules:
        both = F.col(f"s{names.index(rule.source_a)}") & F.col(f"s{names.index(rule.source_b)}")
        a, b = (F.when(both, F.col(f"v{places[place]}")) for place in ((rule.source_a, rule.a), (rule.source_b, rule.b)))
        likes.append((both, Likeness(a, b, tolerance)))
    means = rows.agg(F.struct(*[like.mean_size().alias(f"m{i}") for i, (_, like) in enumerate(likes)]).alias("m")).scalar()
    counts, entries = [], []
    for i, (rule, (both, like)) in enumerate(zip(rules, likes)):
        counts += [F.count_if(both).alias(f"n{i}"), F.count_if(both & like.holds(means[f"m{i}"])).alias(f"p{i}")]
        entries.append(_entry(rule, "PAIR", F.col(f"p{i}"), F.col(f"n{i}") - F.col(f"p{i}")))
    return _exploded(rows.agg(*counts), entries)


def tag_codes(df: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """Adds affect_tag and affect_category from a code list (code, description, category)."""
    lookup = codes.select(
        F.upper(F.trim("code")).alias("_code"), F.col("description").alias("_tag"), F.col("category").alias("_category")
    ).groupBy("_code").agg(F.min("_tag").alias("_tag"), F.min("_category").alias("_category"))
    given = F.upper(F.trim(col(code).cast("string")))
    tagged = even_join(df.withColumn("_code", given), lookup, ["_code"], "left")
    is_null = F.col("_code").isNull()
    return tagged.withColumns({
        "affect_tag": F.when(is_null, "NULL").otherwise(F.coalesce("_tag", F.concat(F.lit("UNKNOWN:"), F.col("_code")))),
        "affect_category": F.when(is_null, "NULL").otherwise(F.coalesce("_category", F.lit("UNKNOWN"))),
    }).drop("_code", "_tag", "_category")


def audit_summary(results: DataFrame) -> DataFrame:
    """Rules by status and the ids of critical ones that fail; a row per rule goes in, one comes out."""
    critical = F.when((F.col("status") == "FAIL") & (F.col("severity") == "CRITICAL"), F.col("rule_id"))
    return results.agg(
        F.count(F.lit(1)).alias("total_rules"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL")],
        F.array_sort(F.collect_list(critical)).alias("critical_failures"),
    )
