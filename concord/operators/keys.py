"""Questions about keys, codes and totals that precede the writing of a rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.numbers import NUMBER, col, number_of, tolerance_of


def rows_per_key(df: DataFrame, *keys: str, name: str = "n_rows") -> DataFrame:
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def key_cardinality(df: DataFrame, key: str, many: int = 10) -> DataFrame:
    """Keys, rows, and rows per key: smallest, largest, mean, keys with one row, keys with more than `many`."""
    n = F.col("n_rows")
    return rows_per_key(df, key).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(n).alias("n_rows"),
        F.min(n).alias("min_rows"),
        F.max(n).alias("max_rows"),
        F.avg(n).alias("avg_rows"),
        F.count_if(n == 1).alias("single_row_keys"),
        F.count_if(n > many).alias("many_row_keys"),
    )


def key_dependency(df: DataFrame, key: str, partner: str) -> DataFrame:
    """Keys with more than one distinct partner: the partner does not depend on the key alone."""
    pairs = df.filter(col(key).isNotNull() & (col(key).cast("string") != "") & col(partner).isNotNull())
    return (
        pairs.select(col(key).alias("key"), col(partner).alias("partner")).distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("n_partners")).filter("n_partners > 1")
    )


def largest(df: DataFrame, measure: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest measure; ties in a fixed order."""
    return df.orderBy(F.col(measure).desc(), *[F.col(t) for t in ties]).limit(n)


def key_scatter(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """How far the rows of a key lie apart: (largest id - smallest id + 1) / rows."""
    return df.groupBy(col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.max(col(row_id)) - F.min(col(row_id)) + 1) / F.count(F.lit(1))).alias("scatter"),
    )


def column_equality(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.agg(
        F.count_if(col(left) == col(right)).alias("n_equal"),
        F.count_if(col(left) != col(right)).alias("n_different"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def nonzero_pivot(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per code: in how many rows each column is not zero."""
    return df.groupBy(*[col(b) for b in by]).agg(
        *[F.count_if(number_of(df, c) != 0).alias(f"nonzero_{c}") for c in columns],
        F.count(F.lit(1)).alias("n_rows"),
    )


def nonzero_parity(old: DataFrame, new: DataFrame, old_column: str, new_column: str) -> DataFrame:
    """Non-null and non-zero values of a column on either side, in one row."""

    def counts(df: DataFrame, column: str, side: str) -> DataFrame:
        value = number_of(df, column)
        return df.select(
            *[F.when(col(column).isNotNull(), 1).otherwise(0).alias(f"{side}_values")],
            F.when(value != 0, 1).otherwise(0).alias(f"{side}_nonzero"),
        )

    both = counts(old, old_column, "old").unionByName(counts(new, new_column, "new"), allowMissingColumns=True)
    names = ["old_values", "old_nonzero", "new_values", "new_nonzero"]
    return both.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def prefix_distribution(df: DataFrame, prefix: Column, key: str, account: str) -> DataFrame:
    """Per prefix: rows, distinct keys, distinct accounts. Keys and accounts are made unique each on their own, never as
    triples, so a task holds one row per key or per account."""
    base = df.select(prefix.alias("prefix"), col(key).alias("key"), col(account).alias("account"))
    zero = F.lit(0).cast("long")

    def counted(name: str) -> DataFrame:
        values = base.groupBy("prefix", name).agg(F.count(F.lit(1)).alias("n"))
        found = F.count(name)
        own = {"n_rows": F.sum("n"), "n_keys": found, "n_accounts": zero} if name == "key" else {"n_rows": zero, "n_keys": zero, "n_accounts": found}
        return values.groupBy("prefix").agg(*[c.alias(n) for n, c in own.items()])

    # A row per prefix from either; prefixes may be null, so they meet by an aggregation and not by a join.
    both = counted("key").unionByName(counted("account"))
    return both.groupBy("prefix").agg(*[F.sum(n).alias(n) for n in ("n_rows", "n_keys", "n_accounts")])


def routed_totals(df: DataFrame, routes: dict[str, Column], value: Column, by: Sequence[str] = ()) -> DataFrame:
    """One total per route, a route being a row test; per group if `by` is given."""
    zero = F.lit(0).cast(NUMBER)
    sums = [F.coalesce(F.sum(F.when(test, value)), zero).alias(name) for name, test in routes.items()]
    return df.groupBy(*by).agg(*sums) if by else df.agg(*sums)


def routed_differences(old: DataFrame, new: DataFrame, on: Sequence[str], names: Sequence[str], tolerance: float) -> DataFrame:
    """Groups whose totals differ by more than the tolerance: one row per group and route."""
    both = old.select(*on, *[F.col(n).alias(f"old_{n}") for n in names]).join(
        new.select(*on, *[F.col(n).alias(f"new_{n}") for n in names]), list(on), "full_outer"
    )
    zero = F.lit(0).cast(NUMBER)
    rows = F.array(*[
        F.struct(F.lit(n).alias("route"), F.coalesce(F.col(f"old_{n}"), zero).alias("old_total"),
                 F.coalesce(F.col(f"new_{n}"), zero).alias("new_total"))
        for n in names
    ])
    far = F.abs(F.col("r.old_total") - F.col("r.new_total")) > tolerance_of(tolerance)
    return both.select(*on, F.explode(rows).alias("r")).filter(far).select(*on, "r.*")


def code_cooccurrence(df: DataFrame, key: str, code: str, first: str, second: str) -> DataFrame:
    """Keys that have one of two codes without the other."""
    has = df.filter(col(code).isin(first, second)).groupBy(col(key).alias("key")).agg(
        F.bool_or(col(code) == first).alias("has_first"), F.bool_or(col(code) == second).alias("has_second")
    )
    return has.filter(F.col("has_first") != F.col("has_second"))


def key_coverage(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct left keys with and without a right row, and right keys without a left one; case does not matter."""

    def keys(df: DataFrame, name: str, side: str) -> DataFrame:
        other = "r" if side == "l" else "l"
        return df.filter(col(name).isNotNull()).select(
            F.lower(F.trim(col(name).cast("string"))).alias("key"), F.lit(1).alias(side), F.lit(0).alias(other)
        )

    both = keys(left, left_key, "l").unionByName(keys(right, right_key, "r"))
    found = both.groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return found.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("in_both"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only"),
    )


def side_counts(old: DataFrame, new: DataFrame, old_key: str, new_key: str) -> DataFrame:
    """key, old_rows, new_rows; zero where a side has no row."""
    a = old.select(col(old_key).alias("key"), F.lit(1).alias("o"), F.lit(0).alias("n"))
    b = new.select(col(new_key).alias("key"), F.lit(0).alias("o"), F.lit(1).alias("n"))
    return a.unionByName(b).groupBy("key").agg(F.sum("o").alias("old_rows"), F.sum("n").alias("new_rows"))


def rows_per_key_matrix(old: DataFrame, new: DataFrame, old_key: str, new_key: str) -> DataFrame:
    """How many keys have which pair of row counts; keys of the old side only."""
    return (
        side_counts(old, new, old_key, new_key).filter("old_rows > 0")
        .groupBy("old_rows", "new_rows").agg(F.count(F.lit(1)).alias("n_keys"))
    )


def row_diff_outliers(old: DataFrame, new: DataFrame, old_key: str, new_key: str, expected: int) -> DataFrame:
    """Keys on both sides whose row counts differ by something else than expected."""
    gap = F.col("old_rows") - F.col("new_rows")
    return (
        side_counts(old, new, old_key, new_key).filter("old_rows > 0 and new_rows > 0")
        .withColumn("row_diff", gap).filter(F.col("row_diff") != expected)
    )


def source_attribution(target: DataFrame, key: str, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per source: target rows whose key it has, and whose key it has not.

    All tables meet in one aggregation by key, so a key with many rows is never joined row by row.
    """
    names = list(sources)
    parts = [target.filter(col(key).isNotNull()).select(col(key).alias("key"), F.lit(1).alias("rows"), F.lit(0).cast("long").alias("held"))]
    for bit, name in enumerate(names):
        df, own = sources[name]
        parts.append(df.select(col(own).alias("key"), F.lit(0).alias("rows"), F.lit(1 << bit).cast("long").alias("held")))
    keys = reduce(lambda a, b: a.unionByName(b), parts).groupBy("key").agg(
        F.sum("rows").alias("rows"), F.bit_or("held").alias("held")
    )
    counts = keys.agg(*[
        c for bit, name in enumerate(names) for c in (
            F.sum(F.when(F.col("held").bitwiseAND(F.lit(1 << bit)) != 0, F.col("rows")).otherwise(0)).alias(f"w{bit}"),
            F.sum(F.when(F.col("held").bitwiseAND(F.lit(1 << bit)) == 0, F.col("rows")).otherwise(0)).alias(f"o{bit}"),
        )
    ])
    rows = F.array(*[
        F.struct(F.lit(name).alias("source"), F.col(f"w{bit}").alias("with_match"), F.col(f"o{bit}").alias("without_match"))
        for bit, name in enumerate(names)
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def codes_reaching_target(old: DataFrame, new: DataFrame, old_key: str, new_key: str, code: str) -> DataFrame:
    """Per code: (key, code) pairs of the old side that the target has too, and those it has not."""
    a = old.select(col(old_key).alias("key"), col(code).alias("code"), F.lit(1).alias("o"), F.lit(0).alias("n"))
    b = new.select(col(new_key).alias("key"), col(code).alias("code"), F.lit(0).alias("o"), F.lit(1).alias("n"))
    pairs = a.unionByName(b).groupBy("key", "code").agg(F.max("o").alias("o"), F.max("n").alias("n")).filter("o = 1")
    return pairs.groupBy("code").agg(
        F.count_if(F.col("n") == 1).alias("reached"), F.count_if(F.col("n") == 0).alias("lost")
    )


def sums_by_code(
    olds: Sequence[tuple[DataFrame, str, str]], new: tuple[DataFrame, str, str], tolerance: float
) -> DataFrame:
    """code, old_total, new_total, mismatch: an amount per code, all sources together against the target."""

    def part(df: DataFrame, code: str, amount: str, side: str) -> DataFrame:
        number = number_of(df, amount)
        none = F.lit(None).cast(NUMBER)
        return df.select(
            F.coalesce(F.trim(col(code).cast("string")), F.lit("")).alias("code"),
            (number if side == "old" else none).alias("o"), (number if side == "new" else none).alias("n"),
        )

    parts = [part(*o, "old") for o in olds] + [part(*new, "new")]
    zero = F.lit(0).cast(NUMBER)
    totals = reduce(lambda a, b: a.unionByName(b), parts).groupBy("code").agg(
        F.coalesce(F.sum("o"), zero).alias("old_total"), F.coalesce(F.sum("n"), zero).alias("new_total")
    )
    return totals.withColumn("mismatch", F.abs(F.col("old_total") - F.col("new_total")) > tolerance_of(tolerance))


def multi_row_groups(df: DataFrame, key: str, code: str, amount: str) -> DataFrame:
    """Keys with several rows and several codes: rows, codes and total."""
    groups = df.groupBy(col(key).alias("key"), col(code).alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(number_of(df, amount)).alias("s")
    )
    return groups.groupBy("key").agg(
        F.sum("n").alias("n_rows"), F.count("code").alias("n_codes"), F.sum("s").alias("total")
    ).filter("n_rows > 1 and n_codes > 1")


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and distinct values of the given columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(col(c)).alias(f"n_{c}") for c in columns])


def derived_column_errors(df: DataFrame, expected: Column, actual: str, tolerance: float) -> DataFrame:
    """Rows where a column is not what the others make it; a missing number counts as zero."""
    zero = F.lit(0).cast(NUMBER)
    gap = F.coalesce(expected, zero) - F.coalesce(number_of(df, actual), zero)
    return df.filter(F.abs(gap) > tolerance_of(tolerance))
