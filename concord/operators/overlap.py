"""Which values two sets of columns share.

Every value is reduced to two bit masks, the old and the new columns it occurs in. The masks are combined
by one aggregation over the value and then counted per pair of masks, so the pairs of columns are formed
from a few distinct masks and never per value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.sources.scratch import stored

BITS = 62


def _words(n: int) -> int:
    return max(1, -(-n // BITS))


def _cells(df: DataFrame, columns: Sequence[tuple[str, Column]], form: Callable[[Column], Column] | None = None) -> DataFrame:
    """(i, value) of every cell that holds one; with `form`, its value in that form, which may be null."""
    if not columns:
        return df.sparkSession.createDataFrame([], "i int, value string")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), value.cast("string").alias("value")) for i, (_, value) in enumerate(columns)])
    held = df.select(F.explode(cells).alias("c")).select("c.i", "c.value").filter(F.col("value").isNotNull())
    # Not filtered again: a filter would be pushed below the form and compute it twice.
    return held.select("i", form(F.col("value")).alias("value")) if form else held


def _masked(cells: DataFrame, side: str, words: dict[str, int]) -> DataFrame:
    masks = []
    for name, count in words.items():
        for w in range(count):
            here = F.lit(0).cast("long")
            if name == side:
                bit = F.expr(f"shiftleft(1L, i - {w * BITS})")
                here = F.when(F.col("value").isNotNull() & (F.col("i") >= w * BITS) & (F.col("i") < (w + 1) * BITS), bit).otherwise(here)
            masks.append(here.alias(f"{name}{w}"))
    return cells.select("value", *masks)


def shared_values(
    old: DataFrame, new: DataFrame, old_columns: Sequence[tuple[str, Column]], new_columns: Sequence[tuple[str, Column]],
    form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """old_column, new_column, n_shared, n_old, n_new: distinct values both have, and each has.

    Only pairs that share a value are returned. `form` is what all values are brought to before they are compared: one
    expression over the cells, which stays in generated code, where one for every column would not.
    """
    return shared_cells(_cells(old, old_columns, form), _cells(new, new_columns, form), [n for n, _ in old_columns], [n for n, _ in new_columns])


def shared_cells(old_cells: DataFrame, new_cells: DataFrame, old_names: Sequence[str], new_names: Sequence[str]) -> DataFrame:
    """The same from cells: i (the place of the column's name) and value; null values are in no column."""
    words = {"o": _words(len(old_names)), "n": _words(len(new_names))}
    names = [f"{side}{w}" for side, count in words.items() for w in range(count)]
    cells = _masked(old_cells, "o", words).unionByName(_masked(new_cells, "n", words))
    values = cells.groupBy("value").agg(*[F.bit_or(m).alias(m) for m in names])
    # A row per set of columns that share values, read three times below; what is asked of it stays above the values.
    masks = stored(values.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "masks")

    def held(side: str, columns: Sequence[str]) -> Column:
        tests = []
        for i, name in enumerate(columns):
            word, bit = divmod(i, BITS)
            tests.append(F.when(F.col(f"{side}{word}").bitwiseAND(F.lit(1 << bit)) != 0, F.lit(name)))
        return F.filter(F.array(*tests), lambda x: x.isNotNull())

    sets = masks.select(held("o", old_names).alias("olds"), held("n", new_names).alias("news"), "n")
    n_old = sets.select(F.explode("olds").alias("old_column"), "n").groupBy("old_column").agg(F.sum("n").alias("n_old"))
    n_new = sets.select(F.explode("news").alias("new_column"), "n").groupBy("new_column").agg(F.sum("n").alias("n_new"))
    pairs = (
        sets.select(F.explode("olds").alias("old_column"), "news", "n")
        .select("old_column", F.explode("news").alias("new_column"), "n")
        .groupBy("old_column", "new_column").agg(F.sum("n").alias("n_shared"))
    )
    return pairs.join(n_old, ["old_column"]).join(n_new, ["new_column"]).select(
        "old_column", "new_column", "n_shared", "n_old", "n_new"
    )
