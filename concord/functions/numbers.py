"""Numbers held as text: parsing, rendering, tolerant equality and formulas."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exact decimals: sums do not depend on the order in which tasks finish.
NUMBER = "decimal(28,8)"
# For equality of texts: more digits after the point. Texts of more than EXACT_DIGITS digits may be binary fractions
# written out, whose last digits mean nothing; they are compared at the scale of sums.
WIDE_NUMBER, EXACT_DIGITS = "decimal(38,18)", 15
NUMERIC_TYPES = (T.NumericType,)
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# The formulas a mapping may name.
FORMULAS = ("SUM", "SUBTRACT", "EXACT")


def col(name: str) -> Column:
    """Column by exact name, also where the name holds dots or dollar signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def parsed(text: Column) -> Column:
    """Decimal of trimmed text, null where it is no number.

    The shape is tested first: a failed cast raises and catches an exception per value, which costs far more.
    """
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast(NUMBER))


def to_number(value: Column) -> Column:
    """Decimal of the whole text, null where the text is not a number."""
    return parsed(F.trim(value.cast("string")))


def number_of(df: DataFrame, name: str) -> Column:
    """Decimal of a column; typed numbers skip the text parser."""
    return col(name).try_cast(NUMBER) if is_numeric(df, name) else to_number(col(name))


def plain(number: Column) -> Column:
    """Decimal (with decimals) as text without trailing zeros: 100, 0.5, -1387.16."""
    return F.when(number == 0, F.lit("0")).otherwise(F.rtrim(F.rtrim(number.cast("string"), F.lit("0")), F.lit(".")))


def exact_number(text: Column) -> Column:
    """Decimal of a text shaped like a number, with all its digits where there are at most EXACT_DIGITS."""
    short = F.length(F.regexp_replace(text, "[^0-9]", "")) <= EXACT_DIGITS
    return F.when(short, text.try_cast(WIDE_NUMBER)).otherwise(text.try_cast(NUMBER).cast(WIDE_NUMBER))


def normal_number_text(value: Column) -> Column:
    """Trimmed text; '.8', '0.8' and '0.80' become the same value. Blank becomes null."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    return F.when(text.rlike(NUMBER_SHAPE), F.coalesce(plain(exact_number(text)), text)).otherwise(text)


def number_text_of(df: DataFrame, name: str) -> Column:
    """The same for a column; a typed number needs no parsing, and a whole one no decimal."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return col(name).cast("string")
    if is_numeric(df, name):
        return F.coalesce(plain(col(name).try_cast(NUMBER)), col(name).cast("string"))
    return normal_number_text(col(name))


def tolerance_of(tolerance: float | str | Decimal) -> Column:
    return F.lit(Decimal(str(tolerance))).cast(NUMBER)


def differs(left: Column, right: Column, tolerance: float) -> Column:
    """True where two numbers are further apart than the tolerance."""
    return F.abs(left - right) > tolerance_of(tolerance)


def equal_texts(a: Column, b: Column, tolerance: float) -> Column:
    """Equality of two cleaned texts: null equals null, numbers within a tolerance, other text without case."""
    # Equal texts, the usual case, are settled without parsing.
    return (
        F.when(a.eqNullSafe(b), F.lit(True))
        .when(a.isNull() | b.isNull(), F.lit(False))
        .when(
            a.rlike(NUMBER_SHAPE) & b.rlike(NUMBER_SHAPE),
            F.coalesce(~(F.abs(exact_number(a) - exact_number(b)) > F.lit(Decimal(str(tolerance)))), F.lit(False)),
        )
        .otherwise(F.lower(a) == F.lower(b))
    )


def equal_numbers(a: Column, b: Column, tolerance: float) -> Column:
    """Equality of two decimals within a tolerance; null equals null."""
    return F.coalesce(~differs(a, b, tolerance), a.isNull() & b.isNull())


def tolerant_equal(left: Column, right: Column, tolerance: float = 0) -> Column:
    """Blank equals null, numbers within a tolerance, any other text without case."""

    def cleaned(value: Column) -> Column:
        return F.nullif(F.trim(value.cast("string")), F.lit(""))

    return equal_texts(cleaned(left), cleaned(right), tolerance)


def formula_of(formula: str, values: Sequence[Column]) -> Column:
    """SUM, SUBTRACT or EXACT over numbers, a missing number counting as zero."""
    zero = F.lit(0).cast(NUMBER)
    numbers = [F.coalesce(v, zero) for v in values]
    if formula == "SUM":
        return reduce(lambda a, b: a + b, numbers)
    if formula == "SUBTRACT":
        return reduce(lambda a, b: a - b, numbers)
    if formula == "EXACT":
        return numbers[0]
    raise ValueError(f"unknown formula {formula!r}, expected one of {FORMULAS}")
