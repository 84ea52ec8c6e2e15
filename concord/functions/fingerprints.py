"""Row fingerprints: the same row on both sides gives the same text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.numbers import col, is_numeric, normal_number_text, plain

# Text dates that a fingerprint shortens to the day.
ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T"
LONG_DATE = r"^[A-Za-z]{3} [A-Za-z]{3} \d{2} \d{4}"
YEAR = r"^\d{4}$"


def fingerprint_part(df: DataFrame, name: str, year_only: bool = False) -> Column:
    """Dates as yyyy-MM-dd (or the year), numbers without trailing zeros, other text trimmed."""
    value = col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        day = F.date_format(value, "yyyy-MM-dd")
        return F.coalesce(F.left(day, F.lit(4)) if year_only else day, F.lit(""))
    if is_numeric(df, name):
        return F.coalesce(plain(value.try_cast("decimal(28,8)")), F.lit(""))
    text = F.trim(value.cast("string"))
    long_day = F.date_format(F.try_to_date(F.substring(text, 5, 11), "MMM dd yyyy"), "yyyy-MM-dd")
    day = F.when(text.rlike(ISO_TIMESTAMP), F.left(text, F.lit(10))).when(text.rlike(LONG_DATE), long_day)
    if year_only:
        day = F.left(day, F.lit(4))
        day = F.coalesce(day, F.when(text.rlike(YEAR), text))
    return F.coalesce(day, normal_number_text(text), F.lit(""))


def fingerprint(df: DataFrame, parts: Sequence[tuple[str, bool]]) -> Column:
    return F.concat_ws("|", *[fingerprint_part(df, name, year_only) for name, year_only in parts])
