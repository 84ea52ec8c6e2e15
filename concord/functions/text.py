"""Text transforms, normalisers and name similarity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.numbers import NUMBER_SHAPE

# The accepted date shapes, and the length of the suffix a composite key carries.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
DAY_FIRST_DATE = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
KEY_SUFFIX_LENGTH = 4

# Words that mean "no value" to the aggressive normaliser.
NULL_WORDS = ["nan", "none", "null", "nat", "", "<na>", "-", "?", "n/a", "undefined", "nil"]
CURRENCY_AND_SPACE = ",$€£¥ \t\n\x0b\f\r"


def clean(value: Column) -> Column:
    """Trimmed text, blank as null."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def strip_leading_zeros(value: Column) -> Column:
    text = clean(value)
    stripped = F.ltrim(text, F.lit("0"))
    return F.when(stripped == "", F.lit("0")).otherwise(stripped)


def strip_special_chars(value: Column) -> Column:
    return F.regexp_replace(clean(value), "[^a-zA-Z0-9]", "")


def date_text(value: Column) -> Column:
    """yyyy-MM-dd from an ISO date, an ISO timestamp or a day-first date; else the date part as it is."""
    text = clean(value)
    head = F.substring_index(F.substring_index(text, "T", 1), " ", 1)
    day_first = F.concat_ws(
        "-",
        F.regexp_extract(text, DAY_FIRST_DATE, 3),
        F.lpad(F.regexp_extract(text, DAY_FIRST_DATE, 2), 2, "0"),
        F.lpad(F.regexp_extract(text, DAY_FIRST_DATE, 1), 2, "0"),
    )
    return F.when(~head.rlike(ISO_DATE) & text.rlike(DAY_FIRST_DATE), day_first).otherwise(head)


def split_first(value: Column) -> Column:
    text = clean(value)
    return F.substr(text, F.lit(1), F.length(text) - KEY_SUFFIX_LENGTH)


def split_second(value: Column) -> Column:
    return F.right(clean(value), F.lit(KEY_SUFFIX_LENGTH))


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "NONE": clean,
    "CONCAT": clean,
    "STRIP_LEADING_ZEROS": strip_leading_zeros,
    "STRIP_SPECIAL_CHARS": strip_special_chars,
    "DATE_TO_DATETIME": date_text,
    "SPLIT_FIRST": split_first,
    "SPLIT_SECOND": split_second,
}


def transform(value: Column, rule: str | None) -> Column:
    return TRANSFORMS.get(rule or "NONE", clean)(value)


def concat_columns(values: Sequence[Column], separator: str = "") -> Column:
    """Trimmed columns joined; a missing one contributes an empty text."""
    return F.concat_ws(separator, *[F.coalesce(F.trim(v.cast("string")), F.lit("")) for v in values])


def name_similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length, without case; from 0 to 1."""
    a, b = F.lower(left), F.lower(right)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def prefix(value: Column, length: int | None = None, until: str = "-") -> Column:
    """The first `length` characters, or everything before the first `until`."""
    text = value.cast("string")
    return F.left(text, F.lit(length)) if length else F.substring_index(text, until, 1)


def comparable(value: Column) -> Column:
    """DATE:, NUM: or TXT: form that makes differently written values equal; null for null words.

    Each step stands once in the expression, and a single character is looked at before a pattern is tried.
    """
    text = F.trim(value.cast("string"))
    digits = F.translate(text, CURRENCY_AND_SPACE, "")
    number = F.when(digits.rlike(NUMBER_SHAPE), digits.try_cast("decimal(38,4)"))
    lower = F.lower(text)
    letters = F.when(lower.rlike("[a-z0-9]"), F.concat(F.lit("TXT:"), F.regexp_replace(lower, "[^a-z0-9]+", "")))
    return (
        F.when(text.isNull() | lower.isin(NULL_WORDS), F.lit(None))
        .when((F.substring(text, 5, 1) == "-") & text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(F.lit("DATE:"), F.left(text, F.lit(10))))
        .when(
            (F.substring(text, 3, 1) == "/") & text.rlike(r"^\d{2}/\d{2}/\d{4}"),
            F.concat(
                F.lit("DATE:"), F.substring(text, 7, 4), F.lit("-"),
                F.substring(text, 4, 2), F.lit("-"), F.substring(text, 1, 2),
            ),
        )
        .when(
            text.rlike(r"^\d{8}"),
            F.concat(
                F.lit("DATE:"), F.substring(text, 1, 4), F.lit("-"),
                F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2),
            ),
        )
        .otherwise(F.coalesce(F.concat(F.lit("NUM:"), number.cast("string")), letters))
    )


# The rewrites tried when two columns hold the same values in different clothes.
REWRITES: dict[str, Callable[[Column], Column]] = {
    "RAW": lambda c: c.cast("string"),
    "STRIP_LEADING_ZEROS": lambda c: F.ltrim(c.cast("string"), F.lit("0")),
    "REMOVE_PUNCTUATION": lambda c: F.regexp_replace(c.cast("string"), r"(?U)[^\w\s]", ""),
    "UPPERCASE": lambda c: F.upper(c.cast("string")),
    "LOWERCASE": lambda c: F.lower(c.cast("string")),
    "REMOVE_SPACES": lambda c: F.replace(c.cast("string"), F.lit(" "), F.lit("")),
    "STRIP_HYPHENS": lambda c: F.replace(c.cast("string"), F.lit("-"), F.lit("")),
    "NUMERIC_ONLY": lambda c: F.regexp_replace(c.cast("string"), r"[^0-9.]", ""),
}
# Those that leave a text of ASCII letters and digits as it is.
KEEP_PLAIN = ("REMOVE_PUNCTUATION", "REMOVE_SPACES", "STRIP_HYPHENS")
