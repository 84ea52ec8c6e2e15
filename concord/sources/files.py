"""Delimited files, virtual sources and the code list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.numbers import col

# The encoding tried first, and the one for older Thai files.
FIRST_ENCODING, THAI_ENCODING = "UTF-8", "cp874"
# Spark reads no Thai code page. Latin-1 keeps every byte, and these two texts map its upper half to Thai.
_PAIRS = [(chr(b), bytes([b]).decode(THAI_ENCODING, "ignore")) for b in range(0x80, 0x100)]
LATIN, THAI = ("".join(p[side] for p in _PAIRS if p[1]) for side in (0, 1))


def delimited(spark: SparkSession, path: str, encoding: str | None = None, **options) -> DataFrame:
    """Delimited file with a header line, all columns text, header names trimmed.

    Without an encoding the file is read as UTF-8, and as cp874 if some text is not valid UTF-8.
    """
    chosen = encoding or (THAI_ENCODING if _broken_utf8(spark, path) else FIRST_ENCODING)
    thai = chosen.lower() == THAI_ENCODING
    df = spark.read.options(header=True, encoding="ISO-8859-1" if thai else chosen, escape='"', **options).csv(path)
    if thai:
        to_thai = str.maketrans(LATIN, THAI)
        df = df.select(*[F.translate(col(c), LATIN, THAI).alias(c.translate(to_thai)) for c in df.columns])
    return df.toDF(*[name.strip() for name in df.columns])


def _broken_utf8(spark: SparkSession, path: str) -> bool:
    """Whether any line holds bytes that are no UTF-8; stops at the first one."""
    lines = spark.read.text(path)
    return not lines.filter(~F.is_valid_utf8("value")).isEmpty()


def virtual_source(frames: list[DataFrame], combine: str | None = "UNION", source_filter: str | None = None) -> DataFrame:
    """Several sources as one: by column name, missing columns null, then the filter."""
    if not frames:
        raise ValueError("no source given")
    if combine and combine.upper() == "UNION":
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    else:
        df = frames[0]
    return df.filter(F.expr(source_filter)) if source_filter else df


def code_list(spark: SparkSession, path: str) -> DataFrame:
    """(code, description, category) of a JSON code list."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("codes").alias("c")).select("c.code", "c.description", "c.category")


def known_codes(codes: DataFrame) -> frozenset[str]:
    """Upper-case codes for rule triggers; a code list is configuration of a few dozen rows."""
    return frozenset(r.code for r in codes.select(F.upper("code").alias("code")).distinct().collect())
