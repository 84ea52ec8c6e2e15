"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.sources.scratch import stored

# A key with this many rows is spread over SALTS tasks. At most total_rows / HOT_ROWS keys can be hot,
# which bounds the list of hot keys that is broadcast.
HOT_ROWS = 1_000_000
SALTS = 64


def estimated_bytes(df: DataFrame) -> int:
    """Size the optimizer expects, from file or cache statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame) -> bool:
    """True where Spark's own broadcast limit covers the estimated size."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(df) <= int(limit)


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least `hot_rows` rows."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= hot_rows).select(*on)


def even_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join many `left` rows to at most one `right` row per key.

    A right side below the broadcast limit is broadcast. Otherwise the rows of hot left keys are spread
    over salted copies of their single right row, and every other key is joined by a plain shuffle.
    Only for inner, left, left_semi and left_anti: they never report unmatched right rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"even_join cannot do {how!r}")
    if small_enough(right):
        return left.join(F.broadcast(right), list(on), how)
    hot = stored(hot if hot is not None else hot_keys(left, on, hot_rows), "hot")
    flag = hot.withColumn("_hot", F.lit(True))
    if small_enough(hot):  # by the size of its files; a longer list is joined as any other table
        flag = F.broadcast(flag)
    unmatched = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    # From the row itself, so that a stage that runs again deals its rows as before.
    salt = F.when(F.col("_hot") | unmatched, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = left.join(flag, list(on), "left").withColumn("_salt", salt).drop("_hot")
    copied = right.join(flag, list(on), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return spread.join(copied, [*on, "_salt"], how).drop("_salt")


SIEVE_BITS = 23


def marked(rows: DataFrame, keys: DataFrame, on: Sequence[str], bits: int = SIEVE_BITS) -> DataFrame:
    """`rows` with the column `seen`: true for every row whose key is in `keys`, and for few others.

    The keys become a bitmap of 2 ** bits places by their hash, a megabyte however many keys there are, which is
    broadcast as rows of 4 KB. Rows that are not seen need no join with the keys, so they need not move. With more
    keys than places little is ruled out and the join behind it does the work; results never depend on it.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << bits)) + 1  # Spark's bitmaps count from 1
    maps = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_map"))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substr("_map", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.call_function("getbit", byte, bit.bitwiseAND(7)) == 1, F.lit(False))
    parted = rows.withColumn("_part", F.bitmap_bucket_number(place)).join(F.broadcast(stored(maps, "sieve")), ["_part"], "left")
    return parted.withColumn("seen", found).drop("_part", "_map")


def only_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str], bits: int = SIEVE_BITS) -> DataFrame:
    """The rows whose key is in `keys` (stored, each key once). A short list, by the size of its files, is broadcast;
    with a longer one few rows are moved that are not wanted."""
    if small_enough(keys):
        return rows.join(F.broadcast(keys.select(*on)), list(on), "left_semi")
    return marked(rows, keys, on, bits).filter("seen").drop("seen").join(keys.select(*on), list(on), "left_semi")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by `order`.

    Spark prunes to one row per key before the shuffle (window group limit), so a hot key stays small.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") == 1).drop("_place")


def lookup_table(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(lookup_key, lookup_value) with one value per key: blanks are dropped, the smallest value wins."""
    pairs = df.select(
        F.nullif(F.trim(key.cast("string")), F.lit("")).alias("lookup_key"),
        F.nullif(F.trim(value.cast("string")), F.lit("")).alias("lookup_value"),
    ).filter(F.col("lookup_key").isNotNull() & F.col("lookup_value").isNotNull())
    return pairs.groupBy("lookup_key").agg(F.min("lookup_value").alias("lookup_value"))
