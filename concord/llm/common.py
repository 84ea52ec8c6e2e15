"""What the operators share: the registry, keys of rows, bounded Arrow batches, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# A batch handed to Python: few enough rows that very long texts fit beside each other.
BATCH_ROWS = 512


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name below the folder that driver and executors share; Spark creates it."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would read it by, for readers that know no default file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: short lineage, safe against lost executors.

    The shuffle files of the step are released when its table is written.
    """
    spark, path = frame.sparkSession, shared_path(frame.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(frame.schema).parquet(path)


def row_keys(id_column: str = "doc_id", text: str = "text") -> list:
    """Two columns that name a row, null or repeated ids included.

    Rows with equal id and equal text share the key, and so the result; both columns are never null.
    """
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("k_id"),
        F.xxhash64(F.col(id_column).isNull(), F.col(text)).alias("k_text"),
    ]


def column(name: str) -> Column:
    """The column of that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(documents: DataFrame, *columns: Column) -> DataFrame:
    """All columns of the documents as the struct `row`, so that no name of theirs meets one of `columns`."""
    return documents.select(F.struct(*map(column, documents.columns)).alias("row"), *columns)


def unwrapped(rows: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns of `row` again; those in `new` get other values."""
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])


SIEVE_BITS = 23
MAP_BITS = 1 << 15  # of one of Spark's bitmaps


def marked(rows: DataFrame, keys: DataFrame, *columns: str, bits: int = SIEVE_BITS) -> DataFrame:
    """`rows` with the column `seen`: true for every row whose `columns` are in `keys`, and for few others.

    The keys become a bitmap of 2 ** bits places by their hash: at most 2 ** bits / MAP_BITS rows of MAP_BITS bits, a
    megabyte by default however many keys there are, which is broadcast. Rows that are not seen need no join with the
    keys, so they need not move. With more keys than places little is ruled out and the joins behind it do the work;
    results never depend on it.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << bits)) + 1  # Spark's bitmaps count from 1
    maps = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("sieve_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("sieve_map"))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substr("sieve_map", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.call_function("getbit", byte, bit.bitwiseAND(7)) == 1, F.lit(False))
    parts = rows.withColumn("sieve_part", F.bitmap_bucket_number(place)).join(F.broadcast(stored(maps, "sieve")), ["sieve_part"], "left")
    return parts.select(*map(column, rows.columns), found.alias("seen"))


def arrow_batches(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has about `chars` bytes, or one row."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * chars / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
