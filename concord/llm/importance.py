"""Importance resampling: draws documents so that hashed n-grams are spread as in a target corpus.

Texts are words (bytes that are a-z, 0-9 or not ASCII, after lower-casing A-Z); features are all runs of 1 to `orders`
words, hashed by crc32 into buckets. A bucket's gain is the log ratio of its smoothed shares in the target and in the
documents; a document weighs the sum of its features' gains, and a Gumbel variable from its id turns the highest
weights into a draw without replacement.

Batch concatenation: the texts of a batch are joined with a sentinel byte that UTF-8 never uses, one regular
expression finds all words and sentinels, and the places of the sentinels are the documents' offsets. `searchsorted`
over them gives each word its document, which masks runs of words that cross from one document to the next, and
`bincount` counts what is left. The checksum of a run follows from those of its words, because crc32 is linear: moving
a checksum past `k` bytes is a table look-up. Long texts go through in sections that carry the last words over.

The counts of both corpora are sums over all rows, a number per bucket from each task. Ranks come from one range
partitioning of thin rows, sorted within partitions, and the number of rows before each partition; no task holds more
than its range.

Null and empty texts, and those without words, have no features and weight 0. A null id is hashed as an empty string
and comes after other ids of the same score. Rows are documents of their own: a repeated row has the same score, and
its copies take neighbouring ranks in any order. Ties go to the smaller id. An empty target is one with a count of 0
in each bucket; no documents give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import arrow_batches, bounded_batches, query, stored, table

BUCKETS = 10_000
ORDERS = 3
SENTINEL = b"\xff"
WORD = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
SECTION = 2_000_000  # bytes of joined texts that are held as words at a time
NEAR = 64  # checksums move past fewer bytes than this by one look-up


def _one_byte_on() -> np.ndarray:
    """What each value of the lowest byte of a checksum becomes when a zero byte follows."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, np.uint32(0xEDB88320) ^ (values >> np.uint32(1)), values >> np.uint32(1))
    return values


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """For lengths below NEAR, and for the powers of two from NEAR on: the four tables of 256 entries that move a
    checksum past so many bytes."""
    step = _one_byte_on()

    def moved(tables: np.ndarray, by: np.ndarray) -> np.ndarray:
        return by[0][tables & 255] ^ by[1][tables >> 8 & 255] ^ by[2][tables >> 16 & 255] ^ by[3][tables >> 24]

    none = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    one = np.stack([step[t & 255] ^ (t >> np.uint32(8)) for t in none])
    near = [none]
    for _ in range(NEAR - 1):
        near.append(moved(near[-1], one))
    power, far = moved(near[-1], one), []
    for _ in range(31 - NEAR.bit_length() + 1):
        far.append(power)
        power = moved(power, power)
    return np.stack(near).ravel(), np.stack(far)


SHIFT_NEAR, SHIFT_FAR = _shift_tables()


def past(checksums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The checksums' part in those of longer strings, `lengths` bytes further on."""
    at = (lengths & (NEAR - 1)) * 1024
    out = SHIFT_NEAR[at + (checksums & 255)]
    for k in range(1, 4):
        out ^= SHIFT_NEAR[at + 256 * k + (checksums >> (8 * k) & 255)]
    far = lengths // NEAR
    for bit in range(int(far.max(initial=0)).bit_length()):
        which = np.flatnonzero(far >> bit & 1)
        own, tables = out[which], SHIFT_FAR[bit]
        out[which] = tables[0][own & 255] ^ tables[1][own >> 8 & 255] ^ tables[2][own >> 16 & 255] ^ tables[3][own >> 24]
    return out


BLANK, SENTINEL_SUM = zlib.crc32(b" "), zlib.crc32(SENTINEL)


def sections(blob: bytes) -> Iterator[list[bytes]]:
    """The words and sentinels of joined texts, in order, some SECTION bytes at a time."""
    start = 0
    while start < len(blob):
        gap = BETWEEN.search(blob, start + SECTION) if start + SECTION < len(blob) else None
        end = gap.start() if gap else len(blob)
        yield WORD.findall(blob, start, end)
        start = end


def features(texts: list[str | None], orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For all runs of words of the texts, section by section and length by length: texts, checksums, and the length."""
    blob = SENTINEL.join([(t or "").encode() for t in texts]).lower()
    before = 0  # texts that ended in earlier sections
    document, sums = np.zeros(0, np.int64), [np.zeros(0, np.uint32)] * orders
    for words in sections(blob):
        own = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        offsets = np.flatnonzero((lengths == 1) & (own == SENTINEL_SUM))
        places = np.searchsorted(offsets, np.arange(len(words))) + before
        before += len(offsets)
        ends = np.full(len(words), -1, dtype=np.int64)
        ends[offsets] = 0
        is_word = ends < 0
        carried = len(document)
        document = np.concatenate([document, np.where(is_word, places, -1)])
        follows = past(np.full(len(words), BLANK, dtype=np.uint32), lengths) ^ own
        sums[0] = np.concatenate([sums[0], own])
        for order in range(1, orders):
            shorter = sums[order - 1][carried - 1 : -1] if carried else np.append(np.uint32(0), sums[order - 1][:-1]).astype(np.uint32)
            sums[order] = np.concatenate([sums[order], past(shorter, lengths + 1) ^ follows])
        for order in range(orders):
            at = np.arange(max(carried, order), len(document))
            at = at[(document[at] >= 0) & (document[at] == document[at - order])]
            yield document[at], sums[order][at], order + 1
        document, sums = document[-orders:], [s[-orders:] for s in sums]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""
    bounded_batches(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in arrow_batches(batches):
            for _, sums, _ in features(batch.column(0).to_pylist(), orders):
                total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """The gain of each bucket; what comes to the driver is a number per bucket of either corpus."""
    counts = []
    for corpus in (target, documents):
        own = np.zeros(buckets, dtype=np.int64)
        for row in bucket_counts(corpus, text, buckets, orders).collect():
            own[row["bucket"]] = row["n"]
        counts.append(own)
    wanted, present = counts
    above, below = float(present.sum() + buckets), float(wanted.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(t + 1) * above / (float(s + 1) * below))) for t, s in zip(wanted.tolist(), present.tolist())], dtype=np.int64)


def gumbel(id_column: str, seed: int) -> Column:
    """A Gumbel variable in thousandths, from the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def importance(documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score of each row of `documents`."""
    gain = gains(documents, target, text, buckets, orders).astype(float)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            size = batch.num_rows
            words, number, weight = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
            for document, sums, length in features(batch.column(2).to_pylist(), orders):
                own = np.bincount(document, minlength=size)
                number += own
                if length == 1:
                    words += own
                weight += np.bincount(document, gain[sums % np.uint32(buckets)], size)  # whole numbers, so the order of sums is no matter
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (words, number, weight.astype(np.int64)))],
                                             names=["doc_id", "text_hash", "n_words", "n_features", "weight"])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text)
    rows = rows.mapInArrow(weighed, "doc_id long, text_hash long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel("doc_id", seed))


IN_PARTITION = 33  # bits that Spark numbers the rows of a partition with


def ranked(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """The rows with `rank`: 1, 2, 3... for the percent of eligible rows that are drawn, else null."""
    scored = stored(scored, "scores")  # the range partitioning reads it twice
    eligible = F.col("n_words") >= least_words
    order = [eligible.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("place", IN_PARTITION)
    # A row for each partition.
    parts = placed.groupBy(part.alias("part")).agg(F.count_if(eligible).alias("own"))
    before = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << IN_PARTITION) - 1) + 1
    drawn = eligible & (rank <= F.floor(percent * F.col("all") / 100))
    rows = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return rows.select(*scored.columns, F.when(drawn, rank).alias("rank"))


def resampled(documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = 42) -> DataFrame:
    """The drawn documents, in their own columns. All copies of a repeated row stay if one of them is drawn."""
    rows = ranked(importance(documents, target, id_column, text, buckets, orders, seed), percent, least_words)
    drawn = rows.filter("rank is not null").select(F.col("doc_id").alias(f"{id_column}_drawn_{seed}"), F.col("text_hash").alias(f"{text}_drawn_{seed}"))
    same = documents[id_column].cast("long").eqNullSafe(drawn[drawn.columns[0]]) & (F.xxhash64(documents[text]) == drawn[drawn.columns[1]])
    return documents.join(drawn, same, "left_semi")


@query("op13_importance_resampling")
def op13_importance_resampling(spark, folder):
    scored = importance(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")
