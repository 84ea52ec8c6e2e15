"""Multiset difference of row fingerprints within groups."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.fingerprints import fingerprint
from concord.operators.joins import only_keys
from concord.sources.scratch import stored

Parts = Sequence[tuple[str, str, bool]]
HALF = (1 << 32) - 1


def multiset_hash(value: Column) -> list[Column]:
    """Four sums that stand for a multiset of values: those of the halves of two 64-bit hashes.

    They add up over tasks in any order. Equal multisets have equal sums; different ones have equal sums with a
    probability of about 2 ** -128. Halves keep the sums within a long for two thousand million values.
    """
    hashes = [F.xxhash64(F.lit(seed), value) for seed in (1, 2)]
    return [F.sum(half) for h in hashes for half in (h.bitwiseAND(HALF), F.shiftrightunsigned(h, 32))]


def multisets_hash(values: Sequence[Column]) -> list[Column]:
    """The same for several values at once, each with its place. A sum that overflows is null and stands for nothing."""
    hashes = [[F.xxhash64(F.lit(seed), F.lit(i), v.cast("string")) for i, v in enumerate(values)] for seed in (1, 2)]
    halves = [[half(h) for h in own] for own in hashes for half in (lambda h: h.bitwiseAND(HALF), lambda h: F.shiftrightunsigned(h, 32))]
    return [F.try_sum(reduce(lambda a, b: a + b, half)) for half in halves]


def old_fingerprint(old: DataFrame, parts: Parts) -> Column:
    return fingerprint(old, [(o, year) for o, _, year in parts])


def new_fingerprint(new: DataFrame, parts: Parts) -> Column:
    return fingerprint(new, [(n, year) for _, n, year in parts])


def differing_groups(old: DataFrame, new: DataFrame, key: Sequence[str], parts: Parts) -> DataFrame:
    """Keys of the groups whose rows differ as multisets: one aggregation over both tables, five numbers a group."""
    def hashed(df: DataFrame, value: Column, sign: int) -> DataFrame:
        sums = multiset_hash(value)
        one = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *[s.alias(f"h{i}") for i, s in enumerate(sums)])
        return one.select(*key, *[(F.col(c) * sign).alias(c) for c in ("rows", *(f"h{i}" for i in range(len(sums))))])

    both = hashed(old, old_fingerprint(old, parts), 1).unionByName(hashed(new, new_fingerprint(new, parts), -1))
    names = [c for c in both.columns if c not in key]
    gaps = both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in names])
    return gaps.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in names])).select(*key)


def fingerprint_gaps(old: DataFrame, new: DataFrame, key: Sequence[str], parts: Parts, among: DataFrame | None = None) -> DataFrame:
    """`fingerprint_diff` of the groups that differ; the rows of all others are in no shuffle of fingerprints.

    `among`: the groups to look at, where they are known (keys, each once).
    """
    groups = stored(among if among is not None else differing_groups(old, new, key, parts), "differing")
    left = only_keys(old.select(*key, old_fingerprint(old, parts).alias("fingerprint")), groups, key)
    right = only_keys(new.select(*key, new_fingerprint(new, parts).alias("fingerprint")), groups, key)
    rows = left.select("*", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(right.select("*", F.lit(0).alias("o"), F.lit(1).alias("n")))
    return fingerprint_diff(rows.groupBy(*key, "fingerprint").agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new")))


def fingerprint_diff(counts: DataFrame) -> DataFrame:
    """Fingerprints held more often by one side: how many copies are missing from or extra in the target."""
    gap = F.col("n_old") - F.col("n_new")
    return counts.filter(gap != 0).withColumn(
        "side", F.when(gap > 0, "missing_in_target").otherwise("extra_in_target")
    ).withColumn("copies", F.abs(gap))
