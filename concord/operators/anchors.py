"""Finding the key two unknown tables share, and joining them on it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.numbers import col
from concord.functions.text import comparable, name_similarity
from concord.operators.joins import first_per_key
from concord.operators.overlap import shared_values
from concord.operators.profile import as_text, with_traits

# Words that rule a key out or speak for one, and the limits of a key column.
BLACKLIST = [
    "remark", "note", "comment", "description", "detail", "details",
    "text", "memo", "content", "message", "narrative",
    "address", "addr", "name", "firstname", "lastname", "fullname",
    "desc", "reason", "explain", "info", "information", "body",
    "summary", "subject", "title", "label", "tag",
]
IDEAL = [
    "id", "no", "num", "number", "code", "key", "ref", "reference",
    "seq", "sequence", "txn", "transaction", "account", "acct",
    "serial", "batch", "voucher", "invoice", "order", "request",
]
STRONG_IDEAL = IDEAL[:6]
DATE_WORDS = ["date", "time", "dt", "day"]
ID_WORDS = ["id", "_no", "number", "seq"]
MAX_LENGTH, MAX_WORDS, MIN_UNIQUE, MAX_VARIATION = 100, 8, 0.05, 3.5
STRATEGIES = [("IDEAL_ID", 45), ("HIGH_UNIQUE", 35), ("DATE", 30)]
MIN_NAME, MIN_OVERLAP, MIN_COMPOSITE = 35, 1, 25
MIN_JOIN, MAX_JOIN = 0.01, 3.0
EMPTY_CONTEXT = ["", "nan", "0", "0.0", "none"]


def _has(name: str | Column, words: list[str]) -> Column:
    return F.lower(name).rlike("|".join(words))


def anchor_quality(counts: DataFrame) -> DataFrame:
    """column_name, eligible, quality (0 to 100) as a key."""
    n, size = F.col("n"), F.col("length")
    held = with_traits(counts.filter(F.col("value").isNotNull()), "length", "words", "digits", "codes")
    stats = held.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cardinality"),
        F.sum(size * n).alias("chars"), F.sum(size * size * n).alias("chars2"),
        F.sum(F.col("words") * n).alias("words"),
        F.coalesce(F.sum(F.when(F.col("digits"), n)), F.lit(0)).alias("digits"),
        F.coalesce(F.sum(F.when(F.col("codes"), n)), F.lit(0)).alias("codes"),
    )
    rows = F.col("rows")
    mean = F.col("chars") / rows
    variance = (F.col("chars2") - F.col("chars") * F.col("chars") / rows) / F.nullif(rows - 1, F.lit(0))
    unique = F.col("cardinality") / rows
    eligible = (
        ~_has("column_name", BLACKLIST) & (mean <= MAX_LENGTH) & (F.col("words") / rows <= MAX_WORDS)
        & (unique >= MIN_UNIQUE)
        & ((mean == 0) | (F.coalesce(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0)) / F.nullif(mean, F.lit(0)) <= MAX_VARIATION))
    )
    # The first word of the list that fits decides: 40 if it is the whole name, 20 if it is part of it.
    word = F.lit(0)
    for keyword in reversed(IDEAL):
        name = F.lower("column_name")
        word = F.when(name == keyword, 40).when(name.contains(keyword), 20).otherwise(word)
    length = F.when(mean <= 10, 20).when(mean <= 20, 10).when(mean <= 40, 5).otherwise(0)
    coded = F.when(F.greatest("digits", "codes") / rows > 0.7, 10).otherwise(0)
    quality = F.least(word + unique * 30 + length + coded, F.lit(100.0))
    return stats.select("column_name", F.coalesce(eligible, F.lit(False)).alias("eligible"), quality.alias("quality"))


def eligible_names(quality: DataFrame) -> list[str]:
    """Names of possible key columns, for planning; at most a row per column."""
    return sorted(r.column_name for r in quality.filter("eligible").select("column_name").collect())


def anchor_candidates(old: DataFrame, new: DataFrame, old_quality: DataFrame, new_quality: DataFrame) -> DataFrame:
    """Pairs of eligible columns per strategy with overlap, name similarity, quality and score."""
    olds, news = eligible_names(old_quality), eligible_names(new_quality)
    shared = shared_values(
        old, new, [(n, as_text(old, n)) for n in olds], [(n, as_text(new, n)) for n in news]
    )
    overlap = F.col("n_shared") / F.greatest("n_old", "n_new") * 100

    def scores(quality: DataFrame, side: str) -> DataFrame:
        return quality.select(F.col("column_name").alias(f"{side}_column"), F.col("quality").alias(f"{side}_quality"))

    pairs = (
        shared.withColumn("overlap", overlap).filter(F.col("overlap") >= MIN_OVERLAP)
        .withColumn("name_sim", name_similarity(F.col("old_column"), F.col("new_column")) * 100)
        .filter(F.col("name_sim") >= MIN_NAME)
        .join(scores(old_quality, "old"), ["old_column"]).join(scores(new_quality, "new"), ["new_column"])
    )
    score = F.col("overlap") * 0.5 + F.col("name_sim") * 0.3 + (F.col("old_quality") + F.col("new_quality")) / 2 * 0.2

    def both(words: list[str]) -> Column:
        return _has("old_column", words) & _has("new_column", words)

    fits = {"IDEAL_ID": both(STRONG_IDEAL), "HIGH_UNIQUE": F.lit(True), "DATE": both(DATE_WORDS)}
    tried = F.array(*[
        F.when(fits[name], F.struct(F.lit(i).alias("place"), F.lit(name).alias("strategy"), F.lit(least).alias("min_score")))
        for i, (name, least) in enumerate(STRATEGIES)
    ])
    return (
        pairs.withColumn("score", score)
        .select("old_column", "new_column", "overlap", "name_sim", "score", F.explode(F.filter(tried, lambda t: t.isNotNull())).alias("t"))
        .select("old_column", "new_column", "overlap", "name_sim", "score", "t.*")
        .filter(F.col("score") >= F.col("min_score"))
    )


def composite_candidates(old: DataFrame, new: DataFrame, olds: list[str], news: list[str]) -> DataFrame:
    """Pairs of column pairs by the share of new value pairs the old side has."""

    def pairs(df: DataFrame, names: list[str]) -> list[tuple[str, Column]]:
        return [
            (f"{a}+{b}", F.when(col(a).isNotNull() & col(b).isNotNull(), F.concat_ws("_", as_text(df, a), as_text(df, b))))
            for a, b in combinations(names, 2)
        ]

    shared = shared_values(old, new, pairs(old, olds), pairs(new, news))
    return shared.withColumn("overlap", F.col("n_shared") / F.col("n_new") * 100).filter(F.col("overlap") >= MIN_COMPOSITE)


def anchored_join(old: DataFrame, new: DataFrame, old_key: list[str], new_key: list[str]) -> DataFrame:
    """Both tables made unique on the key and joined; columns get the suffixes _O and _N."""

    def unique(df: DataFrame, key: list[str], suffix: str) -> DataFrame:
        parts = [as_text(df, k) for k in key]
        named = df.select(F.concat_ws("_", *parts).alias("anchor"), *[col(c).alias(f"{c}_{suffix}") for c in df.columns])
        present = named
        for k in key:
            present = present.filter(F.col(f"`{k}_{suffix}`").isNotNull())
        return first_per_key(present, ["anchor"], [F.col(f"`{c}_{suffix}`").asc_nulls_last() for c in df.columns])

    return unique(old, old_key, "O").join(unique(new, new_key, "N"), ["anchor"])


def join_quality(old: DataFrame, new: DataFrame, joined: DataFrame) -> DataFrame:
    """Joined rows against the smaller table: too few means a wrong key, too many a repeated one."""

    def size(df: DataFrame, name: str) -> DataFrame:
        names = ["n_old", "n_new", "n_joined"]
        return df.select(*[F.lit(int(n == name)).alias(n) for n in names])

    counts = size(old, "n_old").unionByName(size(new, "n_new")).unionByName(size(joined, "n_joined"))
    totals = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_old", "n_new", "n_joined")])
    ratio = F.col("n_joined") / F.greatest(F.least("n_old", "n_new"), F.lit(1))
    verdict = (
        F.when(F.col("n_joined") == 0, "EMPTY").when(ratio < MIN_JOIN, "POOR")
        .when(ratio > MAX_JOIN, "EXPLODED").otherwise("GOOD")
    )
    return totals.select("n_old", "n_new", "n_joined", ratio.alias("join_ratio"), verdict.alias("verdict"))


def context_rows(joined: DataFrame, old_columns: list[str], new_columns: list[str]) -> DataFrame:
    """Joined rows, and how many of them share a value outside the key: none at all means a ghost join."""

    def context(names: list[str]) -> Column:
        kept = [
            F.when(~F.lower(F.trim(col(n).cast("string"))).isin(EMPTY_CONTEXT), comparable(col(n))) for n in names
        ]
        return F.filter(F.array(*kept), lambda v: v.isNotNull())

    meets = F.arrays_overlap(context(old_columns), context(new_columns))
    return joined.agg(F.count(F.lit(1)).alias("n_joined"), F.count_if(meets).alias("n_with_context"))


def anchor_verdicts(candidates: DataFrame, shared: DataFrame) -> DataFrame:
    """Rejects pairs of ids that were numbered anew (almost no shared value) and keys that hardly join."""
    ids = _has("old_column", ID_WORDS) & _has("new_column", ID_WORDS)
    of_old = F.col("n_shared") / F.col("n_old") * 100
    of_both = F.col("n_shared") / F.greatest("n_old", "n_new")
    verdict = F.when(ids & (of_old < 1), "ID_REGENERATED").when(of_both < MIN_JOIN, "POOR_JOIN").otherwise("ACCEPTED")
    return candidates.join(shared, ["old_column", "new_column"]).withColumn("verdict", verdict)


def best_per_strategy(candidates: DataFrame) -> DataFrame:
    """The best pair of each strategy that found one."""
    best = F.max_by(F.struct("old_column", "new_column", "score"), F.struct("score", "old_column", "new_column"))
    return candidates.groupBy("place", "strategy").agg(best.alias("b")).select("place", "strategy", "b.*")
