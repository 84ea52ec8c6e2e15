"""Proposing which old column became which new one: names, types and shared values.

Profiles, name pairs and matches have a row per column or per pair of columns; the only large steps are
the distinct values of each table (`profile`) and the values two tables share (`overlap`).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.text import name_similarity
from concord.operators.overlap import shared_values
from concord.operators.profile import as_text, column_meta, most_frequent, value_counts
from concord.operators.schema import name_pairs

# Weights and thresholds of a match, and the words that mark a key column.
NAME_WEIGHT, TYPE_WEIGHT, VALUE_WEIGHT = 0.6, 0.2, 0.2
VERIFIED, PROBABLE, MANUAL = 0.9, 0.7, 0.5
SAME_NAME, NO_VALUES, MANY_VALUES = 0.85, 0.1, 0.05
ANCHOR_WORDS = [
    "accountno", "refno", "referencenumber", "referenceno", "systemreference", "contractno", "policyno", "memberno",
]
ANCHOR_UNIQUE, ANCHOR_OVERLAP = 0.01, 0.2


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def paired_profiles(old_profile: DataFrame, new_profile: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Every pair of columns with both profiles and the place of the new column in its table."""
    spark = old_profile.sparkSession
    places = {name: i for i, name in enumerate(new)}
    place = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])[F.col("new_column")]
    pairs = name_pairs(spark, old, new).withColumn("new_place", place)
    left = prefixed(old_profile, "old_").withColumnRenamed("old_column_name", "old_column")
    right = prefixed(new_profile, "new_").withColumnRenamed("new_column_name", "new_column")
    return pairs.join(left, ["old_column"]).join(right, ["new_column"])


def _trimmed_columns(df: DataFrame, names: list[str]) -> list[tuple[str, Column]]:
    return [(n, F.nullif(F.trim(as_text(df, n)), F.lit(""))) for n in names]


def _magnitude(mean: Column) -> Column:
    return F.when(mean == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(mean))))


def value_similarity(shared: Column, old_distinct: Column, new_distinct: Column) -> Column:
    """Numbers by magnitude, texts by shared values over all values, dates as alike."""
    kinds = (F.col("old_kind") == "NORMAL") & (F.col("new_kind") == "NORMAL")
    types = [F.col("old_inferred_type"), F.col("new_inferred_type")]

    def are(name: str) -> Column:
        return (types[0] == name) & (types[1] == name)

    near = F.abs(_magnitude(F.col("old_mean_value")) - _magnitude(F.col("new_mean_value"))) <= 1
    union = old_distinct + new_distinct - shared
    return (
        F.when(~kinds, 0.0)
        .when(are("numeric"), F.when(near, 0.8).otherwise(0.2))
        .when(are("string"), F.when(union > 0, shared / union).otherwise(0.0))
        .when(are("date"), 0.8)
        .otherwise(0.5)
    )


def transform_hint() -> Column:
    old, new = F.col("old_inferred_type"), F.col("new_inferred_type")
    before, after = F.coalesce("old_date_format", F.lit("UNKNOWN")), F.coalesce("new_date_format", F.lit("UNKNOWN"))
    dates = (old == "date") & (new == "date")
    return (
        F.when(~dates & (old == "string") & (new == "numeric") & F.col("old_has_leading_zeros"), "STRIP_LEADING_ZEROS")
        .when(~dates | (before == after), "NONE")
        .when((before == "DATE") & ~after.isin("DATE", "UNKNOWN"), "DATE_TO_DATETIME")
        .otherwise("DATETIME_FORMAT_CHANGE")
    )


def match_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """The best new column for each old one, with similarities, confidence, status and transform hint."""
    return best_matches(
        column_meta(value_counts(old)), column_meta(value_counts(new)), old.columns, new.columns,
        shared_values(old, new, _trimmed_columns(old, old.columns), _trimmed_columns(new, new.columns)),
    )


def best_matches(old_meta: DataFrame, new_meta: DataFrame, old: list[str], new: list[str], shared: DataFrame) -> DataFrame:
    pairs = paired_profiles(old_meta, new_meta, old, new).join(
        shared.select("old_column", "new_column", "n_shared"), ["old_column", "new_column"], "left"
    )
    scored = pairs.select(
        "*",
        name_similarity(F.col("old_column"), F.col("new_column")).alias("name_sim"),
        F.when(F.col("old_inferred_type") == F.col("new_inferred_type"), 1.0).otherwise(0.5).alias("type_sim"),
        value_similarity(F.coalesce("n_shared", F.lit(0)), F.col("old_n_distinct"), F.col("new_n_distinct")).alias("value_sim"),
        transform_hint().alias("hint"),
    ).withColumn(
        "confidence", F.col("name_sim") * NAME_WEIGHT + F.col("type_sim") * TYPE_WEIGHT + F.col("value_sim") * VALUE_WEIGHT
    )
    keep = [
        "new_column", "name_sim", "type_sim", "value_sim", "confidence", "hint",
        "old_kind", "old_inferred_type", "new_inferred_type", "old_unique_ratio", "new_unique_ratio", "old_has_large_integers",
    ]
    best = F.max_by(F.struct(*keep), F.struct(F.round("confidence", 9).alias("c"), (-F.col("new_place")).alias("p")))
    chosen = scored.groupBy("old_column").agg(best.alias("b")).select("old_column", "b.*")
    regenerated = (F.lower("old_column") == "id") & (F.col("old_inferred_type") == "numeric") & F.col("old_has_large_integers")
    blank = regenerated | (F.col("old_kind") != "NORMAL")
    moved = (
        (F.col("name_sim") > SAME_NAME) & (F.col("value_sim") < NO_VALUES)
        & (F.col("old_inferred_type") == "string") & (F.col("new_inferred_type") == "string")
        & (F.col("old_unique_ratio") > MANY_VALUES) & (F.col("new_unique_ratio") > MANY_VALUES)
    )
    status = (
        F.when(regenerated, "REGENERATED_ID")
        .when(F.col("old_kind") != "NORMAL", F.concat(F.col("old_kind"), F.lit("_COLUMN")))
        .when(moved, "SAME_NAME_DIFF_DATA")
        .when((F.col("confidence") >= VERIFIED) & (F.col("type_sim") == 1.0), "VERIFIED")
        .when(F.col("confidence") >= PROBABLE, "PROBABLE")
        .when(F.col("confidence") >= MANUAL, "MANUAL_CHECK")
        .otherwise("NO_MATCH")
    )

    def unless_blank(name: str, other) -> Column:
        return F.when(blank, F.lit(other)).otherwise(F.col(name)).alias(name)

    return chosen.withColumn("status", status).select(
        "old_column", unless_blank("new_column", None), unless_blank("name_sim", 0.0), unless_blank("type_sim", 0.0),
        unless_blank("value_sim", 0.0), unless_blank("confidence", 0.0), "status",
        F.when(blank, "NONE").otherwise(F.col("hint")).alias("transform_hint"),
        F.col("old_inferred_type").alias("old_type"), F.col("new_inferred_type").alias("new_type"),
    )


def unmatched_new(matches: DataFrame, new_names: DataFrame) -> DataFrame:
    """New columns no usable match points at."""
    used = matches.filter(
        F.col("new_column").isNotNull() & ~F.col("status").isin("NO_MATCH", "SAME_NAME_DIFF_DATA")
    ).select(F.col("new_column").alias("column_name"))
    return new_names.select("column_name").join(used, ["column_name"], "left_anti")


def _is_anchor_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(ANCHOR_WORDS))


def anchor_overlap(old: DataFrame, new: DataFrame, old_meta: DataFrame, new_meta: DataFrame) -> DataFrame:
    """Candidate key pairs: distinct old values, how many of them the new column holds, and their share."""

    def eligible(meta: DataFrame, side: str) -> DataFrame:
        return meta.filter(
            _is_anchor_name(F.col("column_name")) & (F.col("unique_ratio") > ANCHOR_UNIQUE) & (F.col("kind") == "NORMAL")
        ).select(F.col("column_name").alias(f"{side}_column"))

    shared = shared_values(
        old, new,
        [(n, F.nullif(as_text(old, n), F.lit(""))) for n in old.columns if any(w in n.lower() for w in ANCHOR_WORDS)],
        [(n, F.nullif(as_text(new, n), F.lit(""))) for n in new.columns if any(w in n.lower() for w in ANCHOR_WORDS)],
    )
    return (
        shared.join(eligible(old_meta, "old"), ["old_column"], "left_semi")
        .join(eligible(new_meta, "new"), ["new_column"], "left_semi")
        .select("old_column", "new_column", "n_old", "n_shared", (F.col("n_shared") / F.col("n_old")).alias("overlap"))
    )


def best_anchor(overlaps: DataFrame) -> DataFrame:
    """The pair with the largest overlap, if it is large enough."""
    best = overlaps.agg(F.max_by(F.struct("old_column", "new_column", "overlap"), F.struct(
        "overlap", "old_column", "new_column")).alias("b")).select("b.*")
    return best.filter(F.col("overlap") >= ANCHOR_OVERLAP).select(
        F.col("old_column").alias("anchor_old"), F.col("new_column").alias("anchor_new"),
        F.round(F.col("overlap") * 100).cast("int").alias("overlap_pct"),
    )


def draft_mappings(matches: DataFrame) -> DataFrame:
    """A first rule from the matches: kind of mapping, columns, transform, and whether someone must look at it."""
    usable = matches.filter(F.col("new_column").isNotNull() & F.col("status").isin("VERIFIED", "PROBABLE", "MANUAL_CHECK"))
    kind = (
        F.when(F.col("status") == "MANUAL_CHECK", "manual_check")
        .when(F.col("transform_hint") == "NONE", "exact_matches").otherwise("transformed_matches")
    )
    return usable.select(
        kind.alias("kind"), "old_column", "new_column", F.col("transform_hint").alias("transform_rule"),
        "confidence", (F.col("status") != "VERIFIED").alias("needs_review"),
    )


def split_candidates(matches: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Numeric old columns without a match whose name begins like at least two unmatched new columns."""

    def start(name: Column) -> Column:
        return F.left(F.lower(name), F.greatest(F.lit(3), F.floor(F.length(name) * 0.5)).cast("int"))

    old = matches.filter((F.col("status") == "NO_MATCH") & (F.col("old_type") == "numeric")).select("old_column")
    new = unmatched.select(F.col("column_name").alias("new_column"))
    related = F.lower("new_column").startswith(start(F.col("old_column"))) | F.lower("old_column").startswith(start(F.col("new_column")))
    # Names only: both sides have at most a row per column.
    pairs = old.join(F.broadcast(new), related)
    return pairs.groupBy("old_column").agg(
        F.array_sort(F.collect_list("new_column")).alias("new_columns"), F.count(F.lit(1)).alias("n_columns")
    ).filter("n_columns >= 2")


def ranked_claims(matches: DataFrame) -> DataFrame:
    """Matches with their rank among the claims to the same new column."""
    window = Window.partitionBy("new_column").orderBy(F.col("confidence").desc(), "old_column")
    return matches.withColumn("claim", F.row_number().over(window))


def unmatched_old(counts: DataFrame, matches: DataFrame, sample: int = 5, source: DataFrame | None = None) -> DataFrame:
    """Old columns without a match, each with its most frequent values as a sample; long texts come from `source`."""
    names = counts.select("column_name").distinct().join(
        matches.select(F.col("old_column").alias("column_name")), ["column_name"], "left_anti"
    )
    wanted = counts.join(names, ["column_name"], "left_semi")
    samples = most_frequent(wanted, sample, source).groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("sample"))
    return names.join(samples, ["column_name"], "left")
