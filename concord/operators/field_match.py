"""Field matching of the auditor: values along the anchor, shared values, names and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.numbers import NUMBER, to_number
from concord.functions.text import KEEP_PLAIN, REWRITES, comparable, name_similarity
from concord.operators.matching import paired_profiles, ranked_claims
from concord.operators.overlap import shared_cells, shared_values
from concord.operators.profile import as_text, counted_cells, fingerprint_similarity, fingerprints, value_counts
from concord.sources.scratch import stored

# Score weights, thresholds and the words of a split.
LOW_CARDINALITY = 5
WEIGHTS = {
    # (anchored, few values): row match, name, fingerprint, shared values
    (True, True): (0.30, 0.40, 0.20, 0.10),
    (True, False): (0.60, 0.15, 0.15, 0.10),
    (False, True): (0.0, 0.50, 0.30, 0.20),
    (False, False): (0.0, 0.35, 0.35, 0.30),
}
VETO_VALUES = 10
EVICT_CONFIDENCE, EVICT_GAP = 95, 15
SUSPICIOUS_CONFIDENCE, SUSPICIOUS_NAME = 85, 50
SPLIT_PREFIXES = [
    "debit", "credit", "adj", "org", "prev", "curr", "old", "new", "base", "net", "gross", "txcal",
    "running", "la", "npa", "npl",
]
SPLIT_SUFFIXES = ["debit", "credit", "in", "out", "b4t", "aft", "before", "after", "lv1", "lv2", "a", "b"]
SPLIT_TYPES = [
    ("debit", "credit", "DEBIT_CREDIT_SPLIT"),
    ("b4t", "aft", "BEFORE_AFTER_SPLIT"),
    ("adj", "org", "ORIGINAL_ADJUSTED_SPLIT"),
    ("prev", "curr", "PREV_CURRENT_SPLIT"),
    ("base", "net", "BASE_NET_SPLIT"),
    ("gross", "net", "GROSS_NET_SPLIT"),
]
MIN_STEM, STEM_TO_COLUMN, STEM_TO_STEM = 4, 0.6, 0.65
FORMULA_SHARE, FORMULA_TOLERANCE = 0.90, "0.01"
# Pairs per column from which an index of values is made, and comparisons counted in one pass. Both decide about the plan only.
INDEX_FROM, BLOCK = 64, 1024


def comparable_overlap(old: DataFrame, new: DataFrame, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Shared values of every pair of columns in their comparable form, with the share of old values found. With the
    counts of both tables' values, each different value is brought to its form once."""
    if counts is None:
        shared = shared_values(
            old, new, [(n, as_text(old, n)) for n in old.columns], [(n, as_text(new, n)) for n in new.columns], comparable,
        )
    else:
        # Not filtered behind the form: the filter would be pushed below it and compute it twice.
        cells = [counted_cells(df, own).select("i", comparable(F.col("value")).alias("value")) for df, own in zip((old, new), counts)]
        shared = shared_cells(*cells, old.columns, new.columns)
    return shared.withColumn("set_match", F.col("n_shared") / F.col("n_old") * 100)


def _distinct_rewrites(joined: DataFrame, names: list[str], suffix: str) -> DataFrame:
    """(i, value) for every column and rewrite: place of the column times rewrites plus place of the rewrite, and the
    rewritten text behind the rewrite's number, so that only texts of one rewrite meet. Only different values are rewritten."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), as_text(joined, f"{n}_{suffix}").alias("text")) for i, n in enumerate(names)])
    values = joined.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("text").isNotNull()).distinct()
    rewritten = F.array(*[F.struct((F.col("c") * len(REWRITES) + j).alias("i"), F.concat(F.lit(f"{j}:"), rule(F.col("text"))).alias("value")) for j, rule in enumerate(REWRITES.values())])
    return values.select(F.explode(rewritten).alias("x")).select("x.*")


def _shared_rewrites(joined: DataFrame, olds: list[str], news: list[str]) -> set[tuple[int, int]]:
    """Places (column times rewrites plus rewrite) of the pairs that share a rewritten value: an inverted index of the
    values. A row per pair and rewrite comes to the driver."""
    sides = [[str(i) for i in range(len(names) * len(REWRITES))] for names in (olds, news)]
    shared = shared_cells(_distinct_rewrites(joined, olds, "O"), _distinct_rewrites(joined, news, "N"), *sides)
    return {(int(r.old_column), int(r.new_column)) for r in shared.select("old_column", "new_column").collect()}


def _both_null(joined: DataFrame, olds: list[str], news: list[str]) -> DataFrame:
    """o, n (places of columns), n_null: rows where both are null. Rows are first counted by which columns are null."""
    def nulls(names: list[str], suffix: str) -> Column:
        return F.filter(F.array(*[F.when(as_text(joined, f"{n}_{suffix}").isNull(), F.lit(i)) for i, n in enumerate(names)]), lambda i: i.isNotNull())

    patterns = joined.select(nulls(olds, "O").alias("os"), nulls(news, "N").alias("ns")).groupBy("os", "ns").agg(F.count(F.lit(1)).alias("rows"))
    pairs = patterns.select(F.explode("os").alias("o"), "ns", "rows").select("o", F.explode("ns").alias("n"), "rows")
    return pairs.groupBy("o", "n").agg(F.sum("rows").alias("n_null"))


def _equal_rows(joined: DataFrame, olds: list[str], news: list[str], wanted: list[tuple[int, int]]) -> tuple[dict[tuple[int, int], int], int]:
    """Rows where an old and a new column are equal after a rewrite, null equal to null, by number in `wanted` (places of
    columns) and rewrite; and the number of all rows.

    Equal texts are equal after every rewrite. No rewrite touches the digits of a text but for zeros at its beginning, so
    unlike digits settle the others; what is left over of a row becomes cells, which alone are rewritten.
    """
    counts, total = dict.fromkeys(((k, j) for k in range(len(wanted)) for j in range(len(REWRITES))), 0), 0
    texts = [as_text(joined, f"{n}_{suffix}") for names, suffix in ((olds, "O"), (news, "N")) for n in names]
    none, size = F.lit(None).cast("string"), max(1, BLOCK // len(REWRITES))
    for start in range(0, len(wanted) or 1, size):
        block = [(k, a, len(olds) + b) for k, (a, b) in enumerate(wanted[start:start + size], start)]
        used = sorted({i for _, *two in block for i in two})
        digits = [F.ltrim(F.regexp_replace(F.col(f"t{i}"), "[^0-9]+", ""), F.lit("0")).alias(f"d{i}") for i in used]
        rows = joined.select(*[texts[i].alias(f"t{i}") for i in used]).select("*", *digits)

        def cell(k: int, a: Column, b: Column) -> Column:
            return F.struct(F.lit(k).alias("pair"), a.alias("a"), b.alias("b"))

        every = F.array(cell(-1, none, none), *[  # -1: the row itself
            F.when(F.col(f"t{a}").eqNullSafe(F.col(f"t{b}")), cell(k, none, none))
            .when(F.col(f"d{a}") == F.col(f"d{b}"), cell(k, F.col(f"t{a}"), F.col(f"t{b}"))) for k, a, b in block])
        cells = rows.select(F.explode(every).alias("c")).filter(F.col("c").isNotNull()).select("c.*")
        a, b = F.col("a"), F.col("b")
        odd = F.concat(a, b).rlike("[^0-9A-Za-z]")
        bits = [F.when((odd & (rule(a) == rule(b))) if name in KEEP_PLAIN else (rule(a) == rule(b)), 1 << j).otherwise(0) for j, (name, rule) in enumerate(REWRITES.items())]
        equal = F.when(a.isNull(), (1 << len(REWRITES)) - 1).otherwise(reduce(lambda x, y: x + y, bits))
        # A row per pair and set of rewrites.
        for r in cells.select("pair", equal.alias("equal")).groupBy("pair", "equal").agg(F.count(F.lit(1)).alias("rows")).collect():
            if r.pair < 0:
                total = r.rows
            for j in range(len(REWRITES)) if r.pair >= 0 else ():
                counts[r.pair, j] += r.rows if r.equal >> j & 1 else 0
    return counts, total


def rewrite_rates(joined: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """old_column, new_column, place, rule, match_rate over the anchored rows, for every pair and rewrite.

    Only pairs that share a rewritten value at all are compared row by row; the others agree where both columns
    are null, and nowhere else. The index of values is made where there are many pairs to a column (INDEX_FROM); of
    fewer the comparison costs less than the index, and all are compared.
    """
    olds, news = (list(dict.fromkeys(side)) for side in zip(*pairs))
    n_rules = len(REWRITES)
    indexed = len(pairs) > INDEX_FROM * (len(olds) + len(news))
    if indexed or len(pairs) * n_rules > BLOCK:
        joined = stored(joined, "anchored")
    tried = [(olds.index(o), news.index(n)) for o, n in pairs]
    shared = {(a // n_rules, b // n_rules) for a, b in _shared_rewrites(joined, olds, news) if a % n_rules == b % n_rules} if indexed else set(tried)
    compared = [k for k, at in enumerate(tried) if at in shared]
    counts, total = _equal_rows(joined, olds, news, [tried[k] for k in compared])
    equal = {(compared[k], j): n for (k, j), n in counts.items()}
    # A row per pair and rewrite, as the plan of what was asked.
    found = joined.sparkSession.createDataFrame(
        [(*tried[k], o, n, j, rule, equal.get((k, j))) for k, (o, n) in enumerate(pairs) for j, rule in enumerate(REWRITES)],
        "o int, n int, old_column string, new_column string, place int, rule string, n_equal long")
    found = found.join(_both_null(joined, olds, news), ["o", "n"], "left") if indexed else found.withColumn("n_null", F.lit(0))
    return found.select("old_column", "new_column", "place", "rule", (F.coalesce("n_equal", "n_null", F.lit(0)) / max(total, 1)).alias("match_rate"))


def best_rewrites(rates: DataFrame) -> DataFrame:
    """The rewrite with the best rate per pair; of equals the simplest."""
    best = F.max_by(F.struct("rule", "match_rate"), F.struct("match_rate", (-F.col("place")).alias("p")))
    return rates.groupBy("old_column", "new_column").agg(best.alias("b")).select(
        "old_column", "new_column", "b.rule", "b.match_rate"
    )


def possible_pairs(old: DataFrame, new: DataFrame, overlaps: DataFrame, old_prints: DataFrame, new_prints: DataFrame) -> DataFrame:
    """Pairs of columns the scoring looks at: without those that share nothing although both hold many values."""
    pairs = paired_profiles(old_prints, new_prints, old.columns, new.columns)
    known = overlaps.select("old_column", "new_column", "set_match")
    scored = pairs.join(known, ["old_column", "new_column"], "left").withColumn("set_match", F.coalesce("set_match", F.lit(0.0)))
    veto = (F.col("set_match") == 0) & (F.col("old_cardinality") > VETO_VALUES) & (F.col("new_cardinality") > VETO_VALUES)
    return scored.filter(~veto | F.col("old_is_all_zeros"))


def _score(anchored: bool) -> Column:
    few = F.col("old_is_boolean") | F.col("new_is_boolean") | (F.least("old_cardinality", "new_cardinality") <= LOW_CARDINALITY)

    def weighted(low: bool) -> Column:
        row, name, prints, values = WEIGHTS[(anchored, low)]
        return F.col("row_match") * row + F.col("name_sim") * name + F.col("fp_sim") * prints + F.col("set_match") * values

    zero = F.when(F.col("name_sim") > 95, 100.0).otherwise(F.col("name_sim") * 0.9 + F.col("fp_sim") * 0.1)
    return F.when(F.col("old_is_all_zeros"), zero).when(few, weighted(True)).otherwise(weighted(False))


def decide_matches(scored: DataFrame) -> DataFrame:
    """The best new column per old one and what the evidence says about it."""
    keep = [
        "new_column", "row_match", "set_match", "name_sim", "fp_sim", "score", "rule",
        "old_column_type", "new_column_type", "old_is_all_zeros", "old_cardinality",
    ]
    best = F.max_by(F.struct(*keep), F.struct(F.round("score", 6).alias("s"), (-F.col("new_place")).alias("p")))
    chosen = scored.groupBy("old_column").agg(best.alias("b")).select("old_column", "b.*")
    zero = F.col("old_is_all_zeros")
    row, by_set, name, score = F.col("row_match"), F.col("set_match"), F.col("name_sim"), F.col("score")
    rewritten = F.coalesce(~F.col("rule").isin("RAW", "NONE"), F.lit(False))
    empty = F.col("old_cardinality") == 0
    status = (
        F.when(empty, "EMPTY_COLUMN")
        .when(~zero & (row > 90), "VERIFIED (Data Match)")
        .when(~zero & (row > 85) & rewritten, "VERIFIED (Data Match)")
        .when(~zero & (by_set > 95), "VERIFIED (Set Match)")
        .when(zero & (name > 95), "VERIFIED")
        .when(zero & (score > 80), "MANUAL_CHECK")
        .when(score > 95, "VERIFIED")
        .otherwise("MANUAL_CHECK")
    )
    confidence = (
        F.when(empty, 100.0)
        .when(~zero & (row > 90), 100.0)
        .when(~zero & (row > 85) & rewritten, F.least(F.lit(98.0), score))
        .when(~zero & (by_set > 95), 98.0)
        .when(zero & (name > 95), 100.0)
        .otherwise(score)
    )
    a, b = F.col("old_column_type"), F.col("new_column_type")
    mismatch = ~((a == b) | (a.isin("numeric", "integer") & b.isin("numeric", "integer")))
    decided = chosen.withColumns({"status": status, "confidence": confidence, "type_mismatch": mismatch})
    halved = F.col("type_mismatch") & ~F.col("status").isin("VERIFIED (Data Match)", "VERIFIED (Set Match)", "EMPTY_COLUMN")
    return decided.withColumn("halved", halved).select(
        "old_column", F.when(empty, F.lit(None)).otherwise(F.col("new_column")).alias("new_column"),
        F.when(F.col("halved") & (F.col("confidence") * 0.5 < 80), "MANUAL_CHECK").otherwise(F.col("status")).alias("status"),
        F.when(F.col("halved"), F.col("confidence") * 0.5).otherwise(F.col("confidence")).alias("confidence"),
        "row_match", "set_match", "name_sim", "fp_sim", "rule", "type_mismatch",
        a.alias("old_type"), b.alias("new_type"),
    )


def match_fields(old: DataFrame, new: DataFrame, joined: DataFrame | None = None, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Matches of all old columns; `joined` is the anchored join if a key was found, `counts` the value counts if they are known."""
    old_prints, new_prints = map(fingerprints, counts or (value_counts(old), value_counts(new)))
    # A row per pair of columns, read more than once below.
    pairs = stored(possible_pairs(old, new, comparable_overlap(old, new, counts), old_prints, new_prints), "pairs")
    if joined is None:
        rated = pairs.withColumn("rule", F.lit("NONE")).withColumn("row_match", F.lit(0.0))
    else:
        # Names only: at most a row per pair of columns.
        wanted = sorted((r.old_column, r.new_column) for r in pairs.select("old_column", "new_column").collect())
        best = best_rewrites(rewrite_rates(joined, wanted)).withColumn("row_match", F.col("match_rate") * 100)
        rated = pairs.join(best.drop("match_rate"), ["old_column", "new_column"], "left").fillna(0.0, ["row_match"])
        rated = rated.withColumns({
            "row_match": F.when(F.col("old_is_all_zeros"), 0.0).otherwise(F.col("row_match")),
            "rule": F.when(F.col("old_is_all_zeros"), "NONE").otherwise(F.coalesce("rule", F.lit("NONE"))),
        })
    scored = rated.withColumn("set_match", F.when(F.col("old_is_all_zeros"), 0.0).otherwise(F.col("set_match"))).withColumns({
        "name_sim": name_similarity(F.col("old_column"), F.col("new_column")) * 100,
        "fp_sim": fingerprint_similarity(),
    })
    return decide_matches(scored.withColumn("score", _score(joined is not None)))


def with_configured(matches: DataFrame, configured: list[tuple[str, str]]) -> DataFrame:
    """Configured mappings are verified as they stand, and their new columns are closed to other matches."""
    if not configured:
        return matches
    spark = matches.sparkSession
    fixed = spark.createDataFrame(configured, "old_column string, new_column string")
    rest = matches.join(F.broadcast(fixed.select("old_column")), ["old_column"], "left_anti").join(
        F.broadcast(fixed.select("new_column")), ["new_column"], "left_anti"
    )
    known = fixed.select("old_column", "new_column", F.lit("VERIFIED (Schema Mapping)").alias("status"), F.lit(100.0).alias("confidence"))
    return rest.unionByName(known, allowMissingColumns=True)


def resolve_collisions(matches: DataFrame) -> DataFrame:
    """One owner per new column: a clearly better claim evicts the others, a close one is marked a tie."""
    claims = ranked_claims(matches.filter(F.col("new_column").isNotNull()))
    winners = claims.filter("claim = 1").select(
        "new_column", F.col("old_column").alias("winner"), F.col("confidence").alias("winner_confidence")
    )
    counted = claims.groupBy("new_column").agg(F.count(F.lit(1)).alias("n_claims"))
    all_claims = claims.join(winners, ["new_column"]).join(counted, ["new_column"])
    clear = (F.col("winner_confidence") >= EVICT_CONFIDENCE) | (F.col("winner_confidence") - F.col("confidence") >= EVICT_GAP)
    outcome = (
        F.when(F.col("n_claims") == 1, "SOLE").when(F.col("claim") == 1, "OWNER")
        .when(clear, "EVICTED").otherwise("TIE")
    )
    return all_claims.withColumn("claim_outcome", outcome).select(
        "old_column", "new_column", "claim_outcome", "winner",
        F.when(outcome == "EVICTED", "MANUAL_CHECK").otherwise(F.col("status")).alias("status"),
        F.when(outcome == "EVICTED", 0.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def orphan_status(pairs: DataFrame, old_prints: DataFrame, new_prints: DataFrame, overlaps: DataFrame) -> DataFrame:
    """For matched pairs: does the new column hold data, and if not, are the old values found in another one?"""

    def held(prints: DataFrame, side: str) -> DataFrame:
        return prints.select(F.col("column_name").alias(f"{side}_column"), (F.col("cardinality") > 0).alias(f"{side}_has_data"))

    found = overlaps.filter(F.col("n_shared") >= F.least(F.lit(3.0), F.col("n_old") * 0.3)).groupBy("old_column").agg(
        F.max_by("new_column", F.struct("n_shared", "new_column")).alias("alternative_column")
    )
    status = (
        F.when(~F.col("old_has_data"), "OLD_EMPTY").when(F.col("new_has_data"), "HAS_DATA")
        .when(F.col("alternative_column").isNotNull(), "SCHEMA_MATCH_ONLY").otherwise("DATA_LOST")
    )
    joined = pairs.select("old_column", "new_column").join(held(old_prints, "old"), ["old_column"]).join(
        held(new_prints, "new"), ["new_column"]).join(found, ["old_column"], "left")
    return joined.select(
        "old_column", "new_column", status.alias("status"),
        F.when(status == "SCHEMA_MATCH_ONLY", F.col("alternative_column")).alias("alternative_column"),
    )


def _stem(name: Column) -> Column:
    """Name without the first fitting prefix and suffix, if more than three letters remain."""
    lower = F.regexp_replace(F.lower(name), f"^(?:{'|'.join(SPLIT_PREFIXES)})(?=.{{4}})", "")
    return F.regexp_replace(lower, f"(?<=.{{4}})(?:{'|'.join(SPLIT_SUFFIXES)})$", "")


def _stem_similarity(stem: Column, name: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(F.length(stem) < MIN_STEM, 0.0).when(stem == lower, 1.0)
        .when(lower.contains(stem), F.length(stem) / F.length(lower))
        .otherwise(name_similarity(stem, lower))
    )


def split_siblings(matches: DataFrame, new_names: list[str]) -> DataFrame:
    """New columns that look like the other half of a matched one, with the kind of split their names suggest."""
    matched = matches.filter(
        F.col("new_column").isNotNull() & ~F.col("status").isin("EMPTY_COLUMN", "ZERO_COLUMN")
    ).select("old_column", F.col("new_column").alias("primary_column"))
    others = F.explode(F.array(*[F.lit(n) for n in new_names]))
    pairs = matched.withColumn("sibling_column", others).join(
        matches.filter(F.col("new_column").isNotNull()).select(F.col("new_column").alias("sibling_column")).distinct(),
        ["sibling_column"], "left_anti",
    )
    # Plain columns first: the similarity expressions below use each stem many times.
    stems = pairs.withColumns({
        "old_stem": _stem(F.col("old_column")), "primary_stem": _stem(F.col("primary_column")),
        "sibling_stem": _stem(F.col("sibling_column")),
    })
    near = _stem_similarity(F.col("old_stem"), F.col("sibling_column"))
    stems_near = _stem_similarity(F.col("primary_stem"), F.col("sibling_stem"))
    embedded = (F.length("old_column") >= MIN_STEM) & F.lower("sibling_column").contains(F.lower("old_column"))

    def mentions(name: str, first: str, second: str) -> Column:
        lower = F.lower(name)
        return lower.contains(first) | lower.contains(second)

    kind = F.lit("UNKNOWN_SPLIT")
    for first, second, label in reversed(SPLIT_TYPES):
        kind = F.when(mentions("primary_column", first, second) & mentions("sibling_column", first, second), label).otherwise(kind)
    return stems.filter(embedded | (near > STEM_TO_COLUMN) | (stems_near > STEM_TO_STEM)).select(
        "old_column", "primary_column", "sibling_column", kind.alias("split_type"), near.alias("stem_similarity")
    )


def split_formulas(joined: DataFrame, old_column: str, new_columns: list[str]) -> DataFrame:
    """SUM, DIFFERENCE and SPLIT_BY_SIGN over the anchored rows: which of them gives the old column."""
    zero = F.lit(0).cast(NUMBER)

    def number(name: str) -> Column:
        return F.coalesce(to_number(F.col(f"`{name}`")), zero)

    actual = number(f"{old_column}_O")
    parts = [number(f"{c}_N") for c in new_columns]
    total, size = parts[0], F.abs(parts[0])
    for part in parts[1:]:
        total, size = total + part, size + F.abs(part)
    formulas = {"SUM": total, "SPLIT_BY_SIGN": size}
    if len(parts) > 1:
        formulas["DIFFERENCE"] = parts[0] - parts[1]
    rows = joined.select(actual.alias("actual"), *[f.cast("decimal(38,8)").alias(n) for n, f in formulas.items()])
    # A single number, computed before the rows are judged.
    mean = rows.agg(F.avg(F.abs("actual"))).scalar()
    one_percent = F.lit(FORMULA_TOLERANCE).cast("decimal(4,2)")
    allowed = F.when(mean > 0, mean * one_percent).otherwise(one_percent)
    rates = rows.agg(*[F.avg(F.when(F.abs(F.col(n) - F.col("actual")) <= allowed, 1.0).otherwise(0.0)).alias(n) for n in formulas])
    cells = F.array(*[F.struct(F.lit(n).alias("formula"), F.col(n).alias("match_rate")) for n in formulas])
    return rates.select(F.explode(cells).alias("c")).select(
        F.lit(old_column).alias("old_column"), "c.formula", "c.match_rate",
        F.when(F.col("c.match_rate") >= FORMULA_SHARE, "CONFIRMED_SPLIT").otherwise("NOT_CONFIRMED").alias("status"),
    )


def coverage(source_columns: DataFrame, matches: DataFrame) -> DataFrame:
    """Per source table: columns, mapped, orphaned, and the share mapped. `matches` names its table."""
    mapped = matches.filter(F.col("status").contains("VERIFIED")).select("table_name", F.col("old_column").alias("column_name")).distinct()
    found = source_columns.join(mapped.withColumn("mapped", F.lit(True)), ["table_name", "column_name"], "left")
    is_mapped = F.col("mapped").isNotNull()
    return found.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if(is_mapped).alias("n_mapped"), F.count_if(~is_mapped).alias("n_orphaned"),
        F.avg(F.when(is_mapped, 1.0).otherwise(0.0)).alias("coverage_rate"),
    )


def suspicious_matches(matches: DataFrame) -> DataFrame:
    """Verified matches someone should look at again."""
    verified = F.col("status").contains("VERIFIED")
    typed = verified & (F.col("confidence") > SUSPICIOUS_CONFIDENCE) & F.col("type_mismatch")
    boolean = (F.col("old_type") == "boolean") | (F.col("new_type") == "boolean")
    named = verified & boolean & (F.col("name_sim") < SUSPICIOUS_NAME)
    reason = F.when(named, "boolean column, unlike names").when(typed, "type mismatch, high confidence")
    return matches.withColumn("reason", reason).filter(F.col("reason").isNotNull())
