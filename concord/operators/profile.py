"""Column profiles from one long frame of distinct values.

`value_counts` turns a table into (column_name, value, n): equal values are combined before the shuffle
and every statistic is a weighted sum over the distinct values, so neither a frequent value nor a column
with many values ends up in one task.

A text of more than LONG bytes that is no number does not move: its value is a 128-bit digest, and `long` holds what
the profiles ask of the text itself (`_traits`), measured where the row was read. The few long texts that a report
shows are fetched from the table afterwards (`spelled`). Frames of counts without the column `long` hold whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from concord.functions.numbers import NUMBER, col, parsed, plain
from concord.operators.joins import only_keys
from concord.sources.scratch import stored

# Date shapes of the matcher, in order of precedence.
DATE_FORMATS = [
    ("ISO_TZ", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}:\d{2}$"),
    ("DATETIME_MS", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\.\d+$"),
    ("DATETIME", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"),
    ("DATE", r"^\d{4}-\d{2}-\d{2}$"),
]
DATE_START = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?"
LEADING_ZEROS = r"^0+\d"
LARGE_INTEGER = r"^\d{15,}$"

# Value shapes of the auditor, tested in this order, and the share that decides.
SHAPES = [
    ("date_iso", r"^\d{4}-\d{2}-\d{2}"),
    ("date_slash", r"^\d{1,2}/\d{1,2}/\d{2,4}"),
    ("numeric", r"^-?\d+\.\d+$"),
    ("integer", r"^-?\d+$"),
    ("alpha", r"^[a-zA-Z\s]+$"),
    ("alphanumeric", r"^[a-zA-Z0-9]+$"),
]
SHAPE_SHARE = 0.7
TYPE_SHARE = 0.8
BOOLEAN_SETS = [["0", "1"], ["0.0", "1.0"], ["true", "false"], ["t", "f"], ["yes", "no"], ["y", "n"]]
BOOLEAN_NAME_WORDS = ["is", "has", "flag", "status", "active", "success", "cancel", "yn", "found"]
NUMERIC_NAME_WORDS = [
    "amt", "amount", "bal", "balance", "price", "cost", "val", "sum", "total",
    "rate", "qty", "num", "interest", "principle", "charge", "fee", "tax",
]
ZERO_TEXTS = ["0", "0.0", "0.00", "0.000", "0.0000"]
# Patterns, each with the share of values that must fit.
PATTERNS = [
    ("ID_WITH_PREFIX", r"^[A-Z]{2,5}-\d+$", 0.7),
    ("NUMERIC_ID", r"^\d{8,}$", 0.7),
    ("PHONE_NUMBER", r"^[\+\d][\d\-\(\)\s]{8,}$", 0.5),
    ("EMAIL", "@", 0.5),
    ("CURRENCY", r"^[\$€£¥]?\d+[\d\.,]*$", 0.7),
]
FREE_TEXT_LENGTH, NARRATIVE_WORDS = 40, 5
MAGNITUDES = [(1, "fractional"), (100, "tens"), (10_000, "hundreds-thousands"), (1_000_000, "tens-thousands-millions")]
TOP_VALUES = 15
# Bytes above which a text is counted by its digest, and the characters of it that stay for ordering. Both are about speed.
LONG, HEAD = 512, 64
SHORT_TYPES = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def as_text(df: DataFrame, name: str) -> Column:
    """Value as text; doubles always in plain notation with a fraction, such as 100.0."""
    value = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        text = plain(value.try_cast(NUMBER))
        text = F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))
        return F.coalesce(text, value.cast("string"))
    return value.cast("string")


def _words(value: Column) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(r"\S+"), F.lit(0)))


def _shape(value: Column) -> Column:
    shape = F.lit(None).cast("string")
    for name, pattern in reversed(SHAPES):
        shape = F.when(value.rlike(pattern), name).otherwise(shape)
    return shape


def _digest(text: Column) -> Column:
    return F.concat(F.lit("#"), F.md5(text.cast("binary")))


def _traits(value: Column) -> dict[str, Column]:
    """What the profiles ask of a text. `trimmed` and `folded` tell texts apart that differ after trimming and in case."""
    text = F.trim(value)
    return {
        "head": F.left(value, F.lit(HEAD)), "trimmed": text, "folded": F.lower(text),
        "length": F.length(value), "words": _words(value), "shape": _shape(value),
        "dated": text.rlike(DATE_START), "iso": value.rlike(r"^\d{4}-\d{2}-\d{2}"),
        "day": F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(value, F.lit(10)), "yyyy-MM-dd")),
        "special": value.rlike(r"[^a-zA-Z0-9\s]"), "upper": (value == F.upper(value)) & (F.upper(value) != F.lower(value)),
        "leading_zeros": text.rlike(LEADING_ZEROS), "large_integer": F.regexp_replace(text, r"\..*", "").rlike(LARGE_INTEGER),
        "digits": value.rlike(r"^\d+$"), "codes": value.rlike(r"^[A-Z0-9\-]+$"),
        **{f"form_{name.lower()}": text.rlike(p) for name, p in DATE_FORMATS},
        **{f"pattern_{name.lower()}": value.rlike(p) for name, p, _ in PATTERNS},
    }


def with_traits(counts: DataFrame, *names: str) -> DataFrame:
    """The counts with the named traits of each value as columns."""
    own = _traits(F.col("value"))
    long = F.col("long") if "long" in counts.columns else None
    return counts.withColumns({
        name: own[name] if long is None else F.when(long.isNotNull(), long[name]).otherwise(own[name]) for name in names
    })


def _is_long(text: Column) -> Column:
    return (F.octet_length(text) > LONG) & (F.octet_length(F.trim(text)) > LONG) & parsed(F.trim(text)).isNull()


def _cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, value) for every cell."""
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), as_text(df, n).alias("value")) for n in names])
    return df.select(F.explode(cells).alias("c")).select("c.column_name", "c.value")


def _long_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, text, value, long) of every long text; `value` is its digest, `long` its traits."""
    some = reduce(lambda a, b: a | b, [F.coalesce(F.octet_length(as_text(df, n)) > LONG, F.lit(False)) for n in names])
    text = F.col("text")
    traits = _traits(text) | {"trimmed": _digest(F.trim(text)), "folded": _digest(F.lower(F.trim(text)))}
    cells = _cells(df.filter(some), names).withColumnRenamed("value", "text").filter(_is_long(text))
    return cells.select("column_name", "text", _digest(text).alias("value"), F.struct(*[c.alias(name) for name, c in traits.items()]).alias("long"))


def _text_columns(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    return [n for n in names or df.columns if not isinstance(df.schema[n].dataType, SHORT_TYPES)]


def value_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n, long): how often each value occurs; null is a value here.

    The value of a long text is its digest, and `long` its traits; of all others `long` is null. Long texts are counted
    by a scan of their own, over the columns that may hold any and the rows that do, so that short ones cost no more.
    """
    cells, texts = _cells(df, list(names or df.columns)), _text_columns(df, names)
    if not texts:
        return cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    short = cells.filter(F.coalesce(~_is_long(F.col("value")), F.lit(True))).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    long = _long_cells(df, texts).groupBy("column_name", "value", "long").agg(F.count(F.lit(1)).alias("n"))
    return short.unionByName(long, allowMissingColumns=True)


def counted_cells(df: DataFrame, counts: DataFrame) -> DataFrame:
    """(i, value): the values of every column (place of its name), each once, from the counts of the table; null is left
    out. Long texts, of which the counts hold digests, come from the table, if it has any."""
    places = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(df.columns)), "i int, column_name string"))
    held = counts.filter(F.col("value").isNotNull())
    if "long" not in counts.columns or held.filter("long is not null").isEmpty():
        return held.join(places, ["column_name"]).select("i", "value")
    texts = _long_cells(df, _text_columns(df)).select("column_name", F.col("text").alias("value"))
    return held.filter("long is null").select("column_name", "value").unionByName(texts).join(places, ["column_name"]).select("i", "value")


def spelled(counts: DataFrame, source: DataFrame) -> DataFrame:
    """The counts with the texts of `source` for digests. Only rows with one of these digests move."""
    counts = stored(counts, "spelled")
    wanted = stored(counts.filter("long is not null").select("column_name", "value"), "digests")
    # Grouped by the text itself, which the digest tells apart, so that copies are combined before they move.
    texts = only_keys(_long_cells(source, _text_columns(source)).select("column_name", "value", "text"), wanted, ["column_name", "value"]).distinct()
    whole = counts.join(texts, ["column_name", "value"], "left")
    return whole.withColumn("value", F.coalesce("text", "value")).drop("text", "long")


def most_frequent(counts: DataFrame, most: int, source: DataFrame | None = None) -> DataFrame:
    """The `most` most frequent values of each column with their `place`, the smaller of equally frequent ones first.

    Long texts are ordered by their beginnings first; those that tie with the last place are fetched from `source` and
    ordered whole. Without `source` they are ordered by, and shown as, their digests.
    """
    held = with_traits(counts.filter(F.col("value").isNotNull()), "head")
    by = Window.partitionBy("column_name")
    if source is not None and "long" in counts.columns:
        near = held.withColumn("place", F.rank().over(by.orderBy(F.col("n").desc(), "head"))).filter(F.col("place") <= most)
        held = spelled(near.drop("place"), source)
    place = F.row_number().over(by.orderBy(F.col("n").desc(), "value"))
    return held.withColumn("place", place).filter(F.col("place") <= most).select("column_name", "place", "value", "n")


def _sum(test: Column, amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, amount)), F.lit(0))


def column_meta(counts: DataFrame) -> DataFrame:
    """One row per column: noise kind, inferred type, date format, unique ratio, min, max, mean.

    Built for matching: types by more than 80 % of the non-blank values.
    """
    n, value = F.col("n"), F.col("value")
    text = F.trim(value)
    held = value.isNotNull()
    shown = held & (text != "")
    number = parsed(text)
    numeric, dated = shown & number.isNotNull(), shown & F.col("dated")
    forms = [f"form_{name.lower()}" for name, _ in DATE_FORMATS]
    counts = stored(counts, "counts")
    # Counted apart: a distinct count within the aggregate below would move all its sums once for every value.
    texts = with_traits(counts, "trimmed").filter(shown).select("column_name", "trimmed").distinct()
    texts = texts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    base = with_traits(counts, "dated", "leading_zeros", "large_integer", *forms).groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        _sum(held, n).alias("n_values"),
        _sum(held & ~text.isin("0", ""), n).alias("n_nonzero"),
        _sum(held & ~text.isin("0", "1", "true", "false"), n).alias("n_nonboolean"),
        _sum(shown, n).alias("n_shown"),
        _sum(numeric, n).alias("n_numeric"),
        _sum(dated, n).alias("n_date"),
        F.min(number).alias("min_number"), F.max(number).alias("max_number"),
        F.sum(number * n).alias("sum_number"),
        _sum(shown & F.col("leading_zeros"), n).alias("n_leading_zeros"),
        _sum(shown & F.col("large_integer"), n).alias("n_large_integer"),
        *[_sum(shown & F.col(form), n).alias(form) for form in forms],
    ).join(texts, ["column_name"], "left").fillna(0, ["n_distinct"])
    kind = (
        F.when(F.col("n_values") == 0, "NULL").when(F.col("n_nonzero") == 0, "ZERO")
        .when(F.col("n_nonboolean") == 0, "BOOLEAN").otherwise("NORMAL")
    )
    inferred = (
        F.when(F.col("kind") == "BOOLEAN", "boolean")
        .when(F.col("n_numeric") > F.col("n_shown") * TYPE_SHARE, "numeric")
        .when(F.col("n_date") > F.col("n_shown") * TYPE_SHARE, "date")
        .otherwise("string")
    )
    # The format most values have; of equals the more detailed one.
    best = F.greatest(*[F.col(f"form_{name.lower()}") for name, _ in DATE_FORMATS])
    form = F.lit("UNKNOWN")
    for name, _ in reversed(DATE_FORMATS):
        form = F.when((best > 0) & (F.col(f"form_{name.lower()}") == best), name).otherwise(form)
    is_number = F.col("inferred_type") == "numeric"
    return (
        base.withColumn("kind", kind)
        .withColumn("inferred_type", inferred)
        .withColumn("date_format", F.when(F.col("inferred_type") == "date", form))
        .withColumn("unique_ratio", F.col("n_distinct") / F.col("n_rows"))
        .withColumn("min_value", F.when(is_number, F.col("min_number").cast("double")))
        .withColumn("max_value", F.when(is_number, F.col("max_number").cast("double")))
        .withColumn("mean_value", F.when(is_number, F.col("sum_number").cast("double") / F.col("n_numeric")))
        .select(
            "column_name", "kind", "inferred_type", "date_format", "n_rows", "n_values", "n_distinct", "unique_ratio",
            "min_value", "max_value", "mean_value",
            (F.col("n_leading_zeros") > 0).alias("has_leading_zeros"),
            (F.col("n_large_integer") > 0).alias("has_large_integers"),
        )
    )


def column_profile(counts: DataFrame) -> DataFrame:
    """One row per column: rates, cardinality, number scale and constraints, date range, text shape."""
    n, value = F.col("n"), F.col("value")
    held = value.isNotNull()
    number = parsed(F.trim(value))
    numeric = held & number.isNotNull()
    base = with_traits(counts, "iso", "day", "length", "special", "upper").groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        _sum(held, n).alias("n_values"),
        F.count("value").alias("cardinality"),
        _sum(numeric, n).alias("n_numeric"), _sum(held & F.col("iso"), n).alias("n_iso"),
        F.min(number).alias("lo"), F.max(number).alias("hi"), F.sum(number * n).alias("total"),
        _sum(numeric & (number == 0), n).alias("n_zero"),
        _sum(numeric & (number < 0), n).alias("n_negative"),
        _sum(numeric & (number != F.floor(number)), n).alias("n_fraction"),
        F.min("day").alias("earliest"), F.max("day").alias("latest"),
        F.sum(F.col("length") * n).alias("chars"), F.max("length").alias("longest"),
        _sum(held & F.col("special"), n).alias("n_special"),
        _sum(held & F.col("upper"), n).alias("n_upper"),
    )
    data_type = (
        F.when(F.col("n_values") == 0, "EMPTY")
        .when(F.col("n_numeric") > F.col("n_values") * SHAPE_SHARE, "numeric")
        .when(F.col("n_iso") > F.col("n_values") * SHAPE_SHARE, "date").otherwise("text")
    )
    is_number, is_date, is_text = (F.col("data_type") == t for t in ("numeric", "date", "text"))
    # Squared distances from the mean, in a second pass over the distinct values; a row per column is broadcast.
    means = base.select("column_name", (F.col("total").cast("double") / F.nullif(F.col("n_numeric"), F.lit(0))).alias("mean"))
    gap = number.cast("double") - F.col("mean")
    spread = counts.join(F.broadcast(means), ["column_name"]).groupBy("column_name").agg(F.sum(gap * gap * n).alias("squares"))
    base = base.join(spread, ["column_name"])
    variance = F.col("squares") / (F.col("n_numeric") - 1)
    return base.withColumn("data_type", data_type).select(
        "column_name", "data_type", "row_count", "cardinality",
        (1 - F.col("n_values") / F.col("row_count")).alias("null_rate"),
        F.when(F.col("n_values") > 0, F.col("cardinality") / F.col("n_values")).alias("unique_ratio"),
        F.when(is_number, F.col("lo").cast("double")).alias("min_value"),
        F.when(is_number, F.col("hi").cast("double")).alias("max_value"),
        F.when(is_number, F.col("total").cast("double") / F.col("n_numeric")).alias("mean_value"),
        F.when(is_number, F.when(F.col("n_numeric") > 1, F.sqrt(variance)).otherwise(0.0)).alias("std_value"),
        F.when(is_number, F.col("n_negative") == 0).alias("non_negative"),
        F.when(is_number, F.col("n_fraction") == 0).alias("integer_only"),
        F.when(is_number, F.col("n_zero") / F.col("n_numeric")).alias("zero_rate"),
        F.when(is_date, F.date_format("earliest", "yyyy-MM-dd")).alias("earliest"),
        F.when(is_date, F.date_format("latest", "yyyy-MM-dd")).alias("latest"),
        F.when(is_date, F.date_diff("latest", "earliest")).alias("span_days"),
        F.when(is_text, F.col("chars") / F.col("n_values")).alias("avg_length"),
        F.when(is_text, F.col("longest")).alias("max_length"),
        F.when(is_text, F.col("n_special") > 0).alias("has_special_chars"),
        F.when(is_text, F.col("n_upper") > F.col("n_values") * TYPE_SHARE).alias("all_uppercase"),
    )


def medians(counts: DataFrame, buckets: int = 4096) -> DataFrame:
    """Exact lower median of the numbers of each column.

    Every round counts the values in `buckets` ranges per column, first on a logarithmic and then on linear scales, and
    keeps only the range that holds the median. A linear round divides the range by `buckets`, so a handful of rounds
    leaves at most `buckets` different values per column, whatever their number was; these are ordered.
    """
    numbers = counts.select("column_name", parsed(F.trim(F.col("value"))).cast("double").alias("x"), "n").filter("x is not null")
    numbers = stored(numbers.groupBy("column_name", "x").agg(F.sum("n").alias("n")), "numbers")
    middle = numbers.groupBy("column_name").agg(
        F.floor((F.sum("n") + 1) / 2).alias("middle"), F.lit(0).cast("long").alias("before")
    )
    x = F.col("x")
    scale = F.signum(x) * F.log1p(F.abs(x))
    # One number: how many values the longest column has left.
    while (numbers.groupBy("column_name").count().agg(F.max("count")).first()[0] or 0) > buckets:
        numbers, middle = (stored(df, "median") for df in _narrowed(numbers, middle, scale, buckets))
        scale = x
    running = F.sum("n").over(Window.partitionBy("column_name").orderBy("x"))
    return (
        numbers.withColumn("upto", running).join(F.broadcast(middle), ["column_name"])
        .filter(F.col("before") + F.col("upto") >= F.col("middle"))
        .groupBy("column_name").agg(F.min("x").alias("median_value"))
    )


def _narrowed(numbers: DataFrame, middle: DataFrame, scale: Column, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The values of the range that holds the middle one, and how many lie before it. Broadcasts a row per column."""
    scaled = numbers.withColumn("y", scale)
    ranges = scaled.groupBy("column_name").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    share = (F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    bucket = F.least(F.coalesce(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    placed = scaled.join(F.broadcast(ranges), ["column_name"]).select("column_name", "x", "n", bucket.alias("bucket"))
    sizes = placed.groupBy("column_name", "bucket").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy("column_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        sizes.join(F.broadcast(middle), ["column_name"])
        .withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .filter((F.col("upto") < F.col("middle")) & (F.col("upto") + F.col("size") >= F.col("middle")))
        .select("column_name", "bucket", "middle", F.col("upto").alias("before"))
    )
    kept = placed.join(F.broadcast(chosen.select("column_name", "bucket")), ["column_name", "bucket"]).drop("bucket")
    return kept, chosen.drop("bucket")


def number_shape(counts: DataFrame) -> DataFrame:
    """column_name, decimals (the commonest number of decimals, the smaller of equals), magnitude of the mean."""
    value, n = F.trim(F.col("value")), F.col("n")
    number = parsed(value)
    numbers = counts.filter(number.isNotNull()).select(
        "column_name", number.alias("x"), F.length(F.regexp_extract(value, r"\.(\d+)", 1)).alias("decimals"), "n"
    )
    per = numbers.groupBy("column_name", "decimals").agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s"))
    fractions = F.when(F.col("decimals") > 0, F.struct("n", (-F.col("decimals")).alias("d")))
    shape = per.groupBy("column_name").agg(
        F.coalesce(-F.max(fractions)["d"], F.lit(0)).alias("decimals"),
        F.abs(F.sum("s").cast("double") / F.sum("n")).alias("size"),
    )
    magnitude = F.lit("millions-plus")
    for limit, word in reversed(MAGNITUDES):
        magnitude = F.when(F.col("size") < limit, word).otherwise(magnitude)
    return shape.select("column_name", "decimals", magnitude.alias("magnitude"))


def shape_counts(counts: DataFrame, *more: Column) -> DataFrame:
    """Per column: values, which words of the boolean sets occur (a bit each), and how many values fit each shape and
    pattern; `more` joins the same pass."""
    n, value = F.col("n"), F.col("value")
    held = value.isNotNull()
    low = F.lower(F.trim(value))
    patterns = [f"pattern_{name.lower()}" for name, _, _ in PATTERNS]
    word = F.lit(0)
    for i, text in enumerate(text for words in BOOLEAN_SETS for text in words):
        word = F.when(low == text, 1 << i).otherwise(word)
    return with_traits(counts, "shape", "length", "words", *patterns).groupBy("column_name").agg(
        _sum(held, n).alias("n_values"),
        F.bit_or(word).alias("boolean_words"),
        *[_sum(F.col("shape") == name, n).alias(f"shape_{name}") for name, _ in SHAPES],
        *[_sum(held & F.col(p), n).alias(p) for p in patterns],
        *[_sum(held & ~low.isin(words), n).alias(f"not_boolean_{i}") for i, words in enumerate(BOOLEAN_SETS)],
        F.sum(F.when(held, F.col("length")) * n).alias("chars"),
        F.sum(F.when(held, F.col("words")) * n).alias("words"),
        *more,
    )


def _name_has(words: Sequence[str]) -> Column:
    return F.lower("column_name").rlike("|".join(words))


def _column_type() -> Column:
    boolean = F.least(*[F.col(f"not_boolean_{i}") for i in range(len(BOOLEAN_SETS))]) == 0
    # All values are of one set, so its two words are all the texts there can be.
    both_words = F.bit_count("boolean_words") == 2
    by_shape = F.lit("alphanumeric")
    for name, _ in reversed(SHAPES):
        by_shape = F.when(F.col(f"shape_{name}") > F.col("n_values") * SHAPE_SHARE, name).otherwise(by_shape)
    return (
        F.when(F.col("n_values") == 0, "EMPTY")
        .when(boolean & _name_has(NUMERIC_NAME_WORDS), "numeric")
        .when(boolean & _name_has(BOOLEAN_NAME_WORDS), "boolean")
        .when(boolean, F.when(both_words, "boolean").otherwise("numeric"))
        .otherwise(by_shape)
    )


def column_types(shapes: DataFrame) -> DataFrame:
    """column_name, column_type: boolean sets with name hints first, then the shape of most values."""
    return shapes.select("column_name", _column_type().alias("column_type"))


def column_patterns(shapes: DataFrame) -> DataFrame:
    """column_name, patterns, avg_length, avg_words."""
    fits = {
        name: F.col(f"pattern_{name.lower()}") > F.col("n_values") * share for name, _, share in PATTERNS
    }
    fits["NUMERIC_ID"] = fits["NUMERIC_ID"] & ~fits["ID_WITH_PREFIX"]
    fits["FREE_TEXT"] = F.floor(F.col("chars") / F.col("n_values")) > FREE_TEXT_LENGTH
    fits["NARRATIVE"] = F.col("words") / F.col("n_values") > NARRATIVE_WORDS
    names = F.filter(F.array(*[F.when(test, name) for name, test in fits.items()]), lambda p: p.isNotNull())
    return shapes.filter("n_values > 0").select(
        "column_name", names.alias("patterns"),
        F.floor(F.col("chars") / F.col("n_values")).alias("avg_length"),
        (F.col("words") / F.col("n_values")).alias("avg_words"),
    )


def fingerprints(counts: DataFrame) -> DataFrame:
    """One row per column: null share, cardinality, entropy, zero share, numeric statistics."""
    n, value = F.col("n"), F.col("value")
    held = value.isNotNull()
    number = parsed(F.trim(value))
    # Entropy of p = n / total: log2(total) - sum(n * log2 n) / total, so no second pass needs the total.
    base = shape_counts(
        counts,
        F.sum("n").alias("n_rows"), F.count("value").alias("cardinality"),
        F.sum(F.when(held, n * F.log2(n))).alias("n_log_n"),
        _sum(held & F.trim(value).isin(ZERO_TEXTS), n).alias("n_zero"),
        F.min(number).alias("lo"), F.max(number).alias("hi"), F.sum(number * n).alias("total"),
        _sum(number.isNotNull(), n).alias("n_numeric"),
    ).withColumn("column_type", _column_type())
    some = F.col("n_values") > 0
    return base.select(
        "column_name", "column_type", "cardinality",
        ((1 - F.col("n_values") / F.col("n_rows")) * 100).alias("null_pct"),
        F.when(some, F.col("cardinality") / F.col("n_values")).otherwise(0.0).alias("unique_ratio"),
        F.when(some, F.greatest(F.log2("n_values") - F.col("n_log_n") / F.col("n_values"), F.lit(0.0))).otherwise(0.0).alias("entropy"),
        F.when(some, F.col("n_zero") / F.col("n_values") * 100).otherwise(0.0).alias("zero_pct"),
        (some & (F.col("n_zero") > F.col("n_values") * 0.95)).alias("is_all_zeros"),
        (F.col("column_type") == "boolean").alias("is_boolean"),
        F.col("lo").cast("double").alias("min_value"), F.col("hi").cast("double").alias("max_value"),
        F.when(F.col("n_numeric") > 0, F.col("total").cast("double") / F.col("n_numeric")).alias("mean_value"),
    )


def top_values(counts: DataFrame, most: int = TOP_VALUES, source: DataFrame | None = None) -> DataFrame:
    """The `most` most frequent values of each column: column_name, place, value, n, share. `source`: see `most_frequent`."""
    sizes = counts.filter(F.col("value").isNotNull()).groupBy("column_name").agg(F.sum("n").alias("n_values"))
    few = most_frequent(counts, most, source).join(F.broadcast(sizes), ["column_name"])  # a row per column
    return few.select("column_name", "place", "value", "n", (F.col("n") / F.col("n_values")).alias("share"))


def type_similarity(left: Column, right: Column) -> Column:
    pair = [left.isin("numeric", "integer"), right.isin("numeric", "integer")]
    contains = (left != "") & (right != "") & (right.contains(left) | left.contains(right))
    return F.when(left == right, 30).when(pair[0] & pair[1], 20).when(contains, 10).otherwise(0)


def fingerprint_similarity(prefix_a: str = "old_", prefix_b: str = "new_") -> Column:
    """0 to 100 from two fingerprints in one row: type 30, cardinality 20, entropy 15, boolean 10, nulls 10, zeros 15."""

    def both(name: str) -> tuple[Column, Column]:
        return F.col(prefix_a + name), F.col(prefix_b + name)

    def ratio(a: Column, b: Column) -> Column:
        return F.least(a, b) / F.greatest(a, b)

    c, e, z = both("cardinality"), both("entropy"), both("is_all_zeros")
    boolean, nulls = both("is_boolean"), both("null_pct")
    score = (
        type_similarity(*both("column_type"))
        + F.when((c[0] > 0) & (c[1] > 0), ratio(*c) * 20).otherwise(0.0)
        + F.when((e[0] > 0) & (e[1] > 0), (1 - F.abs(e[0] - e[1]) / F.greatest(*e)) * 15).otherwise(0.0)
        + F.when(boolean[0] == boolean[1], 10).otherwise(0)
        + (1 - F.abs(nulls[0] - nulls[1]) / 100) * 10
        + F.when(z[0] & z[1], 15).otherwise(0)
    )
    return F.least(score, F.lit(100.0))
