"""Queries of schema operators, profiles, matches and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.catalog import query, with_tables
from concord.operators import anchors, field_match, matching, overlap, profile, schema
from concord.operators.anchor_search import search_anchor
from concord.operators.noisy import noisy_columns
from concord.rules import Exact, Mappings, RowFilter, FilteredSum

F7_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "all_null", "all_zero",
              "zero_or_blank", "zero_one", "true_false", "some_null"]
F8_OLD_COLUMNS = ["order_accountno", "id", "customer_key", "order_status", "total_price", "order_priority", "order_date",
                  "document_no", "active_flag", "spare", "note_text"]
F8_NEW_COLUMNS = ["order_account_no", "id", "cust_key", "orderstatus", "total_price_amt", "order_prio", "order_datetime",
                  "documentno", "note_text", "fixed_seven"]
NUMBER_SQL = "try_cast(trim(value) as decimal(28,8))"


def long_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as column_name, cast({c} as varchar) as value from {table}" for c in columns)


def names_sql(columns: list[str], alias: str = "column_name") -> str:
    rows = ", ".join(f"('{c}', {i})" for i, c in enumerate(columns))
    return f"select * from (values {rows}) t({alias}, place)"


def rounded(df, digits: int = 6):
    return df.select(*[
        F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


# ---- schema ---------------------------------------------------------------------------------------

@query("noisy_columns", with_tables("""
select column_name, case when n_values = 0 then 'NULL' when n_nonzero = 0 then 'ZERO' when n_nonboolean = 0 then 'BOOLEAN' else 'NORMAL' end as kind,
       n_values, n_nonzero, n_nonboolean from (
  select column_name, count(value) as n_values, count(case when value not in ('0', '') then 1 end) as n_nonzero,
         count(case when value not in ('0', '1', 'true', 'false') then 1 end) as n_nonboolean from long group by column_name) t
""", f7=X.F7, long=long_sql("f7", F7_COLUMNS)))
def noisy(spark, folder):
    return noisy_columns(X.derive(spark, folder, X.F7))


PARTIAL = Mappings(
    exact=(Exact("o_orderstatus", "status"), Exact("gone", "custno"), Exact("custref", "lost")),
    filtered_sum=(FilteredSum("o_totalprice", "totalprice", RowFilter(("A",), "C")),),
)


def fixed_frame(spark, rows, columns):
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))


F1_OLD_COLUMNS = ["o_orderkey", "o_custkey", "custref", "o_orderstatus", "o_totalprice", "orderdate", "o_orderpriority"]
F1_NEW_COLUMNS = ["id", "custno", "status", "totalprice", "order_day", "label"]


def counts_sql(table: str, names: list[str]) -> str:
    """column_name and how many rows have a value there."""
    return " union all ".join(f"select '{n}' as column_name, count({n}) as n_values from {table}" for n in names)


def values_in(df):
    """The same of a table, in one pass over it."""
    totals = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("n_values")) for i, c in enumerate(df.columns)])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


@query("missing_columns", with_tables(
    """
select error_type, old_column, new_column, n_rows from (
  select distinct 'COLUMN_MISSING' as error_type, side, case when side = 'old' then name end as old_column, case when side = 'new' then name end as new_column from (
    select side, name from (values ('old', 'o_orderstatus'), ('old', 'gone'), ('old', 'custref'), ('old', 'o_totalprice'), ('old', 'affectcode'), ('old', 'debitcredit'),
      ('new', 'status'), ('new', 'custno'), ('new', 'lost'), ('new', 'totalprice')) m(side, name)
  ) t where (side = 'old' and name not in (select column_name from old_names)) or (side = 'new' and name not in (select column_name from new_names))
) e join (select 'old' as side, count(*) as n_rows from old union all select 'new', count(*) from new) r using (side)
""",
    old=X.F1_OLD, new=X.F1_NEW, old_names=names_sql(F1_OLD_COLUMNS), new_names=names_sql(F1_NEW_COLUMNS)))
def missing_columns(spark, folder):
    """Mapped columns that a table lacks, and how many of its rows go unchecked for that."""
    old, new = X.derive(spark, folder, X.F1_OLD), X.derive(spark, folder, X.F1_NEW)
    found = fixed_frame(spark, schema.missing_columns(old.columns, new.columns, PARTIAL, "old", "new"), ["error_type", "old_column", "new_column"])
    rows = old.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("of_old", F.lit(True)).unionByName(
        new.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("of_old", F.lit(False)))
    return found.withColumn("of_old", F.col("old_column").isNotNull()).join(F.broadcast(rows), "of_old").drop("of_old")


@query("unmapped_columns", with_tables(
    """
select 'old' as side, column_name, n_values from old_names where column_name not in ('o_orderstatus', 'o_orderkey', 'custref')
union all select 'new', column_name, n_values from new_names where column_name not in ('status', 'id', 'custno')
""",
    old=X.F1_OLD, new=X.F1_NEW, old_names=counts_sql("old", F1_OLD_COLUMNS), new_names=counts_sql("new", F1_NEW_COLUMNS)))
def unmapped_columns(spark, folder):
    """Columns no mapping names, and how many values are in them."""
    old, new = X.derive(spark, folder, X.F1_OLD), X.derive(spark, folder, X.F1_NEW)
    mappings = Mappings(exact=(Exact("o_orderstatus", "status"), Exact("custref", "custno")))
    rest_old, rest_new = schema.unmapped(old.columns, new.columns, mappings, ["o_orderkey"], ["id"])
    return values_in(old.select(*rest_old)).select(F.lit("old").alias("side"), "*").unionByName(values_in(new.select(*rest_new)).select(F.lit("new").alias("side"), "*"))


@query("schema_diff", with_tables("""
select column_name, 'left_only' as side, n_values from a where column_name not in (select column_name from b)
union all select column_name, 'right_only', n_values from b where column_name not in (select column_name from a)
""", old=X.F8_OLD, new=X.F8_NEW, a=counts_sql("old", F8_OLD_COLUMNS), b=counts_sql("new", F8_NEW_COLUMNS)))
def schema_diff(spark, folder):
    """Columns of one table alone, and how many values are in them."""
    old, new = X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW)
    sizes = values_in(old).withColumn("side", F.lit("left_only")).unionByName(values_in(new).withColumn("side", F.lit("right_only")))
    return schema.schema_diff(old, new).join(F.broadcast(sizes), ["column_name", "side"])


NAME_SIM = "1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))"


@query("fallback_match", with_tables(
    f"""
select old_column, new_column, similarity, o_values as old_values, n_values as new_values from (
  select o.column_name as old_column, n.column_name as new_column, o.n_values as o_values, n.n_values, {NAME_SIM.format(a='o.column_name', b='n.column_name')} as similarity,
         row_number() over (partition by o.column_name order by {NAME_SIM.format(a='o.column_name', b='n.column_name')} desc, p.place) as rn
  from o cross join n join p on p.new_column = n.column_name) t where rn = 1 and similarity >= 0.9
""", old=X.F8_OLD, new=X.F8_NEW, o=counts_sql("old", F8_OLD_COLUMNS), n=counts_sql("new", F8_NEW_COLUMNS), p=names_sql(F8_NEW_COLUMNS, "new_column")))
def fallback_match(spark, folder):
    """Columns of nearly the same name, and how many values either has."""
    old, new = X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW)
    pairs = schema.fallback_matches(spark, old.columns, new.columns)
    sizes_old = values_in(old).select(F.col("column_name").alias("old_column"), F.col("n_values").alias("old_values"))
    sizes_new = values_in(new).select(F.col("column_name").alias("new_column"), F.col("n_values").alias("new_values"))
    return pairs.join(F.broadcast(sizes_old), "old_column").join(F.broadcast(sizes_new), "new_column")


# ---- profiles -------------------------------------------------------------------------------------

DATE_SQL = {name: pattern for name, pattern in profile.DATE_FORMATS}


def meta_sql(long: str) -> str:
    formats = ", ".join(f"count(case when regexp_matches(trim(value), '{p}') then 1 end) as f{i}" for i, (_, p) in enumerate(profile.DATE_FORMATS))
    return f"""
select column_name, kind, inferred_type,
       case when inferred_type = 'date' then case when greatest(f0, f1, f2, f3) = 0 then 'UNKNOWN' when f0 = greatest(f0, f1, f2, f3) then 'ISO_TZ'
            when f1 = greatest(f0, f1, f2, f3) then 'DATETIME_MS' when f2 = greatest(f0, f1, f2, f3) then 'DATETIME' else 'DATE' end end as date_format,
       n_rows, n_values, n_distinct, n_distinct / n_rows as unique_ratio,
       case when inferred_type = 'numeric' then cast(lo as double) end as min_value, case when inferred_type = 'numeric' then cast(hi as double) end as max_value,
       case when inferred_type = 'numeric' then cast(total as double) / n_numeric end as mean_value,
       n_zeros > 0 as has_leading_zeros, n_large > 0 as has_large_integers
from (select *, case when kind = 'BOOLEAN' then 'boolean' when n_numeric > n_shown * 0.8 then 'numeric' when n_date > n_shown * 0.8 then 'date' else 'string' end as inferred_type
  from (select *, case when n_values = 0 then 'NULL' when n_nonzero = 0 then 'ZERO' when n_nonboolean = 0 then 'BOOLEAN' else 'NORMAL' end as kind
    from (select column_name, count(*) as n_rows, count(value) as n_values, count(case when trim(value) not in ('0', '') then 1 end) as n_nonzero,
            count(case when trim(value) not in ('0', '1', 'true', 'false') then 1 end) as n_nonboolean,
            count(case when trim(value) <> '' then 1 end) as n_shown, count({NUMBER_SQL}) as n_numeric,
            count(case when regexp_matches(trim(value), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([ T]\\d{{2}}:\\d{{2}}(:\\d{{2}})?)?') then 1 end) as n_date,
            count(distinct nullif(trim(value), '')) as n_distinct, min({NUMBER_SQL}) as lo, max({NUMBER_SQL}) as hi, sum({NUMBER_SQL}) as total,
            count(case when regexp_matches(trim(value), '^0+\\d') then 1 end) as n_zeros,
            count(case when regexp_matches(regexp_replace(trim(value), '\\..*', ''), '^\\d{{15,}}$') then 1 end) as n_large, {formats}
          from {long} group by column_name) a) b) c
"""


META_ROUND = """
select column_name, kind, inferred_type, date_format, n_rows, n_values, n_distinct, round(unique_ratio, 6) as unique_ratio,
       round(min_value, 2) as min_value, round(max_value, 2) as max_value, round(mean_value, 2) as mean_value, has_leading_zeros, has_large_integers from meta
"""


def rounded_meta(meta):
    return meta.withColumns({
        "unique_ratio": F.round("unique_ratio", 6),
        **{c: F.round(c, 2) for c in ("min_value", "max_value", "mean_value")},
    })


@query("profile_meta", with_tables(META_ROUND, f8=X.F8_OLD, long=long_sql("f8", F8_OLD_COLUMNS), meta=meta_sql("long")))
def profile_meta(spark, folder):
    return rounded_meta(profile.column_meta(profile.value_counts(X.derive(spark, folder, X.F8_OLD))))


@query("profile_meta_new", with_tables(META_ROUND, f8=X.F8_NEW, long=long_sql("f8", F8_NEW_COLUMNS), meta=meta_sql("long")))
def profile_meta_new(spark, folder):
    return rounded_meta(profile.column_meta(profile.value_counts(X.derive(spark, folder, X.F8_NEW))))


PROFILE_SQL = f"""
select column_name, data_type, n_rows as row_count, cardinality, round(1 - n_values / n_rows, 4) as null_rate,
       case when n_values > 0 then round(cardinality / n_values, 4) end as unique_ratio,
       case when data_type = 'numeric' then round(cast(lo as double), 4) end as min_value, case when data_type = 'numeric' then round(cast(hi as double), 4) end as max_value,
       case when data_type = 'numeric' then round(mean, 2) end as mean_value, case when data_type = 'numeric' then round(std, 2) end as std_value,
       case when data_type = 'numeric' then n_negative = 0 end as non_negative, case when data_type = 'numeric' then n_fraction = 0 end as integer_only,
       case when data_type = 'numeric' then round(n_zero / n_numeric, 4) end as zero_rate,
       case when data_type = 'date' then earliest end as earliest, case when data_type = 'date' then latest end as latest,
       case when data_type = 'date' then cast(cast(latest as date) - cast(earliest as date) as integer) end as span_days,
       case when data_type = 'text' then round(chars / n_values, 4) end as avg_length, case when data_type = 'text' then cast(longest as integer) end as max_length,
       case when data_type = 'text' then n_special > 0 end as has_special_chars, case when data_type = 'text' then n_upper > n_values * 0.8 end as all_uppercase
from (select *, case when n_values = 0 then 'EMPTY' when n_numeric > n_values * 0.7 then 'numeric' when n_iso > n_values * 0.7 then 'date' else 'text' end as data_type from (
  select column_name, count(*) as n_rows, count(value) as n_values, count(distinct value) as cardinality, count({NUMBER_SQL}) as n_numeric,
    count(case when regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then 1 end) as n_iso, min({NUMBER_SQL}) as lo, max({NUMBER_SQL}) as hi,
    avg(cast({NUMBER_SQL} as double)) as mean, stddev_samp(cast({NUMBER_SQL} as double)) as std,
    count(case when {NUMBER_SQL} < 0 then 1 end) as n_negative, count(case when {NUMBER_SQL} = 0 then 1 end) as n_zero,
    count(case when {NUMBER_SQL} <> floor({NUMBER_SQL}) then 1 end) as n_fraction,
    min(case when regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then left(value, 10) end) as earliest,
    max(case when regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then left(value, 10) end) as latest,
    sum(length(value)) as chars, max(length(value)) as longest,
    count(case when regexp_matches(value, '[^a-zA-Z0-9\\s]') then 1 end) as n_special,
    count(case when value = upper(value) and upper(value) <> lower(value) then 1 end) as n_upper
  from long group by column_name) a) b
"""


def rounded_profile(df):
    digits = {"mean_value": 2, "std_value": 2}
    return df.select(*[F.round(c, digits.get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("profile_columns", with_tables(PROFILE_SQL, f7=X.F7, long=long_sql("f7", F7_COLUMNS)))
def profile_columns(spark, folder):
    return rounded_profile(profile.column_profile(profile.value_counts(X.derive(spark, folder, X.F7))))


@query("profile_dates", with_tables(PROFILE_SQL, f8=X.F8_OLD, long=long_sql("f8", [c for c in F8_OLD_COLUMNS if c != "id"])))
def profile_dates(spark, folder):
    return rounded_profile(profile.column_profile(profile.value_counts(X.derive(spark, folder, X.F8_OLD).drop("id"))))


@query("profile_medians", with_tables(f"""
select column_name, quantile_disc(cast({NUMBER_SQL} as double), 0.5) as median_value from long where {NUMBER_SQL} is not null group by column_name
""", f7=X.F7, long=long_sql("f7", F7_COLUMNS)))
def profile_medians(spark, folder):
    return profile.medians(profile.value_counts(X.derive(spark, folder, X.F7)))


@query("profile_number_shape", with_tables(f"""
select a.column_name, coalesce(b.decimals, 0) as decimals,
       case when size < 1 then 'fractional' when size < 100 then 'tens' when size < 10000 then 'hundreds-thousands'
            when size < 1000000 then 'tens-thousands-millions' else 'millions-plus' end as magnitude
from (select column_name, abs(avg(cast({NUMBER_SQL} as double))) as size from long where {NUMBER_SQL} is not null group by column_name) a
left join (select column_name, cast(d as integer) as decimals from (
   select column_name, length(regexp_extract(trim(value), '\\.(\\d+)', 1)) as d,
          row_number() over (partition by column_name order by count(*) desc, length(regexp_extract(trim(value), '\\.(\\d+)', 1))) as rn
   from long where {NUMBER_SQL} is not null and length(regexp_extract(trim(value), '\\.(\\d+)', 1)) > 0 group by 1, 2) t where rn = 1) b using (column_name)
""", f7=X.F7, long=long_sql("f7", F7_COLUMNS)))
def profile_number_shape(spark, folder):
    return profile.number_shape(profile.value_counts(X.derive(spark, folder, X.F7)))


def shapes_sql(long: str) -> str:
    shape = "case " + " ".join(f"when regexp_matches(value, '{p}') then '{n}'" for n, p in profile.SHAPES) + " end"
    return f"""
select column_name, count(value) as n_values, count(distinct lower(trim(value))) as n_texts,
       {", ".join(f"count(case when {shape} = '{n}' then 1 end) as shape_{n}" for n, _ in profile.SHAPES)},
       {", ".join(f"count(case when regexp_matches(value, '{p}') then 1 end) as pattern_{n.lower()}" for n, p, _ in profile.PATTERNS)},
       {", ".join(f"count(case when lower(trim(value)) not in ({', '.join(repr(w) for w in words)}) then 1 end) as not_boolean_{i}" for i, words in enumerate(profile.BOOLEAN_SETS))},
       sum(length(value)) as chars, sum(len(regexp_extract_all(value, '\\S+'))) as words
from {long} group by column_name
"""


def types_sql(shapes: str) -> str:
    bools = ", ".join(f"not_boolean_{i}" for i in range(len(profile.BOOLEAN_SETS)))
    shape = " ".join(f"when shape_{n} > n_values * 0.7 then '{n}'" for n, _ in profile.SHAPES)
    return f"""
select column_name, case when n_values = 0 then 'EMPTY'
  when least({bools}) = 0 and regexp_matches(column_name, '{"|".join(profile.NUMERIC_NAME_WORDS)}') then 'numeric'
  when least({bools}) = 0 and regexp_matches(column_name, '{"|".join(profile.BOOLEAN_NAME_WORDS)}') then 'boolean'
  when least({bools}) = 0 then case when n_texts = 2 then 'boolean' else 'numeric' end {shape} else 'alphanumeric' end as column_type from {shapes}
"""


@query("profile_types", with_tables("select * from types", f7=X.F7, long=long_sql("f7", F7_COLUMNS), shapes=shapes_sql("long"), types=types_sql("shapes")))
def profile_types(spark, folder):
    return profile.column_types(profile.shape_counts(profile.value_counts(X.derive(spark, folder, X.F7))))


TEXTS = "select doc_id, lang, source, text from documents"
CONTACTS = """
select concat('ORD-', cast(o_orderkey as varchar(20))) as code, lpad(cast(o_orderkey as varchar(20)), 10, '0') as long_number,
       concat('+66 2', lpad(cast(o_orderkey as varchar(20)), 7, '0')) as phone, concat('u', cast(o_custkey as varchar(20)), '@example.com') as mail,
       cast(cast(o_totalprice as decimal(18,2)) as varchar(30)) as price, o_orderpriority from orders
"""


@query("profile_patterns", with_tables(
    """
select column_name, case when p = '' then cast([] as varchar[]) else string_split(p, ',') end as patterns,
       avg_length, avg_words from (
  select column_name, cast(chars // n_values as bigint) as avg_length, round(words / n_values, 4) as avg_words, concat_ws(',',
         case when pattern_id_with_prefix > n_values * 0.7 then 'ID_WITH_PREFIX' end,
         case when pattern_numeric_id > n_values * 0.7 and not pattern_id_with_prefix > n_values * 0.7 then 'NUMERIC_ID' end,
         case when pattern_phone_number > n_values * 0.5 then 'PHONE_NUMBER' end, case when pattern_email > n_values * 0.5 then 'EMAIL' end,
         case when pattern_currency > n_values * 0.7 then 'CURRENCY' end, case when chars // n_values > 40 then 'FREE_TEXT' end,
         case when words / n_values > 5 then 'NARRATIVE' end) as p from shapes where n_values > 0) t
""",
    docs=TEXTS, contacts=CONTACTS,
    long=long_sql("docs", ["doc_id", "lang", "source", "text"]) + " union all " + long_sql("contacts", ["code", "long_number", "phone", "mail", "price", "o_orderpriority"]),
    shapes=shapes_sql("long")))
def profile_patterns(spark, folder):
    """Patterns of order columns and of whole documents."""
    parts = [profile.value_counts(X.derive(spark, folder, sql)) for sql in (TEXTS, CONTACTS)]
    found = profile.column_patterns(profile.shape_counts(parts[0].unionByName(parts[1], allowMissingColumns=True)))
    return found.withColumn("avg_words", F.round("avg_words", 4))


def prints_sql(long: str, types: str) -> str:
    return f"""
select a.*, column_type, column_type = 'boolean' as is_boolean from (
  select column_name, count(value) as cardinality, (1 - coalesce(sum(case when value is not null then n end), 0) / sum(n)) * 100 as null_pct,
         coalesce(count(value) / sum(case when value is not null then n end), 0) as unique_ratio,
         coalesce(abs(sum(case when value is not null then n / t * log2(n / t) end)), 0) as entropy,
         coalesce(sum(case when trim(value) in ('0', '0.0', '0.00', '0.000', '0.0000') then n else 0 end) / max(t) * 100, 0) as zero_pct,
         coalesce(sum(case when trim(value) in ('0', '0.0', '0.00', '0.000', '0.0000') then n else 0 end) > max(t) * 0.95, false) as is_all_zeros,
         cast(min({NUMBER_SQL}) as double) as min_value, cast(max({NUMBER_SQL}) as double) as max_value,
         sum({NUMBER_SQL} * n) / sum(case when {NUMBER_SQL} is not null then n end) as mean_value
  from (select *, sum(case when value is not null then n end) over (partition by column_name) as t
        from (select column_name, value, count(*) as n from {long} group by column_name, value) c) d group by column_name) a join {types} using (column_name)
"""


PRINTS_ROUND = """
select column_name, column_type, cardinality, round(null_pct, 4) as null_pct, round(unique_ratio, 4) as unique_ratio, round(entropy, 4) as entropy,
       round(zero_pct, 4) as zero_pct, is_all_zeros, is_boolean, round(min_value, 4) as min_value, round(max_value, 4) as max_value, round(cast(mean_value as double), 2) as mean_value
from prints
"""


@query("fingerprint_entropy", with_tables(PRINTS_ROUND, f7=X.F7, long=long_sql("f7", F7_COLUMNS), shapes=shapes_sql("long"),
                                          types=types_sql("shapes"), prints=prints_sql("long", "types")))
def fingerprint_entropy(spark, folder):
    return rounded_profile(profile.fingerprints(profile.value_counts(X.derive(spark, folder, X.F7))))


@query("top_values", with_tables("""
select column_name, place, value, n, round(n / t, 6) as share from (
  select column_name, value, count(*) as n, cast(row_number() over (partition by column_name order by count(*) desc, value) as integer) as place,
         sum(count(*)) over (partition by column_name) as t
  from long where value is not null group by column_name, value) x where place <= 15
""", f7=X.F7, long=long_sql("f7", F7_COLUMNS)))
def top_values(spark, folder):
    return rounded(profile.top_values(profile.value_counts(X.derive(spark, folder, X.F7))))


TEXT_COLUMNS = ["lang", "source", "text"]


@query("profile_texts", with_tables(PROFILE_SQL, docs=TEXTS, long=long_sql("docs", TEXT_COLUMNS)))
def profile_texts(spark, folder):
    """Whole documents, which move as digests."""
    return rounded_profile(profile.column_profile(profile.value_counts(X.derive(spark, folder, TEXTS), TEXT_COLUMNS)))


@query("top_texts", with_tables("""
select column_name, place, value, n, round(n / t, 6) as share from (
  select column_name, value, count(*) as n, cast(row_number() over (partition by column_name order by count(*) desc, value) as integer) as place,
         sum(count(*)) over (partition by column_name) as t
  from long where value is not null group by column_name, value) x where place <= 15
""", docs=TEXTS, long=long_sql("docs", TEXT_COLUMNS)))
def top_texts(spark, folder):
    """The most frequent documents, fetched by their digests."""
    docs = X.derive(spark, folder, TEXTS).select(*TEXT_COLUMNS)
    return rounded(profile.top_values(profile.value_counts(docs), source=docs))


TYPE_SIM = """case when o.column_type = n.column_type then 30 when o.column_type in ('numeric', 'integer') and n.column_type in ('numeric', 'integer') then 20
  when contains(o.column_type, n.column_type) or contains(n.column_type, o.column_type) then 10 else 0 end"""
FP_SIM = f"""least(100, {TYPE_SIM}
  + case when o.cardinality > 0 and n.cardinality > 0 then least(o.cardinality, n.cardinality) / greatest(o.cardinality, n.cardinality) * 20 else 0 end
  + case when o.entropy > 0 and n.entropy > 0 then (1 - abs(o.entropy - n.entropy) / greatest(o.entropy, n.entropy)) * 15 else 0 end
  + case when o.is_boolean = n.is_boolean then 10 else 0 end + (1 - abs(o.null_pct - n.null_pct) / 100) * 10
  + case when o.is_all_zeros and n.is_all_zeros then 15 else 0 end)"""


def side_ctes(side: str, fixture: str, columns: list[str]) -> dict[str, str]:
    return {
        f"{side}": fixture, f"{side}_long": long_sql(side, columns), f"{side}_shapes": shapes_sql(f"{side}_long"),
        f"{side}_types": types_sql(f"{side}_shapes"), f"{side}_prints": prints_sql(f"{side}_long", f"{side}_types"),
    }


BOTH_PRINTS = {**side_ctes("old", X.F8_OLD, F8_OLD_COLUMNS), **side_ctes("new", X.F8_NEW, F8_NEW_COLUMNS)}


@query("fingerprint_similarity", with_tables(
    f"select o.column_name as old_column, n.column_name as new_column, round({FP_SIM}, 3) as similarity from old_prints o cross join new_prints n", **BOTH_PRINTS))
def fingerprint_similarity(spark, folder):
    old, new = X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW)
    pairs = matching.paired_profiles(
        profile.fingerprints(profile.value_counts(old)), profile.fingerprints(profile.value_counts(new)), old.columns, new.columns)
    return pairs.select("old_column", "new_column", F.round(profile.fingerprint_similarity(), 3).alias("similarity"))


# ---- matching -------------------------------------------------------------------------------------

BOTH_META = {
    "old": X.F8_OLD, "old_long": long_sql("old", F8_OLD_COLUMNS), "old_meta": meta_sql("old_long"),
    "new": X.F8_NEW, "new_long": long_sql("new", F8_NEW_COLUMNS), "new_meta": meta_sql("new_long"),
    "shared": """select a.column_name as old_column, b.column_name as new_column, count(*) as n_shared from
        (select distinct column_name, trim(value) as v from old_long where trim(value) <> '') a
        join (select distinct column_name, trim(value) as v from new_long where trim(value) <> '') b using (v) group by 1, 2""",
    "places": names_sql(F8_NEW_COLUMNS),
}
MATCH_SQL = f"""
select old_column, case when blank then null else new_column end as new_column, case when blank then 0 else round(name_sim, 4) end as name_sim,
       cast(case when blank then 0 else type_sim end as double) as type_sim, case when blank then 0 else round(value_sim, 4) end as value_sim,
       case when blank then 0 else round(confidence, 4) end as confidence, status, case when blank then 'NONE' else hint end as transform_hint, old_type, new_type
from (select *, case when regen then 'REGENERATED_ID' when kind <> 'NORMAL' then concat(kind, '_COLUMN')
        when name_sim > 0.85 and value_sim < 0.1 and old_type = 'string' and new_type = 'string' and old_unique > 0.05 and new_unique > 0.05 then 'SAME_NAME_DIFF_DATA'
        when confidence >= 0.9 and type_sim = 1 then 'VERIFIED' when confidence >= 0.7 then 'PROBABLE' when confidence >= 0.5 then 'MANUAL_CHECK' else 'NO_MATCH' end as status,
      regen or kind <> 'NORMAL' as blank
  from (select *, lower(old_column) = 'id' and old_type = 'numeric' and large as regen,
               row_number() over (partition by old_column order by round(confidence, 9) desc, place) as rn
    from (select *, name_sim * 0.6 + type_sim * 0.2 + value_sim * 0.2 as confidence
      from (select o.column_name as old_column, n.column_name as new_column, p.place, {NAME_SIM.format(a='o.column_name', b='n.column_name')} as name_sim,
              case when o.inferred_type = n.inferred_type then 1.0 else 0.5 end as type_sim, o.kind, o.inferred_type as old_type, n.inferred_type as new_type,
              o.unique_ratio as old_unique, n.unique_ratio as new_unique, o.has_large_integers as large,
              case when o.kind <> 'NORMAL' or n.kind <> 'NORMAL' then 0.0
                   when o.inferred_type = 'numeric' and n.inferred_type = 'numeric' then
                     case when abs(floor(log10(abs(o.mean_value))) - floor(log10(abs(n.mean_value)))) <= 1 then 0.8 else 0.2 end
                   when o.inferred_type = 'string' and n.inferred_type = 'string' then
                     cast(coalesce(n_shared, 0) as double) / (o.n_distinct + n.n_distinct - coalesce(n_shared, 0))
                   when o.inferred_type = 'date' and n.inferred_type = 'date' then 0.8 else 0.5 end as value_sim,
              case when o.inferred_type = 'string' and n.inferred_type = 'numeric' and o.has_leading_zeros then 'STRIP_LEADING_ZEROS'
                   when not (o.inferred_type = 'date' and n.inferred_type = 'date') or o.date_format = n.date_format then 'NONE'
                   when o.date_format = 'DATE' and n.date_format not in ('DATE', 'UNKNOWN') then 'DATE_TO_DATETIME' else 'DATETIME_FORMAT_CHANGE' end as hint
            from old_meta o cross join new_meta n join places p on p.column_name = n.column_name
            left join shared s on s.old_column = o.column_name and s.new_column = n.column_name) a) b) c where rn = 1) d
"""


def matches_of(spark, folder):
    return matching.match_columns(X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW))


@query("match_columns", with_tables(MATCH_SQL, **BOTH_META))
def match_columns(spark, folder):
    return rounded(matches_of(spark, folder), 4)


@query("match_unmatched_new", with_tables(
    "select column_name from places where column_name not in (select new_column from m where new_column is not null and status not in ('NO_MATCH', 'SAME_NAME_DIFF_DATA'))",
    **BOTH_META, m=MATCH_SQL))
def match_unmatched_new(spark, folder):
    new = X.derive(spark, folder, X.F8_NEW)
    return matching.unmatched_new(matches_of(spark, folder), schema.name_list(spark, new.columns, "column_name"))


@query("match_status_counts", with_tables("select status, count(*) as n_columns from m group by status", **BOTH_META, m=MATCH_SQL))
def match_status_counts(spark, folder):
    from concord.operators.report import match_counts

    return match_counts(matches_of(spark, folder))


@query("draft_mappings", with_tables("""
select case when status = 'MANUAL_CHECK' then 'manual_check' when transform_hint = 'NONE' then 'exact_matches' else 'transformed_matches' end as kind,
       old_column, new_column, transform_hint as transform_rule, round(confidence, 4) as confidence, status <> 'VERIFIED' as needs_review
from m where new_column is not null and status in ('VERIFIED', 'PROBABLE', 'MANUAL_CHECK')
""", **BOTH_META, m=MATCH_SQL))
def draft_mappings(spark, folder):
    return rounded(matching.draft_mappings(matches_of(spark, folder)), 4)


ANCHOR_OLD, ANCHOR_NEW = ["order_accountno"], ["order_account_no"]
A_OLD = "select o_orderkey as orderrefno, o_custkey as custaccountno, o_orderstatus as status_refno, o_totalprice as amount from orders"
A_NEW = "select o_orderkey + case when o_orderkey % 4 = 1 then 900000000 else 0 end as new_refno, o_custkey as accountno, o_orderpriority as memberno from orders where o_orderkey % 97 <> 13"
ANCHOR_CTES = {
    "old": A_OLD, "new": A_NEW,
    "ol": long_sql("old", ["orderrefno", "custaccountno", "status_refno"]), "nl": long_sql("new", ["new_refno", "accountno", "memberno"]),
    "oc": "select column_name, count(distinct value) as d, count(*) as n from ol group by column_name having count(distinct value) / count(*) > 0.01",
    "nc": "select column_name, count(distinct value) as d, count(*) as n from nl group by column_name having count(distinct value) / count(*) > 0.01",
}
ANCHOR_SQL = """
select a.column_name as old_column, b.column_name as new_column, oc.d as n_old, count(*) as n_shared, count(*) / oc.d as overlap
from (select distinct column_name, value from ol) a join (select distinct column_name, value from nl) b using (value)
join oc on oc.column_name = a.column_name join nc on nc.column_name = b.column_name group by a.column_name, b.column_name, oc.d
"""


def anchor_frames(spark, folder):
    old, new = X.derive(spark, folder, A_OLD), X.derive(spark, folder, A_NEW)
    return matching.anchor_overlap(
        old, new, profile.column_meta(profile.value_counts(old)), profile.column_meta(profile.value_counts(new)))


@query("anchor_overlap", with_tables(ANCHOR_SQL, **ANCHOR_CTES))
def anchor_overlap(spark, folder):
    return anchor_frames(spark, folder)


@query("anchor_best", with_tables(
    "select old_column as anchor_old, new_column as anchor_new, cast(round(overlap * 100) as integer) as overlap_pct from x order by overlap desc, old_column desc, new_column desc limit 1",
    **ANCHOR_CTES, x=ANCHOR_SQL))
def anchor_best(spark, folder):
    return matching.best_anchor(anchor_frames(spark, folder))


COMPARABLE_SQL = """case when value is null or lower(trim(value)) in ('nan', 'none', 'null', 'nat', '', '<na>', '-', '?', 'n/a', 'undefined', 'nil') then null
  when regexp_matches(trim(value), '^\\d{4}-\\d{2}-\\d{2}') then concat('DATE:', left(trim(value), 10))
  when regexp_matches(trim(value), '^\\d{2}/\\d{2}/\\d{4}') then concat('DATE:', substr(trim(value), 7, 4), '-', substr(trim(value), 4, 2), '-', substr(trim(value), 1, 2))
  when regexp_matches(trim(value), '^\\d{8}') then concat('DATE:', substr(trim(value), 1, 4), '-', substr(trim(value), 5, 2), '-', substr(trim(value), 7, 2))
  when try_cast(regexp_replace(trim(value), '[,$\\s€£¥]', '', 'g') as decimal(38,4)) is not null
    then concat('NUM:', cast(cast(regexp_replace(trim(value), '[,$\\s€£¥]', '', 'g') as decimal(38,4)) as varchar))
  when regexp_replace(lower(trim(value)), '[^a-z0-9]', '', 'g') <> '' then concat('TXT:', regexp_replace(lower(trim(value)), '[^a-z0-9]', '', 'g')) end"""
OVERLAP_CTES = {
    "old": X.F8_OLD, "old_long": long_sql("old", F8_OLD_COLUMNS), "new": X.F8_NEW, "new_long": long_sql("new", F8_NEW_COLUMNS),
    "ov": f"select distinct column_name, {COMPARABLE_SQL} as v from old_long", "nv": f"select distinct column_name, {COMPARABLE_SQL} as v from new_long",
    "shared_pairs": """select a.column_name as old_column, b.column_name as new_column, count(*) as n_shared, max(x.n) as n_old, max(y.n) as n_new, count(*) / max(x.n) * 100 as set_match
        from ov a join nv b on a.v = b.v join (select column_name, count(v) as n from ov group by 1) x on x.column_name = a.column_name
        join (select column_name, count(v) as n from nv group by 1) y on y.column_name = b.column_name group by 1, 2""",
}


@query("set_match", with_tables(
    "select old_column, new_column, n_shared, n_old, n_new, round(set_match, 6) as set_match from shared_pairs", **OVERLAP_CTES))
def set_match(spark, folder):
    return rounded(field_match.comparable_overlap(X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW)))


@query("value_overlap", """
with a as (select distinct 'l_orderkey' as c, l_orderkey as v from lineitem union all select distinct 'l_partkey', l_partkey from lineitem union all select distinct 'l_suppkey', l_suppkey from lineitem),
b as (select distinct 'p_partkey' as c, p_partkey as v from part union all select distinct 'p_size', p_size from part)
select a.c as old_column, b.c as new_column, count(*) as n_shared, max(x.n) as n_old, max(y.n) as n_new from a join b using (v)
join (select c, count(*) as n from a group by c) x on x.c = a.c join (select c, count(*) as n from b group by c) y on y.c = b.c group by a.c, b.c
""")
def value_overlap(spark, folder):
    t = X.tables(spark, folder, "lineitem", "part")
    return overlap.shared_values(
        t["lineitem"], t["part"], [(c, F.col(c)) for c in ("l_orderkey", "l_partkey", "l_suppkey")], [(c, F.col(c)) for c in ("p_partkey", "p_size")])


# ---- anchors --------------------------------------------------------------------------------------

def ideal_sql() -> str:
    cases = " ".join(f"when column_name = '{w}' then 40 when contains(column_name, '{w}') then 20" for w in anchors.IDEAL)
    return f"case {cases} else 0 end"


def quality_sql(long: str) -> str:
    return f"""
select column_name, not regexp_matches(column_name, '{"|".join(anchors.BLACKLIST)}') and mean <= 100 and words / n <= 8 and u >= 0.05
         and (mean = 0 or coalesce(sd, 0) / mean <= 3.5) as eligible,
       least(100, {ideal_sql()} + u * 30 + case when mean <= 10 then 20 when mean <= 20 then 10 when mean <= 40 then 5 else 0 end
         + case when greatest(digits, codes) / n > 0.7 then 10 else 0 end) as quality
from (select column_name, count(*) as n, avg(length(value)) as mean, stddev_samp(length(value)) as sd, count(distinct value) / count(*) as u,
        sum(len(regexp_extract_all(value, '\\S+'))) as words,
        count(case when regexp_matches(value, '^\\d+$') then 1 end) as digits, count(case when regexp_matches(value, '^[A-Z0-9\\-]+$') then 1 end) as codes
      from {long} where value is not null group by column_name) t
"""


@query("anchor_quality", with_tables("select column_name, eligible, round(quality, 4) as quality from q",
                                     old=X.F8_OLD, l=long_sql("old", F8_OLD_COLUMNS), q=quality_sql("l")))
def anchor_quality(spark, folder):
    return rounded(anchors.anchor_quality(profile.value_counts(X.derive(spark, folder, X.F8_OLD))), 4)


CANDIDATE_CTES = {
    "old": X.F8_OLD, "ol": long_sql("old", F8_OLD_COLUMNS), "oq": quality_sql("ol"),
    "new": X.F8_NEW, "nl": long_sql("new", F8_NEW_COLUMNS), "nq": quality_sql("nl"),
    "ov": "select distinct column_name, value from ol where value is not null and column_name in (select column_name from oq where eligible)",
    "nv": "select distinct column_name, value from nl where value is not null and column_name in (select column_name from nq where eligible)",
    "sh": """select a.column_name as old_column, b.column_name as new_column, count(*) as n_shared, max(x.n) as n_old, max(y.n) as n_new from ov a join nv b using (value)
        join (select column_name, count(*) as n from ov group by 1) x on x.column_name = a.column_name
        join (select column_name, count(*) as n from nv group by 1) y on y.column_name = b.column_name group by 1, 2""",
    "sc": f"""select old_column, new_column, n_shared / greatest(n_old, n_new) * 100 as overlap, ({NAME_SIM.format(a='old_column', b='new_column')}) * 100 as name_sim,
        oq.quality as qo, nq.quality as qn from sh join oq on oq.column_name = old_column join nq on nq.column_name = new_column""",
}
STRONG = "|".join(anchors.STRONG_IDEAL)
CANDIDATE_SQL = " union all ".join(
    f"select old_column, new_column, '{name}' as strategy, round(overlap * 0.5 + name_sim * 0.3 + (qo + qn) / 2 * 0.2, 3) as score from sc "
    f"where overlap >= 1 and name_sim >= 35 and overlap * 0.5 + name_sim * 0.3 + (qo + qn) / 2 * 0.2 >= {least} and {test}"
    for name, least, test in [
        ("IDEAL_ID", 45, f"regexp_matches(old_column, '{STRONG}') and regexp_matches(new_column, '{STRONG}')"),
        ("HIGH_UNIQUE", 35, "true"),
        ("DATE", 30, "regexp_matches(old_column, 'date|time|dt|day') and regexp_matches(new_column, 'date|time|dt|day')"),
    ]
)


def qualities(spark, folder):
    old, new = X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW)
    return old, new, anchors.anchor_quality(profile.value_counts(old)), anchors.anchor_quality(profile.value_counts(new))


@query("anchor_search", with_tables(CANDIDATE_SQL, **CANDIDATE_CTES))
def anchor_search(spark, folder):
    found = anchors.anchor_candidates(*qualities(spark, folder))
    return found.select("old_column", "new_column", "strategy", F.round("score", 3).alias("score"))


@query("anchor_verdicts", with_tables("""
select old_column, new_column, case when regexp_matches(old_column, 'id|_no|number|seq') and regexp_matches(new_column, 'id|_no|number|seq') and n_shared / n_old * 100 < 1 then 'ID_REGENERATED'
  when n_shared / greatest(n_old, n_new) < 0.01 then 'POOR_JOIN' else 'ACCEPTED' end as verdict from sh
""", **CANDIDATE_CTES))
def anchor_verdicts(spark, folder):
    old, new, qo, qn = qualities(spark, folder)
    shared = overlap.shared_values(
        old, new, [(n, profile.as_text(old, n)) for n in anchors.eligible_names(qo)], [(n, profile.as_text(new, n)) for n in anchors.eligible_names(qn)])
    pairs = shared.select("old_column", "new_column")
    return anchors.anchor_verdicts(pairs, shared).select("old_column", "new_column", "verdict")


COMPOSITE_OLD, COMPOSITE_NEW = ["o_custkey", "o_orderstatus", "o_orderpriority"], ["custno", "status", "prio"]
C_OLD = "select cast(o_custkey as varchar(20)) as o_custkey, o_orderstatus, o_orderpriority from orders"
C_NEW = "select cast(o_custkey as varchar(20)) as custno, o_orderstatus as status, lower(o_orderpriority) as prio from orders where o_orderkey % 97 <> 13"


def pair_sql(table: str, names: list[str]) -> str:
    return " union ".join(f"select '{a}+{b}' as c, concat({a}, '_', {b}) as v from {table}" for i, a in enumerate(names) for b in names[i + 1:])


@query("anchor_composite", with_tables(
    """
select a.c as old_column, b.c as new_column, count(*) as n_shared, round(count(*) / max(y.n) * 100, 6) as overlap
from a join b using (v) join (select c, count(*) as n from b group by c) y on y.c = b.c group by a.c, b.c having count(*) / max(y.n) * 100 >= 25
""", old=C_OLD, new=C_NEW, a=pair_sql("old", COMPOSITE_OLD), b=pair_sql("new", COMPOSITE_NEW)))
def anchor_composite(spark, folder):
    found = anchors.composite_candidates(X.derive(spark, folder, C_OLD), X.derive(spark, folder, C_NEW), COMPOSITE_OLD, COMPOSITE_NEW)
    return rounded(found.select("old_column", "new_column", "n_shared", "overlap"))


def joined_of(spark, folder):
    old, new = X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW)
    return old, new, anchors.anchored_join(old, new, ["order_accountno"], ["order_account_no"])


F8_JOIN = "select o.*, n.* exclude (id, note_text), n.id as new_id, n.note_text as new_note from old o join new n on o.order_accountno = n.order_account_no"


@query("anchored_join", with_tables(
    "select cast(order_accountno as varchar) as anchor, customer_key, cust_key, total_price, document_no, documentno from j", old=X.F8_OLD, new=X.F8_NEW, j=F8_JOIN))
def anchored_join(spark, folder):
    joined = joined_of(spark, folder)[2]
    return joined.select("anchor", F.col("customer_key_O").alias("customer_key"), F.col("cust_key_N").alias("cust_key"),
                         F.col("total_price_O").alias("total_price"), F.col("document_no_O").alias("document_no"), F.col("documentno_N").alias("documentno"))


@query("anchored_join_composite", with_tables(
    "select anchor, o_custkey, status from (select distinct concat(o_custkey, '_', o_orderstatus) as anchor, o_custkey from old) a join (select distinct concat(custno, '_', status) as anchor, status from new) b using (anchor)",
    old=C_OLD, new=C_NEW))
def anchored_join_composite(spark, folder):
    joined = anchors.anchored_join(X.derive(spark, folder, C_OLD), X.derive(spark, folder, C_NEW), ["o_custkey", "o_orderstatus"], ["custno", "status"])
    return joined.select("anchor", F.col("o_custkey_O").alias("o_custkey"), F.col("status_N").alias("status"))


@query("join_quality", with_tables("""
select n_old, n_new, n_joined, n_joined / greatest(least(n_old, n_new), 1) as join_ratio,
       case when n_joined = 0 then 'EMPTY' when n_joined / least(n_old, n_new) < 0.01 then 'POOR' when n_joined / least(n_old, n_new) > 3 then 'EXPLODED' else 'GOOD' end as verdict
from (select (select count(*) from old) as n_old, (select count(*) from new) as n_new, (select count(*) from j) as n_joined) t
""", old=X.F8_OLD, new=X.F8_NEW, j=F8_JOIN))
def join_quality(spark, folder):
    old, new, joined = joined_of(spark, folder)
    return anchors.join_quality(old, new, joined)


@query("ghost_join", with_tables("""
select count(*) as n_joined, count(case when customer_key = cust_key or order_status = orderstatus or lower(order_priority) = lower(order_prio) or order_date = left(order_datetime, 10)
       then 1 end) as n_with_context from j
""", old=X.F8_OLD, new=X.F8_NEW, j=F8_JOIN))
def ghost_join(spark, folder):
    old, new, joined = joined_of(spark, folder)
    return anchors.context_rows(joined, [f"{c}_O" for c in old.columns if c != "order_accountno"], [f"{c}_N" for c in new.columns if c != "order_account_no"])


REWRITE_PAIRS = [("order_priority", "order_prio"), ("document_no", "documentno"), ("customer_key", "cust_key"), ("total_price", "total_price_amt"), ("order_date", "order_datetime")]
REWRITE_SQL = {
    "RAW": "{0}", "STRIP_LEADING_ZEROS": "ltrim({0}, '0')", "REMOVE_PUNCTUATION": "regexp_replace({0}, '[^\\w\\s]', '', 'g')", "UPPERCASE": "upper({0})",
    "LOWERCASE": "lower({0})", "REMOVE_SPACES": "replace({0}, ' ', '')", "STRIP_HYPHENS": "replace({0}, '-', '')", "NUMERIC_ONLY": "regexp_replace({0}, '[^0-9.]', '', 'g')",
}


def rates_sql(pairs) -> str:
    return " union all ".join(
        f"select '{a}' as old_column, '{b}' as new_column, {i} as place, '{rule}' as rule, "
        f"avg(case when {sql.format(f'cast(o.{a} as varchar)')} is not distinct from {sql.format(f'cast(n.{b} as varchar)')} then 1.0 else 0.0 end) as match_rate "
        f"from old o join new n on o.order_accountno = n.order_account_no"
        for a, b in pairs for i, (rule, sql) in enumerate(REWRITE_SQL.items()))


@query("best_transform", with_tables(
    "select old_column, new_column, rule, round(match_rate, 6) as match_rate from (select *, row_number() over (partition by old_column, new_column order by match_rate desc, place) as rn from r) t where rn = 1",
    old=X.F8_OLD, new=X.F8_NEW, r=rates_sql(REWRITE_PAIRS)))
def best_transform(spark, folder):
    rates = field_match.rewrite_rates(joined_of(spark, folder)[2], REWRITE_PAIRS)
    return rounded(field_match.best_rewrites(rates))


# ---- the search for a key, and whole tables -------------------------------------------------------

# serial_no shares most of its values, but with other rows: a ghost. The rows agree along two columns of unlike names.
GHOST_OLD = """select o_orderkey as serial_no, concat('A', cast(o_orderkey - o_orderkey % 5 as varchar(20))) as belnr,
  concat('B', cast(o_orderkey % 5 as varchar(2)), 'x', cast(o_orderkey - o_orderkey % 7 as varchar(20))) as posten from orders"""
GHOST_NEW = """select o_orderkey + 500 as serial_no, concat('A', cast(o_orderkey - o_orderkey % 5 as varchar(20))) as voucher,
  concat('B', cast(o_orderkey % 5 as varchar(2)), 'x', cast(o_orderkey - o_orderkey % 7 as varchar(20))) as chapter from orders where o_orderkey % 97 <> 13"""
GHOST_OLD_COLUMNS, GHOST_NEW_COLUMNS = ["serial_no", "belnr", "posten"], ["serial_no", "voucher", "chapter"]
GHOST_CTES = {
    **CANDIDATE_CTES, "old": GHOST_OLD, "ol": long_sql("old", GHOST_OLD_COLUMNS), "new": GHOST_NEW, "nl": long_sql("new", GHOST_NEW_COLUMNS),
    "best": f"select * from (select *, row_number() over (partition by strategy order by score desc, old_column desc, new_column desc) as rn from ({CANDIDATE_SQL}) t) u where rn = 1",
    "single": """select b.strategy, 1 + (b.strategy <> 'IDEAL_ID')::int as place, sh.n_old, sh.n_new, sh.n_shared,
      (select count(*) from old o join new n using (serial_no) where o.belnr in (n.voucher, n.chapter) or o.posten in (n.voucher, n.chapter)) as n_with_context
      from best b join sh on sh.old_column = b.old_column and sh.new_column = b.new_column where b.old_column = 'serial_no' and b.new_column = 'serial_no'""",
}


def sets_sql(table: str, names: list[str]) -> str:
    """Distinct pairs of values of every ordered pair of columns."""
    return " union ".join(f"select ['{a}', '{b}'] as k, concat(md5(cast({a} as varchar)), md5(cast({b} as varchar))) as v from {table}" for a in names for b in names if a != b)


@query("anchor_found", with_tables("""
select strategy, ['serial_no'] as old_key, ['serial_no'] as new_key, n_old, n_new, n_shared as n_joined,
       case when n_with_context = 0 then 'GHOST_JOIN' else 'ACCEPTED' end as verdict, n_with_context > 0 as chosen from single
union all
select 'COMPOSITE', old_key, new_key, n_old, n_new, n_joined, 'ACCEPTED', true from (
  select x.k as old_key, y.k as new_key, count(*) as n_joined, max(xn.n) as n_old, max(yn.n) as n_new
  from x join y using (v) join (select k, count(*) as n from x group by k) xn on xn.k = x.k join (select k, count(*) as n from y group by k) yn on yn.k = y.k
  where x.k[1] < x.k[2] group by 1, 2 order by count(*) / max(yn.n) desc, count(*) desc, old_key desc, new_key desc limit 1) t
where n_joined / n_new >= 0.25 and (select max(n_with_context) from single) = 0
""", **GHOST_CTES, x=sets_sql("old", GHOST_OLD_COLUMNS), y=sets_sql("new", GHOST_NEW_COLUMNS)))
def anchor_found(spark, folder):
    """The best single column joins rows that have nothing else in common, so the pair of columns is chosen."""
    old, new = X.derive(spark, folder, GHOST_OLD), X.derive(spark, folder, GHOST_NEW)
    tested, _ = search_anchor(old, new, anchors.anchor_quality(profile.value_counts(old)), anchors.anchor_quality(profile.value_counts(new)))
    return tested.select("strategy", "old_key", "new_key", "n_old", "n_new", "n_joined", "verdict", "chosen")
