"""Queries of field matches, row-rule audits, column functions, files and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import columns as C
from checks import fixtures as X
from checks.catalog import plain, query, with_tables
from checks.validators import long, FULL, f2b, BREAKDOWN_CTES
from concord.functions import text
from concord.functions.fingerprints import fingerprint_part
from concord.functions.formulas import Likeness, row_formula
from concord.functions.numbers import formula_of, normal_number_text, to_number, tolerant_equal
from concord.operators import audit, field_match, profile, report, schema
from concord.operators.audit import PairRule, RowRule
from concord.plans.match_tables import match_tables
from concord.session import checkpoint_dir
from concord.sources import files, sinks
from concord.sources.tables import repeatable_sample

# ---- field matches --------------------------------------------------------------------------------

ALL_PAIRS = [(o, n) for o in C.F8_OLD_COLUMNS for n in C.F8_NEW_COLUMNS]
JOINED_RATES = ", ".join(
    f"avg(case when {sql.format(f'cast(o.{a} as varchar)')} is not distinct from {sql.format(f'cast(n.{b} as varchar)')} then 1.0 else 0.0 end) as r{k}_{i}"
    for k, (a, b) in enumerate(ALL_PAIRS) for i, sql in enumerate(C.REWRITE_SQL.values())
)
RATE_ROWS = " union all ".join(
    f"select '{a}' as old_column, '{b}' as new_column, {i} as place, '{rule}' as rule, r{k}_{i} as match_rate from wide_rates"
    for k, (a, b) in enumerate(ALL_PAIRS) for i, rule in enumerate(C.REWRITE_SQL)
)


def field_sql(anchored: bool) -> str:
    low = "row_match * 0.30 + name_sim * 0.40 + fp_sim * 0.20 + set_match * 0.10" if anchored else "name_sim * 0.50 + fp_sim * 0.30 + set_match * 0.20"
    high = "row_match * 0.60 + name_sim * 0.15 + fp_sim * 0.15 + set_match * 0.10" if anchored else "name_sim * 0.35 + fp_sim * 0.35 + set_match * 0.30"
    rates = "left join best b on b.old_column = o.column_name and b.new_column = n.column_name" if anchored else ""
    row, rule = ("coalesce(b.match_rate, 0) * 100", "coalesce(b.rule, 'NONE')") if anchored else ("0.0", "'NONE'")
    return f"""
select old_column, case when empty then null else new_column end as new_column,
       case when halved and confidence * 0.5 < 80 then 'MANUAL_CHECK' else status end as status,
       round(case when halved then confidence * 0.5 else confidence end, 2) as confidence, rule
from (select *, type_mismatch and status not in ('VERIFIED (Data Match)', 'VERIFIED (Set Match)', 'EMPTY_COLUMN') as halved from (
  select *, old_card = 0 as empty,
    not (ot = nt or (ot in ('numeric', 'integer') and nt in ('numeric', 'integer'))) as type_mismatch,
    case when old_card = 0 then 'EMPTY_COLUMN' when not zero and row_match > 90 then 'VERIFIED (Data Match)'
      when not zero and row_match > 85 and rule not in ('RAW', 'NONE') then 'VERIFIED (Data Match)' when not zero and set_match > 95 then 'VERIFIED (Set Match)'
      when zero and name_sim > 95 then 'VERIFIED' when zero and score > 80 then 'MANUAL_CHECK' when score > 95 then 'VERIFIED' else 'MANUAL_CHECK' end as status,
    case when old_card = 0 then 100 when not zero and row_match > 90 then 100 when not zero and row_match > 85 and rule not in ('RAW', 'NONE') then least(98, score)
      when not zero and set_match > 95 then 98 when zero and name_sim > 95 then 100 else score end as confidence,
    row_number() over (partition by old_column order by round(score, 6) desc, place) as rn
  from (select *, case when zero then case when name_sim > 95 then 100 else name_sim * 0.9 + fp_sim * 0.1 end
            when ob or nb or least(old_card, new_card) <= 5 then {low} else {high} end as score
    from (select o.column_name as old_column, n.column_name as new_column, p.place, o.cardinality as old_card, n.cardinality as new_card,
            o.is_all_zeros as zero, o.is_boolean as ob, n.is_boolean as nb, o.column_type as ot, n.column_type as nt,
            case when o.is_all_zeros then 0 else {row} end as row_match, case when o.is_all_zeros then 'NONE' else {rule} end as rule,
            case when o.is_all_zeros then 0 else coalesce(s.set_match, 0) end as set_match, coalesce(s.set_match, 0) as shared_pct,
            ({C.NAME_SIM.format(a='o.column_name', b='n.column_name')}) * 100 as name_sim, {C.FP_SIM} as fp_sim
          from old_prints o cross join new_prints n join places p on p.column_name = n.column_name
          left join shared_pairs s on s.old_column = o.column_name and s.new_column = n.column_name {rates}) a
    where not (shared_pct = 0 and old_card > 10 and new_card > 10) or zero) b) c where rn = 1) d
"""


PAIR_CTES = {**C.BOTH_PRINTS, **{k: v for k, v in C.OVERLAP_CTES.items() if k in ("ov", "nv", "shared_pairs")}, "places": C.names_sql(C.F8_NEW_COLUMNS)}
RATE_CTES = {
    "wide_rates": f"select {JOINED_RATES} from old o join new n on o.order_accountno = n.order_account_no", "rates": RATE_ROWS,
    "best": "select * from (select *, row_number() over (partition by old_column, new_column order by match_rate desc, place) as rn from rates) t where rn = 1",
}
FIELD_ANCHORED = with_tables(field_sql(True), **PAIR_CTES, **RATE_CTES)
FIELD_COLUMNS = ["old_column", "new_column", "status", "confidence", "rule"]


def fields(spark, folder, anchored: bool):
    old, new, joined = C.joined_of(spark, folder)
    return field_match.match_fields(old, new, joined if anchored else None)


@query("match_fields_anchored", FIELD_ANCHORED)
def match_fields_anchored(spark, folder):
    return fields(spark, folder, True).select(*FIELD_COLUMNS).withColumn("confidence", F.round("confidence", 2))


@query("match_fields_unanchored", with_tables(field_sql(False), **PAIR_CTES))
def match_fields_unanchored(spark, folder):
    return fields(spark, folder, False).select(*FIELD_COLUMNS).withColumn("confidence", F.round("confidence", 2))


@query("collisions", with_tables("""
select old_column, new_column, case when n = 1 then 'SOLE' when rn = 1 then 'OWNER' when top >= 95 or top - confidence >= 15 then 'EVICTED' else 'TIE' end as claim_outcome, winner
from (select old_column, new_column, confidence, count(*) over w as n, row_number() over (partition by new_column order by confidence desc, old_column) as rn,
        max(confidence) over w as top, first_value(old_column) over (partition by new_column order by confidence desc, old_column) as winner
      from m where new_column is not null window w as (partition by new_column)) t
""", **PAIR_CTES, m=field_sql(False)))
def collisions(spark, folder):
    return field_match.resolve_collisions(fields(spark, folder, False)).select("old_column", "new_column", "claim_outcome", "winner")


CONFIGURED = [("customer_key", "cust_key"), ("note_text", "note_text")]


@query("configured_mappings", with_tables("""
select old_column, new_column, status from m where old_column not in ('customer_key', 'note_text') and (new_column is null or new_column not in ('cust_key', 'note_text'))
union all select 'customer_key', 'cust_key', 'VERIFIED (Schema Mapping)' union all select 'note_text', 'note_text', 'VERIFIED (Schema Mapping)'
""", **PAIR_CTES, m=field_sql(False)))
def configured_mappings(spark, folder):
    return field_match.with_configured(fields(spark, folder, False), CONFIGURED).select("old_column", "new_column", "status")


@query("mapping_report_order", with_tables("""
select old_column, status, cast(case status when 'VERIFIED (Schema Mapping)' then 0 when 'VERIFIED' then 1 when 'VERIFIED (Data Match)' then 2 when 'VERIFIED (Set Match)' then 3
  when 'MANUAL_CHECK' then 6 when 'EMPTY_COLUMN' then 11 else 12 end as integer) as status_rank from m
""", **PAIR_CTES, m=field_sql(False)))
def mapping_report_order(spark, folder):
    return report.mapping_order(fields(spark, folder, False)).select("old_column", "status", "status_rank")


@query("suspicious_matches", with_tables("""
select old_column, new_column, case when boolean and name_sim < 50 then 'boolean column, unlike names' else 'type mismatch, high confidence' end as reason
from m where status like '%VERIFIED%' and ((boolean and name_sim < 50) or (confidence > 85 and mismatch))
""", **PAIR_CTES, **RATE_CTES, m=f"""select m.*, 'boolean' in (o.column_type, n.column_type) as boolean, ({C.NAME_SIM.format(a='m.old_column', b='m.new_column')}) * 100 as name_sim,
    not (o.column_type = n.column_type or (o.column_type in ('numeric', 'integer') and n.column_type in ('numeric', 'integer'))) as mismatch
    from ({field_sql(True)}) m join old_prints o on o.column_name = m.old_column join new_prints n on n.column_name = m.new_column"""))
def suspicious_matches(spark, folder):
    return field_match.suspicious_matches(fields(spark, folder, True)).select("old_column", "new_column", "reason")


ORPHAN_PAIRS = [("note_text", "note_text"), ("spare", "note_text"), ("customer_key", "cust_key"), ("document_no", "note_text"), ("order_status", "note_text")]
ORPHAN_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in ORPHAN_PAIRS)


@query("orphans", with_tables(f"""
select p.old_column, p.new_column, case when o.cardinality = 0 then 'OLD_EMPTY' when n.cardinality > 0 then 'HAS_DATA' when f.new_column is not null then 'SCHEMA_MATCH_ONLY' else 'DATA_LOST' end as status,
       case when o.cardinality > 0 and n.cardinality = 0 then f.new_column end as alternative_column
from (values {ORPHAN_VALUES}) p(old_column, new_column) join old_prints o on o.column_name = p.old_column join new_prints n on n.column_name = p.new_column
left join (select * from (select *, row_number() over (partition by old_column order by n_shared desc, new_column desc) as rn from shared_pairs where n_shared >= least(3, n_old * 0.3)) t where rn = 1) f
  on f.old_column = p.old_column
""", **PAIR_CTES))
def orphans(spark, folder):
    old, new = X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW)
    pairs = spark.createDataFrame(ORPHAN_PAIRS, "old_column string, new_column string")
    return field_match.orphan_status(
        pairs, profile.fingerprints(profile.value_counts(old)), profile.fingerprints(profile.value_counts(new)), field_match.comparable_overlap(old, new))


SPLIT_OLD = "select o_orderkey as key, cast(o_totalprice as decimal(18,2)) as interest, o_orderstatus as state_code from orders"
SPLIT_NEW = """select o_orderkey as key, case when o_orderkey % 2 = 0 then cast(o_totalprice as decimal(18,2)) else 0 end as debitinterest,
  case when o_orderkey % 2 = 1 then cast(o_totalprice as decimal(18,2)) else 0 end as creditinterest, o_orderstatus as state_code from orders"""


@query("split_formula", with_tables(
    " union all ".join(
        f"select '{name}' as formula, round(avg(case when abs(({sql}) - interest) <= m * 0.01 then 1.0 else 0.0 end), 6) as match_rate from j, (select avg(interest) as m from j) t"
        for name, sql in {"SUM": "debitinterest + creditinterest", "DIFFERENCE": "debitinterest - creditinterest", "SPLIT_BY_SIGN": "abs(debitinterest) + abs(creditinterest)"}.items()),
    old=SPLIT_OLD, new=SPLIT_NEW, j="select * from old join new using (key)"))
def split_formula(spark, folder):
    from concord.operators.anchors import anchored_join

    joined = anchored_join(X.derive(spark, folder, SPLIT_OLD), X.derive(spark, folder, SPLIT_NEW), ["key"], ["key"])
    found = field_match.split_formulas(joined, "interest", ["debitinterest", "creditinterest"])
    return found.select("formula", F.round("match_rate", 6).alias("match_rate"))


def pair_ctes(old: str, old_columns: list[str], new: str, new_columns: list[str]) -> dict[str, str]:
    """What `field_sql` needs, for any two tables."""
    return {**C.side_ctes("old", old, old_columns), **C.side_ctes("new", new, new_columns),
            **{k: v for k, v in C.OVERLAP_CTES.items() if k in ("ov", "nv", "shared_pairs")}, "places": C.names_sql(new_columns)}


def stem_sql(name: str) -> str:
    prefixes, suffixes = "|".join(field_match.SPLIT_PREFIXES), "|".join(field_match.SPLIT_SUFFIXES)
    return f"regexp_replace(regexp_replace(lower({name}), '^(?:{prefixes})(.{{4}}.*)$', '\\1'), '^(.{{4,}}?)(?:{suffixes})$', '\\1')"


def stem_similarity_sql(stem: str, name: str) -> str:
    return (f"case when length({stem}) < 4 then 0 when {stem} = lower({name}) then 1 when contains(lower({name}), {stem}) then length({stem}) / length(lower({name})) "
            f"else 1 - levenshtein({stem}, lower({name})) / greatest(length({stem}), length({name})) end")


SPLIT_KIND_SQL = "case " + " ".join(
    f"when (contains(lower(primary_column), '{a}') or contains(lower(primary_column), '{b}')) and (contains(lower(sibling_column), '{a}') or contains(lower(sibling_column), '{b}')) then '{kind}'"
    for a, b, kind in field_match.SPLIT_TYPES) + " else 'UNKNOWN_SPLIT' end"


@query("split_siblings", with_tables(f"""
select old_column, primary_column, sibling_column, {SPLIT_KIND_SQL} as split_type from (
  select *, {stem_sql('old_column')} as old_stem, {stem_sql('primary_column')} as primary_stem, {stem_sql('sibling_column')} as sibling_stem
  from (select old_column, new_column as primary_column from settled where new_column is not null and status not in ('EMPTY_COLUMN', 'ZERO_COLUMN')) a,
       (select column_name as sibling_column from places where column_name not in (select new_column from settled where new_column is not null)) b) t
where (length(old_column) >= 4 and contains(lower(sibling_column), lower(old_column)))
  or {stem_similarity_sql('old_stem', 'sibling_column')} > 0.6 or {stem_similarity_sql('primary_stem', 'sibling_stem')} > 0.65
""", **pair_ctes(SPLIT_OLD, ["key", "interest", "state_code"], SPLIT_NEW, ["key", "debitinterest", "creditinterest", "state_code"]), m=field_sql(False),
    settled="""select old_column, new_column, status from m where old_column <> 'interest' and (new_column is null or new_column <> 'debitinterest')
    union all select 'interest', 'debitinterest', 'VERIFIED (Schema Mapping)'"""))
def split_siblings(spark, folder):
    old, new = X.derive(spark, folder, SPLIT_OLD), X.derive(spark, folder, SPLIT_NEW)
    # The tie between the two halves is settled by configuration, as a user would.
    settled = field_match.with_configured(field_match.match_fields(old, new), [("interest", "debitinterest")])
    return field_match.split_siblings(settled, new.columns).select("old_column", "primary_column", "sibling_column", "split_type")


WIDE_OLD = """select o_orderkey as key, cast(o_totalprice as decimal(18,2)) as qty_of_all_pieces_ever_delivered, o_custkey as customer_no, o_orderstatus as qty_state_of_the_order_line from orders"""
WIDE_NEW = """select o_orderkey as key, o_orderkey % 7 + 1 as qtyin, o_orderkey % 7 + 2 as qtyout, o_custkey as customerno, o_orderkey % 5 + 1 as cust from orders"""
WIDE_OLD_COLUMNS, WIDE_NEW_COLUMNS = ["key", "qty_of_all_pieces_ever_delivered", "customer_no", "qty_state_of_the_order_line"], ["key", "qtyin", "qtyout", "customerno", "cust"]
START_SQL = "left(lower({0}), cast(greatest(3, floor(length({0}) * 0.5)) as bigint))"


@query("split_candidates", with_tables(f"""
select old_column, list(new_column order by new_column) as new_columns, count(*) as n_columns
from (select old_column from m where status = 'NO_MATCH' and old_type = 'numeric') o,
     (select column_name as new_column from places where column_name not in (select new_column from m where new_column is not null and status not in ('NO_MATCH', 'SAME_NAME_DIFF_DATA'))) n
where starts_with(lower(new_column), {START_SQL.format('old_column')}) or starts_with(lower(old_column), {START_SQL.format('new_column')})
group by old_column having count(*) >= 2
""", **{**C.BOTH_META, "old": WIDE_OLD, "new": WIDE_NEW, "old_long": C.long_sql("old", WIDE_OLD_COLUMNS), "new_long": C.long_sql("new", WIDE_NEW_COLUMNS),
        "places": C.names_sql(WIDE_NEW_COLUMNS)}, m=C.MATCH_SQL))
def split_candidates(spark, folder):
    """Numeric columns that match nothing, with unmatched new columns whose names begin alike."""
    from concord.operators import matching

    old, new = X.derive(spark, folder, WIDE_OLD), X.derive(spark, folder, WIDE_NEW)
    matches = matching.match_columns(old, new)
    rest = matching.unmatched_new(matches, schema.name_list(spark, new.columns, "column_name"))
    return matching.split_candidates(matches, rest)


@query("coverage", with_tables("""
select 'f8' as table_name, count(*) as n_columns, count(case when v then 1 end) as n_mapped, count(case when not v then 1 end) as n_orphaned,
       round(avg(case when v then 1.0 else 0.0 end), 6) as coverage_rate from (select status like '%VERIFIED%' as v from m) t
""", **PAIR_CTES, **RATE_CTES, m=field_sql(True)))
def coverage(spark, folder):
    old = X.derive(spark, folder, X.F8_OLD)
    found = field_match.coverage(schema.columns_of(old, "f8"), fields(spark, folder, True).withColumn("table_name", F.lit("f8")))
    return found.withColumn("coverage_rate", F.round("coverage_rate", 6))


@query("matched_tables", with_tables("""
select old_column, new_column, coalesce(claim_outcome, 'NONE') as claim_outcome, case when claim_outcome = 'EVICTED' then 'MANUAL_CHECK' else status end as status,
       case when claim_outcome = 'EVICTED' then 0 else confidence end as confidence, 'order_accountno' as old_key, 'order_account_no' as new_key
from m left join (select old_column, case when n = 1 then 'SOLE' when rn = 1 then 'OWNER' when top >= 95 or top - confidence >= 15 then 'EVICTED' else 'TIE' end as claim_outcome
  from (select old_column, confidence, count(*) over w as n, row_number() over (partition by new_column order by confidence desc, old_column) as rn, max(confidence) over w as top
        from m where new_column is not null window w as (partition by new_column)) t) c using (old_column)
""", **PAIR_CTES, **RATE_CTES, m=field_sql(True)))
def matched_tables(spark, folder):
    """The whole way from two tables to their mapping; the key is found, not given."""
    found = match_tables(X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW))
    key = [F.lit(",".join(k)) for k in (found.anchor.old_key, found.anchor.new_key)]
    return found.matches.select("old_column", "new_column", "claim_outcome", "status", F.round("confidence", 2).alias("confidence"), key[0].alias("old_key"), key[1].alias("new_key"))


@query("matched_tables_coverage", with_tables("""
select 'f8' as table_name, count(*) as n_columns, count(case when v then 1 end) as n_mapped, count(case when not v then 1 end) as n_orphaned,
       round(avg(case when v then 1.0 else 0.0 end), 6) as coverage_rate from (
  select status like '%VERIFIED%' and not coalesce(n > 1 and rn > 1 and (top >= 95 or top - confidence >= 15), false) as v from m left join (
    select old_column, count(*) over w as n, row_number() over (partition by new_column order by confidence desc, old_column) as rn, max(confidence) over w as top
    from m where new_column is not null window w as (partition by new_column)) c using (old_column)) t
""", **PAIR_CTES, **RATE_CTES, m=field_sql(True)))
def matched_tables_coverage(spark, folder):
    found = match_tables(X.derive(spark, folder, X.F8_OLD), X.derive(spark, folder, X.F8_NEW), "f8").coverage
    return found.withColumn("coverage_rate", F.round("coverage_rate", 6))


@query("unmatched_old", with_tables("""
select c.column_name, s.sample from (select distinct column_name from long where column_name in ('customer_key', 'order_status', 'spare')) c left join (
  select column_name, list(value order by value) as sample from (select column_name, value, row_number() over (partition by column_name order by count(*) desc, value) as rn
    from long where value is not null group by column_name, value) t where rn <= 5 group by column_name) s using (column_name)
""", old=X.F8_OLD, long=C.long_sql("old", C.F8_OLD_COLUMNS)))
def unmatched_old(spark, folder):
    from concord.operators.matching import unmatched_old as unmatched

    old = X.derive(spark, folder, X.F8_OLD)
    known = [c for c in old.columns if c not in ("customer_key", "order_status", "spare")]
    return unmatched(profile.value_counts(old), spark.createDataFrame([(c,) for c in known], "old_column string"), source=old)


# ---- row rules ------------------------------------------------------------------------------------

ITEMS = """
select l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, cast(l_extendedprice as decimal(18,2)) as price, cast(l_tax as decimal(18,2)) as tax,
       cast(l_extendedprice as decimal(18,2)) + cast(l_tax as decimal(18,2)) + case when l_partkey % 19 = 3 then 500.00 else 0.00 end as gross,
       case when l_partkey % 23 = 4 then null else l_returnflag end as flag, l_orderkey * 8 + l_linenumber as line_id from lineitem
"""
RULES = [
    RowRule("R1", "FORMULA", formula="SUM(price, tax)", target="gross", severity="CRITICAL"),
    RowRule("R2", "NOT_NULL", target="flag"),
    RowRule("R3", "UNIQUE", target="line_id", severity="CRITICAL"),
    RowRule("R4", "RANGE", target="l_quantity", low=5, high=45),
    RowRule("R5", "COMPARE", source="l_returnflag", target="flag"),
    RowRule("R6", "EQUAL", source="price", target="nowhere"),
    RowRule("R7", "FORMULA", formula="DIFF(gross, tax)", target="price"),
]
# sum of price and tax over all rows, the mean that widens the tolerance.
AUDIT_COUNTS = """
select 'R1' as rule_id, 'CRITICAL' as severity, count(case when abs(price + tax - gross) <= greatest(0.01, m * 0.001) then 1 end) as p from items, (select avg(abs(price + tax)) as m from items) t
union all select 'R2', 'WARNING', count(flag) from items
union all select 'R3', 'CRITICAL', count(distinct line_id) from items
union all select 'R4', 'WARNING', count(case when l_quantity between 5 and 45 then 1 end) from items
union all select 'R5', 'WARNING', count(case when flag = l_returnflag then 1 end) from items
union all select 'R6', 'WARNING', 0
union all select 'R7', 'WARNING', count(case when abs(gross - tax - price) <= greatest(0.01, m * 0.001) then 1 end) from items, (select avg(abs(gross - tax)) as m from items) t
"""
AUDIT_SQL = f"""
select rule_id, severity, p as pass_count, n - p as fail_count, round(p / n, 6) as pass_rate, case when p / n >= 0.95 then 'PASS' when p / n >= 0.8 then 'WARN' else 'FAIL' end as status
from ({AUDIT_COUNTS}) a, (select count(*) as n from items) b
"""
RESULT = ["rule_id", "severity", "pass_count", "fail_count", "pass_rate", "status"]


def results(df):
    return df.select(*RESULT).withColumn("pass_rate", F.round("pass_rate", 6))


@query("audit_master", with_tables(AUDIT_SQL, items=ITEMS))
def audit_master(spark, folder):
    return results(audit.audit_rows(X.derive(spark, folder, ITEMS), RULES))


@query("audit_summary", with_tables("""
select count(*) as total_rules, count(case when status = 'PASS' then 1 end) as "pass", count(case when status = 'WARN' then 1 end) as warn, count(case when status = 'FAIL' then 1 end) as fail,
       coalesce(list(rule_id order by rule_id) filter (where status = 'FAIL' and severity = 'CRITICAL'), cast([] as varchar[])) as critical_failures from a
""", items=ITEMS, a=AUDIT_SQL))
def audit_summary(spark, folder):
    return audit.audit_summary(audit.audit_rows(X.derive(spark, folder, ITEMS), RULES))


GROUP_RULES = [
    RowRule("G1", "FORMULA", formula="SUM(price, tax)", target="gross", scope="GROUP"),
    RowRule("G2", "COMPARE", formula="l_returnflag", target="flag", scope="GROUP"),
    RowRule("R2", "NOT_NULL", target="flag"),
]


@query("audit_group", with_tables("""
select rule_id, 'WARNING' as severity, p as pass_count, n - p as fail_count, round(p / n, 6) as pass_rate, case when p / n >= 0.95 then 'PASS' when p / n >= 0.8 then 'WARN' else 'FAIL' end as status from (
  select 'G1' as rule_id, count(case when gap <= greatest(0.01, m * 0.001) then 1 end) as p, count(*) as n from g
  union all select 'G2', count(case when same then 1 end), count(*) from g
  union all select 'R2', (select count(flag) from items), (select count(*) from items)) t
""", items=ITEMS, g="""select l_orderkey, max(abs(price + tax - gross)) as gap, avg(abs(price + tax)) as m,
   bool_and(coalesce(flag, 'nan') = l_returnflag) as same from items group by l_orderkey"""))
def audit_group(spark, folder):
    return results(audit.audit_groups(X.derive(spark, folder, ITEMS), "l_orderkey", GROUP_RULES))


SOURCE_A = "select o_orderkey, o_totalprice, o_custkey from orders"
SOURCE_B = "select o_orderkey, o_totalprice * case when o_orderkey % 11 = 1 then 1.5 else 1 end as total, o_custkey + case when o_orderkey % 5 = 1 then 1 else 0 end as cust, 1 as one from orders where o_orderkey % 97 <> 13"
PAIR_RULES = [PairRule("P1", "o_totalprice", "total", "a", "b"), PairRule("P2", "o_custkey", "DIFF(cust, one)", "a", "b")]


@query("audit_multi", with_tables("""
select rule_id, 'WARNING' as severity, p as pass_count, n - p as fail_count, round(p / n, 6) as pass_rate, case when p / n >= 0.95 then 'PASS' when p / n >= 0.8 then 'WARN' else 'FAIL' end as status from (
  select 'P1' as rule_id, count(case when abs(o_totalprice - total) <= greatest(0.01, m * 0.001) then 1 end) as p, count(*) as n from j, (select avg(abs(o_totalprice)) as m from j) t
  union all select 'P2', count(case when abs(o_custkey - cust + 1) <= greatest(0.01, m * 0.001) then 1 end), count(*) from j, (select avg(abs(o_custkey)) as m from j) t) x
""", a=SOURCE_A, b=SOURCE_B, j="select * from a join b using (o_orderkey)"))
def audit_multi(spark, folder):
    sources = {"a": X.derive(spark, folder, SOURCE_A), "b": X.derive(spark, folder, SOURCE_B)}
    return results(audit.audit_pairs(sources, "o_orderkey", PAIR_RULES))


CODE_ROWS = [("A", "Accepted", "OPEN"), ("N", "None", "CLOSED")]


@query("code_tagging", """
select l_returnflag, case when l_returnflag = 'A' then 'Accepted' when l_returnflag = 'N' then 'None' else concat('UNKNOWN:', l_returnflag) end as affect_tag,
       case when l_returnflag = 'A' then 'OPEN' when l_returnflag = 'N' then 'CLOSED' else 'UNKNOWN' end as affect_category, count(*) as n from lineitem group by 1, 2, 3
""")
def code_tagging(spark, folder):
    items = X.tables(spark, folder, "lineitem")["lineitem"]
    codes = spark.createDataFrame(CODE_ROWS, "code string, description string, category string")
    return audit.tag_codes(items, "l_returnflag", codes).groupBy("l_returnflag", "affect_tag", "affect_category").agg(F.count(F.lit(1)).alias("n"))


@query("repeated_rows", with_tables("""
select o_custkey, o_orderkey from (select *, min(o_orderkey) over (partition by o_custkey) as first from orders) t where o_orderkey <> first
""", one="select 1"))
def repeated_rows(spark, folder):
    orders = X.tables(spark, folder, "orders")["orders"]
    return audit.repeated_rows(orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


# ---- functions ------------------------------------------------------------------------------------

SHAPED = """
select o_orderkey, concat('  ', lpad(cast(o_custkey as varchar(20)), 10, '0'), ' ') as padded, case when o_orderkey % 7 = 0 then '  ' else o_orderpriority end as maybe,
       case when o_orderkey % 3 = 0 then concat(cast(extract(day from o_orderdate) as varchar(2)), '/', cast(extract(month from o_orderdate) as varchar(2)), '/', cast(extract(year from o_orderdate) as varchar(4)))
            when o_orderkey % 3 = 1 then concat(cast(cast(o_orderdate as date) as varchar(20)), 'T00:00:00.000+07:00') else concat(cast(cast(o_orderdate as date) as varchar(20)), ' 12:00') end as some_date,
       case when o_orderkey % 2 = 0 then concat('.', cast(o_custkey as varchar(20))) else cast(cast(o_totalprice as decimal(18,2)) as varchar(30)) end as amount, o_orderdate, o_orderstatus
from orders
"""
TRIMMED = "nullif(trim({0}), '')"


@query("fn_transforms", with_tables(f"""
select o_orderkey, {TRIMMED.format('maybe')} as none, case when ltrim(trim(padded), '0') = '' then '0' else ltrim(trim(padded), '0') end as no_zeros,
       regexp_replace({TRIMMED.format('maybe')}, '[^a-zA-Z0-9]', '', 'g') as letters, cast(cast(o_orderdate as date) as varchar) as day,
       substr(trim(padded), 1, 6) as first_part, right(trim(padded), 4) as second_part, concat(trim(padded), '/', trim(maybe)) as joined, left(trim(padded), 3) as prefix
from f
""", f=SHAPED))
def fn_transforms(spark, folder):
    f = X.derive(spark, folder, SHAPED)
    t = text.transform
    return f.select(
        "o_orderkey", t(F.col("maybe"), "NONE").alias("none"), t(F.col("padded"), "STRIP_LEADING_ZEROS").alias("no_zeros"),
        t(F.col("maybe"), "STRIP_SPECIAL_CHARS").alias("letters"), t(F.col("some_date"), "DATE_TO_DATETIME").alias("day"),
        t(F.col("padded"), "SPLIT_FIRST").alias("first_part"), t(F.col("padded"), "SPLIT_SECOND").alias("second_part"),
        text.concat_columns([F.col("padded"), F.col("maybe")], "/").alias("joined"), text.prefix(F.trim("padded"), 3).alias("prefix"))


# The same rewrites on texts of any script: letters beyond ASCII are letters, and one of them has two capitals.
TEXT_REWRITE_SQL = {**C.REWRITE_SQL, "REMOVE_PUNCTUATION": r"regexp_replace({0}, '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]', '', 'g')", "UPPERCASE": "upper(replace({0}, 'ß', 'SS'))"}


@query("fn_rewrites", with_tables(
    "select doc_id, " + ", ".join(f"md5({sql.format('text')}) as {rule.lower()}" for rule, sql in TEXT_REWRITE_SQL.items())
    + ", ltrim(lpad(cast(doc_id as varchar), 12, '0'), '0') as padded_id from documents", one="select 1"))
def fn_rewrites(spark, folder):
    """All rewrites on whole texts."""
    docs = X.tables(spark, folder, "documents")["documents"]
    return docs.select("doc_id", *[F.md5(rewrite(F.col("text"))).alias(name.lower()) for name, rewrite in text.REWRITES.items()],
                       text.REWRITES["STRIP_LEADING_ZEROS"](F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("padded_id"))


@query("fn_numbers", with_tables(f"""
select o_orderkey, {plain('amount')} as normal, amount is not distinct from amount as same,
       abs(cast(amount as decimal(28,8)) - cast(padded as decimal(28,8))) <= 100 as near,
       lower(trim(maybe)) = lower(o_orderstatus) and trim(maybe) <> '' as equal_text,
       {plain('cast(amount as decimal(28,8)) + cast(padded as decimal(28,8)) + 0')} as total, {plain('cast(amount as decimal(28,8)) - cast(padded as decimal(28,8)) - 0')} as rest
from f
""", f=SHAPED))
def fn_numbers(spark, folder):
    f = X.derive(spark, folder, SHAPED)
    from concord.functions.numbers import plain as shown

    numbers = [to_number(F.col(c)) for c in ("amount", "padded", "maybe")]
    return f.select(
        "o_orderkey", normal_number_text(F.col("amount")).alias("normal"), tolerant_equal(F.col("amount"), F.col("amount")).alias("same"),
        tolerant_equal(F.col("amount"), F.col("padded"), 100).alias("near"), tolerant_equal(F.col("maybe"), F.col("o_orderstatus")).alias("equal_text"),
        shown(formula_of("SUM", numbers)).alias("total"), shown(formula_of("SUBTRACT", numbers)).alias("rest"))


@query("fn_fingerprint", with_tables(f"""
select o_orderkey, case when o_orderkey % 3 = 1 then left(some_date, 10) else some_date end as day_text, cast(cast(o_orderdate as date) as varchar) as day,
       cast(extract(year from o_orderdate) as varchar) as year, {plain('amount')} as amount, trim(maybe) as maybe from f
""", f=SHAPED))
def fn_fingerprint(spark, folder):
    f = X.derive(spark, folder, SHAPED)
    return f.select(
        "o_orderkey", fingerprint_part(f, "some_date").alias("day_text"), fingerprint_part(f, "o_orderdate").alias("day"),
        fingerprint_part(f, "o_orderdate", True).alias("year"), fingerprint_part(f, "amount").alias("amount"), fingerprint_part(f, "maybe").alias("maybe"))


@query("fn_comparable", with_tables(
    f"select o_orderkey, column_name, {C.COMPARABLE_SQL} as comparable from l",
    f=SHAPED, l=" union all ".join(f"select o_orderkey, '{c}' as column_name, {c} as value from f" for c in ("padded", "maybe", "some_date", "amount", "o_orderstatus"))))
def fn_comparable(spark, folder):
    f = X.derive(spark, folder, SHAPED)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), text.comparable(F.col(c)).alias("comparable")) for c in ("padded", "maybe", "some_date", "amount", "o_orderstatus")])
    return f.select("o_orderkey", F.explode(cells).alias("c")).select("o_orderkey", "c.*")


@query("fn_name_similarity", "select c_custkey, 1 - levenshtein(lower(c_name), lower(c_mktsegment)) / greatest(length(c_name), length(c_mktsegment)) as similarity from customer")
def fn_name_similarity(spark, folder):
    return X.tables(spark, folder, "customer")["customer"].select("c_custkey", text.name_similarity(F.col("c_name"), F.col("c_mktsegment")).alias("similarity"))


@query("fn_row_formulas", with_tables("""
select line_id, cast(price + tax as decimal(18,2)) as total, cast(gross - price as decimal(18,2)) as diff, round(cast((price + tax + gross) / 3 as double), 4) as mean,
       concat(l_returnflag, coalesce(flag, '')) as joined, coalesce(flag, l_returnflag) as first, flag as own from items
""", items=ITEMS))
def fn_row_formulas(spark, folder):
    items = X.derive(spark, folder, ITEMS)
    f = lambda s: row_formula(items, s)
    return items.select(
        "line_id", f("SUM(price, tax)").cast("decimal(18,2)").alias("total"), f("DIFF(gross, price)").cast("decimal(18,2)").alias("diff"),
        F.round(f("AVG(price, tax, gross)").cast("double"), 4).alias("mean"), f("CONCAT(l_returnflag, flag)").alias("joined"),
        f("COALESCE(flag, l_returnflag)").alias("first"), f("flag").alias("own"))


@query("fn_mean_tolerance", with_tables("""
select line_id, abs(price - gross) <= greatest(0.01, m * 0.001) as alike from items, (select avg(abs(price)) as m from items) t
""", items=ITEMS))
def fn_mean_tolerance(spark, folder):
    items = X.derive(spark, folder, ITEMS)
    like = Likeness(F.col("price"), F.col("gross"), 0.01)
    return items.select("line_id", like.holds(items.agg(like.mean_size()).scalar()).alias("alike"))


# ---- sources and sinks ----------------------------------------------------------------------------

def scratch(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    base = checkpoint_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("src_virtual_union", with_tables("""
select cast(o_orderkey as varchar) as id, o_orderstatus as state, null as segment from orders where o_orderstatus <> 'P'
union all select cast(c_custkey as varchar), null, c_mktsegment from customer
""", one="select 1"))
def src_virtual_union(spark, folder):
    """Two delimited files with padded headers and different columns, as one filtered source."""
    t = X.tables(spark, folder, "orders", "customer")
    path = scratch(spark, "files")
    t["orders"].select(F.col("o_orderkey").alias(" id "), F.col("o_orderstatus").alias("state ")).write.csv(f"{path}/a", header=True)
    t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias(" segment")).write.csv(f"{path}/b", header=True)
    frames = [files.delimited(spark, f"{path}/{n}") for n in ("a", "b")]
    return files.virtual_source(frames, "UNION", "state is null or state <> 'P'").select("id", "state", "segment")


@query("src_sample", "select count(*) as n, count(distinct o_orderkey) as n_keys from (select o_orderkey from orders limit 500) t")
def src_sample(spark, folder):
    """A repeatable sample of 500 rows."""
    return repeatable_sample(X.tables(spark, folder, "orders")["orders"], 500).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("src_sample_rows", "select o_orderkey, o_custkey from orders order by md5(cast(o_orderkey as varchar)), o_orderkey limit 500")
def src_sample_rows(spark, folder):
    """Which rows the sample holds, by a hash that any engine has."""
    orders = X.tables(spark, folder, "orders")["orders"]
    return repeatable_sample(orders, 500, [F.md5(F.col("o_orderkey").cast("string")), F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("code_list_tags", """
select c_nationkey, case when n_name is null then concat('UNKNOWN:', cast(c_nationkey as varchar)) else n_name end as affect_tag,
       case when n_name is null then 'UNKNOWN' else concat('R', cast(n_regionkey as varchar)) end as affect_category, count(*) as n
from customer left join (select * from nation where n_nationkey % 5 <> 3) x on n_nationkey = c_nationkey group by all
""")
def code_list_tags(spark, folder):
    """A code list written as JSON, read back and used for tags."""
    t = X.tables(spark, folder, "nation", "customer")
    path = scratch(spark, "codes")
    entry = F.struct(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("description"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category"))
    # One JSON document of a few dozen codes, as such lists are.
    t["nation"].filter("n_nationkey % 5 <> 3").agg(F.collect_list(entry).alias("codes")).coalesce(1).write.json(path)
    codes = files.code_list(spark, path)
    return audit.tag_codes(t["customer"], "c_nationkey", codes).groupBy("c_nationkey", "affect_tag", "affect_category").agg(F.count(F.lit(1)).alias("n"))


@query("sink_detail", f2b("select error_type, count(*) as n from e group by error_type", **BREAKDOWN_CTES))
def sink_detail(spark, folder):
    """The detail log, written and read back."""
    path = scratch(spark, "detail")
    sinks.write_detail(long(spark, folder, FULL), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@query("sink_summary", f2b("""
select error_type, def_id, cast(count(*) as varchar) as "count" from e group by error_type, def_id
""", **BREAKDOWN_CTES))
def sink_summary(spark, folder):
    """The summary files, written and read back."""
    path = scratch(spark, "summary")
    sinks.write_summary([long(spark, folder, FULL)], path)
    return spark.read.option("header", True).csv(f"{path}/Error_Summary").select("error_type", "def_id", "count")


SUMMARY_SQL = """
select 'long' as rule, 'old' as source_table, 'new' as target_table, 'FAIL' as status, (select count(*) from old) as rows_checked,
       (select count(*) from old where sysref not in (select k from e where k is not null)) as "pass",
       (select count(*) from old where sysref in (select k from e where k is not null)) as fail, 0 as skipped, count(*) as total_errors,
       count(case when error_type like '%MISSING' then 1 end) as missing,
       (select string_agg(message, ' | ' order by message) from (
         select concat('Source [old] has ', count(*), ' unmapped column(s): ', string_agg(column_name, ', ' order by place)) as message from old_names where column_name not in ('sysref', 'transactionamount')
         union all select concat('Target [new] has ', count(*), ' unmapped column(s): ', string_agg(column_name, ', ' order by place)) from new_names where column_name not in ('sysrefno', 'transactionamount')) r) as remarks
from e
"""
F2_OLD_COLUMNS = ["sysref", "affectcode", "debitcredit", "loantranshostcode", "accountno", "transactionamount", "quantity", "tellerid", "l_orderkey", "l_partkey", "l_linenumber"]
F2B_NEW_COLUMNS = ["sysrefno", "affectcode", "debitcredit", "accountno", "transactionamount", "quantity", "tellerid", "code_side", "l_orderkey", "l_partkey", "l_linenumber"]
SUMMARY_CTES = {**BREAKDOWN_CTES, "old_names": C.names_sql(F2_OLD_COLUMNS), "new_names": C.names_sql(F2B_NEW_COLUMNS)}


@query("summary_remarks", f2b(SUMMARY_SQL.replace(" as rows_checked", "::bigint as rows_checked").replace("0 as skipped", "0::bigint as skipped"), **SUMMARY_CTES))
def summary_remarks(spark, folder):
    """The whole summary row of a rule, with the messages about its columns."""
    return report.summary([long(spark, folder, FULL)])


@query("sink_summary_report", f2b("select rule, source_table, target_table, status, " + ", ".join(
    f'cast("{c}" as varchar) as "{c}"' for c in ("rows_checked", "pass", "fail", "skipped", "total_errors", "missing")) + ", remarks from s", **SUMMARY_CTES, s=SUMMARY_SQL))
def sink_summary_report(spark, folder):
    """All reports of a run, of which the summary is read back."""
    path = scratch(spark, "run")
    sinks.write_run([long(spark, folder, FULL)], path)
    return spark.read.option("header", True).csv(f"{path}/Summary_Report")


@query("error_summary_order", f2b("""
select error_type, def_id, cast(row_number() over (order by case when error_type = 'DEFECT_VIOLATION' then 0 else 1 end, concat(coalesce(def_id, ''), error_type)) as integer) as place,
       count(*) as n from e group by error_type, def_id
""", **BREAKDOWN_CTES))
def error_summary_order(spark, folder):
    """Where each line stands in the written error summary."""
    path = scratch(spark, "order")
    sinks.write_summary([long(spark, folder, FULL)], path)
    lines = spark.read.option("header", True).csv(f"{path}/Error_Summary").coalesce(1)  # a line per type of error
    return lines.select("error_type", "def_id", (F.monotonically_increasing_id() + 1).cast("int").alias("place"), F.col("count").cast("long").alias("n"))


@query("sink_def_report", with_tables("select group_key, message as shown from m", **{
    "old": X.F2_OLD, "new": X.F2B_NEW, "m": """select k as group_key, concat(cast(o as varchar), ' vs ', cast(n as varchar)) as message
from (select sysref as k, count(*) as o from old group by sysref) a join (select sysrefno as k, count(*) as n from new group by sysrefno) b using (k) where o <> n"""}))
def sink_def_report(spark, folder):
    from checks.validators import long_rule
    from concord.rules import Action, DefRule, Mappings

    rule = DefRule("rows", (Action("ROW_LEVEL_COHESION", {"o": "COUNT(old)", "n": "COUNT(new)"}, "o == n", "differs", report_fields={"o": "o", "n": "n"}),))
    path = scratch(spark, "def")
    sinks.write_def_reports(long(spark, folder, long_rule(Mappings(), (rule,))), path)
    back = spark.read.option("header", True).csv(f"{path}/rows_Detail")
    return back.select("group_key", F.concat("o", F.lit(" vs "), "n").alias("shown"))


@query("sink_document", with_tables("""
select 'f8' as target_table, (select count(*) from m) as total_columns, (select count(*) from a) as n_rules, (select count(*) from m where status = 'MANUAL_CHECK') as manual
""", **PAIR_CTES, m=field_sql(False), items=ITEMS, a=AUDIT_SQL))
def sink_document(spark, folder):
    """The result document, written as JSON and read back."""
    old = X.derive(spark, folder, X.F8_OLD)
    matches = fields(spark, folder, False)
    covered = field_match.coverage(schema.columns_of(old, "f8"), matches.withColumn("table_name", F.lit("f8")))
    document = sinks.result_document("f8", matches, audit.audit_rows(X.derive(spark, folder, ITEMS), RULES), covered)
    path = scratch(spark, "document")
    sinks.write_document(document, path)
    back = spark.read.json(path)
    return back.select(
        "target_table", F.col("mapping.total_columns").alias("total_columns"), F.size("validation.defect_report").cast("long").alias("n_rules"),
        F.size(F.filter("mapping.columns", lambda c: c["status"] == "MANUAL_CHECK")).cast("long").alias("manual"))
