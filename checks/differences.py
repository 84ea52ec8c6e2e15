"""Differing values as rows, rules with a source filter, and rows that have no place in a sum or a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import fixtures as X
from checks import validators as V
from checks.catalog import query, with_tables
from concord.plans.outcome import Outcome
from concord.rules import Action, CompositeKey, DefRule, Exact, Grouping, Mappings, Rule, Subset, Transformed


def values_of(outcome: Outcome, *key: str) -> DataFrame:
    return outcome.details["differences"].select(F.concat_ws("::", *key).alias("group_key"), "mapping", "value", "side")


def set_differences(column: str, old: str = "old", sides: str = "true", lower: bool = False) -> str:
    """Values of a column that one side of a common group lacks."""
    value = f"lower({column})" if lower else column
    return f"""
select coalesce(o.k, n.k) as group_key, '{column}->{column}' as mapping, coalesce(o.v, n.v) as value, case when n.k is null then 'old_only' else 'new_only' end as side
from (select distinct sysref as k, {value} as v from {old}) o
full outer join (select distinct sysrefno as k, {value} as v from new) n on o.k = n.k and o.v = n.v
where ((o.k is null and n.k in (select sysref from {old})) or (n.k is null and o.k in (select sysrefno from new))) and {sides}
"""


@query("multi_source_differences", V.f2b(set_differences("accountno")))
def multi_source_differences(spark, folder):
    return values_of(V.multi(spark, folder), "group_key_1")


@query("union_source_differences", V.f2b(set_differences("affectcode", lower=True)))
def union_source_differences(spark, folder):
    return values_of(V.run(spark, folder, V.UNION, **V.UNION_PARTS), "group_key_1")


@query("txn_subset_differences", V.f2b(set_differences("accountno", sides="n.k is null")))
def txn_subset_differences(spark, folder):
    """Only the values that are missing."""
    return values_of(V.long(spark, folder, V.long_rule(Mappings(subset=(Subset("accountno", "accountno"),)))), "group_key_1")


@query("composite_differences", V.f3("""
select concat(sysref, '::', lv) as group_key, 'affectcode->affectcode' as mapping, v as value, 'old_only' as side
from (select sysref, lv, code, unnest(vs) as v from m where found is not null) x where v <> code
union all
select concat(sysref, '::', lv), 'affectcode->affectcode', code, 'new_only' from m where found is not null and not list_contains(vs, code)
"""))
def composite_differences(spark, folder):
    return values_of(V.composite(spark, folder), "group_key_1", "group_key_2")


@query("def_field_value_differences", V.f2b(
    """
select k as group_key, 'vali001' as mapping, v as value, side from x join counts using (k) where bad > allowed
""",
    counts=rf"""
select n.k, n.bad, o.allowed from
  (select sysrefno as k, count(case when regexp_matches(tellerid, '{V.TELLER_PATTERN}') then 1 end) as bad from new group by sysrefno) n
  join (select sysref as k, count(case when tellerid = 'CONV' then 1 end) as allowed from old group by sysref) o on n.k = o.k
""",
    x=rf"""
select coalesce(w.k, b.k) as k, coalesce(w.v, b.v) as v, case when b.k is null then 'old_only' when w.k is null then 'new_only' else 'both' end as side
from (select distinct sysref as k, tellerid as v from old where tellerid <> 'CONV') w
full outer join (select distinct sysrefno as k, tellerid as v from new where regexp_matches(tellerid, '{V.TELLER_PATTERN}')) b on w.k = b.k and w.v = b.v
""",
))
def def_field_value_differences(spark, folder):
    return values_of(V.long(spark, folder, V.long_rule(Mappings(), (V.TELLER_RULE,))), "group_key_1")


# ---- source filters -------------------------------------------------------------------------------

def filtered_rule(source_filter: str, **more) -> Rule:
    rule = V.long_rule(Mappings(exact=(Exact("affectcode", "affectcode"), Exact("transactionamount", "transactionamount"))))
    return Rule(**{**rule.__dict__, "source_filter": source_filter, **more})


@query("txn_source_filters", V.f2b(" union all ".join(
    f"select '{part}' as part, group_key, mapping, value, side from ({set_differences('affectcode', 'old' + part)}) d{part}" for part in ("a", "b")) + """
union all select 'a', k, 'missing', null, null from (select distinct sysref as k from olda) a where k not in (select sysrefno from new)
union all select 'b', k, 'missing', null, null from (select distinct sysref as k from oldb) b where k not in (select sysrefno from new)
""", olda="select * from old where debitcredit = 'C'", oldb="select * from old where debitcredit = 'D'"))
def txn_source_filters(spark, folder):
    """Two rules own disjoint rows of one table: no extra groups, and missing ones per filter."""
    frames = []
    for part, side in (("a", "C"), ("b", "D")):
        outcome = V.long(spark, folder, filtered_rule(f"debitcredit = '{side}'"))
        found = values_of(outcome, "group_key_1").filter("mapping = 'affectcode->affectcode'")
        lost = outcome.errors.filter("error_type = 'ROW_MISSING'").select(
            "group_key", F.lit("missing").alias("mapping"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("side"))
        frames.append(found.unionByName(lost).select(F.lit(part).alias("part"), "*"))
    return frames[0].unionByName(frames[1])


@query("agg_cross_check_filtered", V.f2b("""
select concat('SUM(transactionamount) WHERE affectcode=''', coalesce(a.c, b.c), '''') as old_column
from (select affectcode as c, sum(cast(transactionamount as decimal(18,2))) as s from old where accountno like '%3' group by affectcode) a
full outer join (select affectcode as c, sum(transactionamount) as s from new where sysrefno in (select sysref from old where accountno like '%3') group by affectcode) b on a.c = b.c
where abs(coalesce(a.s, 0) - coalesce(b.s, 0)) > 0.01
"""))
def agg_cross_check_filtered(spark, folder):
    """Totals of a filtered source against the target rows of its groups alone."""
    found = V.long(spark, folder, filtered_rule("accountno like '%3'", skip_aggregate_sum_check=False)).errors
    return found.filter(F.col("message").startswith("[AGGREGATE]")).select("old_column")


@query("split_source_filter", with_tables("""
select custkey as old_value from (select distinct custkey from old where o_orderkey % 2 = 0) a where custkey not in (select custno from new)
""", old=X.F6_OLD, new=X.F6_NEW))
def split_source_filter(spark, folder):
    """Values that the filter leaves out are no extras."""
    rule = Rule(**{**V.SPLIT.__dict__, "source_filter": "o_orderkey % 2 = 0"})
    return V.run(spark, folder, rule, old=X.F6_OLD, new=X.F6_NEW).errors.filter("error_type = 'ROW_MISSING'").select("old_value")


@query("header_source_filter", with_tables(
    "select cast(user_id as varchar) as row_id from (select distinct user_id from old where user_id % 3 = 1) a where user_id not in (select user_id from new)",
    old=X.F5_LONG, new=X.F5_WIDE))
def header_source_filter(spark, folder):
    rule = Rule(**{**V.HEADER.__dict__, "source_filter": "user_id % 3 = 1"})
    return V.run(spark, folder, rule, old=X.F5_LONG, new=X.F5_WIDE).errors.filter("error_type = 'ROW_MISSING'").select("row_id")


# ---- columns that are not there, rules per identity ------------------------------------------------

@query("split_column_missing", with_tables("""
select 'ROW_MISSING' as error_type, custkey as old_value from (select distinct custkey from old) a where custkey not in (select custno from new)
union all select distinct 'COLUMN_MISSING', cast(null as varchar) from old
""", old=X.F6_OLD, new=X.F6_NEW))
def split_column_missing(spark, folder):
    """A mapping on a missing column is reported; the other one is checked."""
    mappings = Mappings(exact=(Exact("custkey", "custno"), Exact("gone", "c_name")))
    rule = Rule(**{**V.SPLIT.__dict__, "mappings": mappings, "source_filter": "true"})
    found = V.run(spark, folder, rule, old=X.F6_OLD, new=X.F6_NEW).errors
    return found.filter("error_type = 'ROW_MISSING' or (error_type = 'COLUMN_MISSING' and old_column = 'gone')").select("error_type", "old_value")


IDENTITY_COUNT = DefRule("vali009", (Action(
    "ROW_LEVEL_COHESION", {"val_old": "COUNT(old)", "val_new": "COUNT(new)"}, "val_old == val_new", "{val_old} vs {val_new}"),))


@query("header_business_rule", with_tables("""
select cast(user_id as varchar) as group_key, concat(cast(a as varchar), ' vs ', cast(b as varchar)) as message
from (select user_id, count(*) as a from old group by user_id) o join (select user_id, count(*) as b from new group by user_id) n using (user_id) where a <> b
""", old=X.F5_LONG, new=X.F5_WIDE))
def header_business_rule(spark, folder):
    """A rule over the rows of each identity."""
    rule = Rule(**{**V.HEADER.__dict__, "defs": (IDENTITY_COUNT,)})
    return V.run(spark, folder, rule, old=X.F5_LONG, new=X.F5_WIDE).errors.filter("error_type = 'DEFECT_VIOLATION'").select("group_key", "message")


# ---- numbers and groups ---------------------------------------------------------------------------

ODD_OLD = """select concat('K', cast(o_orderkey as varchar(20))) as sysref,
  case when o_orderkey % 97 = 3 then cast('NaN' as double) when o_orderkey % 89 = 5 then cast(1e25 as double) else o_totalprice end as amount from orders"""
ODD_NEW = "select concat('K', cast(o_orderkey as varchar(20))) as sysrefno, o_totalprice as amount from orders"


@query("txn_odd_sums", "select concat('K', cast(o_orderkey as varchar)) as group_key from orders where o_orderkey % 97 = 3 or o_orderkey % 89 = 5")
def txn_odd_sums(spark, folder):
    """Groups whose amounts are not finite, or beyond the digits of a sum, are reported."""
    rule = Rule("odd", "TRANSACTION", "old", "new", Mappings(transformed=(Transformed("amount", "amount"),)), grouping=Grouping("sysref", "sysrefno"),
                tolerance=0.01, tolerance_set=True, skip_aggregate_sum_check=True)
    return V.mismatches(V.run(spark, folder, rule, old=ODD_OLD, new=ODD_NEW)).select("group_key")


TENTH_OLD = "select o_orderkey as id, concat(cast(o_orderkey % 1000 as varchar(20)), '.1234567891') as v from orders"
TENTH_NEW = "select o_orderkey as id, concat(cast(o_orderkey % 1000 as varchar(20)), case when o_orderkey % 7 = 1 then '.1234567894' else '.12345678910' end) as v from orders"


@query("master_many_decimals", "select cast(o_orderkey as varchar) as row_id from orders where o_orderkey % 7 = 1")
def master_many_decimals(spark, folder):
    """Differences after the eighth decimal count; trailing zeros do not."""
    rule = Rule("tenth", "MASTER", "old", "new", Mappings(exact=(Exact("v", "v"),)), old_anchor="id", new_anchor="id")
    found = V.run(spark, folder, rule, old=TENTH_OLD, new=TENTH_NEW).errors
    return found.filter("error_type = 'VALUE_MISMATCH'").select("row_id")


BLANK_OLD = f"select sysref, case when transactionamount like '%7' then null else accountno end as accountno, transactionamount from ({X.F2_OLD}) b"
BLANK_NEW = f"select sysref as sysrefno, accountno, transactionamount from ({X.F2_OLD}) b"


@query("composite_blank_accounts", with_tables("""
select cast(count(*) as bigint) as rows_checked, cast(count(*) filter (accountno is not null) as bigint) as judged from old
""", old=BLANK_OLD))
def composite_blank_accounts(spark, folder):
    """Rows without an account are checked, and neither passed nor failed."""
    rule = Rule("blank", "TRANSACTION", "old", "new", Mappings(exact=(Exact("transactionamount", "transactionamount"),)),
                grouping=Grouping("sysref", "sysrefno", composite_key=CompositeKey("accountno", "accountno", None)), tolerance=0.01, tolerance_set=True,
                skip_aggregate_sum_check=True)
    total = V.run(spark, folder, rule, old=BLANK_OLD, new=BLANK_NEW).accounting
    return total.agg(F.sum("rows_checked").alias("rows_checked"), F.sum(F.col("pass_rows") + F.col("fail_rows")).alias("judged"))


LOW = "right(sysref, 1) in ('0', '1', '2', '3', '4')"
UNION_BLANK = {
    "old0": f"select sysref, cast(null as varchar(10)) as affectcode from ({X.F2_OLD}) a where {LOW}",
    "old1": f"select sysref, affectcode from ({X.F2_OLD}) a where not {LOW}",
    "new": f"select sysref as sysrefno, concat('X', affectcode) as affectcode from ({X.F2_OLD}) a",
}


@query("union_blank_first_source", with_tables("select distinct sysref as group_key from old1", old1=UNION_BLANK["old1"]))
def union_blank_first_source(spark, folder):
    """A column that is blank in the first source is still compared in the second."""
    rule = Rule("ub", "UNION", "old0,old1", "new", Mappings(exact=(Exact("affectcode", "affectcode"),)), grouping=Grouping("sysref", "sysrefno"),
                tolerance=0.01, tolerance_set=True, skip_aggregate_sum_check=True)
    return V.mismatches(V.run(spark, folder, rule, **UNION_BLANK)).select("group_key")


EITHER = DefRule("vali010", (Action(
    "ROW_LEVEL_COHESION", {"a": "SUM(new.transactionamount)", "b": "SUM(old.transactionamount)"}, "a == 0 OR a == b", "{a} and {b}"),))


@query("def_several_equalities", V.f2b("""
select a.k as group_key from (select sysref as k, sum(cast(transactionamount as decimal(28,8))) as s from old group by sysref) a
join (select sysrefno as k, sum(cast(transactionamount as decimal(28,8))) as s from new group by sysrefno) b using (k) where not (abs(b.s) <= 0.01 or abs(a.s - b.s) <= 0.01)
"""))
def def_several_equalities(spark, folder):
    """A condition with two equalities, each within the tolerance."""
    found = V.long(spark, folder, V.long_rule(Mappings(), (EITHER,))).errors
    return found.filter("error_type = 'DEFECT_VIOLATION'").select("group_key")
