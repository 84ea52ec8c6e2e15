"""Queries about keys, codes, coverage and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.catalog import query, with_tables
from checks.validators import ROUTES, f2b
from concord.functions.numbers import number_of, to_number
from concord.functions.text import prefix
from concord.operators import keys


def table(spark, folder, name):
    return X.tables(spark, folder, name)[name]


@query("key_cardinality", """
select count(*) as n_keys, cast(sum(n) as bigint) as n_rows, min(n) as min_rows, max(n) as max_rows, avg(n) as avg_rows,
       count(case when n = 1 then 1 end) as single_row_keys, count(case when n > 10 then 1 end) as many_row_keys
from (select l_orderkey, count(*) as n from lineitem group by l_orderkey) t
""")
def key_cardinality(spark, folder):
    return keys.key_cardinality(table(spark, folder, "lineitem"), "l_orderkey")


@query("key_dependency", """
select l_partkey as key, count(distinct l_suppkey) as n_partners from lineitem group by l_partkey having count(distinct l_suppkey) > 1
""")
def key_dependency(spark, folder):
    return keys.key_dependency(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey")


@query("key_dependency_top", """
select l_partkey as key, count(distinct l_suppkey) as n_partners from lineitem group by l_partkey having count(distinct l_suppkey) > 1
order by n_partners desc, key limit 5
""")
def key_dependency_top(spark, folder):
    return keys.largest(keys.key_dependency(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey"), "n_partners", 5, "key")


@query("key_scatter", "select user_id as key, count(*) as n_rows, (max(event_id) - min(event_id) + 1) / count(*) as scatter from events group by user_id")
def key_scatter(spark, folder):
    return keys.key_scatter(table(spark, folder, "events"), "user_id", "event_id")


@query("prefix_distribution", with_tables("""
select split_part(o_orderpriority, '-', 1) as prefix, count(*) as n_rows, count(distinct o_custkey) as n_keys, count(distinct o_orderstatus) as n_accounts
from orders group by 1
""", one="select 1"))
def prefix_distribution(spark, folder):
    return keys.prefix_distribution(table(spark, folder, "orders"), prefix(F.col("o_orderpriority")), "o_custkey", "o_orderstatus")


@query("prefix_fixed_length", with_tables("""
select left(sysref, 4) as prefix, count(*) as n_rows, count(distinct sysref) as n_keys, count(distinct accountno) as n_accounts from old group by 1
""", old=X.F2_OLD))
def prefix_fixed_length(spark, folder):
    return keys.prefix_distribution(X.derive(spark, folder, X.F2_OLD), prefix(F.col("sysref"), 4), "sysref", "accountno")


@query("rows_per_key_matrix", f2b("""
select a.n as old_rows, coalesce(b.n, 0) as new_rows, count(*) as n_keys
from (select sysref as k, count(*) as n from old group by sysref) a
left join (select sysrefno as k, count(*) as n from new group by sysrefno) b using (k) group by 1, 2
"""))
def rows_per_key_matrix(spark, folder):
    return keys.rows_per_key_matrix(X.derive(spark, folder, X.F2_OLD), X.derive(spark, folder, X.F2B_NEW), "sysref", "sysrefno")


OUTLIERS = """
select a.k as key, a.n as old_rows, b.n as new_rows, a.n - b.n as row_diff
from (select sysref as k, count(*) as n from old group by sysref) a
join (select sysrefno as k, count(*) as n from new group by sysrefno) b using (k) where a.n - b.n <> 0
"""


@query("row_diff_outliers", f2b(OUTLIERS))
def row_diff_outliers(spark, folder):
    return keys.row_diff_outliers(X.derive(spark, folder, X.F2_OLD), X.derive(spark, folder, X.F2B_NEW), "sysref", "sysrefno", 0)


@query("row_diff_outliers_top", f2b(f"select *, abs(row_diff) as gap from ({OUTLIERS}) t order by gap desc, key limit 10"))
def row_diff_outliers_top(spark, folder):
    found = keys.row_diff_outliers(X.derive(spark, folder, X.F2_OLD), X.derive(spark, folder, X.F2B_NEW), "sysref", "sysrefno", 0)
    return keys.largest(found.withColumn("gap", F.abs("row_diff")), "gap", 10, "key")


@query("code_cooccurrence", """
select l_orderkey as key, bool_or(l_returnflag = 'A') as has_first, bool_or(l_returnflag = 'R') as has_second
from lineitem where l_returnflag in ('A', 'R') group by l_orderkey
having bool_or(l_returnflag = 'A') <> bool_or(l_returnflag = 'R')
""")
def code_cooccurrence(spark, folder):
    return keys.code_cooccurrence(table(spark, folder, "lineitem"), "l_orderkey", "l_returnflag", "A", "R")


@query("nonzero_pivot", """
select l_returnflag, l_linestatus, count(case when l_discount <> 0 then 1 end) as nonzero_l_discount,
       count(case when l_tax <> 0 then 1 end) as nonzero_l_tax, count(case when l_quantity <> 0 then 1 end) as nonzero_l_quantity, count(*) as n_rows
from lineitem group by l_returnflag, l_linestatus
""")
def nonzero_pivot(spark, folder):
    return keys.nonzero_pivot(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax", "l_quantity"])


@query("nonzero_parity", """
select (select count(l_discount) from lineitem) as old_values, (select count(case when l_discount <> 0 then 1 end) from lineitem) as old_nonzero,
       (select count(o_totalprice) from orders) as new_values, (select count(case when o_totalprice <> 0 then 1 end) from orders) as new_nonzero
""")
def nonzero_parity(spark, folder):
    return keys.nonzero_parity(table(spark, folder, "lineitem"), table(spark, folder, "orders"), "l_discount", "o_totalprice")


@query("column_equality", """
select count(case when l_linenumber = l_quantity then 1 end) as n_equal, count(case when l_linenumber <> l_quantity then 1 end) as n_different, count(*) as n_rows from lineitem
""")
def column_equality(spark, folder):
    return keys.column_equality(table(spark, folder, "lineitem"), "l_linenumber", "l_quantity")


@query("semi_anti_coverage", """
select (select count(distinct o_custkey) from orders where o_custkey in (select c_custkey from customer)) as in_both,
       (select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)) as left_only,
       (select count(distinct c_custkey) from customer where c_custkey not in (select o_custkey from orders)) as right_only
""")
def semi_anti_coverage(spark, folder):
    return keys.key_coverage(table(spark, folder, "orders"), table(spark, folder, "customer"), "o_custkey", "c_custkey")


@query("collated_coverage", with_tables("""
select count(case when a.k is not null and b.k is not null then 1 end) as in_both, count(case when b.k is null then 1 end) as left_only,
       count(case when a.k is null then 1 end) as right_only
from (select distinct lower(c_name) as k from customer) a full outer join (select distinct lower(name) as k from upper_names) b on a.k = b.k
""", upper_names="select upper(c_name) as name from customer where c_custkey % 50 <> 1"))
def collated_coverage(spark, folder):
    """Keys that differ only in case are the same key."""
    names = X.derive(spark, folder, "select upper(c_name) as name from customer where c_custkey % 50 <> 1")
    return keys.key_coverage(table(spark, folder, "customer"), names, "c_name", "name")


@query("source_attribution", with_tables("""
select source, cast(count(case when held then 1 end) as bigint) as with_match, cast(count(case when not held then 1 end) as bigint) as without_match from (
  select 'part0' as source, sysrefno in (select sysref from old where l_orderkey % 3 = 0) as held from new
  union all select 'part1', sysrefno in (select sysref from old where l_orderkey % 3 = 1) from new
  union all select 'rest', sysrefno in (select sysref from old where l_orderkey % 3 = 2) from new
) t group by source
""", old=X.F2_OLD, new=X.F2B_NEW))
def source_attribution(spark, folder):
    old = X.derive(spark, folder, X.F2_OLD)
    sources = {n: (old.filter(f"l_orderkey % 3 = {i}"), "sysref") for i, n in enumerate(["part0", "part1", "rest"])}
    return keys.source_attribution(X.derive(spark, folder, X.F2B_NEW), "sysrefno", sources)


@query("codes_reaching_target", f2b("""
select affectcode as code, count(case when found then 1 end) as reached, count(case when not found then 1 end) as lost from (
  select a.affectcode, b.k is not null as found from (select distinct sysref as k, affectcode from old) a
  left join (select distinct sysrefno as k, affectcode from new) b on a.k = b.k and a.affectcode = b.affectcode
) t group by affectcode
"""))
def codes_reaching_target(spark, folder):
    return keys.codes_reaching_target(X.derive(spark, folder, X.F2_OLD), X.derive(spark, folder, X.F2B_NEW), "sysref", "sysrefno", "affectcode")


def routes(df):
    return {n: (F.col("affectcode") == c) & (F.col("debitcredit") == d) for c, d, n in ROUTES}


ROUTED = ", ".join(
    f"cast(coalesce(sum(case when affectcode = '{c}' and debitcredit = '{d}' then cast(transactionamount as decimal(18,2)) end), 0) as decimal(18,2)) as {n}"
    for c, d, n in ROUTES
)


@query("routing_totals", with_tables(f"select {ROUTED} from old", old=X.F2_OLD))
def routing_totals(spark, folder):
    old = X.derive(spark, folder, X.F2_OLD)
    totals = keys.routed_totals(old, routes(old), to_number(F.col("transactionamount")))
    return totals.select(*[F.col(c).cast("decimal(18,2)").alias(c) for c in totals.columns])


@query("routing_differences", with_tables(
    " union all ".join(
        f"select coalesce(o.sysref, n.sysref) as sysref, '{n}' as route, cast(coalesce(o.{n}, 0) as decimal(18,2)) as old_total, cast(coalesce(n.{n}, 0) as decimal(18,2)) as new_total "
        f"from o full outer join new n on o.sysref = n.sysref where abs(coalesce(o.{n}, 0) - coalesce(n.{n}, 0)) > 0.01" for _, _, n in ROUTES),
    old=X.F2_OLD, new=X.F2_NEW, o=f"select sysref, {ROUTED} from old group by sysref"))
def routing_differences(spark, folder):
    old, new = X.derive(spark, folder, X.F2_OLD), X.derive(spark, folder, X.F2_NEW)
    names = [n for _, _, n in ROUTES]
    totals = keys.routed_totals(old, routes(old), to_number(F.col("transactionamount")), ["sysref"])
    found = keys.routed_differences(totals, new, ["sysref"], names, 0.01)
    return found.select("sysref", "route", F.col("old_total").cast("decimal(18,2)").alias("old_total"), F.col("new_total").cast("decimal(18,2)").alias("new_total"))


@query("multi_row_groups", with_tables("""
select sysref as key, count(*) as n_rows, count(distinct debitcredit) as n_codes, cast(sum(cast(transactionamount as decimal(18,2))) as decimal(18,2)) as total
from old group by sysref having count(*) > 1 and count(distinct debitcredit) > 1
""", old=X.F2_OLD))
def multi_row_groups(spark, folder):
    found = keys.multi_row_groups(X.derive(spark, folder, X.F2_OLD), "sysref", "debitcredit", "transactionamount")
    return found.select("key", "n_rows", "n_codes", F.col("total").cast("decimal(18,2)").alias("total"))


@query("distinct_counts", "select count(*) as n_rows, count(distinct l_orderkey) as n_l_orderkey, count(distinct l_suppkey) as n_l_suppkey from lineitem")
def distinct_counts(spark, folder):
    return keys.distinct_counts(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey")


DERIVED = f"""
select sysref, debit_a, credit_a, debit_n, credit_n,
       debit_a - credit_a + case when sysref like '%77' then 5.00 else 0.00 end as format_a,
       debit_n + credit_n + case when sysref like '%55' then 0.004 else 0.000 end as total_n from ({X.F2_NEW}) w
"""


@query("derived_column_check", with_tables("""
select sysref, 'format_a' as column_name from d where abs(debit_a - credit_a - format_a) > 0.01
union all select sysref, 'total_n' from d where abs(debit_n + credit_n - total_n) > 0.01
""", d=DERIVED))
def derived_column_check(spark, folder):
    d = X.derive(spark, folder, DERIVED)
    number = lambda c: number_of(d, c)
    a = keys.derived_column_errors(d, number("debit_a") - number("credit_a"), "format_a", 0.01)
    b = keys.derived_column_errors(d, number("debit_n") + number("credit_n"), "total_n", 0.01)
    return a.select("sysref", F.lit("format_a").alias("column_name")).unionByName(b.select("sysref", F.lit("total_n").alias("column_name")))
