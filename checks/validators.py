"""Queries of the validators: group, row, composite, several sources, containment, pivot."""

from __future__ import annotations

from dataclasses import replace


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from checks.catalog import ORACLES, plain, query, with_tables
from concord.operators import report
from concord.operators.fingerprint_diff import fingerprint_gaps
from concord.operators.keys import sums_by_code
from concord.plans.common import duplicate_keys
from concord.plans.master import RowComparison
from concord.plans.outcome import Outcome
from concord.plans.validate import validate
from concord.rules import (
    AccountMapping, Action, CompositeKey, Concat, DefRule, Exact, FilteredSum, Formula, Grouping, Mappings,
    Pivot, PivotConfig, RowFilter, Rule, Split, Subset, Transformed, Trigger,
)
from concord.sources.tables import resolver

ROUTES = [
    ("A", "C", "credit_a"), ("A", "D", "debit_a"), ("N", "C", "credit_n"),
    ("N", "D", "debit_n"), ("R", "C", "credit_r"), ("R", "D", "debit_r"),
]
WIDE = tuple(column for _, _, column in ROUTES)
TELLER_PATTERN = r"^\d+$|^\*|^CONV$|^PLAN"
KEYS = Grouping("sysref", "sysref")
LONG_KEYS = Grouping("sysref", "sysrefno")


def run(spark: SparkSession, folder: str, rule: Rule, **tables: str) -> Outcome:
    return validate(rule, resolver(spark, {name: X.derive(spark, folder, sql) for name, sql in tables.items()}))


def wide_rule(mappings: Mappings, defs: tuple[DefRule, ...] = (), **more) -> Rule:
    return Rule("wide", "TRANSACTION", "old", "new", mappings, grouping=KEYS, tolerance=0.01, tolerance_set=True,
                defs=defs, skip_aggregate_sum_check=True, **more)


def long_rule(mappings: Mappings, defs: tuple[DefRule, ...] = (), fingerprint=(), **more) -> Rule:
    grouping = Grouping("sysref", "sysrefno", row_fingerprint=fingerprint)
    return Rule("long", "TRANSACTION", "old", "new", mappings, grouping=grouping, tolerance=0.01, tolerance_set=True,
                defs=defs, skip_aggregate_sum_check=True, **more)


def wide(spark, folder, rule: Rule) -> Outcome:
    return run(spark, folder, rule, old=X.F2_OLD, new=X.F2_NEW)


def long(spark, folder, rule: Rule) -> Outcome:
    return run(spark, folder, rule, old=X.F2_OLD, new=X.F2B_NEW)


def mismatches(outcome: Outcome) -> DataFrame:
    return outcome.errors.filter("error_type = 'VALUE_MISMATCH'").select(
        "group_key", "old_column", "new_column", "old_value", "new_value"
    )


FILTERED = Mappings(filtered_sum=tuple(
    FilteredSum("transactionamount", column, RowFilter((code,), side)) for code, side, column in ROUTES
))

# ---- SQL building blocks --------------------------------------------------------------------------

OLD_SUMS = """
select sysref, count(*) as n_old, sum(cast(transactionamount as decimal(28,8))) as amount,
       sum(cast(quantity as decimal(28,8))) as quantity, {routes}
from old group by sysref
""".format(routes=", ".join(
    f"coalesce(sum(case when affectcode = '{c}' and debitcredit = '{d}' then cast(transactionamount as decimal(28,8)) end), 0) as o_{n}"
    for c, d, n in ROUTES
))


def f2(body: str, **more: str) -> str:
    return with_tables(body, old=X.F2_OLD, new=X.F2_NEW, o=OLD_SUMS, **more)


def f2b(body: str, **more: str) -> str:
    return with_tables(body, old=X.F2_OLD, new=X.F2B_NEW, **more)


FILTERED_SQL = " union all ".join(
    f"select sysref as group_key, 'transactionamount[affectcode in [{c}],dc={d}]' as old_column, '{n}' as new_column, "
    f"{plain('o_' + n)} as old_value, {plain('new.' + n)} as new_value "
    f"from o join new using (sysref) where abs(o_{n} - new.{n}) > 0.01"
    for c, d, n in ROUTES
)


def counted(number: str, only: str) -> str:
    return f"concat(cast({number} as varchar), ' distinct values, ', cast({only} as varchar), ' only here')"


def set_lists(old_value: str, new_value: str, old_column: str, new_column: str, test: str) -> str:
    """Distinct values per group as sorted lists, and the groups where the test on them holds."""
    return f2b(
        f"select a.k as group_key, '{old_column}' as old_column, '{new_column}' as new_column, "
        f"{counted('a.m', 'a.only_here')} as old_value, {counted('b.m', 'b.only_here')} as new_value from a join b using (k) where {test}",
        v="select coalesce(o.k, n.k) as k, o.v is not null as in_old, n.v is not null as in_new from "
          f"(select distinct sysref as k, {old_value} as v from old) o full outer join (select distinct sysrefno as k, {new_value} as v from new) n on o.k = n.k and o.v = n.v",
        a="select k, count(*) filter (in_old) as m, count(*) filter (in_old and not in_new) as only_here, max(l) as l from v join (" f"select k, string_agg(v, '|' order by v) as l from (select distinct sysref as k, {old_value} as v from old) t group by k) q using (k) group by k",
        b="select k, count(*) filter (in_new) as m, count(*) filter (in_new and not in_old) as only_here, max(l) as l from v join (" f"select k, string_agg(v, '|' order by v) as l from (select distinct sysrefno as k, {new_value} as v from new) t group by k) q using (k) group by k",
    )


# ---- TRANSACTION ----------------------------------------------------------------------------------

@query("txn_filtered_sum", f2(FILTERED_SQL))
def txn_filtered_sum(spark, folder):
    return mismatches(wide(spark, folder, wide_rule(FILTERED)))


@query("txn_filtered_sum_new_filter", f2b("""
select coalesce(a.k, b.k) as group_key,
       'transactionamount[affectcode in [A],dc=C]' as old_column, 'transactionamount' as new_column,
       rtrim(rtrim(cast(coalesce(a.s, 0) as varchar), '0'), '.') as old_value,
       rtrim(rtrim(cast(coalesce(b.s, 0) as varchar), '0'), '.') as new_value
from (select sysref as k, count(case when affectcode = 'A' and debitcredit = 'C' then 1 end) as hits,
             cast(coalesce(sum(case when affectcode = 'A' and debitcredit = 'C' then cast(transactionamount as decimal(28,8)) end), 0) as decimal(28,8)) as s
      from old group by sysref) a
join (select sysrefno as k,
             cast(coalesce(sum(case when affectcode = 'A' and debitcredit = 'C' then cast(transactionamount as decimal(28,8)) end), 0) as decimal(28,8)) as s
      from new group by sysrefno) b on a.k = b.k
where hits > 0 and abs(coalesce(a.s, 0) - coalesce(b.s, 0)) > 0.01
"""))
def txn_filtered_sum_new_filter(spark, folder):
    """Filter on both sides; groups without a matching old row are left alone."""
    test = RowFilter(("A",), "C")
    rule = long_rule(Mappings(filtered_sum=(FilteredSum("transactionamount", "transactionamount", test, test, True),)))
    return mismatches(long(spark, folder, rule))


@query("txn_sum", f2(f"""
select sysref as group_key, 'transactionamount' as old_column, 'transactionamount' as new_column,
       {plain('amount')} as old_value, {plain('new.transactionamount')} as new_value
from o join new using (sysref) where abs(amount - new.transactionamount) > 0.01
union all
select sysref, 'quantity', 'quantity', {plain('o.quantity')}, {plain('new.quantity')}
from o join new using (sysref) where abs(o.quantity - new.quantity) > 0.01
union all
select sysref, 'transactionamount', 'credit_a', {plain('amount')}, {plain('new.credit_a')}
from o join new using (sysref) where abs(amount - new.credit_a) > 0.01
"""))
def txn_sum(spark, folder):
    """Sums per group: equal ones, ones within tolerance, and a wrong mapping that nearly always differs."""
    mappings = Mappings(transformed=(
        Transformed("transactionamount", "transactionamount"), Transformed("quantity", "quantity"),
        Transformed("transactionamount", "credit_a"),
    ))
    return mismatches(wide(spark, folder, wide_rule(mappings)))


SPLIT_SUM = " + ".join(WIDE)


@query("txn_split", f2(f"""
select sysref as group_key, 'transactionamount' as old_column, '{'+'.join(WIDE)}' as new_column,
       {plain('amount')} as old_value, {plain(SPLIT_SUM)} as new_value
from o join new using (sysref) where abs(amount - ({SPLIT_SUM})) > 0.01
"""))
def txn_split(spark, folder):
    return mismatches(wide(spark, folder, wide_rule(Mappings(split=(Split("transactionamount", WIDE, "SUM"),)))))


@query("txn_formula", f2(f"""
select sysref as group_key, 'transactionamount+quantity' as old_column, 'amount_and_quantity' as new_column,
       {plain('amount + o.quantity')} as old_value, {plain('amount_and_quantity')} as new_value
from o join new using (sysref) where abs(amount + o.quantity - amount_and_quantity) > 0.01
union all
select sysref, 'transactionamount-quantity', 'credit_a', {plain('amount - o.quantity')}, {plain('credit_a')}
from o join new using (sysref) where abs(amount - o.quantity - credit_a) > 0.01
"""))
def txn_formula(spark, folder):
    mappings = Mappings(formula=(
        Formula(("transactionamount", "quantity"), "SUM", "amount_and_quantity"),
        Formula(("transactionamount", "quantity"), "SUBTRACT", "credit_a"),
    ))
    return mismatches(wide(spark, folder, wide_rule(mappings)))


@query("txn_exact", set_lists("accountno", "accountno", "accountno", "accountno", "a.l <> b.l"))
def txn_exact(spark, folder):
    return mismatches(long(spark, folder, long_rule(Mappings(exact=(Exact("accountno", "accountno"),)))))


@query("txn_concat", set_lists(
    "concat(affectcode, debitcredit)", "code_side", "affectcode+debitcredit", "code_side", "a.l <> b.l"))
def txn_concat(spark, folder):
    mappings = Mappings(concat=(Concat(("affectcode", "debitcredit"), "code_side"),))
    return mismatches(long(spark, folder, long_rule(mappings)))


@query("txn_subset", set_lists(
    "accountno", "accountno", "accountno", "accountno",
    "exists (select 1 from old x where x.sysref = a.k and not exists "
    "(select 1 from new y where y.sysrefno = x.sysref and y.accountno = x.accountno))"))
def txn_subset(spark, folder):
    return mismatches(long(spark, folder, long_rule(Mappings(subset=(Subset("accountno", "accountno"),)))))


@query("txn_value_differences", f2b("""
select coalesce(a.k, b.k) as group_key, coalesce(a.v, b.v) as value,
       case when b.k is null then 'old_only' else 'new_only' end as side
from (select distinct sysref as k, accountno as v from old) a
full outer join (select distinct sysrefno as k, accountno as v from new) b on a.k = b.k and a.v = b.v
where (a.k is null and b.k in (select sysref from old)) or (b.k is null and a.k in (select sysrefno from new))
"""))
def txn_value_differences(spark, folder):
    """Every differing value, one row each, however large the group."""
    outcome = long(spark, folder, long_rule(Mappings(exact=(Exact("accountno", "accountno"),))))
    return outcome.details["differences"].select(F.col("group_key_1").alias("group_key"), "value", "side")




@query("txn_missing_groups", f2("select sysref as group_key from o where sysref not in (select sysref from new)"))
def txn_missing_groups(spark, folder):
    return wide(spark, folder, wide_rule(FILTERED)).errors.filter("error_type = 'ROW_MISSING'").select("group_key")


@query("txn_extra_groups", f2b("""
select distinct sysrefno as group_key, false as in_source from new where sysrefno not in (select sysref from old)
union all select distinct sysref, true from old where sysref not in (select sysrefno from new)
"""))
def txn_extra_groups(spark, folder):
    outcome = long(spark, folder, long_rule(Mappings(subset=(Subset("affectcode", "affectcode"),))))
    return outcome.errors.filter("error_type = 'ROW_MISSING'").select(
        "group_key", F.col("message").contains("in source but").alias("in_source")
    )


FINGERPRINT_SQL = """
select k as group_key, fp as fingerprint, abs(o - n) as copies,
       case when o > n then 'missing_in_target' else 'extra_in_target' end as side
from (
  select k, fp, cast(sum(o) as bigint) as o, cast(sum(n) as bigint) as n from (
    select sysref as k, concat(affectcode, '|', debitcredit, '|', {old_amount}) as fp, 1 as o, 0 as n from old
    union all
    select sysrefno, concat(affectcode, '|', debitcredit, '|', {new_amount}), 0, 1 from new
  ) u group by k, fp
) c where o <> n
""".format(old_amount=plain("transactionamount"), new_amount=plain("transactionamount"))
FINGERPRINT = (("affectcode", "affectcode", False), ("debitcredit", "debitcredit", False),
               ("transactionamount", "transactionamount", False))


@query("txn_fingerprint", f2b(FINGERPRINT_SQL))
def txn_fingerprint(spark, folder):
    """Multiset difference of rows within groups, all groups."""
    old = X.derive(spark, folder, X.F2_OLD)
    new = X.derive(spark, folder, X.F2B_NEW).withColumnRenamed("sysrefno", "sysref")
    return fingerprint_gaps(old, new, ["sysref"], FINGERPRINT).select(F.col("sysref").alias("group_key"), "fingerprint", "copies", "side")


FAILING_SUMS = """
select a.k from (select sysref as k, sum(cast(transactionamount as decimal(28,8))) as s from old group by sysref) a
join (select sysrefno as k, sum(transactionamount) as s from new group by sysrefno) b on a.k = b.k
where abs(a.s - b.s) > 0.01
"""


@query("txn_fingerprint_failing", f2b(
    f"select group_key, fingerprint, side from ({FINGERPRINT_SQL}) f where group_key in (select k from failing)",
    failing=FAILING_SUMS))
def txn_fingerprint_failing(spark, folder):
    """The same difference as a validator reports it: only for groups whose mapping failed."""
    rule = long_rule(Mappings(transformed=(Transformed("transactionamount", "transactionamount"),)), fingerprint=FINGERPRINT)
    found = long(spark, folder, rule).errors.filter(F.col("message").startswith("[FP]"))
    return found.select(
        "group_key", F.coalesce("old_value", "new_value").alias("fingerprint"),
        F.when(F.col("old_value").isNotNull(), "missing_in_target").otherwise("extra_in_target").alias("side"),
    )


@query("txn_pass_fail", f2b(
    """
select cast(count(*) as bigint) as rows_checked,
       cast(count(case when sysref not in (select k from bad) then 1 end) as bigint) as pass_rows,
       cast(count(case when sysref in (select k from bad) then 1 end) as bigint) as fail_rows
from old
""",
    bad=FAILING_SUMS + " union select sysref from old where sysref not in (select sysrefno from new)"))
def txn_pass_fail(spark, folder):
    rule = long_rule(Mappings(transformed=(Transformed("transactionamount", "transactionamount"),)))
    return long(spark, folder, rule).accounting


# ---- business rules -------------------------------------------------------------------------------

ORDER_RULE = DefRule("def001", (
    Action(
        "ROW_LEVEL_COHESION",
        {
            "a": "SUM(old.transactionamount[affectcode=A][debitcredit=C])", "b": "SUM(new.credit_a)",
            "n": "COUNT(old)", "least": "MIN(new.quantity)", "r": "SUM(old.transactionamount) WHERE affectcode == 'R'",
        },
        "a == b", "credit_a is {b}, expected {a}",
        report_fields={"expected": "a", "found": "b", "gap": "b - a", "rows": "n", "least": "MIN(new.quantity)", "r": "r"},
    ),
))
BOOLEAN_RULE = DefRule("def002", (
    Action(
        "ROW_LEVEL_COHESION",
        {"n": "COUNT(old)", "q": "SUM(old.quantity)", "m": "COUNT(new)", "least": "MIN(old.quantity)"},
        "n <= 5 || (Math.abs(q) < 300 && m > 0) || q / m >= 400 || !(least > 1)", "n={n} q={q}",
    ),
))


@query("def_cohesion", f2("""
select sysref as group_key, 'def001' as def_id from o join new using (sysref) where abs(o_credit_a - credit_a) > 0.01
union all
select sysref, 'def002' from o join new using (sysref) join
  (select sysref, min(cast(quantity as decimal(28,8))) as least from old group by sysref) l using (sysref)
where not (n_old <= 5 or abs(o.quantity) < 300 or o.quantity >= 400 or not least > 1)
"""))
def def_cohesion(spark, folder):
    found = wide(spark, folder, wide_rule(Mappings(), (ORDER_RULE, BOOLEAN_RULE))).errors
    return found.filter("error_type = 'DEFECT_VIOLATION'").select("group_key", "def_id")


@query("def_trigger", f2("""
select sysref as group_key, 'any' as def_id from o join new using (sysref)
where abs(o_credit_a - credit_a) > 0.01 and sysref in (select sysref from old where affectcode in ('A', 'N'))
  and sysref not like 'P000000%'
union all
select sysref, 'all' from o join new using (sysref)
where abs(o_credit_a - credit_a) > 0.01 and sysref in (select sysref from old where affectcode = 'A')
  and sysref in (select sysref from old where affectcode = 'N')
"""))
def def_trigger(spark, folder):
    """Triggers on codes and key prefix; R is not on the code list, so a rule that asks for it never fires."""
    action = ORDER_RULE.actions[0]
    rules = (
        DefRule("any", (action,), Trigger(must_have_any=("A", "N", "R"), groupkey_not_starts_with=("P000000",))),
        DefRule("all", (Action(**{**action.__dict__, "trigger": Trigger(must_have_all=("N",))}),), Trigger(must_have_all=("A",))),
        DefRule("never", (action,), Trigger(must_have_all=("R",))),
    )
    found = wide(spark, folder, wide_rule(Mappings(), rules, known_codes=frozenset({"A", "N"}))).errors
    return found.filter("error_type = 'DEFECT_VIOLATION'").select("group_key", "def_id")


@query("def_report_fields", f2(f"""
select 'wide' as rule, sysref as group_key, {plain('o_credit_a')} as expected, {plain('credit_a')} as found,
       {plain('credit_a - o_credit_a')} as gap, cast(n_old as varchar) as "rows", {plain('new.quantity')} as least,
       {plain('o_credit_r + o_debit_r')} as r
from o join new using (sysref) where abs(o_credit_a - credit_a) > 0.01
"""))
def def_report_fields(spark, folder):
    outcome = wide(spark, folder, wide_rule(Mappings(), (ORDER_RULE,)))
    return report.def_report(outcome.errors, "def001", ["expected", "found", "gap", "rows", "least", "r"])


TELLER_RULE = DefRule("vali001", (Action(
    "FIELD_VALUE_CHECK",
    {"new_col": "tellerid", "old_col": "tellerid", "skip_if_old_equals": "CONV", "fail_if_new_matches": TELLER_PATTERN},
    error_message="teller not converted",
),))


@query("def_field_value", f2b(
    """
select k as group_key, 'vali001' as def_id, cast(coalesce(w.l, 0) as varchar) as old_value, cast(coalesce(b.l, 0) as varchar) as new_value
from counts left join w using (k) left join b using (k) where bad > allowed
""",
    counts=rf"""
select n.k, n.bad, o.allowed from
  (select sysrefno as k, count(case when regexp_matches(tellerid, '{TELLER_PATTERN}') then 1 end) as bad from new group by sysrefno) n
  join (select sysref as k, count(case when tellerid = 'CONV' then 1 end) as allowed from old group by sysref) o on n.k = o.k
""",
    w="select k, count(v) as l from (select distinct sysref as k, tellerid as v from old where tellerid <> 'CONV') t group by k",
    b=rf"select k, count(v) as l from (select distinct sysrefno as k, tellerid as v from new where regexp_matches(tellerid, '{TELLER_PATTERN}')) t group by k",
))
def def_field_value(spark, folder):
    found = long(spark, folder, long_rule(Mappings(), (TELLER_RULE,))).errors
    return found.filter("error_type = 'DEFECT_VIOLATION'").select("group_key", "def_id", "old_value", "new_value")


COUNT_RULE = DefRule("vali002", (Action(
    "ROW_LEVEL_COHESION", {"val_old": "COUNT(old)", "val_new": "COUNT(new)"}, "val_old == val_new", "{val_old} vs {val_new}"),))


@query("def_row_count", f2b("""
select k as group_key, concat(cast(o as varchar), ' vs ', cast(n as varchar)) as message
from (select sysref as k, count(*) as o from old group by sysref) a
join (select sysrefno as k, count(*) as n from new group by sysrefno) b using (k) where o <> n
"""))
def def_row_count(spark, folder):
    """Count-only validation of batch keys."""
    found = long(spark, folder, long_rule(Mappings(), (COUNT_RULE,))).errors
    return found.filter("error_type = 'DEFECT_VIOLATION'").select("group_key", "message")


# ---- MASTER ---------------------------------------------------------------------------------------

MASTER = Rule(
    "orders", "MASTER", "old", "new",
    Mappings(
        exact=(Exact("o_orderstatus", "status"), Exact("custref", "custno", "STRIP_LEADING_ZEROS")),
        transformed=(Transformed("orderdate", "order_day", "DATE_TO_DATETIME"), Transformed("o_totalprice", "totalprice")),
        concat=(Concat(("o_orderstatus", "o_orderpriority"), "label", "/"),),
        split=(Split("o_totalprice", ("totalprice",), "EXACT"),),
        formula=(Formula(("o_custkey", "o_orderkey"), "SUM", "custno"),),
    ),
    old_anchor="o_orderkey", new_anchor="id", tolerance=0.01, tolerance_set=True,
)
MASTER_JOIN = "from old join new on cast(o_orderkey as varchar) = cast(id as varchar)"
MASTER_SQL = f"""
select cast(o_orderkey as varchar) as row_id, 'VALUE_MISMATCH' as error_type, 'o_orderstatus' as old_column, 'status' as new_column,
       o_orderstatus as old_value, status as new_value {MASTER_JOIN} where status is null or lower(o_orderstatus) <> lower(status)
union all
select cast(o_orderkey as varchar), 'VALUE_MISMATCH', 'o_totalprice', 'totalprice', cast(o_totalprice as varchar), cast(totalprice as varchar)
{MASTER_JOIN} where abs(o_totalprice - totalprice) > 0.01
union all
select cast(o_orderkey as varchar), 'VALUE_MISMATCH', 'o_totalprice', 'totalprice', {plain('o_totalprice')}, {plain('totalprice')}
{MASTER_JOIN} where abs(o_totalprice - totalprice) > 0.01
union all
select cast(o_orderkey as varchar), 'VALUE_MISMATCH', 'o_custkey+o_orderkey', 'custno', {plain('o_custkey + o_orderkey')}, {plain('custno')}
{MASTER_JOIN} where abs(o_custkey + o_orderkey - custno) > 0.01
union all
select cast(o_orderkey as varchar), 'ROW_MISSING', null, null, null, null from old where o_orderkey not in (select id from new)
union all
select cast(id as varchar), 'ROW_MISSING', null, null, null, null from new where id not in (select o_orderkey from old)
"""


def master(spark, folder, rule: Rule = MASTER) -> Outcome:
    return run(spark, folder, rule, old=X.F1_OLD, new=X.F1_NEW)


@query("master_compare", with_tables(MASTER_SQL, old=X.F1_OLD, new=X.F1_NEW))
def master_compare(spark, folder):
    return master(spark, folder).errors.filter("row_id is not null").select(
        "row_id", "error_type", "old_column", "new_column", "old_value", "new_value"
    )


@query("master_pass_fail", with_tables(
    f"""
select cast(count(*) as bigint) as rows_checked,
       cast(count(case when cast(o_orderkey as varchar) not in (select row_id from e) then 1 end) as bigint) as pass_rows,
       cast(count(case when cast(o_orderkey as varchar) in (select row_id from e) then 1 end) as bigint) as fail_rows from old
""", old=X.F1_OLD, new=X.F1_NEW, e=MASTER_SQL))
def master_pass_fail(spark, folder):
    return master(spark, folder).accounting


@query("master_reverse", with_tables(
    "select cast(id as varchar) as row_key from new where id not in (select o_orderkey from old)",
    old=X.F1_OLD, new=X.F1_NEW))
def master_reverse(spark, folder):
    comparison = RowComparison(
        X.derive(spark, folder, X.F1_OLD), X.derive(spark, folder, X.F1_NEW), "o_orderkey", "id", Mappings(), set(), 0
    )
    return comparison.extra_keys()


@query("master_counts", with_tables(
    "select (select count(*) from old) as old_rows, (select count(*) from new) as new_rows", old=X.F1_OLD, new=X.F1_NEW))
def master_counts(spark, folder):
    return RowComparison(X.derive(spark, folder, X.F1_OLD), X.derive(spark, folder, X.F1_NEW), "o_orderkey", "id", Mappings(), set(), 0).totals()


@query("dup_keys", "select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def dup_keys(spark, folder):
    return duplicate_keys(X.tables(spark, folder, "lineitem")["lineitem"], "l_orderkey", "l_linenumber")


# ---- composite key --------------------------------------------------------------------------------

COMPOSITE = Rule(
    "composite", "TRANSACTION", "old", "new", Mappings(transformed=(Transformed("transactionamount", "amount"),),
                                                     exact=(Exact("sysref", "sysrefno"), Exact("affectcode", "affectcode"))),
    grouping=Grouping("sysref", "sysrefno", composite_key=CompositeKey(
        "accountno", "lvaccountno", AccountMapping("map", "invaccountno", "newinvaccountno"))),
    tolerance=0.01, tolerance_set=True, skip_aggregate_sum_check=True,
)


def f3(body: str, **more: str) -> str:
    return with_tables(
        body, old=X.F2_OLD, new=X.F3_NEW, map=X.F3_MAP,
        g="""select sysref, accountno, newinvaccountno as lv, count(*) as n, sum(cast(transactionamount as decimal(28,8))) as s,
                    string_agg(distinct affectcode, '|' order by affectcode) as codes, list(distinct affectcode) as vs
             from old left join map on accountno = invaccountno group by sysref, accountno, newinvaccountno""",
        m="""select g.*, new.amount, new.affectcode as code, new.sysrefno as found from g
             left join new on g.sysref = new.sysrefno and g.lv = new.lvaccountno""",
        **more)


def composite(spark, folder) -> Outcome:
    return run(spark, folder, COMPOSITE, old=X.F2_OLD, new=X.F3_NEW, map=X.F3_MAP)


@query("composite_txn", f3(f"""
select concat(sysref, '::', lv) as group_key, 'transactionamount' as old_column, 'amount' as new_column,
       {plain('s')} as old_value, {plain('amount')} as new_value from m where abs(s - amount) > 0.01
union all
select concat(sysref, '::', lv), 'affectcode', 'affectcode',
       {counted('len(vs)', 'len(list_filter(vs, lambda x: x <> code))')}, {counted('1', 'case when list_contains(vs, code) then 0 else 1 end')}
from m where found is not null and codes <> code
"""))
def composite_txn(spark, folder):
    return mismatches(composite(spark, folder))


@query("composite_unmapped", f3("""
select concat(sysref, '::', accountno) as group_key, true as unmapped from m where lv is null
union all select concat(sysref, '::', lv), false from m where lv is not null and found is null
"""))
def composite_unmapped(spark, folder):
    return composite(spark, folder).errors.filter("error_type = 'ROW_MISSING'").select(
        "group_key", F.col("message").startswith("No account mapping").alias("unmapped")
    )


@query("composite_pass_fail", f3("""
select cast(sum(n) as bigint) as rows_checked,
       cast(sum(case when found is not null and abs(s - amount) <= 0.01 and codes = code then n else 0 end) as bigint) as pass_rows,
       cast(sum(case when found is not null and abs(s - amount) <= 0.01 and codes = code then 0 else n end) as bigint) as fail_rows from m
"""))
def composite_pass_fail(spark, folder):
    total = composite(spark, folder).accounting
    return total.agg(*[F.sum(c).alias(c) for c in ("rows_checked", "pass_rows", "fail_rows")])


# ---- several sources ------------------------------------------------------------------------------

# The rows of the legacy table spread over three sources; the second one names its key differently.
PART_0 = f"select * from ({X.F2_OLD}) p where l_orderkey % 3 = 0"
PART_1 = f"select sysref as refno, accountno, affectcode, transactionamount, l_partkey from ({X.F2_OLD}) p where l_orderkey % 3 = 1"
PART_2 = f"select * from ({X.F2_OLD}) p where l_orderkey % 3 = 2"
PARTS = {"old0": PART_0, "old1": PART_1, "old2": PART_2, "new": X.F2B_NEW}
PART_KEYS = Grouping("sysref", "sysrefno", source_key_aliases={"old1": "refno"})


def per_source(kind, *names: str):
    return tuple(kind(*names, source=s) for s in ("old0", "old1", "old2"))


MULTI = Rule(
    "multi", "MULTIPLE", "old0,old1,old2", "new",
    Mappings(exact=per_source(Exact, "accountno", "accountno"),
             transformed=tuple(Transformed("transactionamount", "transactionamount", source=s) for s in ("old0", "old1", "old2"))),
    grouping=PART_KEYS, tolerance=0.01, tolerance_set=True, skip_aggregate_sum_check=True,
)
MULTI_SQL = f"""
select a.k as group_key, 'accountno' as old_column, 'accountno' as new_column,
       {counted('len(a.v)', 'len(list_filter(a.v, lambda x: not list_contains(b.v, x)))')} as old_value,
       {counted('len(b.v)', 'len(list_filter(b.v, lambda x: not list_contains(a.v, x)))')} as new_value
from a join b using (k) where a.l <> b.l
union all
select a.k, 'transactionamount', 'transactionamount', {plain('a.s')}, {plain('b.s')} from a join b using (k) where abs(a.s - b.s) > 0.01
"""
MULTI_CTES = {
    "a": "select sysref as k, string_agg(distinct accountno, '|' order by accountno) as l, list(distinct accountno) as v, sum(cast(transactionamount as decimal(28,8))) as s, count(*) as n from old group by sysref",
    "b": "select sysrefno as k, string_agg(distinct accountno, '|' order by accountno) as l, list(distinct accountno) as v, sum(transactionamount) as s from new group by sysrefno",
}


def multi(spark, folder, rule: Rule = MULTI) -> Outcome:
    return run(spark, folder, rule, **PARTS)


@query("multi_source", f2b(MULTI_SQL, **MULTI_CTES))
def multi_source(spark, folder):
    return mismatches(multi(spark, folder))


@query("multi_source_missing", f2b("""
select k as group_key, true as in_source from a where k not in (select k from b)
union all select k, false from b where k not in (select k from a)
""", **MULTI_CTES))
def multi_source_missing(spark, folder):
    """Groups one side lacks; extras are judged against all sources together."""
    return multi(spark, folder).errors.filter("error_type = 'ROW_MISSING'").select(
        "group_key", F.col("message").contains("in source but").alias("in_source")
    )


@query("multi_source_pass_fail", f2b(
    """
select cast(sum(n) as bigint) as rows_checked,
       cast(sum(case when k in (select k from bad) then 0 else n end) as bigint) as pass_rows,
       cast(sum(case when k in (select k from bad) then n else 0 end) as bigint) as fail_rows from a
""", **MULTI_CTES,
    bad="select k from a where k not in (select k from b) union select a.k from a join b using (k) where a.l <> b.l or abs(a.s - b.s) > 0.01"))
def multi_source_pass_fail(spark, folder):
    total = multi(spark, folder).accounting
    return total.agg(*[F.sum(c).alias(c) for c in ("rows_checked", "pass_rows", "fail_rows")])


ROW_PAIRS = Rule(
    "pairs", "MULTIPLE", "old,cust", "new,custnew",
    Mappings(exact=(Exact("o_orderstatus", "status"), Exact("c_name", "c_name", None, "cust", "custnew"))),
    old_anchor="key", new_anchor="key",
)
PAIR_TABLES = {
    "old": f"select o_orderkey as key, o_orderstatus from ({X.F1_OLD}) p",
    "new": f"select id as key, status from ({X.F1_NEW}) p",
    "cust": "select c_custkey as key, c_name from customer",
    "custnew": "select c_custkey as key, case when c_custkey % 31 = 2 then upper(concat(c_name, 'x')) else upper(c_name) end as c_name from customer where c_custkey % 50 <> 1",
}


@query("multi_row_mode", with_tables("""
select cast(key as varchar) as row_id, 'VALUE_MISMATCH' as error_type, 'status' as new_column from old join new using (key)
where status is null or lower(o_orderstatus) <> lower(status)
union all select cast(key as varchar), 'VALUE_MISMATCH', 'c_name' from cust join custnew using (key) where lower(cust.c_name) <> lower(custnew.c_name)
union all select cast(key as varchar), 'ROW_MISSING', null from old where key not in (select key from new)
union all select cast(key as varchar), 'ROW_MISSING', null from new where key not in (select key from old)
union all select cast(key as varchar), 'ROW_MISSING', null from cust where key not in (select key from custnew)
""", **PAIR_TABLES))
def multi_row_mode(spark, folder):
    found = run(spark, folder, ROW_PAIRS, **PAIR_TABLES).errors.filter("row_id is not null")
    return found.select("row_id", "error_type", "new_column")


UNION_PARTS = {
    **{f"old{i}": f"select sysref, affectcode, transactionamount, debitcredit, l_orderkey * 1000 + l_linenumber as id from ({X.F2_OLD}) p where l_orderkey % 3 = {i}" for i in range(3)},
    "new": f"select sysrefno as sysref, lower(affectcode) as affectcode, transactionamount, debitcredit, l_orderkey * 1000 + l_linenumber as id from ({X.F2B_NEW}) p",
}
UNION = Rule(
    "union", "UNION", "old0,old1,old2", "new",
    Mappings(exact=(Exact("affectcode", "affectcode"), Exact("transactionamount", "transactionamount"))),
    grouping=KEYS, tolerance=0.01, tolerance_set=True, skip_aggregate_sum_check=True,
)
UNION_CTES = {
    "a": "select sysref as k, lower(string_agg(distinct affectcode, '|' order by affectcode)) as l, list(distinct lower(affectcode)) as v, sum(cast(transactionamount as decimal(28,8))) as s, count(*) as n from old group by sysref",
    "b": "select sysrefno as k, lower(string_agg(distinct affectcode, '|' order by affectcode)) as l, list(distinct lower(affectcode)) as v, sum(transactionamount) as s from new group by sysrefno",
}


@query("union_source", f2b(MULTI_SQL.replace("accountno", "affectcode"), **UNION_CTES))
def union_source(spark, folder):
    return mismatches(run(spark, folder, UNION, **UNION_PARTS))


FIRST_ROWS = Rule(
    "first", "UNION", "old", "new",
    Mappings(transformed=(Transformed("o_orderstatus", "status"), Transformed("orderdate", "order_day", "DATE_TO_DATETIME"))),
    old_anchor="o_orderkey", new_anchor="id", grouping=Grouping("o_custkey", "custno"),
)


@query("union_first_row", with_tables(
    """
select cast(a.k as varchar) as group_key, 'o_orderstatus' as old_column, 'status' as new_column, a.o_orderstatus as old_value, b.status as new_value
from a join b using (k) where status is null or lower(o_orderstatus) <> lower(status)
union all
select cast(a.k as varchar), 'orderdate', 'order_day', a.orderdate, b.order_day from a join b using (k)
where concat(substr(a.orderdate, 7, 4), '-', substr(a.orderdate, 4, 2), '-', substr(a.orderdate, 1, 2)) <> b.order_day
""", old=X.F1_OLD, new=X.F1_NEW,
    a="select o_custkey as k, o_orderstatus, orderdate from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from old) t where rn = 1",
    b="select custno as k, status, order_day from (select *, row_number() over (partition by custno order by id) as rn from new) t where rn = 1"))
def union_first_row(spark, folder):
    """Transformed mappings of a union compare the first row of each group."""
    return mismatches(run(spark, folder, FIRST_ROWS, old=X.F1_OLD, new=X.F1_NEW))


# ---- containment and pivot ------------------------------------------------------------------------

SPLIT = Rule("contained", "SPLIT", "old", "new", Mappings(exact=(Exact("custkey", "custno"),)), old_anchor="o_orderkey")


@query("split_containment", with_tables("""
select custkey as old_value, cast(null as varchar) as new_value from (select distinct custkey from old) a where custkey not in (select custno from new)
union all select null, custno from (select distinct custno from new) b where custno not in (select custkey from old)
""", old=X.F6_OLD, new=X.F6_NEW))
def split_containment(spark, folder):
    found = run(spark, folder, SPLIT, old=X.F6_OLD, new=X.F6_NEW).errors
    return found.filter("error_type = 'ROW_MISSING'").select("old_value", "new_value")


@query("split_pass_fail", with_tables("""
select cast(count(*) as bigint) as rows_checked, cast(count(case when custkey in (select custno from new) then 1 end) as bigint) as pass_rows,
       cast(count(case when custkey not in (select custno from new) then 1 end) as bigint) as fail_rows from old
""", old=X.F6_OLD, new=X.F6_NEW))
def split_pass_fail(spark, folder):
    return run(spark, folder, SPLIT, old=X.F6_OLD, new=X.F6_NEW).accounting


TYPES = ["click", "view", "error", "signup", "purchase"]
HEADER = Rule(
    "header", "HEADER", "old", "new", Mappings(pivot=tuple(Pivot(t, "v", f"{t}_value") for t in TYPES)),
    pivot=PivotConfig("user_id", "user_id", "event_type"), tolerance=0.01, tolerance_set=True,
)
HEADER_CTES = {
    "old": X.F5_LONG, "new": X.F5_WIDE,
    "p": "select user_id, " + ", ".join(f"sum(case when event_type = '{t}' then v end) as {t}" for t in TYPES) + " from old group by user_id",
    # Nulls last on every column, so the kept row is the one with values.
    "w": "select * from (select *, row_number() over (partition by user_id order by "
         + ", ".join(f"{t}_value asc nulls last" for t in TYPES) + ") as rn, count(*) over (partition by user_id) as n from new) t where rn = 1",
}
HEADER_SQL = " union all ".join(
    f"select cast(user_id as varchar) as row_id, 'VALUE_MISMATCH' as error_type, '{t}_value' as new_column from p join w using (user_id) "
    f"where abs({t} - {t}_value) > 0.01 or ({t} is null) <> ({t}_value is null)" for t in TYPES
) + """
union all select cast(user_id as varchar), 'TRANSFORM_ERROR', null from w where n > 1
union all select cast(user_id as varchar), 'ROW_MISSING', null from p where user_id not in (select user_id from w)
union all select cast(user_id as varchar), 'ROW_MISSING', null from w where user_id not in (select user_id from p)
"""


@query("header_pivot", with_tables(HEADER_SQL, **HEADER_CTES))
def header_pivot(spark, folder):
    found = run(spark, folder, HEADER, old=X.F5_LONG, new=X.F5_WIDE).errors
    return found.select("row_id", "error_type", "new_column")


@query("header_pass_fail", with_tables(
    """
select cast(count(*) as bigint) as rows_checked, cast(count(case when cast(user_id as varchar) not in (select row_id from e) then 1 end) as bigint) as pass_rows,
       cast(count(case when cast(user_id as varchar) in (select row_id from e) then 1 end) as bigint) as fail_rows from old
""", **HEADER_CTES, e=HEADER_SQL))
def header_pass_fail(spark, folder):
    return run(spark, folder, HEADER, old=X.F5_LONG, new=X.F5_WIDE).accounting


# ---- totals ---------------------------------------------------------------------------------------

CODE_SUMS = """
select coalesce(a.c, b.c) as code, cast(coalesce(a.s, 0) as decimal(18,2)) as old_total, cast(coalesce(b.s, 0) as decimal(18,2)) as new_total,
       abs(coalesce(a.s, 0) - coalesce(b.s, 0)) > 0.01 as mismatch
from (select affectcode as c, sum(cast(transactionamount as decimal(18,2))) as s from old group by affectcode) a
full outer join (select affectcode as c, sum(transactionamount) as s from new group by affectcode) b on a.c = b.c
"""


@query("agg_sum_by_code", f2b(CODE_SUMS))
def agg_sum_by_code(spark, folder):
    old, new = X.derive(spark, folder, X.F2_OLD), X.derive(spark, folder, X.F2B_NEW)
    sums = sums_by_code([(old, "affectcode", "transactionamount")], (new, "affectcode", "transactionamount"), 0.01)
    return sums.select("code", F.col("old_total").cast("decimal(18,2)").alias("old_total"),
                       F.col("new_total").cast("decimal(18,2)").alias("new_total"), "mismatch")


@query("agg_cross_check", f2b(f"select concat('SUM(transactionamount) WHERE affectcode=''', code, '''') as old_column from ({CODE_SUMS}) t where mismatch"))
def agg_cross_check(spark, folder):
    """The totals check a grouped validation adds by itself."""
    rule = long_rule(Mappings(exact=(Exact("transactionamount", "transactionamount"),)))
    found = long(spark, folder, Rule(**{**rule.__dict__, "skip_aggregate_sum_check": False})).errors
    return found.filter(F.col("message").startswith("[AGGREGATE]")).select("old_column")


@query("crosscheck_targets", with_tables(f"""
select sysref as group_key, 'credit_a-debit_a' as old_column, 'bill_a' as new_column, {plain('credit_a - debit_a')} as old_value, {plain('bill_a')} as new_value
from new join bill using (sysref) where abs(credit_a - debit_a - bill_a) > 0.01
""", new=X.F2_NEW, bill=f"select sysref, affected as bill_a from (select sysref, sum(case when affectcode = 'A' and debitcredit = 'C' then cast(transactionamount as decimal(18,2)) when affectcode = 'A' then -cast(transactionamount as decimal(18,2)) else 0 end) as affected from ({X.F2_OLD}) b group by sysref) t"))
def crosscheck_targets(spark, folder):
    """Two target tables against each other, one of them in the role of the source."""
    bill = f"""select sysref, sum(case when affectcode = 'A' and debitcredit = 'C' then cast(transactionamount as decimal(18,2))
                when affectcode = 'A' then -cast(transactionamount as decimal(18,2)) else 0 end) as bill_a from ({X.F2_OLD}) b group by sysref"""
    rule = Rule("cross", "TRANSACTION", "new", "bill", Mappings(formula=(Formula(("credit_a", "debit_a"), "SUBTRACT", "bill_a"),)),
                grouping=KEYS, tolerance=0.01, tolerance_set=True, skip_aggregate_sum_check=True)
    return mismatches(run(spark, folder, rule, new=X.F2_NEW, bill=bill))


# ---- reports --------------------------------------------------------------------------------------

FULL = long_rule(Mappings(transformed=(Transformed("transactionamount", "transactionamount"),)), (COUNT_RULE,))
BREAKDOWN_CTES = {
    "a": "select sysref as k, sum(cast(transactionamount as decimal(28,8))) as s, count(*) as n from old group by sysref",
    "b": "select sysrefno as k, sum(transactionamount) as s, count(*) as n from new group by sysrefno",
    "e": """
select 'VALUE_MISMATCH' as error_type, cast(null as varchar) as def_id, a.k, a.n from a join b using (k) where abs(a.s - b.s) > 0.01
union all select 'DEFECT_VIOLATION', 'vali002', a.k, a.n from a join b using (k) where a.n <> b.n
union all select 'ROW_MISSING', null, k, n from a where k not in (select k from b)
union all select 'ROW_MISSING', null, k, 0 from b where k not in (select k from a)
union all select 'DATA_MISSING', null, null, 0 union all select 'DATA_MISSING', null, null, 0
""",
}


@query("error_breakdown", f2b('select error_type, def_id, count(*) as "count" from e group by error_type, def_id', **BREAKDOWN_CTES))
def error_breakdown(spark, folder):
    return report.breakdown(long(spark, folder, FULL).errors).select("error_type", "def_id", "count")


@query("summary_report", f2b(
    """
select 'long' as rule, 'FAIL' as status, cast((select count(*) from old) as bigint) as rows_checked,
       cast((select count(*) from old where sysref not in (select k from e where k is not null)) as bigint) as "pass",
       cast((select count(*) from old where sysref in (select k from e where k is not null)) as bigint) as fail,
       cast(0 as bigint) as skipped, cast(count(*) as bigint) as total_errors,
       cast(count(case when error_type like '%MISSING' then 1 end) as bigint) as missing from e
""", **BREAKDOWN_CTES))
def summary_report(spark, folder):
    return report.summary([long(spark, folder, FULL)]).select(
        "rule", "status", "rows_checked", "pass", "fail", "skipped", "total_errors", "missing")


SAME = Rule("same", "TRANSACTION", "old", "old", Mappings(transformed=(Transformed("transactionamount", "transactionamount"),),
            exact=tuple(Exact(c, c) for c in ("affectcode", "debitcredit", "loantranshostcode", "accountno", "quantity", "tellerid",
                                              "l_orderkey", "l_partkey", "l_linenumber"))),
            grouping=KEYS)


@query("summary_overall", f2b("""
select cast(2 as bigint) as total_tables, cast(case when (select count(*) from e) = 0 then 2 else 1 end as bigint) as overall_pass,
       cast(case when (select count(*) from e) = 0 then 0 else 1 end as bigint) as overall_fail
""", **BREAKDOWN_CTES))
def summary_overall(spark, folder):
    """A table compared with itself passes, a defective one fails."""
    return report.overall(report.summary([long(spark, folder, FULL), run(spark, folder, SAME, old=X.F2_OLD)]))


# ---- rules that break, balance and associate ------------------------------------------------------

BROKEN_RULE = DefRule("broken", (Action("ROW_LEVEL_COHESION", {"a": "COUNT(old)"}, "a === (", "never"),))
# A ledger of its own: the six routed columns of a target row add up to its amount.
BALANCE_RULE = DefRule("balance", (Action(
    "ROW_LEVEL_COHESION", {"total": "SUM(new.transactionamount)", **{c: f"SUM(new.{c})" for c in WIDE}}, " + ".join(WIDE) + " == total", "{total}"),))
# Debits are turned round: what the legacy table holds as a debit stands on the debit side alone.
SIGN_RULE = DefRule("sign", (Action(
    "ROW_LEVEL_COHESION",
    {"gave": "SUM(old.transactionamount[debitcredit=D])", "took": "SUM(old.transactionamount[debitcredit=C])",
     **{c: f"SUM(new.{c})" for c in WIDE}},
    "took - gave == " + " + ".join(c for c in WIDE if c.startswith("credit")) + " - " + " - ".join(c for c in WIDE if c.startswith("debit")), "{took} {gave}"),))


@query("def_broken_rule", f2b("""
select 'DEFECT_VIOLATION' as error_type, 'vali002' as def_id, k as group_key
from (select sysref as k, count(*) as o from old group by sysref) a join (select sysrefno as k, count(*) as n from new group by sysrefno) b using (k) where o <> n
union all select 'TRANSFORM_ERROR', 'broken', null
"""))
def def_broken_rule(spark, folder):
    """A rule that cannot be read is one error; the other rule goes on."""
    found = long(spark, folder, long_rule(Mappings(), (BROKEN_RULE, COUNT_RULE))).errors
    return found.filter("error_type in ('DEFECT_VIOLATION', 'TRANSFORM_ERROR')").select("error_type", "def_id", "group_key")


@query("def_ledger", f2(f"""
select sysref as group_key, 'balance' as def_id from new join o using (sysref) where abs({' + '.join(WIDE)} - transactionamount) > 0.01
union all
select sysref, 'sign' from new join
  (select sysref, sum(case when debitcredit = 'C' then cast(transactionamount as decimal(28,8)) else 0 end) - sum(case when debitcredit = 'D' then cast(transactionamount as decimal(28,8)) else 0 end) as net from old group by sysref) l
  using (sysref) where abs(net - ({' + '.join(c for c in WIDE if c.startswith('credit'))} - {' - '.join(c for c in WIDE if c.startswith('debit'))})) > 0.01
"""))
def def_ledger(spark, folder):
    """Rules about a ledger's own balance and its signs."""
    found = wide(spark, folder, wide_rule(Mappings(), (BALANCE_RULE, SIGN_RULE))).errors
    return found.filter("error_type = 'DEFECT_VIOLATION'").select("group_key", "def_id")


@query("associate_compare", ORACLES["master_compare"])
def associate_compare(spark, folder):
    """ASSOCIATE tables are held against each other as MASTER tables are."""
    return master(spark, folder, replace(MASTER, table_type="ASSOCIATE")).errors.filter("row_id is not null").select(
        "row_id", "error_type", "old_column", "new_column", "old_value", "new_value")


# Two columns that no mapping names, with nearly the same name; some rows differ in them.
NEAR_OLD = "select o_orderkey as key_no, o_custkey as customer, o_orderstatus as order_status_code, o_orderpriority as left_alone from orders"
NEAR_NEW = "select o_orderkey as key_no, o_custkey as customer, case when o_orderkey % 29 = 4 then concat(o_orderstatus, 'x') else lower(o_orderstatus) end as order_statuscode, 1 as another from orders"
NEAR = Rule("near", "MASTER", "old", "new", Mappings(exact=(Exact("customer", "customer"),)), old_anchor="key_no", new_anchor="key_no")


@query("master_fallback", with_tables("""
select cast(key_no as varchar) as row_id, 'VALUE_MISMATCH' as error_type, 'order_status_code' as old_column, 'order_statuscode' as new_column, cast(null as varchar) as message
from old join new using (key_no) where lower(order_status_code) <> lower(order_statuscode)
union all select null, 'DATA_MISSING', null, null, 'Source [old] has 2 unmapped column(s): order_status_code, left_alone' from (select count(*) as n from old) t
union all select null, 'DATA_MISSING', null, null, 'Target [new] has 2 unmapped column(s): order_statuscode, another' from (select count(*) as n from new) t
""", old=NEAR_OLD, new=NEAR_NEW))
def master_fallback(spark, folder):
    """What a validator returns about columns no mapping names: reported, and compared where the names are alike."""
    found = run(spark, folder, NEAR, old=NEAR_OLD, new=NEAR_NEW).errors
    return found.select("row_id", "error_type", "old_column", "new_column", F.when(F.col("error_type") == "DATA_MISSING", F.col("message")).alias("message"))


LOST = Rule("lost", "TRANSACTION", "old", "new", Mappings(
    exact=(Exact("affectcode", "affectcode"), Exact("branch", "affectcode"), Exact("tellerid", "teller_name")),
    transformed=(Transformed("transactionamount", "transactionamount"),)), grouping=Grouping("sysref", "sysrefno"), tolerance=0.01, tolerance_set=True, skip_aggregate_sum_check=True)


@query("missing_columns_reported", f2b("""
select 'COLUMN_MISSING' as error_type, 'branch' as old_column, cast(null as varchar) as new_column, count(distinct 1) as n from old
union all select 'COLUMN_MISSING', null, 'teller_name', count(distinct 1) from new
union all select 'VALUE_MISMATCH', 'transactionamount', 'transactionamount', count(*) from (select sysref as k, sum(cast(transactionamount as decimal(28,8))) as s from old group by 1) a
  join (select sysrefno as k, sum(transactionamount) as s from new group by 1) b using (k) where abs(a.s - b.s) > 0.01 having count(*) > 0
"""))
def missing_columns_reported(spark, folder):
    """A validator reports mapped columns that are not there and goes on with the other mappings."""
    found = long(spark, folder, LOST).errors.filter("error_type = 'COLUMN_MISSING' or new_column = 'transactionamount'")
    return found.groupBy("error_type", "old_column", "new_column").agg(F.count(F.lit(1)).alias("n"))
