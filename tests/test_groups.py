"""Group comparison on literal rows: deliberate rules, worked examples, invariants."""

import pytest
from pyspark.sql import functions as F

from concord.functions.numbers import number_text_of
from concord.operators import defects
from concord.operators.defects import RuleError, condition_sql
from concord.operators.fingerprint_diff import multisets_hash
from concord.operators.sides import Side
from concord.plans.validate import validate
from concord.rules import (
    AccountMapping, Action, CompositeKey, Concat, DefRule, Exact, FilteredSum, Formula, Grouping, Mappings, RowFilter, Rule,
    Split, Subset, Transformed, Trigger, rule_from,
)
from concord.sources.tables import resolver

OLD = "k string, affectcode string, debitcredit string, amount string, note string"


ONE = "distinct values, 1 only here"


def check(spark, old, new, mappings=Mappings(), defs=(), grouping=Grouping("k", "k"), **more):
    rule = Rule("r", "TRANSACTION", "old", "new", mappings, grouping=grouping, tolerance=more.pop("tolerance", 0.01),
                skip_aggregate_sum_check=True, defs=tuple(defs), **more)
    return validate(rule, resolver(spark, {"old": old, "new": new}))


def found(outcome, *types):
    rows = outcome.errors.filter(F.col("error_type").isin(*types) if types else F.lit(True)).collect()
    return sorted((r.group_key, r.old_column, r.old_value, r.new_value) for r in rows)


def rows(spark, data, schema=OLD):
    return spark.createDataFrame(data, schema)


def test_text_that_is_no_number_voids_a_sum(spark):
    old = rows(spark, [("a", "PP", "C", "1", None), ("a", "PP", "C", "x", None), ("b", "PP", "C", "1", None), ("b", "PP", "C", None, None), ("c", "PP", "C", "", None)])
    new = rows(spark, [("a", 5.0), ("b", 5.0), ("c", 5.0)], "k string, amount double")
    outcome = check(spark, old, new, Mappings(transformed=(Transformed("amount", "amount"),)))
    assert found(outcome, "VALUE_MISMATCH") == [("b", "amount", "1", "5")]


def test_filtered_sum_counts_a_voided_sum_as_zero(spark):
    old = rows(spark, [("a", "PP", "C", "x", None), ("b", "QQ", "C", "1", None)])
    new = rows(spark, [("a", 0.0), ("b", 3.0)], "k string, amount double")
    wanted = FilteredSum("amount", "amount", RowFilter(("PP",), "C"))
    assert found(check(spark, old, new, Mappings(filtered_sum=(wanted,))), "VALUE_MISMATCH") == [
        ("b", "amount[affectcode in [PP],dc=C]", "0", "3")]
    skipping = FilteredSum("amount", "amount", RowFilter(("PP",), "C"), None, True)
    assert found(check(spark, old, new, Mappings(filtered_sum=(skipping,))), "VALUE_MISMATCH") == []


def test_host_code_filters(spark):
    schema = "k string, loantranshostcode string, amount string"
    old = rows(spark, [("a", "1", "10"), ("a", "2", "20"), ("a", None, "40")], schema)
    new = rows(spark, [("a", 60.0)], "k string, amount double")
    for row_filter, total in ((RowFilter(loantranshostcode_not_in=("1",)), "60"), (RowFilter(loantranshostcode_in=("1", "2")), "30")):
        outcome = check(spark, old, new, Mappings(filtered_sum=(FilteredSum("amount", "amount", row_filter),)))
        assert [r[2] for r in found(outcome, "VALUE_MISMATCH")] == ([] if total == "60" else [total])


def test_exact_sets_ignore_blanks_and_number_spelling(spark):
    old = rows(spark, [("a", "", "", ".8", "x"), ("a", "", "", "", "y"), ("b", "", "", "1", "x"), ("c", "", "", "1", None)])
    new = rows(spark, [("a", "0.80", "y"), ("a", "0.8", "x"), ("b", "1", "z"), ("c", "1", "q")], "k string, amount string, note string")
    outcome = check(spark, old, new, Mappings(exact=(Exact("amount", "amount"), Exact("note", "note"))))
    # The blank side of group c skips the check.
    assert found(outcome, "VALUE_MISMATCH") == [("b", "note", f"1 {ONE}", f"1 {ONE}")]


def test_blank_as_zero_option(spark):
    old = rows(spark, [("a", "", "", "", "x"), ("b", "", "", "5", "y")])
    new = rows(spark, [("a", "7"), ("b", "5")], "k string, amount string")
    mapping = Mappings(exact=(Exact("amount", "amount"),))
    assert found(check(spark, old, new, mapping), "VALUE_MISMATCH") == []
    assert found(check(spark, old, new, mapping, blank_as_zero=True), "VALUE_MISMATCH") == [("a", "amount", f"1 {ONE}", f"1 {ONE}")]


def test_date_transform_compares_days(spark):
    old = spark.createDataFrame([("a", "5/2/2021"), ("b", "2021-02-05T00:00:00.000Z")], "k string, d string")
    new = spark.sql("select 'a' as k, timestamp'2021-02-05 00:00:00' as d union all select 'b', timestamp'2021-02-06 00:00:00'")
    outcome = check(spark, old, new, Mappings(transformed=(Transformed("d", "d", "DATE_TO_DATETIME"),)))
    assert found(outcome, "VALUE_MISMATCH") == [("b", "d", f"1 {ONE}", f"1 {ONE}")]


def test_concat_keeps_blanks_and_subset_allows_more(spark):
    old = rows(spark, [("a", "P", None, "1", "x"), ("b", "P", "D", "1", "x")])
    new = rows(spark, [("a", "P-", "x"), ("a", "P-", "more"), ("b", "PD", "more")], "k string, joined string, note string")
    outcome = check(spark, old, new, Mappings(concat=(Concat(("affectcode", "debitcredit"), "joined", "-"),), subset=(Subset("note", "note"),)))
    assert found(outcome, "VALUE_MISMATCH") == [
        ("b", "affectcode+debitcredit", f"1 {ONE}", f"1 {ONE}"), ("b", "note", f"1 {ONE}", f"1 {ONE}")]
    assert {(r.mapping, r.value, r.side) for r in outcome.details["differences"].collect()} == {
        ("affectcode+debitcredit->joined", "P-D", "old_only"), ("affectcode+debitcredit->joined", "PD", "new_only"), ("note->note", "x", "old_only")}


def test_all_values_of_a_large_group_are_given(spark):
    old = spark.range(5000).selectExpr("'hot' as k", "concat('v', id) as note")
    new = spark.range(3, 5003).selectExpr("'hot' as k", "concat('v', id) as note")
    outcome = check(spark, old, new, Mappings(exact=(Exact("note", "note"),)))
    assert found(outcome, "VALUE_MISMATCH") == [("hot", "note", "5000 distinct values, 3 only here", "5000 distinct values, 3 only here")]
    assert sorted((r.value, r.side) for r in outcome.details["differences"].collect()) == [
        ("v0", "old_only"), ("v1", "old_only"), ("v2", "old_only"), ("v5000", "new_only"), ("v5001", "new_only"), ("v5002", "new_only")]


def test_missing_columns_do_not_stop_the_rest(spark):
    # An amount of 1 alone would be a column of 0/1 values, which is not compared.
    old = rows(spark, [("a", "PP", "C", "3", "x")])
    new = rows(spark, [("a", 2.0)], "k string, amount double")
    mappings = Mappings(transformed=(Transformed("amount", "amount"),), exact=(Exact("gone", "amount"), Exact("note", "lost")),
                        split=(Split("amount", ("amount", "part")),), formula=(Formula(("amount", "gone"), "SUM", "amount"),))
    outcome = check(spark, old, new, mappings)
    kinds = {(r.error_type, r.old_column, r.new_column) for r in outcome.errors.collect()}
    assert ("COLUMN_MISSING", "gone", None) in kinds and ("COLUMN_MISSING", None, "lost") in kinds and ("COLUMN_MISSING", None, "part") in kinds
    assert ("VALUE_MISMATCH", "amount", "amount") in kinds
    assert any(k[0] == "DATA_MISSING" for k in kinds)


def test_blank_keys_and_missing_and_extra_groups(spark):
    old = rows(spark, [(None, "PP", "C", "1", None), (" a ", "PP", "C", "1", None), ("b", "PP", "C", "1", None)])
    new = rows(spark, [("", 1.0), ("a", 1.0), ("c", 1.0)], "k string, amount double")
    mapping = Mappings(transformed=(Transformed("amount", "amount"),))
    assert [r[0] for r in found(check(spark, old, new, mapping), "ROW_MISSING")] == ["", "b", "c"]
    filtered = check(spark, old, new, mapping, source_filter="affectcode = 'PP'")
    assert [r[0] for r in found(filtered, "ROW_MISSING")] == ["", "b"]
    account = filtered.accounting.first()
    assert (account.rows_checked, account.pass_rows, account.fail_rows) == (3, 1, 2)


def test_key_transform(spark):
    old = rows(spark, [("0012", "PP", "C", "1", None)])
    new = rows(spark, [("12", 1.0)], "k string, amount double")
    outcome = check(spark, old, new, Mappings(transformed=(Transformed("amount", "amount"),)), grouping=Grouping("k", "k", "STRIP_LEADING_ZEROS"))
    assert found(outcome, "ROW_MISSING") == []


def test_identical_tables_have_no_error(spark):
    old = rows(spark, [("a", "PP", "C", "1", "x"), ("a", "I1", "D", "2", "y"), ("b", "PP", "C", "3", "z")])
    mappings = Mappings(exact=tuple(Exact(c, c) for c in ("affectcode", "debitcredit", "note")), transformed=(Transformed("amount", "amount"),))
    outcome = check(spark, old, old, mappings)
    assert outcome.errors.count() == 0
    assert outcome.accounting.first().pass_rows == 3


# The order example: interest rows processed in the wrong order shift the running sum.
ORDER_RULE = DefRule("def003", (Action(
    "ROW_LEVEL_COHESION",
    {"run": "SUM(new.running)", "before": "SUM(new.ib4t)", "d": "SUM(old.amount[affectcode=I1][debitcredit=D])", "c": "SUM(old.amount[affectcode=I1][debitcredit=C])"},
    "c <= 0 || d <= 0.01 || (Math.abs(run) <= 0.01 && Math.abs(c - before - d) <= 0.01)"
    " || Math.abs((run + c) - (before + 2 * d)) > (d + c) * 2 || Math.abs(run + c - before - 2 * d) <= 0.01",
    "order: run={run} c={c} {unknown}",
    report_fields={"impact": "d + c", "rows": "COUNT(new)", "least": "MIN(new.running)", "diff": "run + c - before - 2 * d", "bad": "nope + 1"},
),), Trigger(must_have_any=("I1",)))


def test_worked_order_example(spark):
    old = rows(spark, [(k, "I1", s, a, None) for k, d, c in (("wrong", "693.58", "693.58"), ("right", "693.58", "693.58"), ("late", "136.36", "644"), ("fine", "136.36", "644"))
                       for s, a in (("D", d), ("C", c))])
    new = rows(spark, [("wrong", -693.58, 0.0), ("right", 693.58, 0.0), ("late", 371.28, 507.64), ("late", 0.0, 1015.28), ("fine", 1151.64, 1522.92)],
               "k string, running double, ib4t double")
    outcome = check(spark, old, new, defs=(ORDER_RULE,))
    errors = {r.group_key: r for r in outcome.errors.filter("error_type = 'DEFECT_VIOLATION'").collect()}
    assert set(errors) == {"wrong", "late"}
    assert errors["wrong"].report_fields == {"impact": "1387.16", "rows": "1", "least": "-693.58", "diff": "-1387.16", "bad": None}
    assert errors["late"].report_fields["diff"] == "-780.36"
    assert errors["wrong"].message == "order: run=-693.58 c=693.58 {unknown}"


@pytest.mark.parametrize("text, wanted", [
    ("a == b + 1", "abs((`A`) - (`B` + 1)) <= cast('0.01' as decimal(28,8))"),
    ("a > 0 && !(b < 1)", "`A` > 0 AND NOT ( `B` < 1 )"),
    ("a", "(`A`) <> 0"),
    ("a / b > 1", "`A` / nullif( `B` , 0) > 1"),
    ("a / (b - 1) > 1", "`A` / nullif( ( `B` - 1 ) , 0) > 1"),
    ("a / Math.abs(b) !== 1", "`A` / nullif( abs ( `B` ) , 0) <> 1"),
])
def test_condition_text(text, wanted):
    assert condition_sql(text, {"a": "A", "b": "B"}, 0.01) == wanted


@pytest.mark.parametrize("text", ["", "a == b && a", "a == b OR", "process.exit()", "a; b", "require('fs')", "c == 1", "a == b == a", "'x' == a"])
def test_conditions_that_are_refused(text):
    with pytest.raises(RuleError):
        condition_sql(text, {"a": "A", "b": "B"}, 0.01)


def test_several_equalities_each_have_the_tolerance(spark):
    for text in ("a == 0 OR a == b", "a == 0 || (a == b && !(b > 9))", "(a == 0) or (a == b)"):
        frame = spark.createDataFrame([(0.005, 3.0), (3.004, 3.0), (2.0, 3.0)], "A double, B double")
        got = [r[0] for r in frame.selectExpr(condition_sql(text, {"a": "A", "b": "B"}, 0.01)).collect()]
        assert got == [True, True, False]


def test_broken_rules_give_one_error_and_others_go_on(spark):
    old = rows(spark, [("a", "PP", "C", "1", "x"), ("b", "PP", "C", "1", "x")])
    new = rows(spark, [("a", "2"), ("b", "*")], "k string, amount string")
    broken = DefRule("bad", (Action("ROW_LEVEL_COHESION", {"v": "AVG(old.amount)"}, "v == 1", "m"),
                             Action("ROW_LEVEL_COHESION", {"v": "SUM(old.amount)"}, "v && v", "m"),
                             Action("FIELD_VALUE_CHECK", {"new_col": "amount", "fail_if_new_matches": "("}, error_message="m"),
                             Action("FIELD_VALUE_CHECK", {"new_col": "amount"}, error_message="m")))
    good = DefRule("good", (Action("FIELD_VALUE_CHECK", {"new_col": "amount", "fail_if_new_matches": r"^\*"}, error_message="star"),))
    outcome = check(spark, old, new, defs=(broken, good))
    kinds = sorted((r.error_type, r.def_id, r.group_key) for r in outcome.errors.filter("def_id is not null").collect())
    assert kinds == [("DEFECT_VIOLATION", "good", "b")] + [("TRANSFORM_ERROR", "bad", None)] * 4


def test_permitted_old_values_excuse_bad_new_ones(spark):
    old = spark.createDataFrame([("a", "conv "), ("a", "x"), ("b", "x")], "k string, t string")
    new = spark.createDataFrame([("a", "PLAN1"), ("a", "user"), ("b", "123"), ("b", "plan9")], "k string, t string")
    rule = DefRule("v", (Action("FIELD_VALUE_CHECK", {"new_col": "t", "old_col": "t", "skip_if_old_equals": "CONV", "fail_if_new_matches": r"^\d+$|^PLAN"}, error_message="bad"),))
    outcome = check(spark, old, new, defs=(rule,))
    row = outcome.errors.filter("error_type = 'DEFECT_VIOLATION'").collect()
    assert [(r.group_key, r.old_value, r.new_value, r.message) for r in row] == [("b", "1", "2", "bad - 1 old values, 2 new values")]
    assert {(r.mapping, r.value, r.side) for r in outcome.details["differences"].collect()} == {(rule.def_id, "x", "old_only"), (rule.def_id, "123", "new_only"), (rule.def_id, "plan9", "new_only")}


def test_fingerprint_counts_copies(spark):
    old = spark.createDataFrame([("a", "x", "1.0"), ("a", "x", "1"), ("a", "y", "2")], "k string, n string, v string")
    new = spark.createDataFrame([("a", "x", "1.00"), ("a", "y", "2"), ("a", "z", "9")], "k string, n string, v string")
    outcome = check(spark, old, new, Mappings(transformed=(Transformed("v", "v"),)), grouping=Grouping("k", "k", row_fingerprint=(("n", "n", False), ("v", "v", False))))
    messages = sorted(r.message for r in outcome.errors.filter("error_type = 'ROW_MISSING'").collect())
    assert messages == ["[FP] 1x extra in target not in source | z|9", "[FP] 1x in source not in target | x|1"]


def test_two_old_accounts_may_share_a_new_one(spark):
    old = spark.createDataFrame([("s", "a1", "5", "p"), ("s", "a2", "5", "q"), ("s", "a3", "1", "p"), ("s", None, "1", "p")], "k string, acct string, amount string, n string")
    new = spark.createDataFrame([("s", "N", "5", "p")], "k string, lv string, amount string, n string")
    lookup = spark.createDataFrame([("a1", "N"), ("a2", "N"), ("a2", "Z")], "o string, n string")
    rule = Rule("r", "TRANSACTION", "old", "new", Mappings(transformed=(Transformed("amount", "amount"),), exact=(Exact("n", "n"),)),
                grouping=Grouping("k", "k", composite_key=CompositeKey("acct", "lv", AccountMapping("map", "o", "n"))), skip_aggregate_sum_check=True)
    outcome = validate(rule, resolver(spark, {"old": old, "new": new, "map": lookup}))
    assert found(outcome, "VALUE_MISMATCH") == [("s::N", "n", f"1 {ONE}", f"1 {ONE}")]
    assert found(outcome, "ROW_MISSING") == [("s::a3", None, None, None)]
    total = outcome.accounting.agg(F.sum("rows_checked"), F.sum("pass_rows"), F.sum("fail_rows")).first()
    assert tuple(total) == (4, 1, 2)


def test_rule_from_dictionary():
    rule = rule_from("t", {
        "table_info": {"source": "[db].dbo.[old]", "target": "new", "table_type": "TRANSACTION", "source_filter": "x = 1"},
        "anchor_key": {"old": "id", "new": "id"},
        "transaction_grouping": {"keys": {"old": "a", "new": "b"}, "row_fingerprint": [{"old": "d", "new": "e", "transform": "YEAR_ONLY"}],
                                 "composite_key": {"old_col": "p", "new_col": "q", "account_mapping": {"table": "m", "lookup_col": "l", "result_col": "r"}}},
        "schema_mappings": {"exact_matches": [{"old": "x", "new": "y", "transform_rule": "NONE"}],
                            "filtered_sum_matches": [{"old": "x", "old_filter": {"affectcode_in": ["PP"], "debitcredit": "C"}, "new": "z"}]},
        "defaults": {"tolerance": 0.01},
    })
    assert rule.grouping.row_fingerprint == (("d", "e", True),)
    assert rule.grouping.composite_key.mapping.result_col == "r"
    assert rule.mappings.filtered_sum[0].old_filter.columns() == ["affectcode", "debitcredit"]
    assert not rule.extras_wanted() and rule.tolerance_set
    assert defects.tokens_of("a+1") == ["a", "+", "1"]


def test_only_unlike_groups_list_their_values(spark):
    from concord.plans.grouped import GroupComparison

    old = rows(spark, [("a", "PP", "C", "1", None), ("a", "QQ", "C", "2", None), ("b", "PP", "C", "1", None), ("c", "PP", "C", "1", None), ("d", "PP", "C", "1", None)])
    new = rows(spark, [("a", "QQ", "C", "2", None), ("a", "PP", "C", "1", None), ("b", "PP", "C", "1", None), ("b", "PP", "C", "1", None), ("c", "RR", "C", "1", None)])
    comparison = GroupComparison(old, new, ["k"], Mappings(exact=(Exact("affectcode", "affectcode"), Exact("amount", "amount"))))
    assert {r.k for r in comparison.groups().filter("failed").collect()} == {"c", "d"}
    assert {(r.k, r.value, r.side) for r in comparison.differences().collect()} == {("c", "PP", "old_only"), ("c", "RR", "new_only")}
    # a agrees; b differs in its number of rows, not in its values; d is on one side.
    assert {r.k for r in comparison.value_table.collect()} == {"b", "c"}


def test_hashed_values_are_made_once_per_row(spark):
    rows = spark.createDataFrame([("g", "1.0", 5), ("g", "1", -7)], "k string, v string, w long")
    side = Side(rows, "old", ["k"])
    made = [F.lower(F.col("v")), number_text_of(rows, "w")]
    sums = side.multisets(made)
    assert all("lower" not in str(a) for _, a in side._aggregates.values())
    other = Side(rows, "old", ["k"])
    plain = other.df.groupBy("k").agg(*multisets_hash(made)).first()
    assert tuple(side.aggregated().select(*sums).first()) == tuple(plain)[1:]
    assert [r[0] for r in rows.select(number_text_of(rows, "w")).collect()] == ["5", "-7"]
    assert "decimal" not in str(number_text_of(rows, "w")).lower()
