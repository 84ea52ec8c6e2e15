"""Row comparison, several sources, containment, pivot, files and reports on literal rows."""

import os

import pytest

from concord.operators import audit, joins, report, schema
from concord.operators.audit import PairRule, RowRule
from concord.operators.noisy import noisy_columns, noisy_names
from concord.plans.validate import validate
from concord.rules import Exact, Formula, Grouping, Mappings, Pivot, PivotConfig, Rule, Split, Transformed, load_rule
from concord.sources import files, sinks
from concord.sources.tables import name_parts, resolver, source_rows


def run(spark, rule, **tables):
    return validate(rule, resolver(spark, tables))


def master(spark, old, new, mappings, **more):
    rule = Rule("m", "MASTER", "old", "new", mappings, old_anchor="id", new_anchor="id", **more)
    return run(spark, rule, old=old, new=new)


def test_rows_are_joined_by_key(spark):
    old = spark.createDataFrame([(1, "a", "5"), (2, "b", "6"), (3, "c", "7"), (None, "d", "8")], "id int, name string, v string")
    new = spark.createDataFrame([("1 ", "A", 5.004), ("2", "x", 6.5), ("4", "e", 1.0)], "id string, name string, v double")
    outcome = master(spark, old, new, Mappings(exact=(Exact("name", "name"), Exact("v", "v"))), tolerance=0.01)
    rows = sorted((r.error_type, r.row_id or "", r.old_column or "") for r in outcome.errors.filter("error_type <> 'DATA_MISSING'").collect())
    assert rows == [("ROW_MISSING", "3", ""), ("ROW_MISSING", "4", ""), ("VALUE_MISMATCH", "2", "name"), ("VALUE_MISMATCH", "2", "v")]
    account = outcome.accounting.first()
    assert (account.rows_checked, account.pass_rows, account.fail_rows) == (3, 1, 2)


def test_row_formulas_and_skips(spark):
    old = spark.createDataFrame([(1, 10.0, 4.0), (2, 10.0, None), (3, 9.0, 9.0)], "id int, c double, d double")
    new = spark.createDataFrame([(1, 7.0, 3.0, 6.0), (2, 7.0, 3.0, 1.0), (3, 9.0, None, 1.0)], "id int, p double, q double, diff double")
    mappings = Mappings(split=(Split("c", ("p", "q"), "SUM"),), formula=(Formula(("c", "d"), "SUBTRACT", "diff"),))
    outcome = master(spark, old, new, mappings)
    assert [(r.row_id, r.old_column, r.old_value, r.new_value) for r in outcome.errors.filter("row_id is not null").collect()] == [("3", "c-d", "0", "1")]


def test_repeated_keys_are_reported_and_not_multiplied(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "id int, v string")
    outcome = master(spark, old, new, Mappings(exact=(Exact("v", "v"),)))
    kinds = [r.error_type for r in outcome.errors.collect()]
    assert kinds.count("TRANSFORM_ERROR") == 2 and kinds.count("VALUE_MISMATCH") == 1
    assert outcome.accounting.first().rows_checked == 2


def test_fallback_compares_columns_with_nearly_the_same_name(spark):
    old = spark.createDataFrame([(1, "a", "q"), (2, "b", "r")], "id int, v string, customer_reference string")
    new = spark.createDataFrame([(1, "a", "q"), (2, "b", "other")], "id int, v string, customer_references string")
    outcome = master(spark, old, new, Mappings(exact=(Exact("v", "v"),)))
    assert [r.new_column for r in outcome.errors.filter("error_type = 'VALUE_MISMATCH'").collect()] == ["customer_references"]


def test_nothing_left_to_compare(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    outcome = master(spark, old, old, Mappings(exact=(Exact("gone", "v"),)))
    assert outcome.errors.filter("error_type = 'COLUMN_MISSING'").count() == 1
    assert outcome.accounting.first().rows_checked == 0


def test_hot_keys_are_spread_without_changing_the_join(spark):
    left = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id as string) end as k", "id")
    right = spark.createDataFrame([("hot", 1), ("5", 2), ("none", 3)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            spread = joins.even_join(left, right, ["k"], how, hot_rows=100, salts=4)
            plain = left.join(right, ["k"], how)
            assert spread.columns == plain.columns
            assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        joins.even_join(left, right, ["k"], "full_outer")


def test_hot_keys_keep_a_validator_right(spark):
    """A third of all rows under one key, joined without any broadcast."""
    old = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id end as id", "cast(id % 5 as string) as v")
    new = spark.range(3000).selectExpr("id", "cast(id % 5 as string) as v")
    mappings = Mappings(exact=(Exact("v", "v"),))
    before = master(spark, old, new, mappings).accounting.first()
    saved = joins.HOT_ROWS
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joins.even_join.__defaults__ = tuple(100 if d == saved else d for d in joins.even_join.__defaults__)
    try:
        assert master(spark, old, new, mappings).accounting.first() == before
    finally:
        joins.even_join.__defaults__ = tuple(saved if d == 100 else d for d in joins.even_join.__defaults__)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert before.fail_rows == 800


def test_noisy_kinds(spark):
    frame = spark.createDataFrame([(None, "0", "1", "x"), (None, "", "true", "0")], "a string, b string, c string, d string")
    assert {r.column_name: r.kind for r in noisy_columns(frame).collect()} == {"a": "NULL", "b": "ZERO", "c": "BOOLEAN", "d": "NORMAL"}
    assert noisy_names(frame, frame.columns) == {"a", "b", "c"}
    late = spark.range(20_001).selectExpr("case when id = 20000 then 'x' else '0' end as v")
    assert noisy_names(late, ["v"]) == set()


def test_pivot_needs_a_configuration(spark):
    empty = spark.createDataFrame([], "id int, a double")
    full = spark.createDataFrame([(1, 1.0)], "id int, a double")
    for target, n in ((empty, 2), (full, 1)):
        outcome = run(spark, Rule("h", "HEADER", "old", "new", Mappings()), old=full, new=target)
        assert outcome.errors.count() == n


def test_pivot_text_values_and_duplicates(spark):
    old = spark.createDataFrame([("1", "name", "ann"), ("1", "city", "bkk"), ("2", "name", "bob"), ("3", "name", "cy")], "id string, t string, v string")
    new = spark.createDataFrame([("1", "Ann", "bkk"), ("2", "rob", None), ("2", "rob", None), ("4", "x", "y")], "id string, name string, city string")
    rule = Rule("h", "HEADER", "old", "new", Mappings(pivot=(Pivot("name", "v", "name"), Pivot("city", "v", "city"))), pivot=PivotConfig("id", "id", "t"))
    outcome = run(spark, rule, old=old, new=new)
    assert sorted((r.error_type, r.row_id) for r in outcome.errors.collect()) == [
        ("ROW_MISSING", "3"), ("ROW_MISSING", "4"), ("TRANSFORM_ERROR", "2"), ("VALUE_MISMATCH", "2")]
    account = outcome.accounting.first()
    assert (account.rows_checked, account.pass_rows, account.fail_rows) == (4, 2, 2)


def test_union_needs_grouping(spark):
    frame = spark.createDataFrame([(1, "a")], "id int, v string")
    outcome = run(spark, Rule("u", "UNION", "a,b", "new", Mappings(exact=(Exact("v", "v"),))), a=frame, b=frame, new=frame)
    assert [r.error_type for r in outcome.errors.collect()] == ["TRANSFORM_ERROR"]


def test_filter_applies_to_the_first_source_only(spark):
    a = spark.createDataFrame([("k1", "x", 1), ("k2", "y", 0)], "k string, v string, ok int")
    b = spark.createDataFrame([("k3", "z")], "k string, v string")
    new = spark.createDataFrame([("k1", "x"), ("k3", "q")], "k string, v string")
    rule = Rule("m", "MULTIPLE", "a,b", "new", Mappings(exact=(Exact("v", "v", source="a"), Exact("v", "v", source="b"))), grouping=Grouping("k", "k"),
                source_filter="ok = 1", report_extra_groups=True)
    outcome = run(spark, rule, a=a, b=b, new=new)
    assert sorted((r.error_type, r.group_key) for r in outcome.errors.filter("group_key is not null").collect()) == [("VALUE_MISMATCH", "k3")]


def test_bracketed_names_and_filters(spark):
    assert name_parts("[db-one].dbo.[conv$x]") == ["db-one", "dbo", "conv$x"]
    frame = spark.createDataFrame([(1, "TF"), (None, "TF"), (2, "TX")], "id int, kind string")
    assert resolver(spark, {"conv$x": frame})("[db-one].dbo.[conv$x]") is frame
    assert [r.id for r in source_rows(frame, "kind = 'TF'", "id").collect()] == [1]


def test_delimited_files_fall_back_to_the_thai_encoding(spark, tmp_path):
    path = tmp_path / "thai.csv"
    path.write_bytes(" ชื่อ ,code\nเงินต้น,PP\n".encode("cp874"))
    frame = files.delimited(spark, str(path))
    assert frame.columns == ["ชื่อ", "code"] and frame.first()[0] == "เงินต้น"
    path.write_text("ชื่อ,code\nดอกเบี้ย,I1\n", encoding="utf-8")
    assert files.delimited(spark, str(path)).first()[0] == "ดอกเบี้ย"


def test_code_list(spark, tmp_path):
    path = tmp_path / "codes.json"
    path.write_text('{"codes": [\n {"code": "pp", "description": "Principal", "category": "P"},\n {"code": "I1", "description": "Interest"}\n]}')
    codes = files.code_list(spark, str(path))
    assert files.known_codes(codes) == {"PP", "I1"}
    rows = spark.createDataFrame([("PP",), (" i1 ",), ("ZZ",), (None,)], "c string")
    tags = {r.c: (r.affect_tag, r.affect_category) for r in audit.tag_codes(rows, "c", codes).collect()}
    assert tags == {"PP": ("Principal", "P"), " i1 ": ("Interest", "UNKNOWN"), "ZZ": ("UNKNOWN:ZZ", "UNKNOWN"), None: ("NULL", "NULL")}


def test_rule_files(spark, tmp_path):
    root = tmp_path / "rules"
    for place, name, body in (
        ("case", "common", "table_info: {source: old, target: new, table_type: TRANSACTION}\nanchor_key: {old: id, new: id}\n"
                           "transaction_grouping: {keys: {old: k, new: k}}\nschema_mappings: {transformed_matches: [{old: v, new: v, transform_rule: NONE}]}\n"),
        ("case/vali", "vali001", "actions: [{check_type: ROW_LEVEL_COHESION, variables: {a: COUNT(old), b: COUNT(new)}, condition: a == b, error_message: own}]\n"),
        ("vali", "vali001", "actions: []\n"), ("vali", "vali002", "actions: []\n"), ("case/def", "def001", "actions: []\n"),
    ):
        (root / place).mkdir(parents=True, exist_ok=True)
        (root / place / f"{name}.yaml").write_text(body)
    rule = load_rule(str(root), "case")
    assert [d.def_id for d in rule.defs] == ["vali001", "vali002", "def001"]
    assert rule.defs[0].actions[0].error_message == "own"
    old = spark.createDataFrame([(1, "a", "5"), (2, "a", "6")], "id int, k string, v string")
    new = spark.createDataFrame([(1, "a", "11")], "id int, k string, v string")
    outcome = run(spark, rule, old=old, new=new)
    assert [r.message for r in outcome.errors.filter("def_id = 'vali001'").collect()] == ["own"]
    sinks.write_run([outcome], str(tmp_path / "out"))
    assert os.path.exists(tmp_path / "out" / "Summary_Report" / "_SUCCESS")


def test_breakdown_description_and_order(spark):
    rows = [("ROW_MISSING", None, "b. \nmore"), ("DEFECT_VIOLATION", "d2", "x" * 100), ("DEFECT_VIOLATION", "d1", "y"), ("COLUMN_MISSING", None, "c.")]
    frame = spark.createDataFrame(rows, "error_type string, def_id string, message string")
    got = [(r.error_type, r.def_id, r["count"], r.description) for r in report.report_order(report.breakdown(frame)).collect()]
    assert got == [("DEFECT_VIOLATION", "d1", 1, "y"), ("DEFECT_VIOLATION", "d2", 1, "x" * 100), ("COLUMN_MISSING", None, 1, "c"), ("ROW_MISSING", None, 1, "b")]


def test_audit_edges(spark):
    frame = spark.createDataFrame([("1", "1", 5.0), ("2", "x", None), (None, None, 50.0)], "a string, b string, c double")
    rules = [RowRule("cmp", "COMPARE", source="a", target="b"), RowRule("uni", "UNIQUE", target="b"), RowRule("ran", "RANGE", target="c", low=1, high=9), RowRule("odd", "WHAT", target="c")]
    got = {r.rule_id: (r.pass_count, r.fail_count, r.status) for r in audit.audit_rows(frame, rules).collect()}
    assert got == {"cmp": (2, 1, "FAIL"), "uni": (3, 0, "PASS"), "ran": (1, 2, "FAIL"), "odd": (0, 3, "FAIL")}
    pairs = audit.audit_pairs({"x": frame, "y": frame}, "a", [PairRule("p", "c", "c", "x", "y")]).collect()
    assert [(r.pass_count, r.fail_count) for r in pairs] == [(2, 0)]


def test_schema_helpers(spark):
    mappings = Mappings(exact=(Exact("a", "x"),), transformed=(Transformed("b", "y"),))
    missing = schema.missing_columns(["a"], ["x", "y"], mappings, "s", "t")
    assert [e["old_column"] for e in missing] == ["b"]
    assert schema.usable_mappings(mappings, missing) == Mappings(exact=(Exact("a", "x"),))
