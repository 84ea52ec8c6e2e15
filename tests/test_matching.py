"""Keys, whole tables, rates, medians, fingerprints and joins by bitmap, against plain Python on literal rows."""

import random
from collections import Counter
from statistics import median_low

import pytest
from pyspark.sql import functions as F

from concord.functions.text import REWRITES
from concord.operators import anchor_search, anchors, audit, field_match, joins, keys, matching, profile
from concord.operators.anchor_search import next_level, search_anchor, shared_alignments, single_verdict
from concord.operators.audit import PairRule
from concord.operators.field_match import rewrite_rates
from concord.operators.fingerprint_diff import differing_groups, fingerprint_gaps
from concord.plans.match_tables import match_tables
from concord.plans.validate import validate
from concord.rules import CompositeKey, AccountMapping, Exact, Grouping, Mappings, Rule, Transformed
from concord.sources import sinks
from concord.sources.scratch import stored
from concord.sources.tables import resolver


def search(old, new, **more):
    return search_anchor(old, new, *[anchors.anchor_quality(profile.value_counts(t)) for t in (old, new)], **more)


def test_levels_grow_from_survivors():
    a, b, c, d = ("a", "x"), ("b", "y"), ("c", "z"), ("a", "y")
    assert next_level([(a,), (b,), (d,)]) == [(a, b)]  # a and d share an old column, b and d a new one
    assert next_level([(a, b), (a, c), (b, c)]) == [(a, b, c)]
    assert next_level([(a, b), (a, c)]) == []  # one part is missing
    assert next_level([]) == []


def test_verdicts():
    assert single_verdict(True, 1000, 1000, 9, 5) == "ID_REGENERATED"
    assert single_verdict(False, 1000, 1000, 9, 5) == "POOR_JOIN"
    assert single_verdict(True, 10, 10, 9, 0) == "GHOST_JOIN" and single_verdict(True, 10, 10, 9, 1) == "ACCEPTED"
    assert single_verdict(False, 0, 0, 0, 0) == "POOR_JOIN"


def test_a_key_of_three_columns(spark):
    rng = random.Random(4)
    cells = [(f"A{i % 12}", f"B{i // 12 % 12}", f"C{i // 144}") for i in range(12 * 12 * 2)]
    old = spark.createDataFrame([(*c, rng.random()) for c in cells], "belnr string, posten string, konto string, w double")
    new = spark.createDataFrame([(c[2], c[0], c[1]) for c in cells[20:]], "chapter string, voucher string, step string")
    assert search(old, new, most_columns=2)[1] is None or search(old, new, most_columns=2)[1].strategy == "COMPOSITE"
    names = [("belnr", "voucher"), ("posten", "step"), ("konto", "chapter")]
    found = shared_alignments(old, new, [tuple(sorted(names))])
    assert list(found.values()) == [(len(cells) - 20, len(cells), len(cells) - 20)]
    wrong = tuple((o, n) for (o, _), (_, n) in zip(names, names[1:] + names[:1]))
    assert shared_alignments(old, new, [wrong]) == {} and shared_alignments(old, new, []) == {}


def test_contexts_of_several_keys(spark):
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "0"), (3, None, None), (None, "q", "x")], "k int, t string, v string")
    new = spark.createDataFrame([(1, "A", "x"), (2, "d", "0"), (3, "a", "z"), (3, "a", "y")], "n int, s string, w string")
    got = {r["key"]: (r.n_old, r.n_new, r.n_joined, r.n_with_context) for r in anchor_search.tested_keys(old, new, [(["k"], ["n"]), (["t"], ["s"]), (["k", "t"], ["n", "s"])]).collect()}
    # The first row of key 1 is (1, a, x); zero says nothing; (3, None, None) shares nothing.
    assert got[0] == (3, 3, 3, 1) and got[1] == (4, 3, 1, 0) and got[2] == (3, 3, 0, 0)
    none = anchor_search.tested_keys(old.limit(0), new, [(["k"], ["n"])]).collect()
    assert [(r.n_old, r.n_joined) for r in none] == [(0, 0)]


def test_tables_without_a_key(spark):
    old = spark.createDataFrame([(f"u{k}", k % 3) for k in range(40)], "colour string, level int")
    new = spark.createDataFrame([(f"z{k}", k % 3) for k in range(40)], "colours string, level int")
    found = match_tables(old, new, "mine")
    assert found.anchor is None and found.joined is None and found.tested.filter("chosen").count() == 0
    matches = {r.old_column: r.new_column for r in found.matches.collect()}
    assert matches["level"] == "level" and set(matches) <= {"colour", "level"}
    assert found.coverage.first().table_name == "mine" and found.coverage.first().n_columns == 2
    assert found.unmatched_old.count() + found.matches.filter("claim_outcome not in ('EVICTED', 'NONE')").count() == 2
    fixed = match_tables(old, new, configured=[("colour", "colours")]).matches.filter("old_column = 'colour'").first()
    assert (fixed.new_column, fixed.status) == ("colours", "VERIFIED (Schema Mapping)")


@pytest.mark.parametrize("index_from", [0, 4])
def test_rates_of_all_rewrites(spark, monkeypatch, index_from):
    monkeypatch.setattr(field_match, "INDEX_FROM", index_from)
    rng = random.Random(7)
    pick = lambda: rng.choice([None, "007", "7", "a-b", "AB", "a b", "ab", "x.5", "5", "", "é!", "É"])
    rows = [tuple(pick() for _ in range(5)) for _ in range(60)]
    joined = spark.createDataFrame([(*r, "left", None) for r in rows], "a_O string, b_O string, p_N string, q_N string, r_N string, only_O string, empty_N string")
    pairs = [(o, n) for o in ("a", "b", "only") for n in ("p", "q", "r", "empty")]
    rates = {(r.old_column, r.new_column, r.rule): r.match_rate for r in rewrite_rates(joined, pairs).collect()}
    for o, n in pairs:
        for rule, rewrite in REWRITES.items():
            want = joined.agg(F.avg(F.when(rewrite(F.col(f"{o}_O")).eqNullSafe(rewrite(F.col(f"{n}_N"))), 1.0).otherwise(0.0))).first()[0]
            assert rates.pop((o, n, rule)) == pytest.approx(want)
    assert not rates
    assert {r.match_rate for r in rewrite_rates(joined.limit(0), pairs[:1]).collect()} == {0.0}


TEXTS = ["", "   ", "a", "no", "NO ", "2024-01-15", "2024-01-15T10:11:12+07:00", "2024-02-30 and a day that is none", "0000000000000000000042", "123456789012345678",
         "1" * 40, "9" * 600, "ABCDEF-12345678", "A LONG CAPITAL NOTE", "A long capital note", "a long capital note ", "mail@example.com, and so on", "same head, one", "same head, two",
         "same head, three", "x" * 600, "x" * 599 + "y", "+66 2 1234 5678 90", "a\tb c d e f g h", "0.50", "1234567890.125", "1e5", "-12.75", "#abc", None]


def test_long_texts_by_digest(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, rng.choice(TEXTS), rng.choice(TEXTS[:9]) if k % 3 else None, rng.choice(TEXTS) if k % 2 else "x" * 600) for k in range(160)]
    table = spark.createDataFrame(rows, "k int, note string, code string, hot string").withColumn("parts", F.array("note", "code"))

    def everything():
        counts = stored(profile.value_counts(table), "counts")
        frames = [profile.column_meta(counts), profile.column_profile(counts), profile.fingerprints(counts), profile.column_patterns(profile.shape_counts(counts)),
                  profile.number_shape(counts), profile.medians(counts), anchors.anchor_quality(counts),
                  *[profile.top_values(counts, most, table) for most in (3, 40)], matching.unmatched_old(counts, spark.createDataFrame([("k",)], "old_column string"), 3, table)]
        flat = lambda r: [round(v, 9) if isinstance(v, float) else v for v in r]  # noqa: E731  (sums of doubles in any order)
        return [sorted(repr(flat(r)) for r in f.collect()) for f in frames], counts.filter("long is not null").count()

    whole, none = [monkeypatch.setattr(profile, "LONG", 10 ** 6), everything()][1]
    assert none == 0
    for long, head in ((512, 64), (0, 1)):
        monkeypatch.setattr(profile, "LONG", long)
        monkeypatch.setattr(profile, "HEAD", head)
        got, some = everything()
        assert some and got == whole


def test_empty_table_has_no_values(spark):
    table = spark.createDataFrame([], "a string, b int")
    counts = profile.value_counts(table)
    assert counts.count() == 0
    assert profile.top_values(counts, 3, table).count() == profile.column_profile(counts).count() == 0


def test_long_texts_do_not_move(spark):
    """The shuffle of the counts is keyed by digests, and whole texts are no column of it."""
    table = spark.range(4).select(F.repeat(F.col("id").cast("string"), 600).alias("t"))
    # Zeros are a number, whatever their length, and stay as they are; the others have too many digits for one.
    assert sorted(len(r.value) for r in profile.value_counts(table).collect()) == [33, 33, 33, 600]
    table = table.select(F.concat(F.lit("n"), "t").alias("t"))
    got = profile.value_counts(table).collect()
    assert {len(r.value) for r in got} == {33} and {r.long.length for r in got} == {601}


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_medians_by_narrowing(spark, buckets):
    rng = random.Random(1)
    columns = {"flat": [5.0] * 50, "even": [float(k) for k in range(100)], "wide": [10 ** rng.uniform(-5, 12) * rng.choice([-1, 1]) for _ in range(201)],
               "close": [1 + k * 1e-12 for k in range(33)], "one": [3.0]}
    counts = spark.createDataFrame([(c, repr(v), 1 + (k % 3 == 0)) for c, values in columns.items() for k, v in enumerate(values)] + [("text", "x", 3), ("flat", None, 9)],
                                   "column_name string, value string, n int")
    got = {r.column_name: r.median_value for r in profile.medians(counts, buckets).collect()}
    for name, values in columns.items():
        weighed = [float(v) for k, v in enumerate(values) for _ in range(1 + (k % 3 == 0))]
        if name == "close":  # more decimals than amounts have
            assert got[name] == pytest.approx(median_low(weighed), abs=1e-8)
        else:
            assert got[name] == pytest.approx(median_low(weighed), rel=1e-9, abs=1e-8)
    assert "text" not in got


def test_fingerprints_of_differing_groups_only(spark):
    rng = random.Random(2)
    old = [(f"g{k % 9}", rng.choice("abc"), rng.choice(["1", "1.0", "2"])) for k in range(200)]
    new = [r for r in old if r[0] not in ("g1", "g2")] + [("g1", "a", "1")] + [("g2", *r[1:]) for r in old if r[0] == "g2"][:-1] + [("only", "z", "3")]
    rng.shuffle(new)
    parts = (("t", "t", False), ("v", "v", False))
    frames = [spark.createDataFrame(rows, "k string, t string, v string") for rows in (old, new)]
    plain = lambda rows: Counter((k, t, v.replace(".0", "")) for k, t, v in rows)
    lost, more = plain(old) - plain(new), plain(new) - plain(old)
    got = Counter()
    for r in fingerprint_gaps(*frames, ["k"], parts).collect():
        got[r.k, r.side] += r.copies
    want = Counter()
    for side, rows in (("missing_in_target", lost), ("extra_in_target", more)):
        for (k, _, _), n in rows.items():
            want[k, side] += n
    assert got == want
    assert {r.k for r in differing_groups(*frames, ["k"], parts).collect()} == {k for k, _ in want}
    assert fingerprint_gaps(frames[0], frames[0], ["k"], parts).count() == 0


@pytest.mark.parametrize("bits", [15, 23])
def test_rows_of_wanted_keys(spark, bits):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("t"))
    keys = rows.filter("k % 50 = 3").distinct()
    marked = joins.marked(rows, keys, ["k", "t"], bits)
    assert marked.filter("k % 50 = 3 and not seen").count() == 0
    assert marked.filter("k % 50 <> 3 and seen").count() < (2000 if bits == 15 else 60)
    only = joins.only_keys(rows, keys.filter("t is not null"), ["k", "t"], bits)
    assert only.columns == rows.columns and only.count() == rows.filter("k % 50 = 3 and t is not null").count()
    assert joins.only_keys(rows, keys.limit(0), ["k", "t"], bits).count() == 0


def test_repeated_old_rows_each_count(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c"), (3, "d"), (3, "d")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (5, "e"), (None, "f")], "id int, v string")
    rule = Rule("m", "MASTER", "old", "new", Mappings(exact=(Exact("v", "v"),)), old_anchor="id", new_anchor="id")
    outcome = validate(rule, resolver(spark, {"old": old, "new": new}))
    errors = Counter((r.error_type, r.row_id) for r in outcome.errors.collect())
    assert errors[("VALUE_MISMATCH", "1")] == 1 and errors[("VALUE_MISMATCH", "2")] == 1
    assert errors[("ROW_MISSING", "3")] == 2 and errors[("ROW_MISSING", "5")] == 1 and errors[("ROW_MISSING", None)] == 1
    assert errors[("TRANSFORM_ERROR", None)] == 1
    account = outcome.accounting.first()
    assert (account.rows_checked, account.pass_rows, account.fail_rows) == (6, 2, 4)


def test_rules_between_three_sources(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0), (2, 25.0), (None, 9.0)], "k int, x double")
    b = spark.createDataFrame([(1, 10.0), (2, 21.0), (3, 5.0)], "k int, y double")
    c = spark.createDataFrame([(1, "10"), (3, "5")], "k int, z string")
    rules = [PairRule("ab", "x", "y", "a", "b"), PairRule("bc", "y", "z", "b", "c"), PairRule("ac", "SUM(x, x)", "z", "a", "c"), PairRule("ba", "y", "x", "b", "a")]
    got = {r.rule_id: (r.pass_count, r.fail_count) for r in audit.audit_pairs({"a": a, "b": b, "c": c}, "k", rules).collect()}
    assert got == {"ab": (1, 1), "bc": (2, 0), "ac": (0, 1), "ba": (1, 1)}


def test_accounts_are_translated_on_groups(spark):
    old = spark.createDataFrame([("s", "1", "10"), ("s", "1", "5"), ("s", "2", "7"), ("s", "9", "1"), ("t", " ", "3"), ("t", "3", "4")], "ref string, acc string, amount string")
    new = spark.createDataFrame([("s", "A", 15.0), ("s", "B", 8.0), ("u", "C", 1.0)], "ref string, account string, amount double")
    lookup = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "o string, n string")
    rule = Rule("c", "TRANSACTION", "old", "new", Mappings(transformed=(Transformed("amount", "amount"),)), skip_aggregate_sum_check=True,
                grouping=Grouping("ref", "ref", composite_key=CompositeKey("acc", "account", AccountMapping("map", "o", "n"))))
    outcome = validate(rule, resolver(spark, {"old": old, "new": new, "map": lookup}))
    rows = sorted((r.error_type, r.group_key) for r in outcome.errors.filter("group_key is not null").collect())
    assert rows == [("ROW_MISSING", "s::9"), ("ROW_MISSING", "t::C"), ("ROW_MISSING", "u::C"), ("VALUE_MISMATCH", "s::B")]
    account = outcome.accounting.first()
    assert (account.rows_checked, account.pass_rows, account.fail_rows) == (6, 2, 3)


def test_a_run_is_computed_once(spark, tmp_path, monkeypatch):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    new = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 1.0)], "k string, v double")
    rule = Rule("r", "TRANSACTION", "old", "new", Mappings(transformed=(Transformed("v", "v"),)), grouping=Grouping("k", "k"), skip_aggregate_sum_check=True)
    outcome = validate(rule, resolver(spark, {"old": old, "new": new}))
    settled = sinks.settled(outcome)
    assert settled.errors.columns == outcome.errors.columns and settled.errors.count() == outcome.errors.count() == 2
    assert all("parquet" in line.lower() for line in settled.errors.inputFiles())
    monkeypatch.setattr(sinks, "settled", lambda o: settled)
    sinks.write_run([outcome], str(tmp_path))
    summary = spark.read.option("header", True).csv(f"{tmp_path}/Summary_Report").first()
    assert (summary.rule, summary.status, summary.total_errors, summary.rows_checked) == ("r", "FAIL", "2", "2")


def test_forms_are_computed_over_cells(spark, monkeypatch):
    made = []
    monkeypatch.setattr(field_match, "comparable", lambda v: made.append(v) or F.nullif(F.lower(v), F.lit("none")))
    old = spark.createDataFrame([("A", "x"), ("b", "None")], "p string, q string")
    new = spark.createDataFrame([("a", "X"), ("B", "none")], "r string, s string")
    got = {(r.old_column, r.new_column): (r.n_shared, r.n_old, r.n_new) for r in field_match.comparable_overlap(old, new).collect()}
    assert got == {("p", "r"): (2, 2, 2), ("q", "s"): (1, 1, 1)}
    assert len(made) == 2  # once a table, not once a column


def test_types_and_prefixes_move_thin_rows(spark):
    counts = profile.value_counts(spark.createDataFrame([("yes", "0", " a"), ("NO ", "0", "a"), (None, "0", "b")], "found string, x string, t string"))
    shapes = profile.shape_counts(counts)
    assert {r.column_name: r.column_type for r in profile.column_types(shapes).collect()} == {"found": "boolean", "x": "numeric", "t": "alpha"}
    assert {r.column_name: r.n_distinct for r in profile.column_meta(counts).collect()} == {"found": 2, "x": 1, "t": 2}
    assert "distinct" not in shapes._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([("p", "k", 1), ("p", "k", 1), ("p", "l", None), (None, None, 2)], "p string, k string, a int")
    found = keys.prefix_distribution(rows, F.col("p"), "k", "a")
    assert sorted(found.collect(), key=str) == sorted([("p", 3, 2, 1), (None, 1, 0, 1)], key=str)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rewrites_run_over_few_cells(spark, monkeypatch):
    made = []
    monkeypatch.setitem(REWRITES, "REMOVE_PUNCTUATION", lambda c, own=REWRITES["REMOVE_PUNCTUATION"]: made.append(c) or own(c))
    joined = spark.createDataFrame([("01", "0-1", "1", "x"), ("7", None, "7", None)], "a_O string, b_O string, p_N string, q_N string")
    rates = {(r.old_column, r.new_column, r.rule): r.match_rate for r in rewrite_rates(joined, [(o, n) for o in "ab" for n in "pq"]).collect()}
    assert len(made) == 2  # once a side, not once a column
    assert rates["a", "p", "RAW"] == 0.5 and rates["a", "p", "STRIP_LEADING_ZEROS"] == 1.0 and rates["b", "q", "RAW"] == 0.5


def test_only_repeated_values_are_ordered(spark, monkeypatch):
    ordered = []
    whole = anchor_search._first_row
    monkeypatch.setattr(anchor_search, "_first_row", lambda df: ordered.append(df) or whole(df))
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    new = spark.createDataFrame([(1, "A"), (2, "z")], "n int, s string")
    key = [(["k"], ["n"])]
    assert [tuple(r) for r in anchor_search.tested_keys(old, new, key).collect()] == [(0, 2, 2, 2, 1)] and not ordered
    twice = old.unionByName(spark.createDataFrame([(2, "a"), (2, None)], old.schema))
    assert [tuple(r) for r in anchor_search.tested_keys(twice, new.withColumn("s", F.lit("a")), key).collect()] == [(0, 2, 2, 2, 2)] and ordered


def test_overlap_from_counts(spark):
    long = "Long text, " * 60
    old = spark.createDataFrame([("A", "1.0", long), ("a", None, "b"), ("x", "2", "none")], "p string, q string, r string")
    new = spark.createDataFrame([("a", 1, long.upper()), ("y", 2, "B")], "p string, q int, r string")
    counts = tuple(stored(profile.value_counts(t), "counts") for t in (old, new))
    plain, counted = (sorted(field_match.comparable_overlap(old, new, c).collect()) for c in (None, counts))
    assert plain == counted and len(plain) == 3
