"""Importance resampling against a plain count of all features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import importance
from concord.llm.importance import bucket_counts, features, importance as weigh, ranked, resampled

OWN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return OWN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs_of(text, orders=3):
    own = words_of(text)
    return [" ".join(own[k:k + n]) for n in range(1, orders + 1) for k in range(len(own) - n + 1)]


def by_force(docs, target, buckets=10_000, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs_of(x)), Counter(bucket(f) for _, x in target for f in runs_of(x))
    above, below = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * above / ((s[b] + 1) * below)))
    rows = []
    for name, text in docs:
        own = runs_of(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        rows.append((name, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


PARTS = st.lists(st.sampled_from(["a", "B", "é", "longer", "x" * 70, "y" * 5000, " ", " ", "\n", "-", "\x00", "日本", "9", "ÿ", "\U0001f600"]), max_size=12).map("".join)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), PARTS), max_size=6), section=st.sampled_from([1, 7, 100, 2_000_000]), orders=st.integers(1, 4))
def test_features_of_a_batch(texts, section, orders):
    before, importance.SECTION = importance.SECTION, section
    try:
        got = Counter((int(d), int(c)) for document, sums, _ in features(texts, orders) for d, c in zip(document, sums))
    finally:
        importance.SECTION = before
    assert got == Counter((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in runs_of(t, orders))


def test_resampling_by_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    odd = [(None, "Word " * 30), (None, None), (-1, ""), (-2, " .. "), (-3, "one"), (-4, "Two words"), (-5, "same words " * 15), (-5, "same words " * 15), (-6, "É" * 3000 + " z" * 25), (-7, "ab\x00cd " * 40_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    own = [(r.doc_id, r.text) for r in docs.collect()]
    want = by_force(own, [(r.item_id, r.text) for r in target.collect()], percent=20)
    named = docs.selectExpr("doc_id", "text", "1 as weight", "2 as score", "3 as text_hash", "4 as rank")
    rows = ranked(weigh(named, target), percent=20)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    drawn = resampled(named, target, percent=20)
    assert drawn.columns == named.columns
    assert sorted((str(r.doc_id) for r in drawn.collect())) == sorted(str(r[0]) for r in want if r[4])


def test_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "the same words " * 10) for k in (7, 7, 7, 7)] + [(8, "few")], "doc_id long, text string")
    none = docs.limit(0)
    got = ranked(weigh(docs, none), percent=50).collect()
    assert sorted((r["rank"] or 0) for r in got) == [0, 0, 0, 1, 2] and len({r.score for r in got if r.doc_id == 7}) == 1
    assert ranked(weigh(none, docs)).count() == 0 and bucket_counts(none).count() == 0
    assert resampled(docs, docs, percent=0).count() == 0


def test_checksums_of_long_words():
    long = ["a" * 100_000, "b", "c" * 65, "d" * 64]
    got = {int(c) for _, sums, _ in features([" ".join(long)]) for c in sums}
    assert got == {zlib.crc32(f.encode()) for f in runs_of(" ".join(long))}


@pytest.mark.parametrize("buckets", [1, 97])
def test_other_numbers_of_buckets(spark, buckets):
    docs = [(k, f"w{k} w{k % 3} common word {'more ' * 20}") for k in range(40)]
    target = [(1, "w1 common word"), (2, None)]
    frame, other = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "doc_id long, text string")
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in ranked(weigh(frame, other, buckets=buckets), percent=30).collect()]
    assert sorted(got) == sorted(by_force(docs, target, buckets, percent=30))
