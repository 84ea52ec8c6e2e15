"""Hyperdimensional profiles against vectors written out, and on rows they have not learned from."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import language_id
from concord.llm.language_id import Profiles, bundles, fit_languages, held_out, kinds, language_of, letter_signs, permuted

DIMS = 128


def vector(point, times=0):
    signs = letter_signs(np.array([point]), DIMS)
    for _ in range(times):
        signs = permuted(signs)
    return 1.0 - 2 * np.unpackbits(signs.view(np.uint8))


def by_force(text):
    points = [p if kinds()[p] else 0 for p in map(ord, f" {(text or '').lower()} ")]
    total = np.zeros(DIMS)
    for a, b, c in zip(points, points[1:], points[2:]):
        if b:
            total += vector(a, 2) * vector(b, 1) * vector(c)
    return total


TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("abÉé ñ.,1हि", max_size=40)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts=TEXTS, section=st.sampled_from([1, 3, 1 << 19]), grams=st.sampled_from([1, 5, 4096]))
def test_bundles(texts, section, grams):
    before = language_id.SECTION, language_id.GRAMS
    language_id.SECTION, language_id.GRAMS = section, grams
    try:
        sums, lettered = bundles(texts, list(range(len(texts))), len(texts), DIMS)
    finally:
        language_id.SECTION, language_id.GRAMS = before
    for k, text in enumerate(texts):
        assert (sums[k] == by_force(text)).all()
        assert lettered[k] == any(kinds()[ord(c)] == language_id.LETTER for c in (text or "").lower())


def test_permutation_moves_every_dimension():
    signs = letter_signs(np.arange(3), DIMS)
    once = permuted(signs)
    assert (np.unpackbits(once.view(np.uint8), axis=1).sum(1) == np.unpackbits(signs.view(np.uint8), axis=1).sum(1)).all()
    back = signs
    for _ in range(DIMS):
        back = permuted(back)
    assert (back == signs).all() and abs((vector(97) * vector(98)).sum()) < DIMS / 2


def test_held_out_rows(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    profiles = fit_languages(docs.filter(~held_out()))
    assert profiles.languages == ["de", "en", "es", "fr"]
    rows = docs.select("doc_id", "lang", held_out().alias("out"), language_of(profiles).alias("found")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r.found.lang_pred == r.lang for r in rows if r.out]
    assert len(out) > 250 and np.mean(out) > 0.98 and all(0 <= r.found.score <= 1 for r in rows)


def test_odd_rows(spark):
    learned = [("the and of to in that", "en"), ("der die und ist nicht", "de"), ("ignored", None), (None, "en"), ("", "xx")]
    rows = spark.createDataFrame([(k, t, g, 1.0, "x") for k, (t, g) in enumerate(learned)], "doc_id long, text string, lang string, score double, lang_pred string")
    profiles = fit_languages(rows)
    assert profiles.languages == ["de", "en", "xx"]  # xx has no runs: a prototype without length, cosine 0
    texts = [None, "", " 12 %% ", "́", "UND NICHT", "that of", "that of", "the " * 400_000, "日"]
    frame = spark.createDataFrame([(t, 0.5) for t in texts], "text string, score double")
    got = [tuple(r.found) for r in frame.coalesce(1).select(language_of(profiles).alias("found")).collect()]
    assert got[:4] == [("und", 0.0)] * 4 and [g[0] for g in got[4:8]] == ["de", "en", "en", "en"] and got[5] == got[6]
    assert got[8][0] in ("de", "en", "xx")
    tie = Profiles(["a", "b"], np.ones((2, 64)) / 8, 64)
    assert tie.identify(["word"])[0] == ["a"]
    nothing = fit_languages(rows.limit(0))
    assert nothing.identify(["word"]) == (["und"], [0.0]) and frame.limit(0).select(language_of(profiles)).count() == 0
    with pytest.raises(ValueError):
        fit_languages(rows, most=1)
    with pytest.raises(ValueError):
        fit_languages(rows, dims=100)


def test_prototypes_do_not_depend_on_partitions(spark):
    rows = spark.range(300).select(F.concat(F.lit("some words "), F.col("id").cast("string"), F.lit(" und ein wort")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    one, other = fit_languages(rows.repartition(1)), fit_languages(rows.repartition(7))
    assert (one.prototypes == other.prototypes).all()
