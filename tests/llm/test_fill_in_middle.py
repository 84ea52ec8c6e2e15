"""Fill-in-the-middle against a plain split into lines, and back."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import fill_in_middle as fim
from concord.llm.fill_in_middle import Chunks, chunk_ends, fill_in_middle, rearranged, restored, transformed

PIECES = st.lists(st.sampled_from(["\n", "\n", "line", "é", "日", "<", "<P", ">", "P>", "<S>", "<M", "x" * 40, " ", "\r", "\U0001f600", "\x00"]), max_size=40).map("".join)


def by_force(name, text, rate=100, spm=50):
    text = text or ""
    h1, h2, h3, h4 = (int(hashlib.sha256(f"7:{'' if name is None else name}".encode()).hexdigest()[k:k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(PIECES, max_size=5), name=st.integers(-3, 10**9), bits=st.sampled_from([0, 1, 3]), limit=st.sampled_from([0, 50, 10**6]), longest=st.sampled_from([1, 5, 1000]))
def test_cuts_by_chunks(texts, name, bits, limit, longest):
    before = fim.CHUNK_BITS, fim.LONGEST, fim.SECTION
    fim.CHUNK_BITS, fim.LONGEST, fim.SECTION = bits, longest, 64
    try:
        chunks = Chunks(limit)
        digest = hashlib.sha256(f"7:{name}".encode()).hexdigest()
        for text in texts + texts[::-1]:
            for rate, spm in ((100, 50), (100, 0), (100, 100), (0, 50)):
                assert transformed(chunks, text, digest, rate, spm) == by_force(name, text, rate, spm)
    finally:
        fim.CHUNK_BITS, fim.LONGEST, fim.SECTION = before


def test_equal_stretches_share_chunks():
    import random

    random.seed(3)
    body = "".join(random.choice("abcdefgh \n") for _ in range(60_000)).encode()
    cut = lambda data: {data[a:b] for a, b in zip([0, *chunk_ends(data)], chunk_ends(data))}
    one, two = cut(b"some words first " + body), cut(b"others, and more of them, before " + body)
    assert len(one & two) >= len(one) - 2 and len(one) > 20
    assert max(map(len, cut(b"z" * 100_000))) <= fim.LONGEST
    sections = fim.SECTION
    fim.SECTION = 1000
    try:
        assert chunk_ends(body) == (setattr(fim, "SECTION", sections), chunk_ends(body))[1]
    finally:
        fim.SECTION = sections


def test_round_trip_in_spark(spark):
    rows = [(k, "".join(f"line {j} of {k}\n" for j in range(k % 7)) + "end" * (k % 2)) for k in range(60)]
    rows += [(None, None), (None, "a\nb\nc"), (1, ""), (2, "with <S> inside\nx"), (3, "\n\n\n"), (4, "no line end"), (5, "<P\n><S\n>"), (5, "<P\n><S\n>"), (6, "line é\n" * 200_000)]
    docs = spark.createDataFrame([(i, t, "mine", 9) for i, t in rows], "doc_id long, text string, form string, n int")
    got = docs.select("doc_id", "text", fill_in_middle().alias("cut")).select("*", restored("cut.output", "cut.form").alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r.cut) == by_force(r.doc_id, r.text) and r.back == (r.text or "")
    assert {r.cut.form for r in got} == {"plain", "psm", "spm"}
    new = rearranged(docs.withColumnRenamed("text", "a.text"), text="a.text")
    assert new.columns == ["doc_id", "a.text", "form", "n"]
    assert sorted(((r[0], r[1]) for r in new.collect()), key=str) == sorted(((i, None if t is None else by_force(i, t)[4]) for i, t in rows), key=str)
    assert docs.limit(0).select(fill_in_middle().alias("cut")).count() == 0
    assert docs.filter(F.col("doc_id") == 10).select(fill_in_middle(rate=0)["form"].alias("form")).first().form == "plain"
