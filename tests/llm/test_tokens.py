"""Token counts and packing against the tokenizers library, and best-fit decreasing piece by piece."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concord.llm.packing import PieceIds, best_fit_plan, pack, sequences
from concord.llm.token_counts import PieceCounter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "th", "er", "'s", "'RE", "I'LL", "Σ", "ς", "İ", "é", "é", "中文", "😀", " ", " ", "\x1c", "\x85", "​", "1", "٣", "½", "!", "--", "_", "\n", "\t",
       "<|endoftext|>", "<|startoftext|>", "<|END|>", "ﬁ", "ß", "К", "हिन्दी", "한국", "lolololol", "\r\n", "\x00", "ŉ", "K"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(PATH)


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6)), max_size=25))
def test_any_text_counts_as_the_library_does(library, counter, parts):
    text = "".join(parts)
    assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_ids_are_those_of_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD + ["hello", "reading ", "xyzzy"]) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 700, "ab" * 300, ""]
    ids, sizes = PieceIds(PATH).encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_counts_of_odd_rows(spark, library):
    rows = [(1, None, "x"), (None, "one two", "x"), (2, "", "x"), (3, "word " * 3000, "x"), (3, "word " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()))
    assert got == [(-1, 7, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 15000, 3000, True), (3, 15000, 3000, True)]
    assert token_counts(docs.limit(0), PATH).count() == 0


def plain_best_fit(lengths, window):
    """Best-fit decreasing, one piece at a time: the contents of the windows."""
    rests, windows = [], []
    for length in sorted(lengths, reverse=True):
        fitting = [(r, k) for k, r in enumerate(rests) if r >= length]
        if fitting:
            k = min(fitting)[1]
        else:
            k = len(rests)
            rests.append(window)
            windows.append([])
        rests[k] -= length
        windows[k].append(length)
    return windows


@example(counts={14: 1, 1: 1, 2: 1, 3: 3, 21: 1, 32: 1})  # two open windows with equal space
@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    plan = best_fit_plan(counts, 40)
    made = {}
    for number, (length, first, window, each, offset) in enumerate(plan.tolist()):
        following = plan[number + 1] if number + 1 < len(plan) and plan[number + 1][0] == length else None
        for piece in range(first, following[1] if following is not None else counts[length]):
            place = piece - first
            made.setdefault(window + place // each, []).append((offset + place % each * length, length))
    for own in made.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist()
        assert sum(n for _, n in own) <= 40
    want = plain_best_fit([n for n, k in counts.items() for _ in range(k)], 40)
    assert sorted(sorted(n for _, n in own) for own in made.values()) == sorted(sorted(w) for w in want)
    assert sorted(made) == list(range(len(want)))


def test_packing_round_trip(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 5000), (-3, "word " * 5000)], "doc_id long, text string")
    packed = pack(docs.unionByName(odd), PATH, ids=True)
    rows = packed.collect()
    texts = {r.doc_id: r.text for r in docs.unionByName(odd).collect()}
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    for r in rows:
        assert r.ids == ids[r.doc_id][r.start:r.start + r.length] and len(ids[r.doc_id]) == r.doc_tokens
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[-3])
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert max(map(len, whole.values())) <= 2048 and sorted(whole) == list(range(len(whole)))
    assert pack(docs.limit(0), PATH).count() == 0
