"""Near duplicates, repeated passages and embeddings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from concord.llm import embedding_dedup, near_dedup
from concord.llm.components import components
from concord.llm.decontamination import decontaminated
from concord.llm.fill_in_middle import rearranged
from concord.llm.importance import resampled
from concord.llm.suffix_dedup import SHORTER, repeats_report, without_repeats


def roots(number, links):
    up = list(range(number))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    return [root(x) for x in range(number)]


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k:k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set()


def near_by_force(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = roots(len(rows), links)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted(((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows))), key=str)


def near_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(70):  # one large group of near copies, some beyond the threshold
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50)))) for k in range(60)]
    rows += [(200 + k, rows[k][1].upper().replace(" ", "\t\n")) for k in range(8)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "alone"), (304, "Alone"), (305, "two words"), (305, "two words"), (None, "two words"), (None, "nobody has these words")]
    return rows


@pytest.mark.parametrize("chunk", [256, 5])
@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size).collect()), key=str)
    assert got == near_by_force(rows, size)


def test_one_of_each(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.one_of_each(docs, 5).collect()
    names = {(i, c) for i, _, c in near_by_force(rows, 5)}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({i for i, c in names if i is not None and i == c})
    assert near_dedup.near_duplicates(docs.limit(0), 5).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(50)]
    random.Random(1).shuffle(chain)
    star = [(100, 100 + k) for k in range(1, 40)]
    frame = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{100 + k: 100 for k in range(40)}}


def passages_by_force(texts, span):
    seen = Counter(b[p:p + span] for b in ((t or "").encode() for t in texts) for p in range(len(b) - span + 1))
    out = []
    for text in texts:
        data = (text or "").encode()
        hit = bytearray(len(data))
        for p in range(len(data) - span + 1):
            if seen[data[p:p + span]] > 1:
                hit[p:p + span] = b"\1" * span
        runs = len(re.findall(b"\1+", bytes(hit)))
        kept = bytes(c for c, h in zip(data, hit) if not h)
        out.append((len(data), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(110) for _ in range(4)]
    texts = [text(rng.randint(1, 60)) + rng.choice(shared)[rng.randint(0, 90):] + text(rng.randint(0, 60)) for _ in range(60)]
    texts += ["a" * 500, "a" * 450, "ab" * 300, "x" * 399, "x" * 400, None, "", shared[0] * 2, "é" * 250, "é" * 250, texts[0], texts[0] + "z"]
    texts += [texts[1][:300] + "#" + texts[1][301:], "ab" * 299]
    docs = spark.createDataFrame([(k % 80 if k else None, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_chars long, spans string")
    got = sorted(tuple(r)[1:] for r in repeats_report(docs).collect())
    long, short = passages_by_force(texts, 400), passages_by_force(texts, SHORTER)
    assert got == sorted((*a, b[1], b[2]) for a, b in zip(long, short))
    kept = without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    for r in kept.collect():
        assert r.text is None or r.n_chars in (1, len(r.text))
    assert repeats_report(docs.limit(0)).count() == 0


def vectors_by_force(rows, least=0.95):
    usable = [i for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)]
    links = []
    for dims in {len(rows[i][1]) for i in usable}:
        own = [i for i in usable if len(rows[i][1]) == dims]
        points = np.array([rows[i][1] for i in own], dtype=float)
        points /= np.abs(points).max(axis=1, keepdims=True)
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        links += [(own[a], own[b]) for a, b in np.argwhere(points @ points.T >= least) if a != b]
    number, group = Counter(a for a, _ in links), roots(len(rows), links)
    least_of = defaultdict(list)
    for i, g in enumerate(group):
        least_of[g].append(rows[i][0])
    return sorted((rows[i][0], number[i], min(least_of[group[i]])) for i in range(len(rows)))


@pytest.mark.parametrize("block,pivots", [(4096, 64), (30, 16)])
def test_embeddings(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PIVOTS", pivots)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    rows = [(k, (base[k % 6] + rng.normal(size=8) * 0.05 * (k % 5)).tolist()) for k in range(240)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1005, [1.0, 2.0]),
             (1006, [2.0, 4.0]), (1007, [1e200, 2e200]), (1008, []), (1009, rows[3][1]), (1010, rows[3][1]), (1011, [1e-200, 2e-200])]
    frame = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, cls int")
    assert sorted(map(tuple, embedding_dedup.embedding_components(frame).collect())) == vectors_by_force(rows)
    assert embedding_dedup.embedding_components(frame.limit(0)).count() == 0


def test_embeddings_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 4)
    rng = np.random.default_rng(1)
    rows = []
    for dims in range(3, 23):
        base = rng.normal(size=dims)
        rows += [(10 * dims + k, (base + 0.01 * k * rng.normal(size=dims)).tolist()) for k in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup.embedding_components(frame).collect())) == vectors_by_force(rows)


@pytest.mark.parametrize("chunk", [64, 5])
@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_of_large_groups(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "DIRECT", 8)
    confirmed, calls = near_dedup._confirmed, []
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *rest: calls.append(pairs.count()) or confirmed(pairs, *rest))
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size).collect()), key=str)
    assert got == near_by_force(rows, size)
    assert sum(calls) > 8


def test_columns_with_clashing_names(spark):
    """Whatever an operator calls its own columns, a document's column of that name comes back as it was."""
    names = ["_id", "_text", "_k_id", "_k_text", "_cut", "_spans", "_hit_id", "_hit_text", "k_id", "k_text", "row", "spans", "cut", "gone", "n", "runs", "digit", "wide", "weight",
             "run", "place", "lines", "component", "component_id", "cls", "band", "bands", "hub", "items", "w", "f", "i", "a", "b", "a.dot", "back`tick", "_drawn"]
    passage = " ".join(f"word{k}" for k in range(90))
    texts = [f"first {passage}", f"second {passage} and more {passage[:50]}", "other text " * 9, "other text " * 9, None]
    rows = [(k if k != 3 else 2, t, 0, *[f"{name} {k}" for name in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "n_chars int", *[f"`{n.replace('`', '``')}` string" for n in names]]))
    bench = spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12")], "item_id long, text string")
    frames = [near_dedup.one_of_each(docs), without_repeats(docs), decontaminated(docs, bench), decontaminated(docs, bench, remove="spans"), resampled(docs, bench, percent=100, least_words=1), rearranged(docs)]
    counts = []
    for frame in frames:
        assert frame.columns == docs.columns and [t for _, t in frame.dtypes] == [t for _, t in docs.dtypes]
        kept = frame.collect()
        counts.append(len(kept))
        for r in kept:
            assert {v for n, v in zip(names, r[3:])} in [{f"{n} {k}" for n in names} for k in range(len(rows)) if rows[k][0] == r.doc_id]
    assert counts == [3, 5, 3, 5, 4, 5]


def test_passages_of_a_little_over_fifty_words(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [prose(n) for n in (51, 52, 55, 60, 65)]
    texts = [f"{prose(80)} {p} {prose(60)}" for p in passages for _ in range(6)] + [prose(150) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["repeated_passages"]
    kept = {r.doc_id: r.text for r in stage(spark, docs, "").collect()}
    for k, text in enumerate(texts):
        passage = passages[k // 6] if k < 30 else None
        assert (kept[k] == text) if passage is None else (passage[3:-3] not in kept[k] and len(kept[k]) < len(text) - len(passage) + 3)
