"""Decontamination, licences, quality, shards and archives on small cases."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import decontamination, sharding
from concord.llm.common import shared_path
from concord.llm.decontamination import contamination, decontaminated
from concord.llm.license_texts import BODIES
from concord.llm.licenses import license_scan
from concord.llm.quality import FEATURES, Model, fit_quality, passages, quality_score
from concord.llm.sharding import kd_shards, leaves_for, sharded
from concord.llm.warc import page_records, register
from concord.llm.warc_format import EQUAL_PAYLOAD, record_bytes

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def leaks_by_force(rows, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        own = word(text)
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k:k + size]), set()).add(item)
    out = []
    for name, text in rows:
        own, hit, found = word(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if tuple(own[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(own[k:k + size])]
        out.append((name, len(own), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("largest", [50_000, 2])
def test_contamination(spark, monkeypatch, largest):
    monkeypatch.setattr(decontamination, "LARGEST_SET", largest)
    rows = [(1, f"before. {ITEM.upper()}! after"), (2, ITEM[:40]), (3, None), (4, ""), (5, "short item here"), (6, f"{ITEM} {ITEM} x {ITEM}"), (7, "Éalpha beta"),
            (8, "nothing at all"), (8, "nothing at all"), (None, "a short item, twice: short item"), (9, f"y {ITEM}"), (9, f"y {ITEM}")]
    items = [(1, ITEM), (10, "Short item"), (2, None), (3, " .. "), (None, "nothing at all"), (4, "twice")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in contamination(docs, bench).collect()), key=str)
    assert got == leaks_by_force(rows, items)
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    kept = decontaminated(docs, bench)
    clean = sorted((i for i, _, hit, _ in leaks_by_force(rows, items) if not hit), key=str)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == clean


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, f"-- before. {ITEM} after, all", 9), (2, "clean", 5), (3, None, 0)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminated(docs, bench, remove="spans").collect()}
    assert got == {1: ("-- before. after, all", 21), 2: ("clean", 5), 3: (None, 0)}


def test_licences(spark):
    rows = [(1, "prose\nreleased under the mit license\nmore"), (2, "Released under the Mozilla license"), (3, None), (4, ""), (5, "This work is licensed under the GNU General Public License, version 2.")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:1]], "doc_id long, text string, matches int")
    got = sorted((r.doc_id, r.n_units, [(round(m.dice, 3), m.license) for m in r["matches"]]) for r in license_scan(docs).collect())
    assert got[:2] == [(1, 4, [(1.0, "MIT")])] * 2
    assert got[2:] == [(2, 1, []), (3, 0, []), (4, 0, []), (5, 1, [(1.0, "GPL-2.0")])]
    assert license_scan(docs.limit(0)).count() == 0


def test_licences_wrapped_embedded_and_in_full(spark):
    prose = "Some prose that goes on about nothing much for more than a few words.\n"
    texts = {
        "Apache-2.0": [f"{prose}Licensed under the Apache License,\nVersion 2.0.\n{prose}"],
        "GPL-3.0": [f"{prose}This work is licensed under the GNU General Public\nLicense, version 3.\n{prose}",
                    "This work is licensed under the GNU General Public\nLicense, version 3."],
        "MIT": ["Words before it, released under the MIT License. And then there are many more words on this line after it.",
                f"{prose}# Released under\n# the MIT\n# License.\n{prose}"],
        "": ["Mine; licensed under CC BY-NC 3.0. and so on, for any number of words", "Released under the Mozilla license, as some say, and not any other", prose],
        "ISC,MIT": ["Parts are released under the MIT License. Others are released under the ISC License. That is all there is to say about it."],
    }
    cases = [(wanted, text) for wanted, own in texts.items() for text in own]
    cases += [(name, f"{prose}Copyright (c) 2020 A. Holder\n\n{text}\n{prose}") for name, text in BODIES]
    cases += [(name, "Copyright 1999 Somebody. " + " ".join(text.split()) + " " + prose * 3) for name, text in BODIES]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    names = [",".join(sorted({m.license for m in got[k]["matches"]})) for k in range(len(cases))]
    assert names == [wanted for wanted, _ in cases]
    assert [len(got[k]["matches"]) for k in range(5)] == [1] * 5 and len(got[8]["matches"]) == 2
    own = license_scan(docs.limit(3), {"X": "some prose that goes"}).collect()
    assert [[m.license for m in r["matches"]] for r in sorted(own)] == [["X", "X"], ["X", "X"], []]


def test_slopes_of_the_model():
    rng = np.random.default_rng(0)
    bags, labels = [rng.normal(size=(k, FEATURES)) for k in (1, 3, 2)], np.array([0, 1, 1.0])
    model = Model().fit(bags, labels, steps=3)
    x, starts = (np.concatenate(bags) - model.mean) / model.scale, np.array([0, 1, 4])

    def loss():
        score = model._forward(x, starts)["score"]
        return -(labels * np.log(score) + (1 - labels) * np.log(1 - score)).mean()

    for key, slope in model._slopes(x, starts, labels).items():
        if key != "c0":
            at, before = (0,) * slope.ndim, model.weights[key][(0,) * slope.ndim]
            model.weights[key][at] = before + 1e-5
            up = loss()
            model.weights[key][at] = before - 1e-5
            assert abs((up - loss()) / 2e-5 - slope[at]) < 1e-6
            model.weights[key][at] = before


def test_quality_of_held_out_rows(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/labels.parquet")
    model = fit_quality(docs, labels)
    scored = docs.select("doc_id", quality_score(model).alias("score")).join(labels, "doc_id").collect()
    out = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 50 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in out]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "x"), (4, "word " * 30000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in odd.select("doc_id", quality_score(model).alias("score")).collect()}
    assert scores[1] == scores[2] == scores[3] and all(0 <= s <= 1 for s in scores.values())
    assert passages("word " * 130).shape == (3, FEATURES)
    assert fit_quality(docs, labels.limit(0)).scores([passages("x")]).tolist() == [0.5]


def test_shards(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x"), (5, "same"), (5, "same"), *[(9000 + k, "copy of a text " * 30) for k in range(300)]], "doc_id long, text string")
    rows = sharded(docs.unionByName(odd)).collect()
    assert len(rows) == docs.count() + 305 and {r.shard for r in rows} == set(range(16))
    sizes = {}
    for shard in range(16):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[shard] = sum(r.size for r in own)
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= largest + 0.1 * sum(sizes.values()) / 16
    assert {r.text_crc32 for r in rows if r.doc_id in (-1, -2)} == {0}
    assert sharded(docs.limit(0)).count() == 0
    assert leaves_for(odd, 10**9) == 1 and leaves_for(odd.limit(0), 10) == 1


def test_tree_of_three_leaves(spark):
    rows = spark.range(900).select(F.lit(1).cast("long").alias("size"), F.col("id").alias("text_hash"), F.col("id").alias("id_key"), (F.col("id") % 7).alias("axis"))
    got = {r.shard: r["n"] for r in kd_shards(rows, ["axis"], 3).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 300, 1: 300, 2: 300}
    assert sharding.BINS > 1


def test_archives(spark):
    register(spark)
    big = "<p>" + "large page " * 20000
    rows = [(k, f"http://x/{k}", big if k % 3 == 0 else f"page {k // 2}") for k in range(40)] + [(None, None, None), (50, "u", ""), (51, "u", "page 1"), (51, "u", "page 1"), (-5, "é", "minus")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    path = shared_path(spark, "warc")
    page_records(pages).repartition(3).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path).collect()
    assert len(read) == len(rows)
    largest = {}
    for page, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -100), -100 if page is None else page)
    answers = [r for r in read if r.record_type == "response"]
    assert len(answers) == len(largest) + 1  # the repeated row 51
    for r in answers:
        assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert {bytes(r.payload).decode() for r in answers} == set(largest)
    ids = {r.payload_digest: r.record_id for r in answers}
    assert all(r.refers_to == ids[r.payload_digest] and r.payload is None for r in read if r.record_type == "revisit")
    pushed = spark.read.format("warc").option("blocks", "false").load(path).filter("record_type = 'revisit' and target_uri = 'http://x/0'")
    assert [r.payload_bytes for r in pushed.collect()] == [len(big)]
    small = page_records(pages, least=100).filter("record_type = 'revisit'").count()
    assert small == 13
    page_records(pages.limit(0)).write.format("warc").mode("append").save(empty := shared_path(spark, "warc"))
    assert spark.read.format("warc").load(empty).count() == 0


def test_archive_without_compression(spark, tmp_path):
    register(spark)
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    data = record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<a>")], b"made: by\r\n hand") + record_bytes(
        [("WARC-Type", "response"), ("WARC-Record-ID", "<b>"), ("WARC-Profile", EQUAL_PAYLOAD)], block)
    (tmp_path / "one.warc").write_bytes(data)
    got = spark.read.format("warc").load(f"file://{tmp_path}").filter("record_type = 'response'").collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("b", b"hello")]
