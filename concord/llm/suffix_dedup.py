"""Removes repeated passages: every byte inside a string of `span` bytes that also starts somewhere else.

Depth-limited radix sort of suffixes: a suffix matters only through its first `span` bytes, so suffixes are dealt
into groups by digits, most significant first, and a suffix alone in its group is dropped at once; groups that last
through all digits are exactly the repeated strings. Digits are hashes of whole stretches of bytes (sorting needs
equality only), and suffixes that move through the passes together are kept as one run:

1. The first digit of a suffix is the stretch of `span + 1 - ANCHORS` bytes that begins at its anchor, the place with
   the smallest hash of eight bytes among its first ANCHORS places. Equal strings have equal anchors, and neighbouring
   suffixes mostly share theirs, so there is about one row for each ANCHORS / 2 bytes of text. Digits that occur once
   end here; runs of suffixes that agree in all the bytes they cover are repeated as a whole.
2. Other runs are taken apart into blocks of BLOCK suffixes; the second digit is what the suffixes of a block have in
   common, and again blocks end, or are repeated as a whole.
3. Blocks that differ where their second digits agree (the borders of repeats) are taken apart; the third digit is the
   whole string of each suffix, by a 128-bit hash.

Each pass is an aggregation with partial sums and a join, both of which Spark splits for a frequent digit; no group is
gathered in a task. Texts move by their key for passes 2 and 3 and for cutting.

Texts are UTF-8 bytes; null and empty ones, and those under `span` bytes, keep all. Rows are texts of their own: a
repeated row is a second place for each of its strings. Extra columns are not read. An empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import arrow_batches, bounded_batches, marked, query, row_keys, stored, table, unwrapped, wrapped

SPAN = 400
SHORTER = 240  # bytes: passages of over 50 words are mostly longer
ANCHORS = 128
BLOCK = 8
PLACE_BITS = np.uint64(31)  # of a joined text; the other 33 bits compare hashes, ties go to the left
RANGE = (1 << 32) - 1
DIGIT_BITS = 25  # of the bitmap of digits that occur twice


def runs_of_suffixes(texts: list[bytes], span: int, anchors: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts; and for each run of suffixes with one anchor: text, anchor, first and last suffix (joined places)."""
    joined = b"".join(texts) + bytes(8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    number = len(joined) - 8
    if number >= 1 << int(PLACE_BITS):
        raise ValueError("texts of a batch are too long together")
    eight = np.ndarray((number,), dtype="<u8", buffer=joined, strides=(1,))
    keys = eight * np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys >> PLACE_BITS << PLACE_BITS) | np.arange(number, dtype=np.uint64)
    reach = 1
    while 2 * reach <= anchors:
        keys = np.minimum(keys[: len(keys) - reach], keys[reach:]) if len(keys) > reach else keys[:0]
        reach *= 2
    if reach < anchors:
        rest = anchors - reach
        keys = np.minimum(keys[: len(keys) - rest], keys[rest:]) if len(keys) > rest else keys[:0]
    many = np.maximum(sizes - span + 1, 0)
    owner = np.repeat(np.arange(len(texts)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends - sizes, many)
    anchor = (keys[place] & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(anchor))[: len(first)] - 1
    return joined, owner[first], anchor[first], place[first], place[last]


def _bytes(text: str | bytes | None) -> bytes:
    return text.encode() if isinstance(text, str) else text or b""


def packed(first: np.ndarray, more: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A run in one number: its first suffix, how many more, and how far the anchor is."""
    return (first << 32) | (more << 16) | anchor


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _runs(texts: DataFrame, span: int, anchors: int) -> DataFrame:
    """k_id, k_text, digit (first), wide (second), run (see `packed`) of each run."""
    stretch = span + 1 - anchors

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = xxhash.xxh3_64_intdigest
        for batch in arrow_batches(batches, 1_000_000):
            own = [_bytes(t) for t in batch.column(2).to_pylist()]
            starts = np.cumsum([0, *map(len, own)])
            joined, owner, anchor, lo, hi = runs_of_suffixes(own, span, anchors)
            view = memoryview(joined)
            digit = [_signed(hash_of(view[a:a + stretch])) for a in anchor.tolist()]
            wide = [_signed(hash_of(view[f:u + span], a - f)) for a, f, u in zip(anchor.tolist(), lo.tolist(), hi.tolist())]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(digit, pa.int64()), pa.array(wide, pa.int64()),
                 pa.array(packed(lo - starts[owner], hi - lo, anchor - lo))], names=["k_id", "k_text", "digit", "wide", "run"])

    return texts.select("k_id", "k_text", "text").mapInArrow(rows, "k_id long, k_text long, digit long, wide long, run long")


def _taken_apart(lists: DataFrame, hashed, names: list[str]) -> DataFrame:
    """The rows that `hashed(text, run)` gives for the runs listed with each text: hashes, a piece, and the run's weight."""
    fields = [*names, "k_id", "k_text", "run", "weight"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for text, k_id, k_text, runs in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "k_id", "k_text", "runs"))):
                view = memoryview(_bytes(text))
                for run in runs:
                    out += [(*hashes, k_id, k_text, piece, run["weight"]) for hashes, piece in hashed(view, run["run"])]
                    if len(out) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=fields)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=fields)

    return lists.mapInArrow(rows, ", ".join(f"{f} long" for f in fields))


def _blocks(span: int):
    """Cuts a run into pieces of BLOCK suffixes, counted from the anchor. Hashes: what all suffixes of the block have in
    common (the same for blocks of other runs at the same place), and what those of the piece cover together."""
    hash_of = xxhash.xxh3_64_intdigest

    def hashed(view: memoryview, run: int) -> Iterator[tuple[tuple[int, int], int]]:
        first, more, anchor = run >> 32, (run >> 16) & 0xFFFF, run & 0xFFFF
        for block in range((anchor - more) // BLOCK, anchor // BLOCK + 1):
            lo = max(first, first + anchor - BLOCK * block - BLOCK + 1)
            hi = min(first + more, first + anchor - BLOCK * block)
            start = first + anchor - BLOCK * block
            common = hash_of(view[start:start - BLOCK + 1 + span], block + 1000)
            cover = hash_of(view[lo:hi + span], start - lo)
            yield (_signed(common), _signed(cover)), (lo << 32) | ((hi - lo) << 16)

    return hashed


def _strings(span: int):
    """Takes a piece apart: the hash of each suffix's string."""
    hash_of = xxhash.xxh3_128_intdigest

    def hashed(view: memoryview, run: int) -> Iterator[tuple[tuple[int, int], int]]:
        for place in range(run >> 32, (run >> 32) + ((run >> 16) & 0xFFFF) + 1):
            h = hash_of(view[place:place + span])
            yield (_signed(h >> 64), _signed(h & (1 << 64) - 1)), place << 32

    return hashed


def _passed(rows: DataFrame, digit: str, wide: str, name: str) -> tuple[DataFrame, DataFrame]:
    """One pass over rows (digit, wide, k_id, k_text, run, weight): repeated runs, and lists of those to take apart.

    A digit of weight 1 ends. If all rows of a digit are equal in `wide`, they are repeated. Of the others, rows
    that are equal in `wide` are repeated and one of them goes on with weight 2; rows that stand alone go on.
    """
    digits = rows.groupBy(digit).agg(F.sum("weight").alias("n"), F.min(wide).alias("least"), F.max(wide).alias("most"))
    # Stored, so that the join has nothing but shuffles on either side and Spark can split a frequent digit.
    shared = stored(digits.filter("n > 1").select(digit, (F.col("least") != F.col("most")).alias("mixed")), name)
    # Rows of digits that occur once end before they move.
    lasting = stored(marked(rows, shared, digit, bits=DIGIT_BITS).filter("seen").drop("seen").join(shared, digit), name)
    equal = stored(lasting.groupBy(digit, wide).agg(F.sum("weight").alias("n"), F.min(F.struct("k_id", "k_text", "run")).alias("one"), F.max("mixed").alias("mixed")), name)
    # One row for each lasting row, with the number of its equals.
    numbered = stored(lasting.select(digit, wide, "k_id", "k_text", "run").join(equal.select(digit, wide, "n"), [digit, wide]), name)
    whole = numbered.filter("n > 1").select("k_id", "k_text", "run")
    apart = equal.filter("mixed").select("one.*", F.least("n", F.lit(2)).alias("weight"))
    lists = apart.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("run", "weight")).alias("runs"))
    return whole, stored(lists, name)


def _texts_of(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """The texts that have a list, with it; of the others few move."""
    return marked(texts, lists, "k_id", "k_text").filter("seen").join(lists, ["k_id", "k_text"])


def repeated_spans(texts: DataFrame, span: int = SPAN, anchors: int = ANCHORS) -> DataFrame:
    """k_id, k_text, spans (start << 32 | end, not merged) of texts with repeated strings; `texts` has these keys, doc_id and text."""
    runs = _runs(texts, span, anchors).withColumn("weight", F.lit(1))
    whole, lists = _passed(runs, "digit", "wide", "runs")
    blocks = _taken_apart(_texts_of(texts, lists), _blocks(span), ["common", "cover"])
    parts, lists = _passed(stored(blocks, "blocks"), "common", "cover", "blocks")
    strings = stored(_taken_apart(_texts_of(texts, lists), _strings(span), ["h1", "h2"]), "strings")
    again = stored(strings.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).filter("n > 1").select("h1", "h2"), "strings")
    single = strings.join(again, ["h1", "h2"]).select("k_id", "k_text", "run")
    first = F.shiftright("run", 32)
    end = first + F.shiftright("run", 16).bitwiseAND(0xFFFF) + span
    pieces = whole.unionByName(parts).unionByName(single).select("k_id", "k_text", (F.shiftleft(first, 32) + end).alias("piece"))
    return stored(pieces.groupBy("k_id", "k_text").agg(F.collect_list("piece").alias("spans")), "spans")


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", *row_keys(), "text")


def merged(spans: list[int] | np.ndarray | None) -> list[tuple[int, int]]:
    """The spans as runs of bytes, in order; neighbours are one run."""
    out: list[tuple[int, int]] = []
    for piece in sorted(spans if spans is not None else ()):
        start, end = int(piece) >> 32, int(piece) & RANGE
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def covered(runs: list[tuple[int, int]]) -> int:
    return sum(e - s for s, e in runs)


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in runs)]
    starts = [*(s for s, _ in runs), len(data)]
    return b"".join(data[e:s] for e, s in zip(ends, starts))


def _report(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            out = []
            for name, text, spans, short in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "whole", "spans"))):
                data, runs, more = (text or "").encode(), merged(spans), merged(short)
                out.append((name, len(data), covered(runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest(), covered(more), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 4, pa.string(), *[pa.int64()] * 2])], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_short", "n_short_spans"]
    return rows.mapInArrow(cut, ", ".join(f"{c} {'string' if c == 'kept_sha256' else 'long'}" for c in names))


def _cut_text() -> Column:
    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else kept_bytes(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(text, spans)])

    return cut(F.col("row").getField("text"), "spans")


def without_repeats(documents: DataFrame, span: int = SPAN, anchors: int = ANCHORS) -> DataFrame:
    """The documents, in their own columns, without repeated passages; n_chars, where there is one, is counted anew.

    A cut inside a character leaves out the rest of the character.
    """
    bounded_batches(documents.sparkSession)
    spans = repeated_spans(keyed(documents), span, anchors)
    rows = marked(wrapped(documents, *row_keys()), spans, "k_id", "k_text")
    checked = rows.filter("seen").join(spans, ["k_id", "k_text"], "left")
    checked = checked.select("row", "spans", F.when(F.col("spans").isNotNull(), _cut_text()).alias("cut"))
    text = F.when(F.col("spans").isNull(), F.col("row").getField("text")).otherwise(F.col("cut"))
    new = {"text": text}
    if "n_chars" in documents.columns:
        number = F.col("row").getField("n_chars")
        new["n_chars"] = F.when(F.col("spans").isNull(), number).otherwise(F.length("cut").cast(documents.schema["n_chars"].dataType))
    return unwrapped(rows.filter("not seen"), documents.columns, {}).unionByName(unwrapped(checked, documents.columns, new))


REGIONS = "k_id long, k_text long, start long, region_key long, text binary"


def _regions(texts: DataFrame, span: int) -> DataFrame:
    """The runs of `spans` that hold a string of `span` bytes, as texts of their own: keys, start, a key, bytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in REGIONS.split(", ")]
        types = [*[pa.int64()] * 4, pa.binary()]
        for batch in arrow_batches(batches, 1_000_000):
            out = []
            for k_id, k_text, text, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k_id", "k_text", "text", "spans"))):
                data = _bytes(text)
                out += [(k_id, k_text, s, _signed(xxhash.xxh3_64_intdigest(f"{k_id} {k_text} {s}")), data[s:e]) for s, e in merged(spans) if e - s >= span]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=names)

    return texts.mapInArrow(rows, REGIONS)


def longer_spans(texts: DataFrame, short: DataFrame, span: int) -> DataFrame:
    """`repeated_spans` for `span`, from those of shorter strings: a string that repeats lies within one run of shorter
    ones that do, so only these runs are searched, and nothing around them."""
    regions = stored(_regions(_texts_of(texts, short), span), "regions")
    names = regions.select("k_id", "k_text", "start", "region_key").distinct()
    found = repeated_spans(regions.select(F.col("region_key").alias("k_id"), F.lit(0).cast("long").alias("k_text"), "text"), span)
    moved = F.transform("spans", lambda s: s + F.shiftleft("start", 32) + F.col("start"))
    whole = found.select(F.col("k_id").alias("region_key"), "spans").join(names, "region_key").select("k_id", "k_text", moved.alias("spans"))
    return whole.groupBy("k_id", "k_text").agg(F.flatten(F.collect_list("spans")).alias("whole"))


def repeats_report(documents: DataFrame, span: int = SPAN, shorter: int = SHORTER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; and n_short, n_short_spans, the bytes and runs
    that repeats of `shorter` bytes cover."""
    bounded_batches(documents.sparkSession)
    texts = keyed(documents)
    short = repeated_spans(texts, shorter, min(ANCHORS, shorter // 2))
    short = stored(short.join(longer_spans(texts, short, span), ["k_id", "k_text"], "left"), "spans")
    texts = marked(texts, short, "k_id", "k_text")
    nothing = F.lit(None).cast("array<long>")
    rows = texts.filter("not seen").select("doc_id", "text", nothing.alias("spans"), nothing.alias("whole"))
    return _report(rows.unionByName(texts.filter("seen").join(short, ["k_id", "k_text"], "left").select("doc_id", "text", "spans", "whole")))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, folder):
    return repeats_report(table(spark, folder, "documents"))
