"""Packs whole documents into windows of token ids by best-fit decreasing.

Every document is tokenized, ends with one end id, and is cut into full windows and a rest. Lengths are whole
numbers up to the window, so all that best-fit decreasing needs to know about the corpus is how many pieces of each
length there are: at most `window` counts, whatever the size of the corpus. The driver runs the method on these
counts: lengths in falling order; a segment tree indexed by remaining capacity finds the tightest open window; equal
pieces that go to equal windows are placed in one step. The plan is a list of runs (pieces a to b of length L go to
windows from w on); its length is bounded by the window, not by the corpus. Spark then numbers the pieces of each
length over the whole corpus (count per partition, prefix sums, place within the partition) and looks up their places.
So windows are the same as those of one big best-fit decreasing run over all pieces, and no piece passes through the
driver.

Ties: of open windows with equal remaining capacity the one opened first is taken; of equal pieces, those of earlier
partitions, and there earlier rows, go first. Null and empty texts are documents of the end id alone. Repeated rows and null ids are packed as they are. Extra
columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.bpe import Merger
from concord.llm.common import arrow_batches, bounded_batches, query, stored, table

KNOWN_PIECES = 500_000
_tokenizers: dict[str, PieceIds] = {}


class PieceIds:
    """Token ids of texts; one per Python worker. Ids of known pieces lie in one array."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.sizes, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's."""
        own = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        flat = [p for pieces in own for p in pieces]
        at = list(map(self.known.get, flat))
        if None in at:
            if len(self.known) > KNOWN_PIECES:
                self._forget()
            self._learn([p for p in dict.fromkeys(flat) if p not in self.known])
            at = list(map(self.known.__getitem__, flat))
        at = np.array(at, dtype=np.int64)
        sizes = self.sizes[at]
        starts = (np.cumsum(self.sizes) - self.sizes)[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        upto = np.append(0, ends)[np.cumsum([len(pieces) for pieces in own])] if own else np.zeros(0, np.int64)
        return ids, np.diff(np.append(0, upto))

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if self.merger.plain(p)]
        rest = [p for p in pieces if not self.merger.plain(p)]
        ids, sizes = self.merger.ids_plain(plain) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        others = [e.ids for e in self.merger.library.encode_batch(rest, add_special_tokens=False)]
        for piece in (*plain, *rest):
            self.known[piece] = len(self.known)
        self.sizes = np.concatenate([self.sizes, sizes, np.array([len(x) for x in others], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids, *(np.array(x, dtype=np.int32) for x in others)])


class OpenWindows:
    """Windows by remaining capacity; a segment tree over the capacities finds the tightest one that fits.

    Of windows with equal capacity the one opened first, that with the lowest number, is taken."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = np.zeros(2 * self.leaves, dtype=bool)
        self.heaps: list[list[list[int]]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int) -> None:
        node = self.leaves + capacity
        self.some[node] = bool(self.heaps[capacity])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def add(self, capacity: int, first: int, number: int) -> None:
        if number and capacity:
            heapq.heappush(self.heaps[capacity], [first, number])
            self._mark(capacity)

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of an open window that is at least `length`."""
        node = self.leaves + length
        if self.some[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Removes up to `most` windows with this capacity, lowest numbers first: the first window, and how many.

        Runs do not overlap, so the run with the lowest first window holds the lowest numbers."""
        first, size = heapq.heappop(self.heaps[capacity])
        number = min(size, most)
        if number < size:
            heapq.heappush(self.heaps[capacity], [first + number, size - number])
        self._mark(capacity)
        return first, number


def best_fit_plan(counts: dict[int, int], window: int) -> np.ndarray:
    """Runs (length, first piece, first window, pieces a window gets, offset in the window), lengths falling.

    A run goes on to the next run of its length; piece i of it lies in window `first + i // pieces`.
    """
    opened, windows, runs = OpenWindows(window), 0, []
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            capacity = opened.tightest(length)
            fresh = capacity is None
            capacity = window if fresh else capacity
            each = min(capacity // length, left)  # the window it just went to stays the tightest one
            wanted = left // each
            if fresh:
                first, number, windows = windows, wanted, windows + wanted
            else:
                first, number = opened.take(capacity, wanted)
            runs.append((length, done, first, each, window - capacity))
            opened.add(capacity - each * length, first, number)
            done, left = done + each * number, left - each * number
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def pieces(documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, ids: bool = False) -> DataFrame:
    """The pieces of all documents, numbered within partition and length. `ids`: with the ids themselves."""
    bounded_batches(documents.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids array<int>" * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = PieceIds(tokenizer)
        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in arrow_batches(batches):
            names = batch.column(0).to_pylist()
            tokens, sizes = _tokenizers[tokenizer].encode(batch.column(1).to_pylist())
            rows: list[tuple] = []
            at = 0
            for name, size in zip(names, sizes.tolist()):
                own = np.append(tokens[at:at + size], end_id).astype("<u4")
                at += size
                for start in range(0, len(own), window):
                    piece = own[start:start + window]
                    row = (name, start, len(piece), zlib.crc32(piece.tobytes()), len(own), part, seen[len(piece)])
                    rows.append((*row, piece.tolist()) if ids else row)
                    seen[len(piece)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES[: len(rows[0])])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"]
TYPES = [*[pa.int64()] * 5, pa.int32(), pa.int64(), pa.list_(pa.int32())]


def pack(documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = stored(pieces(documents, tokenizer, window, end_id, ids), "pieces")
    numbers = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    plan = best_fit_plan(counts, window)
    # One ordered key for (length, number within the length): lengths fall in the plan, so they are negated.
    keys = ((window - plan[:, 0]) << 44) | plan[:, 1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = plan[np.searchsorted(keys, ((window - length) << 44) | nth, side="right") - 1]
            inside = nth - run[:, 1]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(run[:, 2] + inside // run[:, 3]), pa.array(run[:, 4] + inside % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbers.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(placed, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The windows of `pack(..., ids=True)`: one row per sequence with its ids and the documents in it."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"), F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"))


@query("op1_packing")
def op1_packing(spark, folder):
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
