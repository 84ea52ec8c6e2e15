"""Counts the tokens of whole texts by merging the pairs of many words at the same time.

A text is cut at blanks and line ends (no token crosses them). The pieces a Python worker has not met yet go, as
ragged numpy arrays, through `Merger.count`: in each round every word merges its lowest-ranked pair; what is left
when no word has a pair is its number of tokens. Counts of pieces are kept in a table of bounded size; it only
saves work and decides nothing.

Null and empty texts have 0 bytes and 0 tokens. Rows are counted one by one, so repeated rows and null ids come
back as they are; extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.bpe import Merger
from concord.llm.common import arrow_batches, bounded_batches, query, table

KNOWN_PIECES = 600_000
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """Tokens of texts; one per Python worker."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.known: dict[str, int] = {"": 0}

    def count(self, texts: list[str | None]) -> list[int]:
        pieces = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        flat = [p for own in pieces for p in own]
        counts = list(map(self.known.get, flat))
        if None in counts:
            new = {p for p, c in zip(flat, counts) if c is None}
            if len(self.known) > KNOWN_PIECES:
                self.known = {"": 0}
                new = set(flat)
            self._learn(list(new))
            counts = list(map(self.known.__getitem__, flat))
        ends = np.cumsum([len(own) for own in pieces])
        return np.diff(np.append(0, np.append(0, np.cumsum(counts))[ends])).tolist() if texts else []

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if self.merger.plain(p)]
        if plain:
            self.known.update(zip(plain, self.merger.count_plain(plain).tolist()))
        for piece in set(pieces).difference(plain):
            words, specials = self.merger.words(piece)
            self.known[piece] = specials + int(self.merger.count(words).sum())


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for each row of `documents`."""
    bounded_batches(documents.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = PieceCounter(tokenizer)
        counter = _counters[tokenizer]
        for batch in arrow_batches(batches):
            tokens = counter.count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counts = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op5_token_counts")
def op5_token_counts(spark, folder):
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
