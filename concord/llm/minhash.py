"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from concord.llm.common import arrow_batches

BANDS, ROWS = 48, 6
UNIVERSE_BITS = 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Words between white space (ASCII), A-Z in lower case."""
    return (text or "").encode().translate(_LOWER).split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; fewer words than `size` are one shingle."""
    own = words(text)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    out = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out * _M1 + hashes[k:len(hashes) - width + 1 + k])
    return np.unique(out)


def _circle() -> np.ndarray:
    """The second permutation of the universe, with its beginning once more at the end."""
    order = np.random.default_rng(7).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return np.concatenate([order, order[: BANDS * ROWS]])


def signature(shingles: np.ndarray, circle: np.ndarray) -> np.ndarray:
    """All coordinates of a set: coordinate k is the least value of the second permutation, shifted by k, over the
    places that the first permutation gives to the shingles. The shifted values of a place lie side by side."""
    places = (mixed(shingles) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    shifted = np.lib.stride_tricks.sliding_window_view(circle, BANDS * ROWS)
    least = np.full(BANDS * ROWS, 1 << UNIVERSE_BITS, dtype=np.uint32)
    for start in range(0, len(places), 4096):
        np.minimum(least, shifted[places[start:start + 4096]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = mixed(keys * _M1 + column)
    return keys.view(np.int64)


_circles: list[np.ndarray] = []


def features(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, keys of the row, n_shingles, s1 and s2 (hash of the set), bands (null for an empty set)."""
    names = ["doc_id", "k_id", "k_text", "n_shingles", "s1", "s2", "bands"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _circles:
            _circles.append(_circle())
        for batch in arrow_batches(batches):
            counts, first, second, bands = [], [], [], []
            for text in batch.column(3).to_pylist():
                shingles = shingle_set(text, size)
                whole = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64).tolist()
                counts.append(len(shingles))
                first.append(whole[0])
                second.append(whole[1])
                bands.append(band_keys(signature(shingles, _circles[0])) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), *(pa.array(c, pa.int64()) for c in (counts, first, second)), pa.array(bands, pa.list_(pa.int64()))], names=names)

    return documents.select("doc_id", "k_id", "k_text", "text").mapInArrow(
        rows, "doc_id long, k_id long, k_text long, n_shingles long, s1 long, s2 long, bands array<long>")
