"""Languages of texts by hyperdimensional profiles.

Each letter stands for a random vector of +1 and -1 in `dims` dimensions. A run of three letters is bound into one
vector: the first letter's vector permuted twice, the second's permuted once, the third's as it is, multiplied. The
runs of a text are bundled, that is, added; those of all texts of a language make its prototype; and a text has the
language whose prototype has the largest cosine with its bundle. Letters are lower-cased, marks count as letters, and
whatever else stands between words is one blank, which is a letter of its own at either end of a word.

Vectors need no table: the signs of a letter are the bits of a hash of its code point, so binding is exclusive or and a
permutation is a rotation. Fitting reads all rows with a language and adds up integers, a vector per language from each
task, so it gives the same numbers however the rows are dealt. What comes to the driver is `dims` numbers per language;
more than `most` languages are refused.

Texts without a letter, null and empty ones included, are `und` with a score of 0, and so is every text where no
language was learned. Ties go to the language that sorts first. Rows without a language or without an id are not
learned from. The score is the cosine, 0 where it is negative. Rows are taken one by one, so repeated rows get equal
results; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import arrow_batches, bounded_batches, query, table

DIMS = 1024
MOST_LANGUAGES = 4096
UNKNOWN = "und"
SECTION = 1 << 19  # code points that are bundled at a time
GRAMS = 4096  # different runs that are bound at a time
TEXTS = 256  # texts that are bundled together
BLANK, MARK, LETTER = 0, 1, 2


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """BLANK, MARK or LETTER for each code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))[0]
        if category in "LM":
            out[point] = LETTER if category == "L" else MARK
    return out


def letter_signs(points: np.ndarray, dims: int) -> np.ndarray:
    """The bits of each letter's vector, 64 to a number: a hash of the code point and the place."""
    words = np.arange(dims // 64, dtype=np.uint64)
    out = (points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) + (words[None, :] + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def permuted(signs: np.ndarray) -> np.ndarray:
    """Every dimension moved to another: numbers move on by one, and the bits of each rotate."""
    signs = np.roll(signs, 1, axis=1)
    return (signs << np.uint64(1)) | (signs >> np.uint64(63))


def bound(letters: np.ndarray, dims: int) -> np.ndarray:
    """The vectors of runs of three letters (code points in three columns), as +1 and -1."""
    points, at = np.unique(letters, return_inverse=True)
    third = letter_signs(points, dims)
    second = permuted(third)
    first = permuted(second)
    at = at.reshape(letters.shape)
    signs = first[at[:, 0]] ^ second[at[:, 1]] ^ third[at[:, 2]]
    return 1 - 2 * np.unpackbits(signs.view(np.uint8), axis=1).astype(np.float32)


def runs_of_three(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """The runs of a text as one number each (21 bits a letter), some SECTION at a time, and whether there is a letter."""
    text = text.lower()
    for start in range(0, len(text), SECTION):
        part = f" {text[start:start + SECTION]} " if start == 0 else f"{text[start - 1:start + SECTION]} "
        if start + SECTION < len(text):
            part = part[:-1] + text[start + SECTION]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        kind = kinds()[points]
        points[kind == BLANK] = 0
        middle = np.flatnonzero(points[1:-1]) + 1
        yield (points[middle - 1] << 42) | (points[middle] << 21) | points[middle + 1], bool((kind[1:-1] == LETTER).any())


def bundles(texts: list[str | None], owner: list[int], number: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the vectors of all runs for each of `number` owners of texts, and whether each has a letter.

    Sums are whole numbers and exact, so they do not depend on how the texts are dealt.
    """
    sums, lettered = np.zeros((number, dims)), np.zeros(number, dtype=bool)
    held: list[np.ndarray] = []
    of: list[np.ndarray] = []

    def add() -> None:
        runs, own = np.concatenate(held), np.concatenate(of)
        different, at = np.unique(runs, return_inverse=True)
        for low in range(0, len(different), GRAMS):
            some = different[low:low + GRAMS]
            which = np.flatnonzero((at >= low) & (at < low + GRAMS)) if len(different) > GRAMS else slice(None)
            vectors = bound(np.stack([some >> 42, some >> 21 & 0x1FFFFF, some & 0x1FFFFF], axis=1), dims)
            cells = np.bincount(own[which] * len(some) + at[which] - low, minlength=number * len(some))
            sums[:] += cells.reshape(number, len(some)).astype(np.float32) @ vectors
        held.clear()
        of.clear()

    size = 0
    for text, who in zip(texts, owner):
        for runs, letter in runs_of_three(text or ""):
            lettered[who] |= letter
            held.append(runs)
            of.append(np.full(len(runs), who))
            size += len(runs)
            if size >= SECTION:
                add()
                size = 0
    if size:
        add()
    return sums, lettered


@dataclass
class Profiles:
    """Languages in order, and a prototype of length 1 for each."""

    languages: list[str]
    prototypes: np.ndarray
    dims: int = DIMS

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for start in range(0, len(texts), TEXTS):
            some = texts[start:start + TEXTS]
            if not self.languages:
                names, scores = names + [UNKNOWN] * len(some), scores + [0.0] * len(some)
                continue
            sums, lettered = bundles(some, list(range(len(some))), len(some), self.dims)
            length = np.sqrt((sums * sums).sum(1))
            # Rounded, so that a text has one score however many others stand beside it.
            cosines = np.round((sums @ self.prototypes.T) / np.where(length, length, 1)[:, None], 9)
            best = cosines.argmax(1)
            names += [self.languages[b] if some_letter else UNKNOWN for b, some_letter in zip(best, lettered)]
            scores += np.where(lettered, np.clip(cosines[np.arange(len(some)), best], 0, 1), 0.0).tolist()
        return names, scores


def fit_languages(rows: DataFrame, lang: str = "lang", text: str = "text", dims: int = DIMS, most: int = MOST_LANGUAGES) -> Profiles:
    """The prototypes of all languages of `rows`, from all its texts; rows without a language are left out."""
    if dims <= 0 or dims % 64:
        raise ValueError("dims is a multiple of 64")
    bounded_batches(rows.sparkSession)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            own = [pa.array(list(total), pa.string()), pa.array([v.astype(np.int64).tolist() for v in total.values()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(own, names=["lang", "sums"])

        for batch in arrow_batches(batches):
            names = batch.column(0).to_pylist()
            place = {n: k for k, n in enumerate(dict.fromkeys(names))}
            sums, _ = bundles(batch.column(1).to_pylist(), [place[n] for n in names], len(place), dims)
            for name, k in place.items():
                total[name] = total[name] + sums[k] if name in total else sums[k]
            if len(total) > most:
                yield out()
                total.clear()
        if total:
            yield out()

    known = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), text).mapInArrow(added, "lang string, sums array<long>")
    sums = known.select("lang", F.posexplode("sums").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    rows_of = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("sums")).select("lang", "sums.value")
    found = sorted(rows_of.limit(most + 1).collect(), key=lambda r: r["lang"])
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    prototypes = np.array([r["value"] for r in found], dtype=float).reshape(len(found), dims)
    length = np.sqrt((prototypes ** 2).sum(1, keepdims=True))
    return Profiles([r["lang"] for r in found], prototypes / np.where(length, length, 1), dims)


def language_of(profiles: Profiles, text: str | Column = "text") -> Column:
    """A struct of lang_pred and score for each text."""
    @F.pandas_udf("lang_pred string, score double")
    def identified(texts: pd.Series) -> pd.DataFrame:
        names, scores = profiles.identify(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return identified(text)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op11_language_id")
def op11_language_id(spark, folder):
    documents = table(spark, folder, "documents")
    profiles = fit_languages(documents.filter(F.col("doc_id").isNotNull() & ~held_out()))
    found = documents.select("doc_id", held_out().alias("held_out"), language_of(profiles).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
