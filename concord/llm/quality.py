"""Quality of texts by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded (shares of kinds of bytes, repeated and different
words, word lengths; then a learned layer), a gated attention learned from the labels of whole documents weighs the
passages, and the weighted sum of their codes is scored. Fitting takes a bounded sample: at most `rows` labelled
documents, those with the smallest hash of their id, and at most `passages` passages of each, evenly spaced; both are
parameters. Scoring reads every passage of every text with the fitted weights, a few hundred numbers.

Null, empty and blank texts are bags of one empty passage. Labels with null id or quality are left out; several labels
of a document are averaged. Without labels all scores are 0.5. Repeated rows are scored one by one. Labels, language,
source and id are no inputs of a score; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bounded_batches, query, table

PASSAGE_WORDS = 64
SPACE, UPPER, LOWER, DIGIT, WIDE, STOP, OTHER = range(7)


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, dtype=np.int64)
    kinds[[0x20, *range(0x09, 0x0E)]] = SPACE
    kinds[0x41:0x5B], kinds[0x61:0x7B], kinds[0x30:0x3A], kinds[0x80:] = UPPER, LOWER, DIGIT, WIDE
    kinds[[ord(c) for c in ".,"]] = STOP
    return kinds


KINDS = _kinds()
FEATURES = 13


def passages(text: str | None) -> np.ndarray:
    """One row of FEATURES numbers per passage."""
    data = (text or "").encode()
    own = data.split()
    if not own:
        return np.zeros((1, FEATURES))
    kinds = KINDS[np.frombuffer(data, dtype=np.uint8)]
    inside = kinds != SPACE
    starts = inside & ~np.append(False, inside[:-1])
    number = (len(own) - 1) // PASSAGE_WORDS + 1
    at = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE_WORDS
    shares = np.bincount(at * 7 + kinds, minlength=7 * number).reshape(number, 7).astype(float)
    size = shares.sum(1)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    bag = np.arange(len(own)) // PASSAGE_WORDS
    words = np.bincount(bag, minlength=number)
    same = np.append(False, hashes[1:] == hashes[:-1])
    order = np.lexsort((hashes, bag))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (bag[order][1:] != bag[order][:-1]))
    return np.column_stack([
        shares / size[:, None],
        np.bincount(bag, same, number) / words, np.bincount(bag[order], new, number) / words,
        np.bincount(bag, lengths, number) / words / 10, np.bincount(bag, lengths == 1, number) / words,
        np.log1p(words), np.ones(number)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Standardisation and weights: encoder W, attention V, U, w, score c."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.weights, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        codes = np.tanh(x @ p["W"] + p["b"])
        tanh, gate = np.tanh(codes @ p["V"]), _sigmoid(codes @ p["U"])
        energy = (tanh * gate) @ p["w"]
        weight = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
        weight /= np.add.reduceat(weight, starts)[bag]
        pooled = np.add.reduceat(codes * weight[:, None], starts)
        return {"bag": bag, "codes": codes, "tanh": tanh, "gate": gate, "weight": weight, "pooled": pooled, "score": _sigmoid(pooled @ p["c"] + p["c0"])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags or not self.weights:
            return np.full(len(bags), 0.5)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self._forward((np.concatenate(bags) - self.mean) / self.scale, starts)["score"]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = 150, hidden: int = 12, rate: float = 0.05, decay: float = 1e-4) -> Model:
        if not bags:
            return self
        x, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(11)
        shapes = {"W": (FEATURES, hidden), "b": (hidden,), "V": (hidden, hidden), "U": (hidden, hidden), "w": (hidden,), "c": (hidden,), "c0": ()}
        self.weights = {k: rng.normal(0, 0.3, s) * (k not in ("b", "c0")) for k, s in shapes.items()}
        moments = {k: [np.zeros(s), np.zeros(s)] for k, s in shapes.items()}
        for step in range(1, steps + 1):
            for key, slope in self._slopes(x, starts, labels).items():
                first, second = moments[key]
                slope = slope + decay * self.weights[key]
                first += 0.1 * (slope - first)
                second += 0.001 * (slope ** 2 - second)
                self.weights[key] = self.weights[key] - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _slopes(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        p, f = self.weights, self._forward(x, starts)
        bag, codes, weight = f["bag"], f["codes"], f["weight"]
        error = (f["score"] - labels) / len(labels)
        to_pooled = (error[:, None] * p["c"])[bag]
        to_weight = (to_pooled * codes).sum(1)
        to_energy = weight * (to_weight - np.add.reduceat(weight * to_weight, starts)[bag])
        to_gated = to_energy[:, None] * p["w"]
        to_tanh = to_gated * f["gate"] * (1 - f["tanh"] ** 2)
        to_gate = to_gated * f["tanh"] * f["gate"] * (1 - f["gate"])
        to_codes = (weight[:, None] * to_pooled + to_tanh @ p["V"].T + to_gate @ p["U"].T) * (1 - codes ** 2)
        return {"W": x.T @ to_codes, "b": to_codes.sum(0), "V": codes.T @ to_tanh, "U": codes.T @ to_gate,
                "w": (f["tanh"] * f["gate"]).T @ to_energy, "c": f["pooled"].T @ error, "c0": error.sum()}


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = 6000, passages_of_each: int = 24) -> Model:
    """A model of `labels.quality`, from labelled rows that are not held out."""
    bounded_batches(documents.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    @F.pandas_udf("array<double>")
    def encoded(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            bag = passages(text)
            out.append(bag[np.unique(np.linspace(0, len(bag) - 1, min(len(bag), passages_of_each)).astype(int))].ravel())
        return pd.Series(out)

    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` ids
    sample = sample.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    sample = sample.select("doc_id", "label", encoded("text").alias("bag")).orderBy("doc_id").collect()
    return Model().fit([np.array(r["bag"]).reshape(-1, FEATURES) for r in sample], np.array([r["label"] for r in sample]))


def quality_score(model: Model, text: str = "text") -> Column:
    """The score of a text, from 0 to 1."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([passages(t) for t in texts]))

    return score(text)


def accepted(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents, in their own columns, with a score of at least `least`."""
    bounded_batches(documents.sparkSession)
    return documents.filter(quality_score(model) >= least)


@query("op9_quality_classifier")
def op9_quality_classifier(spark, folder):
    documents = table(spark, folder, "documents")
    model = fit_quality(documents, table(spark, folder, "labels"))
    scored = documents.select("doc_id", held_out().alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
