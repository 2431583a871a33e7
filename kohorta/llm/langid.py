"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Letters are lower-cased, everything else is a blank; one, two and three characters in a row are hashed into a fixed number of
features. Document frequencies cover all learning texts. The weights come from a bounded sample of labelled rows for
each language, by follow-the-regularised-leader with an elastic net, and a temperature fitted on a part of the sample kept aside
turns the outputs into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorta.llm.text import filled, mixed, narrow, slices
from kohorta.session import checked_broadcast, materialize

BITS = 16
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _lower_letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one blank for every run of other characters, and one at each end."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        letter |= (points == c) & chr(c).isalpha()
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint64)
    blank = points == 32
    return points[~(blank & np.concatenate([[False], blank[:-1]]))]


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams and how often each occurs; None without a letter."""
    points = _lower_letters(text)
    if len(points) < 2:
        return None
    with np.errstate(over="ignore"):
        two = points[:-1] * np.uint64(0x110000) + points[1:]
        three = two[:-1] * np.uint64(0x110000) + points[2:]
    hashed = [(mixed(x + np.uint64(n << 60)) >> np.uint64(64 - BITS)).astype(np.int64)
              for n, x in enumerate((points, two, three), 1)]
    counts = np.bincount(np.concatenate(hashed), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def tf_idf(at, counts, idf):
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def _document_frequencies(batches):
    found, n = np.zeros(1 << BITS, np.int64), 0
    for batch in slices(batches):
        for text in filled(batch.column("text")).to_pylist():
            own = features(text)
            if own:
                found[own[0]] += 1
                n += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["feature", "n"])


def _sample_features(batches):
    for batch in slices(batches):
        rows = [(lang, features(text), order) for lang, text, order in zip(
            batch.column("lang").to_pylist(), filled(batch.column("text")).to_pylist(), batch.column("order").to_pylist())]
        rows = [(lang, f, order) for lang, f, order in rows if f]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()),
             pa.array([r[1][0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
             pa.array([r[1][1].astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["lang", "order", "at", "n"])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def outputs(self, at, counts):
        return self.weights[:, at] @ tf_idf(at, counts, self.idf)

    def predict(self, text: str) -> tuple[str, float]:
        own = features(text)
        if own is None or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.outputs(*own) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def follow_the_leader(rows, n_classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3,
                      l2: float = 1e-3) -> np.ndarray:
    """FTRL-proximal weights of a multinomial regression. rows: (features, values, class) in a fixed order."""
    z, n = np.zeros((n_classes, 1 << BITS)), np.zeros((n_classes, 1 << BITS))

    def weights(zs, ns):
        return np.where(np.abs(zs) > l1, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, x, label in rows:
            own = weights(z[:, at], n[:, at])
            error = softmax(own @ x)
            error[label] -= 1
            gradient = error[:, None] * x
            squares = gradient * gradient
            z[:, at] += gradient - (np.sqrt(n[:, at] + squares) - np.sqrt(n[:, at])) / alpha * own
            n[:, at] += squares
    return weights(z, n)


def best_temperature(outputs: list[np.ndarray], labels: list[int]) -> float:
    """The temperature of the least negative log-likelihood, by golden section on its logarithm."""
    if not outputs:
        return 1.0
    stacked, own = np.stack(outputs), np.array(labels)

    def loss(log_t):
        s = stacked / np.exp(log_t)
        top = s.max(axis=1)
        return (top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(own)), own]).mean() + 1e-4 * log_t ** 2

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(documents: DataFrame, sample_per_language: int = 500) -> Model:
    """A model from documents (doc_id, text, lang); rows without language are not learned from.

    At most ``sample_per_language`` rows of each language, those of the smallest hashes of their ids, fit the weights and the
    temperature (every fifth of them); document frequencies come from all rows.
    """
    docs = narrow(documents, doc_id="bigint", text="string", lang="string").where("lang is not null")
    counted = docs.select("text").mapInArrow(_document_frequencies, "feature long, n long").groupBy("feature").agg(
        F.sum("n").alias("n")).toArrow()  # one row per feature at most
    at, found = counted["feature"].to_numpy(), counted["n"].to_numpy()
    total = int(found[at < 0].sum())
    idf = np.full(1 << BITS, np.log(1 + total) + 1)
    idf[at[at >= 0]] = np.log((1 + total) / (1 + found[at >= 0])) + 1
    order = F.xxhash64("doc_id", F.lit(17)).alias("order")
    first = Window.partitionBy("lang").orderBy("order")
    keyed = docs.select("lang", order)
    last = keyed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_per_language).groupBy(
        "lang").agg(F.max("order").alias("last"))
    last = checked_broadcast(materialize(last), 10_000)  # one row for each language: the texts stay where they are
    chosen = docs.select("lang", "text", order).join(last, "lang").where("order <= last").drop("last")
    sample = chosen.mapInArrow(_sample_features, "lang string, order long, at array<int>, n array<int>").toArrow()
    rows = sorted(zip(sample["order"].to_pylist(), sample["lang"].to_pylist(), sample["at"], sample["n"]),
                  key=lambda r: (r[0], r[1]))
    languages = sorted({r[1] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    ready = []
    for _, lang, own, counts in rows:
        own, counts = own.values.to_numpy().astype(np.int64), counts.values.to_numpy()
        ready.append((own, tf_idf(own, counts, idf), place[lang]))
    weights = follow_the_leader([r for i, r in enumerate(ready) if i % 5], len(languages)) if languages else np.zeros((0, 1))
    aside = [r for i, r in enumerate(ready) if not i % 5]
    temperature = best_temperature([weights[:, own] @ x for own, x, _ in aside], [r[2] for r in aside])
    return Model(languages, weights.astype(np.float32), idf.astype(np.float32), temperature)


def _predict(model: Model):
    def run(batches):
        for batch in slices(batches):
            found = [model.predict(t) for t in filled(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"),
                                              pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])
    return run


def held_out(folds: int, out_fold: int):
    """Whether crc32 of the doc_id as text falls in the fold kept from learning; false without doc_id."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(fold == out_fold, F.lit(False))


def identify_language(documents: DataFrame, folds: int = 4, out_fold: int = 2, sample_per_language: int = 500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of documents (doc_id, text, lang).

    Rows of ``out_fold`` and rows without doc_id or language are not learned from, and a prediction sees the text alone.
    A text without a letter, or none at all, is ``und`` with score 0; so is every row if nothing could be learned. Repeated rows
    are each predicted; an empty table gives an empty result.
    """
    docs = narrow(documents, doc_id="bigint", text="string", lang="string").withColumn("held_out", held_out(folds, out_fold))
    model = learn(docs.where("not held_out and doc_id is not null"), sample_per_language)
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
