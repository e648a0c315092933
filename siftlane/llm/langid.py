"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of lower-cased letters (everything else is a blank), hashed into 65,536 buckets. Document frequencies are counted over all labelled
training documents. The weights are learnt with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on a bounded sample: per
language the documents whose hash of doc_id lies in the share of the range that holds ``per_language`` of them. A fifth of the sample is held back to calibrate the temperature of the scores.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.llm.worker import release, remembered

BUCKETS, GRAMS, BLANK = 1 << 16, 3, 32
#: Follow-the-regularised-leader: rate, its offset, L1, L2, rounds over the sample.
ALPHA, BETA, L1, L2, ROUNDS = 2.0, 1.0, 0.002, 0.001, 3
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point its lower-case letter; a blank for all that is no letter."""
    table = np.full(sys.maxunicode + 1, BLANK, np.uint32)
    for c in range(sys.maxunicode + 1):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, ascending, and how often each occurs; nothing if the text has no letter."""
    table = remembered("letters", _letters)
    points = table[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (points != BLANK).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.r_[np.uint32(BLANK), points, np.uint32(BLANK)]
    points = points[np.r_[True, (points[1:] != BLANK) | (points[:-1] != BLANK)]]
    counts = np.zeros(BUCKETS, np.int64)
    for n in range(1, GRAMS + 1):
        h = np.full(max(0, len(points) - n + 1), n, np.uint32)
        for i in range(n):
            h = (h ^ points[i:len(points) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        counts += np.bincount(h >> np.uint32(16), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[at]
    return values / (np.sqrt((values ** 2).sum()) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """Languages, inverse document frequencies, weights (buckets x languages) and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = term_counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax((_weighted(at, counts, self.idf) @ self.weights[at]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], round(float(p[best]), 6)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that are never learnt from: crc32 of the doc_id as text leaves 1 on division by 3. False for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found, n = np.zeros(BUCKETS, np.int64), 0
    for pdf in batches:
        for text in pdf["text"]:
            found[term_counts(text)[0]] += 1
            n += 1
        release()
    at = np.flatnonzero(found)
    yield pd.DataFrame({"bucket": np.r_[-1, at], "n": np.r_[n, found[at]]})


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, calibrate: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and temperature from sparse rows (buckets, values), in the order given. Rows marked in ``calibrate`` only set the temperature."""
    z, n = np.zeros((BUCKETS, n_labels)), np.zeros((BUCKETS, n_labels))

    def weights(at) -> np.ndarray:
        some = z[at]
        w = -(some - np.sign(some) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(some) > L1, w, 0.0)

    for _ in range(ROUNDS):
        for i in np.flatnonzero(~calibrate):
            at, values = rows[i]
            w = weights(at)
            error = _softmax(values @ w)
            error[labels[i]] -= 1
            g = values[:, None] * error[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None)).astype(np.float32)
    logits = np.array([rows[i][1] @ w[rows[i][0]] for i in np.flatnonzero(calibrate)]).reshape(-1, n_labels)
    truth = labels[calibrate]
    # smoothed targets, as in Platt scaling: a sample without errors must not make every score 1
    wanted = (np.eye(n_labels)[truth] * len(truth) + 1) / (len(truth) + n_labels)
    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 93))
    loss = [-(wanted * np.log(_softmax(logits / t) + 1e-12)).sum() if len(truth) else abs(np.log(t)) for t in grid]
    return w, float(grid[int(np.argmin(loss))])


def train(labelled: DataFrame, per_language: int = 1500) -> Model:
    """Learn a model from doc_id, text and lang of the given rows; rows with a null doc_id or lang, or without a letter, teach nothing.

    ``per_language`` bounds the sample that sets the weights (within the spread of a hash, some percent); document frequencies come from all rows. The sample
    meets in one task: sparse vectors of at most 65,536 entries, per_language times the number of languages. With no usable row the model knows no language and predicts ``und``.
    """
    rows = labelled.where("doc_id is not null and lang is not null").select(
        F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    told = rows.select("text").mapInPandas(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n_docs = sum(r.n for r in told if r.bucket < 0)
    idf = np.full(BUCKETS, np.log(n_docs + 1) + 1)
    for r in told:
        if r.bucket >= 0:
            idf[r.bucket] = np.log((n_docs + 1) / (r.n + 1)) + 1
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), 1.0)
    number = {x: i for i, x in enumerate(languages)}
    # hashes are uniform: the share of their range that holds per_language documents, all of it for rarer languages
    last = {x: min((1 << 63) - 1, (per_language << 64) // n - (1 << 63)) for x, n in counts.items()}
    limits = F.create_map(*[F.lit(v) for item in last.items() for v in item])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [term_counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "label": pdf["lang"].map(number), "at": [a.astype(np.uint16).tobytes() for a, _ in found],
                                "v": [_weighted(a, c, idf).astype(np.float32).tobytes() for a, c in found]})
            del found
            release()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["at"].map(len) > 0].sort_values(["h", "label", "at"])
        sparse = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for a, v in zip(pdf["at"], pdf["v"])]
        w, t = learn(sparse, pdf["label"].to_numpy(), len(languages), np.arange(len(pdf)) % 5 == 4)
        del sparse
        release()
        return pd.DataFrame({"w": [w.tobytes()], "t": [t]})

    sample = rows.where(F.col("h") <= limits[F.col("lang")]).mapInPandas(vectors, "h long, label int, at binary, v binary")
    fitted = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "w binary, t double").first()
    return Model(languages, idf, np.frombuffer(bytes(fitted.w), np.float32).reshape(BUCKETS, -1), fitted.t)


def language(text: Column, model: Model) -> Column:
    """A struct lang_pred, score for each text: a language of the model and its calibrated probability; ``und`` and 0 for a null text or one without a letter."""
    def run(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])
        release()
        return found

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its whole text alone. Repeated and null doc_ids are kept; other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), language(F.col("text").cast("string"), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.3) -> DataFrame:
    """The documents, all columns kept, less those without a language: no letter at all, or a best score under ``min_score``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), language(F.col("text").cast("string"), model).alias("p"))
    return rows.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= min_score)).select("doc.*")
