"""Language of notes: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grams, short_batches, sliced, working

#: The language of a text that is null or has no letter.
UNDETERMINED = "und"
#: Lengths of the n-grams, and how many features they are hashed into (as a power of two).
ORDERS, FEATURE_BITS = (1, 2, 3), 18
_GAPS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def char_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of lower-case words, word ends included, and how often each occurs."""
    codes = np.frombuffer(f" {_GAPS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [(grams(codes + np.uint64(n << 32), n) >> np.uint64(64 - FEATURE_BITS)).astype(np.uint32) for n in ORDERS]
    found = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[first], np.diff(np.append(first, len(found)))


def inverse_frequency(df: np.ndarray, n_notes: int) -> np.ndarray:
    return (np.log((1 + n_notes) / (1 + df)) + 1).astype(np.float32)


def tf_idf(features: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of unit length: (1 + log tf) x idf."""
    x = (1 + np.log(tf)) * idf[features]
    return x / np.sqrt((x * x).sum())


class Ftrl:
    """Follow the regularised leader, proximal, for a multinomial logistic regression with an elastic net.

    Per weight it keeps ``z`` (sum of gradients, less what the learning rates took back) and ``n`` (sum of their squares); the weight
    is zero while \\|z\\| is at most ``l1``.
    """

    def __init__(self, n_features: int, n_classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((n_features, n_classes))
        self.n = np.zeros((n_features, n_classes))

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        rate = (self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / rate, 0.0)

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What logits are divided by so that the likelihood of the labels is highest, between 1/20 and 20 (golden section).

    Each label keeps a share of 1 / (rows + 2) for the other classes, so that labels all told right don't make scores certain.
    """
    rest = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        p = np.maximum(softmax(logits / np.exp(t)), 1e-300)
        mine = p[np.arange(len(y)), y]
        return -((1 - rest) * np.log(mine) + rest * np.log(np.maximum(1 - mine, 1e-300))).mean()

    low, high, ratio = -np.log(20.0), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    """``slot``: a feature's row of ``weights`` (-1: all its weights are zero); the last row is the bias."""

    languages: list[str]
    idf: np.ndarray
    slot: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, features: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x, rows = tf_idf(features, tf, self.idf), self.slot[features]
        on = rows >= 0
        return x[on] @ self.weights[rows[on]] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*char_grams(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (feature, n): how many texts of this task have it."""
    working("language")
    df = np.zeros(1 << FEATURE_BITS, np.int64)
    for batch in sliced(batches):
        for text in batch.column("t").to_pylist():
            df[char_grams(text)[0]] += 1
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(df[found])], ["feature", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the sample -> their features, each text once a task."""
    working("language")
    seen = set()
    for batch in sliced(batches):
        rows = []
        for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "t"))):
            if (lang, h) not in seen:
                seen.add((lang, h))
                features, tf = char_grams(text)
                rows.append((lang, h, features.tobytes(), tf.astype(np.uint32).tobytes()))
        cols = list(zip(*rows)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "h", "features", "tf"])


def fit_language(
    notes: DataFrame,
    text: str = "reason",
    label: str = "lang",
    rows: int = 4000,
    epochs: int = 3,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.1,
    min_notes: int = 2,
) -> LanguageModel:
    """Learn the languages of labelled notes.

    Notes are rows with a free text, as the weight-change log's ``reason``, here with a ``label`` that the project's logs don't have themselves.
    Features are the hashed character 1- to 3-grams of lower-case words.  Document frequencies count all notes with a label.  The regression is
    fitted on a bounded sample: of every language the ``rows`` / (number of languages) distinct texts with the smallest hashes, at least one.  Four
    fifths of it train the weights (follow the regularised leader, elastic net ``l1``, ``l2``), in ``epochs`` passes in the order of the hashes; the rest
    sets the temperature.  Features that fewer than ``min_notes`` notes have get no weight.

    Notes without a label, without a text or without a letter teach nothing.  Repeated rows count as often in the frequencies
    and once in the sample.  Without any labelled note the model knows no language.  Whole texts are read, however long.
    """
    short_batches(notes.sparkSession)
    known = notes.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("t")).filter("lang is not null and t is not null")
    known = known.filter(F.col("t").rlike(r"\p{L}"))
    n_notes = known.count()
    if not n_notes:
        return LanguageModel([], *(np.zeros(0),) * 3)
    counted = known.select("t").mapInArrow(_frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << FEATURE_BITS, np.int64)
    df[counted["feature"].to_numpy()] = counted["n"].to_numpy()
    idf = inverse_frequency(df, n_notes)

    hashed = known.withColumn("h", F.xxhash64("t"))
    distinct = hashed.select("lang", "h").distinct()
    n_languages = distinct.select("lang").distinct().count()
    order = Window.partitionBy("lang").orderBy("h")
    chosen = distinct.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(rows // n_languages, 1)).drop("_n")
    # At most max(rows, languages) rows of two small columns.
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi")
    sample = sample.mapInArrow(_examples, "lang string, h bigint, features binary, tf binary")
    sample = sample.groupBy("lang", "h").agg(F.first("features").alias("features"), F.first("tf").alias("tf")).orderBy("h", "lang").collect()

    languages = sorted({r["lang"] for r in sample})
    code = {lang: i for i, lang in enumerate(languages)}
    features = [np.frombuffer(r["features"], np.uint32) for r in sample]
    x = [tf_idf(i, np.frombuffer(r["tf"], np.uint32), idf) for i, r in zip(features, sample)]
    y = np.array([code[r["lang"]] for r in sample])
    used = np.unique(np.concatenate(features))
    used = used[df[used] >= min_notes]
    slot = np.full(1 << FEATURE_BITS, -1, np.int32)
    slot[used] = np.arange(len(used))
    on = [slot[i] >= 0 for i in features]
    at = [np.append(slot[i[o]], len(used)) for i, o in zip(features, on)]
    x = [np.append(v[o], 1.0) for v, o in zip(x, on)]

    tune = np.array([r["h"] % 5 == 0 for r in sample])
    if tune.all() or len(np.unique(y[~tune])) < len(languages):
        tune[:] = False
    ftrl = Ftrl(len(used) + 1, len(languages), alpha, beta, l1, l2)
    for _ in range(epochs):
        for k in np.flatnonzero(~tune):
            ftrl.learn(at[k], x[k], y[k])
    weights = ftrl.weights(slice(None)).astype(np.float32)
    held = np.flatnonzero(tune) if tune.any() else np.arange(len(y))
    logits = np.stack([x[k] @ weights[at[k]] for k in held])
    heat = temperature(logits, y[held]) if len(languages) > 1 else 1.0
    active = np.flatnonzero(np.abs(weights[:-1]).sum(1) > 0)
    slot = np.full(1 << FEATURE_BITS, -1, np.int32)
    slot[used[active]] = np.arange(len(active))
    return LanguageModel(languages, idf, slot, np.concatenate([weights[active], weights[-1:]]), heat)


def add_language(notes: DataFrame, model: LanguageModel, text: str = "reason", into: str = "language") -> DataFrame:
    """Every note with a struct ``into``: lang (``und`` for texts that are null or without a letter) and score (0 to 1; 0 for ``und``).

    The score is the calibrated probability of the language.  A column of that name is replaced; all rows and the other columns stay.
    """
    short_batches(notes.sparkSession)

    @F.pandas_udf("lang string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        working("language")
        for part in texts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang", "score"])

    return notes.withColumn(into, run(F.col(text)))
