"""Toxicity of notes: two Kneser-Ney bigram models, one learned on toxic notes and one on the others."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import notes_of, short_batches, sliced, text_id, working, written

#: Words: letters of any script, with inner apostrophes.
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
DISCOUNT = 0.75


def note_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class BigramModel:
    """One class: sorted codes [previous, word] of the pairs it has and their discounted probabilities, and of every word
    the weight of the backoff behind it and its own backoff probability.  Pairs that the class doesn't have take no memory.
    """

    codes: np.ndarray
    high: np.ndarray
    rest: np.ndarray
    low: np.ndarray

    def logs(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log-probability of each word behind the one before it."""
        p = self.rest[before] * self.low[words]
        if len(self.codes):
            code = before * len(self.low) + words
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            p += np.where(self.codes[at] == code, self.high[at], 0.0)
        return np.log(p)


@dataclass
class ToxicityModel:
    """Words with an id from 1 (0: every other word), the bigrams of either class, calibration."""

    words: dict[str, int]
    toxic: BigramModel
    ordinary: BigramModel
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def logliks(self, text: str) -> tuple[int, float, float]:
        """Number of words and the log-likelihood of the text in either class."""
        words, get = note_words(text), self.words.get
        n = len(words)
        if not n:
            return 0, 0.0, 0.0
        ids = np.empty(n + 1, np.int64)
        ids[0] = len(self.words) + 1
        ids[1:] = np.fromiter((get(w, 0) for w in words), np.int64, n)
        return n, float(self.toxic.logs(ids[:-1], ids[1:]).sum()), float(self.ordinary.logs(ids[:-1], ids[1:]).sum())

    @staticmethod
    def features(n, toxic, ordinary) -> np.ndarray:
        """The difference of the length-normalised log-likelihoods, also by root and by whole length."""
        n = np.asarray(n, float)
        d = (np.asarray(toxic) - np.asarray(ordinary)) / np.maximum(n, 1)
        return np.stack([np.ones_like(d), d, d * np.sqrt(n), np.clip(d * n, -20, 20)], axis=-1)

    def score(self, n, toxic, ordinary) -> np.ndarray:
        z = np.clip(self.features(n, toxic, ordinary) @ self.weights, -30, 30)
        return 1 / (1 + np.exp(-z))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working("toxicity")
    counts = (Counter(), Counter())

    def out():
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string())] + [pa.array([c[w] for w in words], pa.int64()) for c in counts],
            ["word", "n_ordinary", "n_toxic"],
        )
        for c in counts:
            c.clear()

    for batch in sliced(batches):
        for text, label in zip(batch.column("t").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update(set(note_words(text)))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield from out()
    yield from out()


#: Pairs that a task holds before it adds them up, and added up ones before it passes them on.
_HELD = 1 << 20
#: Parts the pairs are dealt over by the word before.
_DEALT = 64
_PAIRS = "part int, label int, codes binary, counts binary"


class _Sums:
    """Counts by code, added up when many have come."""

    def __init__(self):
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((codes, counts))
        if sum(len(c) for c, _ in self.held) > max(_HELD, len(self.codes)):
            self.close()

    def close(self) -> None:
        codes, at = np.unique(np.concatenate([self.codes, *[c for c, _ in self.held]]), return_inverse=True)
        counts = np.concatenate([self.counts, *[n for _, n in self.held]])
        self.codes, self.counts = codes, np.bincount(at, counts, len(codes)).astype(np.int64)
        self.held.clear()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "label", "codes", "counts"])


def _pair_counts(words: dict[str, int]):
    """Pairs of a task by class, a row for each part of them."""
    size = len(words) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [_Sums(), _Sums()]

        def out(label: int) -> pa.RecordBatch:
            s, sums[label] = sums[label], _Sums()
            s.close()
            part = s.codes // size % _DEALT
            dealt = ((p, part == p) for p in range(_DEALT))
            return _packed([(p, label, s.codes[own].tobytes(), s.counts[own].tobytes()) for p, own in dealt if own.any()])

        for batch in sliced(batches):
            ids: tuple[list, list] = ([], [])
            for text, label in zip(batch.column("t").to_pylist(), batch.column("label").to_pylist()):
                one = np.array([size - 1, *(words.get(w, 0) for w in note_words(text))], np.int64)
                ids[label].append(one[:-1] * size + one[1:])
            for label in (0, 1):
                if ids[label]:
                    sums[label].add(*np.unique(np.concatenate(ids[label]), return_counts=True))
                    if len(sums[label].codes) > _HELD:
                        yield out(label)
        for label in (0, 1):
            yield out(label)

    return run


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the same part and class as one."""
    sums: dict[tuple[int, int], _Sums] = {}
    for batch in batches:
        for r in batch.to_pylist():
            own = sums.setdefault((r["part"], r["label"]), _Sums())
            own.add(np.frombuffer(r["codes"], np.int64), np.frombuffer(r["counts"], np.int64))
    for (part, label), own in sums.items():
        own.close()
        yield _packed([(part, label, own.codes.tobytes(), own.counts.tobytes())])


def _bigrams(codes: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> BigramModel:
    """Interpolated Kneser-Ney probabilities of one class from the counts of its pairs (sorted codes).

    shared[w]: in how many contexts a word follows in either class, as probabilities.  Both
    orders back off: the bigram to the word's own count in the class, that to the shared one.
    """
    size = len(shared)
    before, word = codes // size, codes % size
    alone, context = np.bincount(word, counts, size), np.bincount(before, counts, size)
    total = max(alone.sum(), 1.0)
    low = np.maximum(alone - DISCOUNT, 0) / total
    low += (1 - low.sum()) * shared
    high = np.maximum(counts - DISCOUNT, 0) / np.maximum(context[before], 1)
    return BigramModel(codes, high, 1 - np.bincount(before, high, size), low)


def _kneser_ney(counts: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Log of the probabilities of ``_bigrams`` as a table [previous, word], from a table of counts."""
    codes = np.flatnonzero(counts)
    before, words = np.indices(counts.shape)
    return _bigrams(codes, counts.ravel()[codes], shared).logs(before.ravel(), words.ravel()).reshape(counts.shape)


def _evidence(a: Column, na: int, b: Column, nb: int) -> Column:
    """Log-likelihood ratio statistic of a word's note counts in two classes."""

    def side(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    share = (a + b) / F.lit(float(na + nb))
    absent = F.greatest(F.lit(1.0) - share, F.lit(1e-12))
    return 2 * (
        side(a, share * na) + side(b, share * nb) + side(F.lit(na) - a, absent * na) + side(F.lit(nb) - b, absent * nb)
    )


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    notes: DataFrame,
    labels: DataFrame,
    key: str = "seq",
    text: str = "reason",
    label: str = "toxic",
    min_evidence: float = 10.8,
    calibration_rows: int = 20_000,
) -> ToxicityModel:
    """Learn the two class models from labelled notes, all of them.

    A note is a row of a log with a free text.  Equal texts with the same label count once; labels other
    than 0 and 1 are ignored, several labels of one key count as toxic if one is.  Words whose presence tells
    the classes apart (``min_evidence``, a log-likelihood ratio statistic over all labelled notes: 10.8 is one chance in a thousand)
    get an entry of their own, however many they are; words that don't share one entry, whose probabilities come
    from the shared backoff counts.  The model holds the pairs that occur and grows with them.  A quarter of the texts, ``calibration_rows``
    at most, is kept for a logistic curve over the difference of the length-normalised log-likelihoods; all others
    give counts.  Without labels, or with one class only, the score is the
    share of toxic rows (0.5 without any).
    """
    flags = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("label"))
    rows = notes_of(notes, key, text).join(flags.hint("merge"), "k").select("t", "label", text_id("t").alias("id"))
    rows = rows.dropDuplicates(["id", "label"]).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4)) == 0)
    rows = written(rows.select("t", "label", "part", F.xxhash64("id", F.lit(1)).alias("deal")), "labelled")
    # The last deal of the calibration sample; with fewer rows, all of that quarter are in it.
    edge = rows.filter("part").select("deal").orderBy("deal").limit(calibration_rows).agg(F.max("deal")).head()[0]
    tuning = F.col("part") & (F.col("deal") <= F.lit(edge)) if edge is not None else F.lit(False)
    learn = rows.filter(~tuning).select("t", "label")
    sizes = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    words: dict[str, int] = {}
    if n0 and n1:
        counts = learn.mapInArrow(_word_counts, "word string, n_ordinary bigint, n_toxic bigint")
        counts = counts.groupBy("word").agg(F.sum("n_ordinary").alias("n_ordinary"), F.sum("n_toxic").alias("n_toxic"))
        told = counts.withColumn("evidence", _evidence(F.col("n_toxic"), n1, F.col("n_ordinary"), n0))
        told = told.filter(F.col("evidence") >= min_evidence).orderBy(F.desc("evidence"), "word")
        words = {r["word"]: i for i, r in enumerate(told.select("word").collect(), 1)}
    size = len(words) + 2
    pairs = learn.mapInArrow(_pair_counts(words), _PAIRS).repartition("part").mapInArrow(_pair_sums, _PAIRS).collect()
    by = []
    for c in (0, 1):
        own = [r for r in pairs if r["label"] == c]
        codes, counts = (np.frombuffer(b"".join(r[name] for r in own), np.int64) for name in ("codes", "counts"))
        order = np.argsort(codes)
        by.append((codes[order], counts[order].astype(float)))
    follows = np.bincount(np.union1d(by[0][0], by[1][0]) % size, minlength=size) + 0.5
    shared = follows / follows.sum()
    model = ToxicityModel(words, _bigrams(*by[1], shared), _bigrams(*by[0], shared))
    tune = rows.filter(tuning).select("t", "label")
    got = tune.select("label", _logliks(model)("t").alias("x")).select("label", "x.*").toPandas()
    y = got["label"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y) and words:
        model.weights = _logistic(model.features(got["n_words"], got["toxic_loglik"], got["ordinary_loglik"]), y)
    else:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        model.weights = np.array([np.log(share / (1 - share)), 0, 0, 0])
    return model


def _logliks(model: ToxicityModel):
    @F.pandas_udf("n_words bigint, toxic_loglik double, ordinary_loglik double, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        working("toxicity")
        for part in texts:
            got = [model.logliks(t) for t in part]
            n, toxic, ordinary = (np.array(c, float) for c in zip(*got)) if got else (np.zeros(0),) * 3
            yield pd.DataFrame(
                {"n_words": n.astype(int), "toxic_loglik": toxic, "ordinary_loglik": ordinary, "score": model.score(n, toxic, ordinary)}
            )

    return run


def add_toxicity(notes: DataFrame, model: ToxicityModel, text: str = "reason", into: str = "toxicity") -> DataFrame:
    """Every note with a struct ``into``: n_words, toxic_loglik, ordinary_loglik, score (0 to 1).

    A column of that name is replaced.  Null and empty texts, and texts without a word, get the score of no
    evidence.  No rows give no rows; repeated rows keep their number.
    """
    short_batches(notes.sparkSession)
    return notes.withColumn(into, _logliks(model)(F.coalesce(F.col(text), F.lit(""))))
