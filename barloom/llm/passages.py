"""Passages that notes share: k-mer seeds, collinear chains (range maxima, gap costs), aligned word by word."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HASHES, grams, mix, notes_of, sliced, working, written

#: So many times ``min_words`` words on either side of a chain are aligned.
REACH = 2
_NONE = (-1e300, -1)
_SPACES = np.array([chr(i).isspace() for i in range(0x3001)])


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (code points) of every word, as str.split() finds them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = _SPACES[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each run of ``window``: equal runs of words get equal seeds."""
    if len(hashes) <= window:
        return np.array([hashes.argmin()]) if len(hashes) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(views.argmin(1) + np.arange(len(views)))


def occurrences(seeds: np.ndarray) -> np.ndarray:
    """How often each value came before."""
    order = np.argsort(seeds, kind="stable")
    ranked = seeds[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(seeds))
    out = np.empty(len(seeds), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return out


_SEEDS = "seed bigint, k bigint, pos int"


def _seeds(k: int, window: int, least: int):
    """Texts -> their seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("hashes", HASHES.clear)
        for batch in sliced(batches):
            parts: list[tuple] = []
            for key, text in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                words = text.lower().split()
                if key is None or len(words) < max(k, least):  # neither a passage nor the source of one
                    continue
                h = grams(HASHES.of(words), k)
                at = minimizers(h, window)
                # Every occurrence of a seed meets the first one of the earlier note; in a run of one repeated seed its head does, since
                # alignment goes on from there.  In repetitive text the n-th one is also a seed of its own, so that it meets the
                # n-th: two partners each, no squares.
                nth = occurrences(h[at]).astype(np.uint64)
                head = np.ones(len(at), bool)
                head[1:] = (h[at[1:]] != h[at[:-1]]) | (np.diff(at) > window)
                at, nth = np.concatenate([at[head], at[nth > 0]]), np.concatenate([nth[head] * np.uint64(0), nth[nth > 0]])
                seed = mix(h[at] + nth * np.uint64(0x9E3779B97F4A7C15))
                parts.append((seed.view(np.int64), np.full(len(at), key, np.int64), at.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["seed", "k", "pos"])

    return run


class RangeMax:
    """Segment tree over ranks: the best (score, index) of a range of ranks, where entries come and go."""

    def __init__(self, n: int):
        self.n = n
        self.best = [_NONE] * (2 * n)
        self.held: list[deque] = [deque() for _ in range(n)]

    def _set(self, rank: int) -> None:
        best, i = self.best, rank + self.n
        best[i] = self.held[rank][0] if self.held[rank] else _NONE
        while i > 1:
            i >>= 1
            best[i] = max(best[2 * i], best[2 * i + 1])

    def put(self, rank: int, item: tuple[float, int]) -> None:
        held = self.held[rank]
        while held and held[-1] <= item:  # older and no better: never the best again
            held.pop()
        held.append(item)
        if held[0] is item:
            self._set(rank)

    def drop(self, rank: int, index: int) -> None:
        """The oldest entries go first."""
        held = self.held[rank]
        if held and held[0][1] == index:
            held.popleft()
            self._set(rank)

    def get(self, start: int, end: int) -> tuple[float, int]:
        """Over the ranks from ``start`` and before ``end``."""
        found, best = _NONE, self.best
        start, end = start + self.n, end + self.n
        while start < end:
            if start & 1:
                found = max(found, best[start])
                start += 1
            if end & 1:
                end -= 1
                found = max(found, best[end])
            start, end = start >> 1, end >> 1
        return found


def collinear_chains(pos: list[int], other: list[int], k: int, gap_cost: float, max_gap: int) -> list[list[int]]:
    """Chains of matches that rise in both texts, best first, as indices; each match in one chain at most.

    A match is worth the words it adds (k at most), a gap costs ``gap_cost`` a skipped word in either text.  The cost is
    linear, so the best predecessor of a match is the maximum of score + cost x (pos + other) over the matches that lie at
    most ``max_gap`` words before it in both texts.
    """
    order = sorted(range(len(pos)), key=lambda i: (pos[i], -other[i]))
    ranks = sorted(set(other))
    tree, old = RangeMax(len(ranks)), 0
    score, link = [0.0] * len(pos), [-1] * len(pos)
    for i in order:
        p, q = pos[i], other[i]
        while p - pos[order[old]] > max_gap:
            tree.drop(bisect_left(ranks, other[order[old]]), order[old])
            old += 1
        rank = bisect_left(ranks, q)
        best, j = tree.get(bisect_left(ranks, q - max_gap), rank)
        gain = best - gap_cost * (p + q)
        if j >= 0 and gain > 0:
            score[i], link[i] = gain + min(k, p - pos[j], q - other[j]), j
        else:
            score[i] = float(k)
        tree.put(rank, (score[i] + gap_cost * (p + q), i))
    used = [False] * len(pos)
    chains = []
    for i in sorted(order, key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = link[i]
        if chain:
            chains.append(chain[::-1])
    return chains


def unlike(chains: list[list[int]], pos: list[int], other: list[int], k: int, min_words: int) -> list[list[int]]:
    """Without the chains whose matches all lie in a certain passage of an earlier chain: runs of one repeated word.

    Matches on one diagonal without a word between them are a certain passage if they reach ``min_words`` words.
    """
    certain: set[int] = set()
    out = []
    for chain in chains:
        if certain and all(pos[i] in certain for i in chain):
            continue
        out.append(chain)
        run = chain[:1]
        for i, j in zip(chain, chain[1:] + [-1]):
            if j >= 0 and pos[j] - pos[i] == other[j] - other[i] <= k:
                run.append(j)
                continue
            if pos[i] - pos[run[0]] + k >= min_words:
                certain.update(pos[x] for x in run)
            run = [j]
    return out


_CHAIN = "k bigint, owner bigint, pos array<int>, other array<int>"


def _chain(k: int, min_words: int, gap_cost: float, max_gap: int):
    """(k, owner, anchors) -> its chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("chains")
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(4)]
            for r in batch.to_pylist():
                pos, other = zip(*sorted((x["pos"], x["other"]) for x in r["anchors"]))
                for chain in unlike(collinear_chains(pos, other, k, gap_cost, max_gap), pos, other, k, min_words):
                    for c, v in zip(out, (r["k"], r["owner"], [pos[i] for i in chain], [other[i] for i in chain])):
                        c.append(v)
            kinds = [pa.int64()] * 2 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in _CHAIN.split(", ")])

    return run


#: So many words apart are the places of a text that are kept: one for every word would nearly double what is stored and shuffled.
STEP = 8


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _word_starts(texts: pd.Series) -> pd.Series:
    """Number of words of a text, its length, and where every ``STEP``-th word starts (code points)."""
    starts = [(word_places(t)[0], len(t)) for t in texts]
    return pd.Series([np.concatenate([[len(s), n], s[::STEP]]).astype(np.int32) for s, n in starts], dtype=object)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; equal lengths first try place by place."""
    if len(a) == len(b):
        same = sum(x == y for x, y in zip(a, b))
        if 2 * same >= len(a):
            return same
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def _extend(a: list[str], b: list[str], i: int, j: int, step: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """From just beyond a match, over equal words, single changed words with two equal ones behind, and longer edits with
    a run of equal words behind: the seeds there may belong to other notes.

    (i, j, stretches), where a stretch is (words of a, words of b, equal words): equal and unequal ones.
    """
    out = []
    inside = lambda x, y: 0 <= x < len(a) and 0 <= y < len(b)
    while True:
        n = i
        while inside(i, j) and a[i] == b[j]:
            i, j = i + step, j + step
        if i != n:
            out.append((abs(i - n),) * 3)
        for di, dj in ((step, step), (step, 0), (0, step)):
            x, y = i + di, j + dj
            if inside(x + step, y + step) and a[x] == b[y] and a[x + step] == b[y + step]:
                out.append((abs(di), abs(dj), 0))
                i, j = x, y
                break
        else:
            di, dj = _next_run(a, b, i, j, step)
            if not di and not dj:
                return i, j, out
            x, y = i + step * di, j + step * dj
            cut = (a[i:x], b[j:y]) if step > 0 else (a[x + 1 : i + 1], b[y + 1 : j + 1])
            out.append((di, dj, _common(*cut)))
            i, j = x, y


def _next_run(a: list[str], b: list[str], i: int, j: int, step: int, n: int = 4, look: int = 30) -> tuple[int, int]:
    """How many words to skip in either text to the nearest run of ``n`` equal words; (0, 0) if there is none."""
    x, y = (a[i : i + look], b[j : j + look]) if step > 0 else (a[max(i - look + 1, 0) : i + 1][::-1], b[max(j - look + 1, 0) : j + 1][::-1])
    if len(set(x) & set(y)) == 0:
        return 0, 0
    at: dict[tuple, int] = {}
    for d in range(len(y) - n, -1, -1):
        at[tuple(y[d : d + n])] = d
    found = [(d + at[g], d, at[g]) for d in range(len(x) - n + 1) if (g := tuple(x[d : d + n])) in at]
    return min(found)[1:] if found else (0, 0)


def align(a: list[str], b: list[str], pos: list[int], other: list[int], k: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(from, other from, stretches) of what lies around a chain of matches of k words.

    Stretches are (words of a, words of b, equal words) in order; those between two matches count their common words.
    """
    i0, j0, before = _extend(a, b, pos[0] - 1, other[0] - 1, -1)
    out = before[::-1]
    i, j = pos[0], other[0]
    for p, q in zip(pos, other):
        if p >= i and q >= j:
            x, y, start = p, q, i
            while i < p and j < q and a[i] == b[j]:
                i, j = i + 1, j + 1
            while x > i and y > j and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
            if i > start:
                out.append((i - start,) * 3)
            if x > i or y > j:
                out.append((x - i, y - j, _common(a[i:x], b[j:y])))
            out.append((p + k - x,) * 3)
            i, j = p + k, q + k
        elif p - q == i - j:  # overlaps the match before, on its diagonal
            out.append((p + k - i,) * 3)
            i, j = p + k, q + k
        else:
            skip = max(i - p, j - q)
            if skip < k:
                out.append((p + skip - i, q + skip - j, 0))
                out.append((k - skip,) * 3)
                i, j = p + k, q + k
    out += _extend(a, b, i, j, 1)[2]
    return i0 + 1, j0 + 1, out


def passages_in(stretches: list[tuple[int, int, int]], min_words: int, similarity: float, edit: int) -> list[tuple[int, int]]:
    """The parts (from, to) of an alignment that are passages, by numbers of stretches.

    A passage has ``min_words`` words and its equal words are at least ``similarity`` of the longer side; one that can
    be longer is left out.  An unequal stretch of more than ``edit`` words with a passage on both sides divides them.
    """
    runs: list[list[int]] = []  # first and last stretch of each run of equal words
    for i, (m, n, equal) in enumerate(stretches):
        if m == n == equal:
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
    if not runs:
        return []
    sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(np.array(stretches, np.int64), axis=0)])
    first, last = np.array(runs).T

    def are(x, y):
        m, n, equal = (sums[last[y]] - sums[first[x]]).T
        return (m >= min_words) & (equal >= similarity * np.maximum(m, n))

    found, done = [], -1
    for x in range(len(runs)):
        if done == len(runs) - 1:
            break
        good = np.flatnonzero(are(x, np.arange(max(x, done + 1), len(runs))))
        if len(good):
            done = max(x, done + 1) + int(good[-1])
            found.append((x, done))
    gaps = np.maximum(*(sums[first[1:]] - sums[last[:-1]]).T[:2])
    out = []
    while found:
        x, y = found.pop()
        inner = np.arange(x, y)
        inner = inner[gaps[x:y] > edit]
        if len(inner):
            inner = inner[are(x, inner) & are(inner + 1, y)]
        if len(inner):
            cut = int(inner[gaps[inner].argmax()])
            found += [(x, cut), (cut + 1, y)]
        else:
            out.append((int(first[x]), int(last[y])))
    out = sorted(set(out), key=lambda r: (r[0], -r[1]))
    return [r for i, r in enumerate(out) if not any(o[1] >= r[1] for o in out[:i])]


_SPAN = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("start", "end", "n_words", "other_start", "other_end", "other_words", "equal_words")]
)


def _aligned(k: int, min_words: int, similarity: float):
    @F.pandas_udf(T.ArrayType(_SPAN))
    def run(
        a: pd.Series, b: pd.Series, pos: pd.Series, other: pd.Series, lo_a: pd.Series, lo_b: pd.Series, hi_a: pd.Series, hi_b: pd.Series, fa: pd.Series, fb: pd.Series
    ) -> pd.Series:
        rows = []
        for x, y, p, q, u, v, u1, v1, f, g in zip(a, b, pos, other, lo_a, lo_b, hi_a, hi_b, fa, fb):
            own, its = slice(u % STEP, u % STEP + u1 - u), slice(v % STEP, v % STEP + v1 - v)  # a text begins at a kept place
            lo, lo1, parts = align(x.lower().split()[own], y.lower().split()[its], (p - u).tolist(), (q - v).tolist(), k)
            row = []
            if found := passages_in(parts, min_words, similarity, k):
                (s0, e0), (s1, t1) = ([c[own] for c in word_places(x)], [c[its] for c in word_places(y)])
                ends = np.cumsum([(lo, lo1, 0), *parts], axis=0).tolist()
                for n, m in found:
                    (i, j, e), (i1, j1, e1) = ends[n], ends[m]
                    row.append((f + s0[i], f + e0[i1 - 1], i1 - i, g + s1[j], g + t1[j1 - 1], j1 - j, e1 - e))
            rows.append([dict(zip(_SPAN.names, map(int, r))) for r in row])
        return pd.Series(rows, dtype=object)

    return run


def shared_passages(
    notes: DataFrame,
    key: str = "seq",
    text: str = "reason",
    min_words: int = 50,
    similarity: float = 0.8,
    k: int = 6,
    window: int = 12,
    gap_cost: float = 0.1,
    max_gap: int = 60,
) -> DataFrame:
    """Passages of at least ``min_words`` words that an earlier note (smaller key) has too, exactly or with small edits.

    Notes are rows with a unique whole-number key and a free text.  Columns: the key, ``start`` and ``end`` (code points),
    ``n_words``, ``source`` (key of the earlier note), ``source_start``, ``source_end``, ``similarity`` (equal words by the
    longer side, at least ``similarity``).

    Seeds are the minimizers among runs of ``k`` words: in every run of k + window - 1 equal words there is a shared one.
    Every seed is matched with the first note that has it, so a passage of n notes gives n - 1 matches a seed, never all
    pairs; each of its occurrences in the later note meets the first one in the earlier note, and the n-th one the n-th.  The matches of a note with an earlier one become chains; each chain is cut out of both notes with
    2 x ``min_words`` words on either side and aligned word by word, whichever notes the seeds there belong to.  The longest parts of an alignment that are passages are reported, and where more than ``k``
    unequal words have a passage on both sides, these are two.

    Null and empty texts, texts below ``min_words`` words and rows with a null key have no passages; repeated rows count as
    one note; passages inside one note are none.  Ties go to the smallest key.  Extra columns are left out.
    """
    texts = notes_of(notes, key, text)
    seeds = texts.mapInArrow(_seeds(k, window, math.ceil(similarity * min_words)), _SEEDS)
    # Two passes over one shuffle by seed: its first and last note, then its first place in the first one.
    same = Window.partitionBy("seed")
    seeds = seeds.withColumns({"owner": F.min("k").over(same), "last": F.max("k").over(same)}).filter("owner < last")
    matched = seeds.withColumn("other", F.min(F.when(F.col("k") == F.col("owner"), F.col("pos"))).over(same)).filter("k <> owner")
    pairs = matched.groupBy("k", "owner").agg(F.collect_set(F.struct("pos", "other")).alias("anchors"))
    chains = written(pairs.mapInArrow(_chain(k, min_words, gap_cost, max_gap), _CHAIN), "chains")

    # Texts move once: each meets the chains of both its roles, and only the words around them are shuffled to the other side's.
    sides = [
        F.struct(F.col(by).alias("at"), F.lit(role).alias("later"), F.col(places).alias("places"))
        for by, role, places in (("k", True, "pos"), ("owner", False, "other"))
    ]
    asked = chains.withColumn("chain", F.monotonically_increasing_id()).select("chain", "k", "owner", F.inline(F.array(*sides)))
    rows = asked.join(texts.withColumn("starts", _word_starts("t")).withColumnRenamed("k", "at"), "at")
    # From one kept place to another, the numbers of its first word and the one behind its last, and where the text starts.
    reach = REACH * min_words
    low = F.greatest(F.element_at("places", 1) - reach, F.lit(0))
    high = F.least(F.element_at("places", -1) + (k + reach), F.get("starts", F.lit(0)))
    kept = lambda word: F.get("starts", (word / STEP).cast("int") + 2)
    end = F.coalesce(kept(high + (STEP - 1)), F.get("starts", F.lit(1)))
    rows = rows.withColumns({"lo": low, "hi": high, "f": kept(low), "_end": end})
    rows = rows.withColumn("cut", F.struct("places", "lo", "hi", "f", F.expr("substring(t, f + 1, _end - f)").alias("words")))
    cuts = rows.select("chain", "k", "owner", "later", "cut").repartition("chain").groupBy("chain", "k", "owner")
    of = lambda role: F.collect_set(F.when(F.col("later") == role, F.col("cut")))
    both = cuts.agg(of(True).alias("a"), of(False).alias("b")).withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
    got = _aligned(k, min_words, similarity)(*[f"{side}.{c}" for c in ("words", "places", "lo", "hi", "f") for side in "ab"])
    spans = both.select("k", "owner", F.explode(got).alias("s")).select(
        F.col("k").alias(key),
        "s.start",
        "s.end",
        "s.n_words",
        F.col("owner").alias("source"),
        F.col("s.other_start").alias("source_start"),
        F.col("s.other_end").alias("source_end"),
        (F.col("s.equal_words") / F.greatest("s.n_words", "s.other_words")).alias("similarity"),
    )
    # Several chains may find the same words of the same source: only spans that lie in no other one.
    longest = Window.partitionBy(key, "source").orderBy("start", F.desc("end"), F.desc("similarity"), "source_start", "source_end")
    reached = F.max("end").over(longest.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reached", reached).filter("_reached is null or end > _reached").drop("_reached")


def without_passages(notes: DataFrame, spans: DataFrame, key: str = "seq", text: str = "reason") -> DataFrame:
    """The notes with the passages cut out of their texts; all columns and rows stay, untouched texts too."""
    cuts = spans.groupBy(F.col(key).alias("_cut_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_cuts"))
    held = notes.join(cuts, notes[key] == cuts["_cut_key"], "left")
    return held.withColumn(text, F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(_cut_out(text, "_cuts"))).select(*notes.columns)


@F.pandas_udf(T.StringType())
def _cut_out(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    def one(text, spans):
        if text is None or spans is None:
            return text
        parts, at = [], 0
        for s in spans:
            if s["start"] > at:
                parts.append(text[at : s["start"]].strip())
            at = max(at, s["end"])
        parts.append(text[at:].strip())
        return "\n".join(p for p in parts if p)

    return pd.Series([one(t, s) for t, s in zip(texts, cuts)], dtype=object)
