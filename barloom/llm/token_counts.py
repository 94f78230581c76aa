"""Token counts of notes: byte-pair merges with a heap and a linked list; no token ids are made."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MEMO, short_batches, working


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges a list of symbols takes: the adjacent pair of the lowest rank first, the leftmost of equals.

    The symbols are a doubly linked list; the heap holds (rank, place, symbols of the pair), and an entry whose pair
    is not there any more is skipped.  n symbols take O(n log n).
    """
    n = len(symbols)
    if n < 2:
        return 0
    if n == 2:
        return int((symbols[0], symbols[1]) in ranks)
    get = ranks.get
    heap = []
    for i in range(n - 1):
        r = get((symbols[i], symbols[i + 1]))
        if r is not None:
            heap.append((r, i, symbols[i], symbols[i + 1]))
    if not heap:
        return 0
    heapq.heapify(heap)
    at: list[str | None] = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if at[i] is not a:
            continue
        j = after[i]
        if j >= n or at[j] is not b:
            continue
        new = a + b
        at[i], at[j] = new, None
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            r = get((new, at[k]))
            if r is not None:
                heapq.heappush(heap, (r, i, new, at[k]))
        h = before[i]
        if h >= 0:
            r = get((at[h], new))
            if r is not None:
                heapq.heappush(heap, (r, h, at[h], new))
    return merges


def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: White space to str.split(), but not to the patterns of vocabulary files.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


class _Runs(dict):
    """Characters between white space -> number of tokens, remembered: no word of the pattern goes beyond."""

    def __init__(self, counter: TokenCounter):
        self.counter = counter

    def __missing__(self, run: str) -> int:
        if len(self) > 2 * MEMO:
            self.clear()
        self[run] = n = sum(map(self.counter.__getitem__, self.counter.word.findall(run)))
        return n


class TokenCounter(dict):
    """A tokenizer file (.json; byte-level BPE with word ends) as a memo: word -> number of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        known = model["type"] == "BPE" and not model["byte_fallback"] and model["end_of_word_suffix"] and not model["ignore_merges"]
        if not known or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            raise ValueError("only byte-level BPE files with word ends and NFC, white space and lower-case steps are supported")
        self.end = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.word = regex.compile(pre[0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.signs = byte_signs()
        self.runs = _Runs(self)

    def __missing__(self, word: str) -> int:
        signs = self.signs
        symbols = [signs[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        # Equal symbols must be one object: a merged pair is recognised by identity.
        n = len(symbols) - merge_count(symbols, self.ranks)
        if len(self) > 2 * MEMO:
            self.clear()
        self[word] = n
        return n

    def count(self, text: str) -> int:
        total, at = 0, 0
        if "<" in text:
            for m in self.special.finditer(text):
                total += 1 + self._plain(text[at : m.start()])
                at = m.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # characters are lowered one by one
        text = text.lower()
        if _SEPARATORS.search(text):
            return sum(map(self.__getitem__, self.word.findall(text)))
        return sum(map(self.runs.__getitem__, text.split()))


@lru_cache(1)
def _loaded(path: str) -> TokenCounter:
    return TokenCounter(path)


def counter_of(path: str) -> TokenCounter:
    """One vocabulary a worker process."""
    working("counts", _loaded.cache_clear)
    return _loaded(path)


def add_token_counts(notes: DataFrame, vocabulary: str, text: str = "reason", into: str = "n_tokens") -> DataFrame:
    """Every note with ``into`` (long): the tokens of its whole text under a vocabulary file that executors can read.

    The count of a word is its symbols minus its merges.  Special strings in a text count as one token each; nothing
    is added or cut.  Null and empty texts have 0 tokens; a column ``into`` is replaced; repeated rows stay; no rows give no rows.
    """

    @F.pandas_udf(T.LongType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(vocabulary)
        for part in texts:
            yield pd.Series([counter.count(t) for t in part], dtype="int64")

    short_batches(notes.sparkSession)
    return notes.withColumn(into, run(F.coalesce(F.col(text), F.lit(""))))
