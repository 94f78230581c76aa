"""SentencePiece ids by a max-plus scan: transfer matrices between chunk boundaries, then a trace of each chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MEMO, notes_of, sliced, working

#: The sign that stands for a space (fixed value of the format).
SPACE = "▁"
#: Where a path stands at a place between characters: the last piece and how far it reaches beyond the place.
State = tuple[str, int]
#: entry state -> exit state -> (score, pieces that end in between or reach beyond)
Matrix = dict[State, dict[State, float]]
START: State = ("", 0)


class _WordIds(dict):
    """What follows a space sign -> ids of the sign and it, remembered if they give the word back; ``lossy`` counts the others."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lossy = 0

    def __missing__(self, rest: str) -> tuple[int, ...]:
        parts = self.pieces.parts
        lossy = parts.lossy
        ids = tuple(self.pieces.word_ids(SPACE + rest))
        if parts.lossy > lossy:
            self.lossy += 1
            return ids
        if len(self) > 2 * MEMO:
            self.clear()
        self[rest] = ids
        return ids


class _PartIds(dict):
    """A part of a word that no piece reaches beyond -> its ids, remembered if they give it back; ``lossy`` counts the others."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lossy = 0

    def __missing__(self, part: str) -> list[int]:
        d = self.pieces
        path = d.part_path(part)
        try:
            ids = [d.ids[p] for p in path]
        except KeyError:
            ids = d.piece_ids(path)
        if d.joined(ids) != part:
            self.lossy += 1
            return ids
        if len(self) > 2 * MEMO:
            self.clear()
        self[part] = ids
        return ids


class Pieces:
    """The vocabulary of a .model file as a lattice of pieces.

    A unigram model weighs an arc with its piece's score.  A byte-pair model weighs an arc with 0 if the merges of
    its piece and the one before leave exactly these two, else with minus infinity: a chain of such neighbours is
    the one result of the merges.  In both cases ids are the best path in the max-plus semiring.
    """

    def __init__(self, path: str, unigram: bool | None = None, model: bytes | None = None):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        if model is None:
            with open(path, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        self.unigram = proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM if unigram is None else unigram
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i in range(len(self.names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in usable}
        self.scores = {self.names[i]: sp.get_score(i) for i in usable}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.penalty = min(self.scores.values()) - 10.0
        self.longest = max(map(len, self.ids))
        #: 2: a piece; 1: only the start of one.
        self.kind = {p[:n]: 1 for p in self.ids for n in range(1, len(p))} | dict.fromkeys(self.ids, 2)
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        #: Neighbouring characters within a piece; between any others all paths meet in one state.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.found = ahocorasick.Automaton()
        for p in self.ids:
            self.found.add_word(p, p)
        self.found.make_automaton()
        self.words = _WordIds(self)
        self.parts = _PartIds(self)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: the best-scoring adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def after(self, a: str) -> dict[str, bool]:
        """What is known of the pieces behind a piece."""
        if self.n_fits > 4 * MEMO:
            self.fits.clear()
            self.n_fits = 0
        return self.fits.setdefault(a, {})

    def neighbours(self, a: str, b: str, known: dict[str, bool] | None = None) -> bool:
        """Do the merges of a and b leave exactly a and b?"""
        known = self.after(a) if known is None else known
        got = known.get(b)
        if got is None:
            self.n_fits += 1
            got = known[b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def arcs(self, text: str, at: int) -> Iterator[str]:
        """Pieces that begin at a place; the single character always does."""
        yield text[at]
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            p = text[at:end]
            kind = self.kind.get(p)
            if kind is None:
                return
            if kind == 2:
                yield p

    def forward(self, text: str, end: int, entry: State) -> list[tuple[float, str] | None]:
        """best[e]: score and last piece of the best path from the entry state to e, for every e <= len(text).

        No piece begins at ``end`` or later; text behind it only lets pieces reach beyond.
        """
        n = len(text)
        best: list[tuple[float, str] | None] = [None] * (n + 1)
        piece, reach = entry
        if reach <= n:
            best[reach] = (0.0, piece)
        kinds, scores, unigram, longest = self.kind.get, self.scores, self.unigram, self.longest
        for b in range(reach, end):
            here = best[b]
            if here is None:
                continue
            score, last = here
            s = score
            known = self.after(last)
            fits = known.get
            for e in range(b + 1, min(n, b + longest) + 1):
                p = text[b:e]
                kind = kinds(p)
                if kind != 2 and e > b + 1:
                    if kind is None:
                        break
                    continue
                if unigram:
                    s = score + scores.get(p, self.penalty)
                else:
                    fit = fits(p)
                    if fit is None:
                        fit = self.neighbours(last, p, known)
                    if not fit:
                        continue
                if best[e] is None or s > best[e][0]:
                    best[e] = (s, p)
        return best

    def part_path(self, part: str) -> list[str]:
        """The best path of a part from a start state to its end.

        As ``forward`` and ``trace``, with all arcs found in one pass, by their ends; of a byte-pair model, whose arcs
        weigh 0 or minus infinity, one path at most reaches a place.
        """
        if self.unigram or not self.ids.keys() >= set(part):
            return self.trace(self.forward(part, len(part), START), START, len(part))
        after, made = self.after, self.fits.get
        last: list[str | None] = ["", *[None] * len(part)]
        known: list[dict[str, bool] | None] = [after(""), *[None] * len(part)]
        for end, p in self.found.iter(part):
            end += 1
            if last[end] is None:
                b = end - len(p)
                fits = known[b]
                if fits is not None:
                    fit = fits.get(p)
                    if fit is None:
                        fit = self.neighbours(last[b], p, fits)
                    if fit:
                        last[end], known[end] = p, made(p) or after(p)
        out, e = [], len(part)
        while e:
            out.append(last[e])
            e -= len(last[e])
        return out[::-1]

    def trace(self, best: list, entry: State, exit_: int) -> list[str]:
        """Pieces of the best path that end at ``exit_``, without the entry's own."""
        out, e = [], exit_
        while e > entry[1]:
            out.append(best[e][1])
            e -= len(best[e][1])
        return out[::-1]

    def entries(self, text: str, at: int) -> list[State]:
        """Every state a path can be in at a place within a text."""
        out = []
        for b in range(max(0, at - self.longest), at):
            out += [(p, b + len(p) - at) for p in self.arcs(text, b) if b + len(p) >= at]
        return out

    def transfer(self, text: str, length: int, entries: Sequence[State]) -> Matrix:
        """Best scores from each entry state to each state at ``length``; ``text`` goes on behind it.

        Where a word ends, all paths meet in one state: entries matter up to the first such place only, exits from the last.
        """
        stops = [s for s in self.stops(text[:length]) if s >= self.longest]
        if len(stops) > 1:
            first, last = stops[0], stops[-1]
            middle = self.forward(text[first:last], last - first, START)[-1][0] if self.unigram else 0.0
            ends = {x: middle + s for x, s in self._transfer(text[last:], length - last, [START])[START].items()}
            out: Matrix = {}
            for entry in entries:
                met = self.forward(text[:first], first, entry)[-1]
                out[entry] = {x: met[0] + s for x, s in ends.items()} if met else {}
            return out
        return self._transfer(text, length, entries)

    def _transfer(self, text: str, length: int, entries: Sequence[State]) -> Matrix:
        out: Matrix = {}
        for entry in entries:
            row: dict[State, float] = {}
            if entry[1] > length:
                row[entry[0], entry[1] - length] = 0.0
            elif entry[1] == length:
                row[entry[0], 0] = 0.0
            else:
                best = self.forward(text, length, entry)
                for e in range(length, len(best)):
                    # Of all pieces that reach e, each is a state; their scores come from where they begin.
                    for b in range(max(entry[1], e - self.longest), length):
                        if best[b] is None or e <= b:
                            continue
                        p = text[b:e]
                        if (p in self.ids or e == b + 1) and (self.unigram or self.neighbours(best[b][1], p)):
                            row[p, e - length] = best[b][0] + (self.scores.get(p, self.penalty) if self.unigram else 0.0)
            out[entry] = row
        return out

    def piece_ids(self, pieces: Sequence[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def between(self, text: str, entry: State = START, exit_: State | None = None, ahead: str = "") -> list[int]:
        """Ids of the pieces that begin in ``text``, between an entry and an exit state (its end, if none).

        At a space behind another character the path has one state only, as no piece holds both: the
        words between such places are traced one by one and remembered.
        """
        over = exit_[1] if exit_ else 0
        text += ahead[:over]
        if entry[1] >= len(text):
            return []
        stops = self.stops(text)
        out: list[int] = []
        for lo, hi in zip([0, *stops], [*stops, len(text)]):
            if hi <= entry[1]:
                continue
            if lo < entry[1] or (lo == 0 and entry != START):
                word, reach = text[:hi], entry
                best = self.forward(word, hi, reach)
                out += self.piece_ids(self.trace(best, reach, hi))
            else:
                word = text[lo:hi]
                out += self.words[word[1:]] if word[0] == SPACE else self.word_ids(word)
        return out

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text from a start state, part by part."""
        inside, parts = self.inside, self.parts
        at, out = 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out += parts[word[at:i]]
                at = i
        return out + parts[word[at:]] if at else parts[word]

    def stops(self, text: str) -> list[int]:
        """Places before a space sign that follows another character."""
        out, at = [], text.find(SPACE, 1)
        while at >= 0:
            if text[at - 1] != SPACE:
                out.append(at)
            at = text.find(SPACE, at + 1)
        return out

    def whole(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids of a text of one chunk, and whether they decode to it: one matrix of one entry and one exit, one factor a word."""
        norm = self.normal(text)
        if norm[:1] != SPACE or SPACE + SPACE in norm:
            ids = np.array(self.between(norm), np.int32)
            return ids, self.decode(ids.tolist()) == text
        lossy = self.words.lossy
        ids = np.fromiter(chain.from_iterable(map(self.words.__getitem__, norm[1:].split(SPACE))), np.int32)
        if not self.prefix or SPACE in text:
            return ids, self.decode(ids.tolist()) == text
        return ids, self.words.lossy == lossy

    def normal(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def joined(self, ids: Sequence[int]) -> str:
        """The pieces of ids in a row; byte pieces are joined as UTF-8, broken sequences become U+FFFD."""
        names, bytes_ = self.names, self.byte_of
        if bytes_.keys().isdisjoint(ids):
            return "".join([names[i] for i in ids])
        raw = b"".join([bytes([bytes_[i]]) if i in bytes_ else names[i].encode() for i in ids])
        return raw.decode("utf-8", "replace")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids."""
        text = self.joined(ids).replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product: best scores over what lies between."""
    out: Matrix = {}
    for i, row in a.items():
        new: dict[State, float] = {}
        for j, s in row.items():
            for k, t in b.get(j, {}).items():
                if s + t > new.get(k, -np.inf):
                    new[k] = s + t
        out[i] = new
    return out


def prefixes(ms: list[Matrix]) -> list[Matrix]:
    """Products of the first 1, 2, .. matrices: pairs first, their prefixes, then the ones in between."""
    if len(ms) < 2:
        return ms
    pairs = prefixes([product(ms[i], ms[i + 1]) for i in range(0, len(ms) - 1, 2)])
    out = [ms[0]]
    for i in range(1, len(ms)):
        out.append(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], ms[i]))
    return out


def boundary_states(ms: list[Matrix]) -> list[State]:
    """State of the best whole path after each matrix; the last ends at the text's end."""
    run = prefixes(ms)
    ends = {s: v for s, v in run[-1][START].items() if s[1] == 0}
    state = max(ends, key=lambda s: ends[s])
    out = [state]
    for i in range(len(ms) - 1, 0, -1):
        row = run[i - 1][START]
        state = max((s for s in row if state in ms[i].get(s, {})), key=lambda s: row[s] + ms[i][s][state])
        out.append(state)
    return out[::-1]


@lru_cache(1)
def _loaded(path: str, unigram: bool | None) -> Pieces:
    return Pieces(path, unigram)


def pieces_of(path: str, unigram: bool | None = None) -> Pieces:
    """One vocabulary a worker process."""
    working("pieces", _loaded.cache_clear)
    return _loaded(path, unigram)


_CHUNK = "k bigint, row bigint, chunk int, chunks int, before string, body string, ahead string"


def encode_pieces(
    notes: DataFrame, model: str, key: str = "seq", text: str = "reason", into: str = "ids", chunk: int = 65_536, unigram: bool | None = None
) -> DataFrame:
    """The key, ``into`` (array<int>: SentencePiece ids) and ``round_trip`` (do the ids decode to the text?).

    Notes are rows with a whole-number key and a free text; ``model`` is the path of a .model file that every
    executor can read.  Texts of more than ``chunk`` characters are cut there, wherever that falls.  Every chunk yields
    the matrix of best scores between the states at its two ends; the matrices of a text (2 GiB at most, so 32,768 of
    them) are combined by an associative scan into the states of the best path, and every chunk is then traced alone.

    Null texts are empty, empty texts have no ids.  A text with the space sign itself does not round-trip (the format
    cannot tell it from a space).  Repeated rows and null keys stay; other columns are left out; no rows give no rows.
    """
    rows = notes_of(notes, key, text).withColumn("row", F.xxhash64("k", "t"))
    short = rows.filter(F.length("t") <= chunk).select("k", "t")
    short = short.mapInArrow(_encode_short(model, unigram), "k bigint, ids array<int>, round_trip boolean")
    long = rows.filter(F.length("t") > chunk).dropDuplicates(["k", "row"])
    cut = long.select("k", "row", "t").mapInArrow(_cut(model, chunk, unigram), _CHUNK)
    cut = cut.repartition("k", "row", "chunk")
    matrices = cut.mapInArrow(_transfers(model, unigram), "k bigint, row bigint, chunk int, matrix binary")
    states = matrices.groupBy("k", "row").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("ms"))
    states = states.mapInArrow(_scan, "k bigint, row bigint, chunk int, entry binary, exit binary")
    same = lambda a, b: a["k"].eqNullSafe(b["k"]) & (a["row"] == b["row"])
    s = states
    traced = cut.join(s, same(cut, s) & (cut["chunk"] == s["chunk"])).select(
        cut["k"], cut["row"], cut["chunk"], _trace(model, unigram)("body", "ahead", "entry", "exit").alias("ids")
    )
    ids = traced.groupBy("k", "row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    ids = ids.select("k", "row", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    every = rows.filter(F.length("t") > chunk)
    giant = every.join(ids, same(every, ids)).select(every["k"], "ids", (decoded(model, unigram)("ids") == F.col("t")).alias("round_trip"))
    return short.unionByName(giant).select(F.col("k").alias(key), F.col("ids").alias(into), "round_trip")


def decoded(model: str, unigram: bool | None = None):
    """Column function: ids -> text; null ids are none."""

    @F.pandas_udf(T.StringType())
    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = pieces_of(model, unigram)
        for part in ids:
            yield pd.Series([d.decode(x.tolist()) if x is not None else "" for x in part], dtype=object)

    return run


def _encode_short(model: str, unigram: bool | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = pieces_of(model, unigram)
        for batch in sliced(batches):
            texts = batch.column("t").to_pylist()
            coded = [d.whole(t) for t in texts]
            ids, same = [x for x, _ in coded], [s for _, s in coded]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(ends, flat), pa.array(same, pa.bool_())], ["k", "ids", "round_trip"])

    return run


def _cut(model: str, chunk: int, unigram: bool | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = pieces_of(model, unigram)
        for batch in batches:
            for k, row, text in zip(*(batch.column(c).to_pylist() for c in ("k", "row", "t"))):
                text = d.normal(text)
                ends = list(range(0, len(text), chunk))
                for i in range(0, len(ends), 256):
                    part = ends[i : i + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(part), pa.int64()), pa.array([row] * len(part), pa.int64()),
                         pa.array(range(i, i + len(part)), pa.int32()), pa.array([len(ends)] * len(part), pa.int32()),
                         pa.array([text[max(0, a - d.longest) : a] for a in part], pa.string()), pa.array([text[a : a + chunk] for a in part], pa.string()),
                         pa.array([text[a + chunk : a + chunk + d.longest] for a in part], pa.string())],
                        [c.split()[0] for c in _CHUNK.split(", ")],
                    )

    return run


def _pack(x) -> bytes:
    import json

    return json.dumps(x).encode()


def _unpack(b: bytes):
    import json

    return json.loads(b)


def _transfers(model: str, unigram: bool | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = pieces_of(model, unigram)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                entries = d.entries(r["before"] + r["body"] + r["ahead"], len(r["before"])) if r["chunk"] else [START]
                m = d.transfer(r["body"] + r["ahead"], len(r["body"]), entries)
                out.append(_pack([[list(e), [[list(x), s] for x, s in row.items()]] for e, row in m.items()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("row"), batch.column("chunk"), pa.array(out, pa.binary())], ["k", "row", "chunk", "matrix"]
            )

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ms = [{tuple(e): {tuple(x): s for x, s in row} for e, row in _unpack(m["matrix"])} for m in r["ms"]]
            states = boundary_states(ms)
            n = len(ms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["k"]] * n, pa.int64()), pa.array([r["row"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                 pa.array([_pack(s) for s in [START, *states[:-1]]], pa.binary()), pa.array([_pack(s) for s in states], pa.binary())],
                ["k", "row", "chunk", "entry", "exit"],
            )


def _trace(model: str, unigram: bool | None):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        d = pieces_of(model, unigram)
        for body, ahead, entry, exit_ in parts:
            yield pd.Series(
                [np.array(d.between(b, tuple(_unpack(e)), tuple(_unpack(x)), a), np.int32) for b, a, e, x in zip(body, ahead, entry, exit_)], dtype=object
            )

    return run
