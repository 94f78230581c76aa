"""How two tokenizers cut the same notes: tokens of either aligned over byte ranges, each distinct text once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import notes_of, sliced, text_id, working, written

#: Characters of text whose links are counted together before they are shuffled.
BLOCK_CHARS = 1 << 22
# Fixed value: how byte-level vocabularies cut a text before they merge.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters for themselves, others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteVocabulary:
    """A byte-level vocabulary file (.json): ids of a text, and the bytes of an id.  Special strings are plain text.

    Where the merges are in the order of the ids they make, ids are ranks, and the rank encoder gives the same ids in
    a fifth of the time; otherwise the file's own library encodes.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model, cut = byte_letters(), file["model"], file["pre_tokenizer"] or {}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        plain = {token: i for token, i in model["vocab"].items() if token not in special}
        ranks = {bytes(letters[c] for c in token): i for token, i in plain.items()}
        self.pieces = [b""] * (max([*model["vocab"].values(), *special.values()]) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for token, i in special.items():
            self.pieces[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        regular = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file["normalizer"]
        singles = all(bytes([b]) in ranks for b in range(256))
        if regular and singles and made == sorted(set(made)) and len(ranks) == 256 + len(made) and not model.get("ignore_merges"):
            self.encode = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids


class PieceVocabulary:
    """A sentencepiece model: ids of a text (the model adds the space), and the bytes of an id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = model.encode
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.pieces = [
            bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]


class Aligner:
    """Aligns the tokens of a byte-level vocabulary (A) and a piece model (B)."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.a, self.b = ByteVocabulary(byte_vocabulary), PieceVocabulary(piece_model)
        self.n_a, self.n_b = len(self.a.pieces), len(self.b.pieces)
        self.len_a = np.array([len(p) for p in self.a.pieces])
        self.len_b = np.array([len(p) for p in self.b.pieces])
        # Ids as text behind their separator: further A, first A of a group, further B, first B of a group.
        self.words = [f"{s}{i}" for s, n in ((",", self.n_a), (";", self.n_a), (",", self.n_b), ("|", self.n_b)) for i in range(n)]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of either vocabulary, if both spell the text with a space before it."""
        if not text:
            return None
        a, b = self.a.encode(" " + text), self.b.encode(text)
        spelled = b" " + text.encode()
        if b"".join(map(self.a.pieces.__getitem__, a)) != spelled or b"".join(map(self.b.pieces.__getitem__, b)) != spelled:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int, str]:
        """(pair of every link, number of groups, SHA-256 of the groups).

        The ends of both cut the text into stretches that one token of either covers: a link each, since two tokens overlap in one
        stretch only.  Ends that both have are the ends of groups.
        """
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] * self.n_b + b[np.searchsorted(ends_b, ends)]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        line = np.empty(len(a) + len(b), np.int64)
        first = lambda g: np.diff(g, prepend=-1) > 0
        line[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + first(group_a) * self.n_a
        line[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + (2 * self.n_a + first(group_b) * self.n_b)
        groups = "".join(map(self.words.__getitem__, line.tolist()))[1:]
        return pairs, len(common), hashlib.sha256(groups.encode()).hexdigest()


@lru_cache(1)
def _loaded(byte_vocabulary: str, piece_model: str) -> Aligner:
    return Aligner(byte_vocabulary, piece_model)


def aligner_of(byte_vocabulary: str, piece_model: str) -> Aligner:
    """One pair of vocabularies a worker process."""
    working("alignment", _loaded.cache_clear)
    return _loaded(byte_vocabulary, piece_model)


#: Rows of texts (id and what follows), and one row a block with its distinct pairs and how many links of the corpus they are.
_ALIGNED = pa.schema(
    [("block", pa.int64()), ("id", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())]
)
_ALIGNED_DDL = (
    "block bigint, id binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary, "
    "pairs binary, counts binary"
)


def _place_type(n_pairs: int) -> type:
    """Wide enough for places among the distinct pairs of a block."""
    return np.uint16 if n_pairs <= 1 << 16 else np.uint32


def _align(byte_vocabulary: str, piece_model: str):
    """Distinct texts (id, t, n: rows that have it) -> aligned texts by block."""

    def flush(block, rows):
        pairs, place = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        out, at = [], 0
        for i, times, a, b, groups, links, found, much, sha in rows:
            where = place[at : at + len(found)]
            at += len(found)
            counts[where] += much * times
            much = much.astype(np.min_scalar_type(int(much.max())))
            out.append((block, i, a, b, groups, links, sha, where.astype(_place_type(len(pairs))).tobytes(), much.tobytes(), None, None))
        out.append((block, None, None, None, None, None, None, None, None, pairs.tobytes(), counts.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ALIGNED)], schema=_ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = aligner_of(byte_vocabulary, piece_model), TaskContext.get().partitionId() << 32
        rows, room = [], BLOCK_CHARS
        for batch in sliced(batches, 64):
            for i, text, n in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "n"))):
                both = aligner.tokens(text)
                if both is None:
                    continue
                pairs, groups, sha = aligner.align(*both)
                found, much = np.unique(pairs, return_counts=True)
                rows.append((i, n, len(both[0]), len(both[1]), groups, len(pairs), found, much, sha))
                room -= len(text)
                if room <= 0:
                    yield flush(block, rows)
                    rows, room, block = [], BLOCK_CHARS, block + 1
        if rows:
            yield flush(block, rows)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of each block -> (block, pair, n)."""
    for batch in sliced(batches, 4):
        for block, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "counts"))):
            pairs = np.frombuffer(pairs, np.int64)
            cols = (np.full(len(pairs), block), pairs, np.frombuffer(counts, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["block", "pair", "n"])


def _measure(texts: pa.Table, totals: pa.Table) -> pa.Table:
    """The texts of a block with what the corpus-wide counts of its pairs say."""
    order = np.argsort(totals.column("pair").to_numpy())
    total, best = totals.column("total").to_numpy()[order], totals.column("best").to_numpy()[order].astype(np.int64)
    kind = _place_type(len(order))
    n_best, count_sum = [], []
    for places, times in zip(texts.column("places").to_pylist(), texts.column("times").to_pylist()):
        at = np.frombuffer(places, kind)
        much = np.frombuffer(times, f"u{len(times) // len(at)}").astype(np.int64)
        n_best.append(int(much @ best[at]))
        count_sum.append(int(much @ total[at]))
    out = texts.select([*_TEXT, "groups_sha256"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


_TEXT = ["id", "n_a", "n_b", "n_groups", "n_links"]
_MEASURED = "id binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"


def pair_counts(pairs: DataFrame, n_b: int) -> DataFrame:
    """(pair, n) -> (pair, total, best): the links of each pair of ids, and whether none of its B id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    top = F.max("total").over(Window.partitionBy("_b"))  # as many rows as A has ids, at most
    return counts.withColumn("_b", F.col("pair") % n_b).withColumn("best", F.col("total") == top).drop("_b")


def tokenizer_agreement(notes: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "seq", text: str = "reason") -> DataFrame:
    """How a byte-level vocabulary (A, .json) and a sentencepiece model (B) cut each note: one row for each.

    Notes are rows with a key and a free text, as ``seq`` and ``reason`` of the weight-change log.  A encodes the text with a space before it, B
    adds that space itself; special strings are plain text.  Columns: the key, ``n_a``, ``n_b`` (tokens), ``n_groups`` (byte offsets
    where tokens of both end cut a text into groups), ``n_links`` (pairs of tokens whose bytes overlap), ``n_best`` (links whose pair of ids has, over
    all notes, the most links of its B id, ties included), ``count_sum`` (over the links: the links of their pair over all
    notes), ``groups_sha256`` (of the ids by group: ``a1,a2|b1;a3|b2,b3``).

    Notes are shuffled by their whole text and each distinct text is tokenised and aligned once; its pairs count as often as
    rows have it.  The pairs of up to BLOCK_CHARS characters of texts are counted before they are shuffled, and every block asks for
    the counts of its own distinct pairs, so no table of pairs goes to the driver or to all tasks.  Then the measures of a text meet all rows
    with it.

    Texts that are null or empty, and texts that one of the two does not spell (a U+2581 in the text, normalised characters), have no
    tokens: zeros, and an empty hash.  Rows with a missing key and repeated rows are notes like others.  Extra columns are left out.  No rows give no rows.
    """
    rows = notes_of(notes, key, text)
    distinct = rows.filter("t <> ''").groupBy("t").agg(F.count("*").alias("n")).select(text_id("t").alias("id"), "t", "n")
    aligned = written(distinct.mapInArrow(_align(byte_vocabulary, piece_model), _ALIGNED_DDL), "aligned")
    pairs = aligned.filter("pairs is not null").select("block", "pairs", "counts")
    pairs = written(pairs.mapInArrow(_pairs, "block bigint, pair bigint, n bigint"), "pairs")
    counts = pair_counts(pairs, len(PieceVocabulary(piece_model).pieces))
    totals = pairs.select("block", "pair").join(counts, "pair")
    texts = aligned.filter("pairs is null").select("block", *_TEXT, "groups_sha256", "places", "times")
    measured = texts.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_measure, _MEASURED)

    # Rows without a text meet nothing, each under a key of its own.
    own = F.monotonically_increasing_id().cast("string").cast("binary")
    out = rows.select("k", F.when(F.col("t") == "", own).otherwise(text_id("t")).alias("id")).join(measured, "id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select(F.col("k").alias(key), *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
