"""Near-duplicate notes: consistent weighted samples of TF-IDF shingles, in bands, checked by weighted Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HASHES, connected, grams, mix, notes_of, sliced, text_id, working, written

#: Shingles, and texts, that travel together at most.
_BLOCK_SHINGLES, _BLOCK_TEXTS = 1 << 20, (1 << 16) - 1


def shingles(text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (hashes of runs of lower-case words) and how often each occurs."""
    return np.unique(grams(HASHES.of(text.lower().split()), words), return_counts=True)


def _cut(h: np.ndarray) -> bytes:
    """The upper six bytes of each hash: with the bucket, enough to tell shingles apart."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _raw(six: np.ndarray) -> np.ndarray:
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view(np.uint64).ravel()


def _whole(b: bytes, bucket: int) -> np.ndarray:
    """Hashes again, of the six bytes and the bucket."""
    return mix(_raw(np.frombuffer(b, np.uint8).reshape(-1, 6)) + np.uint64(bucket))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"u{len(b) // n}").astype(np.int64)


_DEALT = "bucket int, block bigint, ids binary, totals binary, docs binary, tags binary, sizes binary, shingles binary, tf binary"
_SHARED = "block bigint, bucket int, ids binary, totals binary, docs binary, shingles binary, tf binary, df binary"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names = [c.split(" ") for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], [n for n, _ in names])


def _deal(words: int, buckets: int):
    """Texts -> blocks of texts, their shingles dealt into buckets; a text once a task.

    A block has a row with the ids and sizes of its texts, and a row a bucket: which texts (their place in the block, four bytes of their
    id) have how many of their shingles there, and these.
    """

    def flush(block, ids, sets, tfs):
        sizes = np.array([len(s) for s in sets])
        tags = np.frombuffer(b"".join(ids), np.uint32)[::4]
        totals = np.array([t.sum() for t in tfs], np.uint32)
        h, tf, doc = np.concatenate(sets), np.concatenate(tfs), np.repeat(np.arange(len(ids)), sizes)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, tf, doc, bucket = h[order], tf[order], doc[order], bucket[order]
        found, start = np.unique(bucket, return_index=True)
        rows = [(int(block % buckets), block, b"".join(ids), totals.tobytes(), *[None] * 5)]
        for b, i, j in zip(found, start, [*start[1:], len(bucket)]):
            docs, n = np.unique(doc[i:j], return_counts=True)
            rows.append((int(b), block, None, None, docs.astype(np.uint16).tobytes(), tags[docs].tobytes(), _narrow(n), _cut(h[i:j]), _narrow(tf[i:j])))
        return _batch(rows, _DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("hashes", HASHES.clear)
        seen: set[bytes] = set()
        block, room = TaskContext.get().partitionId() << 32, _BLOCK_SHINGLES
        ids, sets, tfs = [], [], []
        for batch in sliced(batches):
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                if i in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(i)
                h, tf = shingles(t, words)
                if len(h):
                    ids.append(i), sets.append(h), tfs.append(tf)
                    room -= len(h)
                if ids and (room <= 0 or len(ids) == _BLOCK_TEXTS):
                    yield flush(block, ids, sets, tfs)
                    block, room = block + 1, _BLOCK_SHINGLES
                    ids, sets, tfs = [], [], []
        if ids:
            yield flush(block, ids, sets, tfs)

    return run


def _weigh(rows: list[dict]) -> list[tuple]:
    """A bucket -> for each block, the shingles that several texts have, with the number of texts."""
    bucket = rows[0]["bucket"]
    rows.sort(key=lambda r: r["block"])
    docs = [np.frombuffer(r["docs"], np.uint16) for r in rows]
    sizes = np.concatenate([_wide(r["sizes"], len(d)) for r, d in zip(rows, docs)])
    tags = np.frombuffer(b"".join(r["tags"] for r in rows), np.uint32)
    blocks = np.repeat(np.array([r["block"] for r in rows]), [len(d) for d in docs])
    docs = np.concatenate(docs)
    six = np.frombuffer(b"".join(r["shingles"] for r in rows), np.uint8).reshape(-1, 6)
    h = _raw(six)
    tf = np.concatenate([_wide(r["tf"], len(r["shingles"]) // 6) for r in rows])
    # Copies of a text that several tasks sent have the same tag and shingles: the one of the lowest block stays, in every bucket.
    marks = np.add.reduceat(h, np.cumsum(sizes) - sizes)
    order = np.lexsort((docs, blocks, marks, sizes, tags))
    again = np.zeros(len(order), bool)
    again[1:] = True
    for x in (tags, sizes, marks):
        again[1:] &= x[order][1:] == x[order][:-1]
    keep = np.ones(len(order), bool)
    keep[order] = ~again
    entry = np.repeat(np.arange(len(sizes)), sizes)
    on = keep[entry]
    h, tf, entry = h[on], tf[on], entry[on]
    _, where, df = np.unique(h, return_inverse=True, return_counts=True)
    df = df[where]
    on = df > 1
    h, tf, entry, df = h[on], tf[on], entry[on], df[on]
    found, start = np.unique(blocks[entry], return_index=True)
    return [
        (int(b), bucket, None, None, docs[entry[i:j]].tobytes(), _cut(h[i:j]), _narrow(tf[i:j]), _narrow(df[i:j]))
        for b, i, j in zip(found, start, [*start[1:], len(entry)])
    ]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket -> for each block, what the texts of it share with other texts; rows with ids pass."""
    working("shared")
    at, rows = None, []
    for batch in sliced(batches, 32):
        out = []
        for r in batch.to_pylist():
            if r["ids"] is not None:
                out.append((r["block"], -1, r["ids"], r["totals"], *[None] * 4))
                continue
            if rows and r["bucket"] != at:
                out += _weigh(rows)
                rows = []
            at = r["bucket"]
            rows.append(r)
        if out:
            yield _batch(out, _SHARED)
    if rows and (out := _weigh(rows)):
        yield _batch(out, _SHARED)


def idf(df, n_texts: int, idf_share: float):
    """From 1 + idf_share, for a shingle of one text, down to 1, for one that every text has."""
    return 1 + idf_share * (1 - np.log(df) / math.log(max(n_texts, 2)))


def consistent_samples(h: np.ndarray, w: np.ndarray, samples: int, seed: int = 1) -> np.ndarray:
    """One 64-bit code for each sample of a weighted set (improved consistent weighted sampling).

    Two sets have the same code for a sample with the probability of their weighted Jaccard similarity.
    """
    best = np.full(samples, np.inf)
    code = np.zeros(samples, np.uint64)
    lanes = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    low = np.uint64(0xFFFFFFFF)
    logw = np.log(w.astype(float))
    for i in range(0, len(h), 2048):
        part, lw = h[i : i + 2048, None], logw[i : i + 2048, None]
        x = mix(part ^ lanes)
        y = mix(x + np.uint64(0x632BE59BD9B4E019))
        z = mix(y + np.uint64(0x632BE59BD9B4E019))
        unit = lambda v: (v.astype(float) + 0.5) * 2.0**-32
        r = -np.log(unit(x & low) * unit(x >> np.uint64(32)))
        c = -np.log(unit(y & low) * unit(y >> np.uint64(32)))
        beta = unit(z & low)
        t = np.floor(lw / r + beta)
        a = np.log(c) - r * (t - beta) - r
        at = a.argmin(0)
        lane = np.arange(samples)
        value = a[at, lane]
        better = value < best
        best[better] = value[better]
        found = mix(part[at, 0] ^ mix(t[at, lane].astype(np.int64).astype(np.uint64)))
        code[better] = found[better]
    return code


_SIGNED = "id binary, mass double, common double, shingles binary, weights binary, bands array<bigint>, marks array<bigint>"
#: Words of 64 bits that mark which shingles a text shares, each by ten bits of its hash.
_MARKS = 16


def _sign(bands: int, rows: int, similarity: float, idf_share: float, n_texts: int):
    """The rows of a block -> its texts' weights by shingle and a hash for each band; texts too little of which is shared go."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        head = next(r for r in parts if r["ids"] is not None)
        parts = [r for r in parts if r["ids"] is None]
        ids, total = np.frombuffer(head["ids"], "V16"), np.frombuffer(head["totals"], np.uint32).astype(np.int64)
        join = lambda arrays, kind: np.concatenate([np.zeros(0, kind), *arrays])
        sizes = [len(r["docs"]) // 2 for r in parts]
        doc = join([np.frombuffer(r["docs"], np.uint16) for r in parts], np.int64)
        h = join([_whole(r["shingles"], r["bucket"]) for r in parts], np.uint64)
        tf, df = (join([_wide(r[c], n) for r, n in zip(parts, sizes)], np.int64) for c in ("tf", "df"))
        w = (tf * idf(df, n_texts, idf_share)).astype(np.float32)
        order = np.lexsort((h, doc))
        doc, h, tf, w = doc[order], h[order], tf[order], w[order]
        # What only one text has counts as one private element: it weighs as much and meets no other.
        private = (total - np.bincount(doc, tf, len(ids))) * (1 + idf_share)
        shared = np.bincount(doc, w, len(ids))
        ends = np.searchsorted(doc, np.arange(len(ids) + 1))
        out: list[list] = [[] for _ in range(7)]
        for d in np.flatnonzero((shared > 0) & (shared >= (similarity - 1e-6) * (shared + private))):
            hs, ws = h[ends[d] : ends[d + 1]], w[ends[d] : ends[d + 1]]
            marks, bit = np.zeros(_MARKS, np.uint64), hs >> np.uint64(54)
            np.bitwise_or.at(marks, (bit >> np.uint64(6)).astype(int), np.uint64(1) << (bit & np.uint64(63)))
            row = [ids[d].tobytes(), shared[d] + private[d], shared[d] / (shared[d] + private[d]), hs.tobytes(), ws.tobytes()]
            if private[d] > 0:
                hs, ws = np.append(hs, mix(np.frombuffer(row[0], np.uint64)[:1])), np.append(ws, np.float32(private[d]))
            codes = consistent_samples(hs, ws, bands * rows).reshape(bands, rows)
            band = np.arange(bands, dtype=np.uint64)
            for k in range(rows):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + codes[:, k])
            for c, v in zip(out, (*row, band.view(np.int64), marks.view(np.int64))):
                c.append(v)
        kinds = (pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [c.split(" ")[0] for c in _SIGNED.split(", ")])

    return run


def weighted_jaccard(ha, wa, ma: float, hb, wb, mb: float) -> float:
    """Of two weighted sets: sorted shared shingles, weights, and mass with the private rest."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[i], wb[j]).sum(dtype=float))
    return low / max(ma + mb - low, 1e-12)


@F.pandas_udf(T.DoubleType())
def _jaccard(ha: pd.Series, wa: pd.Series, ma: pd.Series, hb: pd.Series, wb: pd.Series, mb: pd.Series) -> pd.Series:
    words = lambda b: np.frombuffer(b, np.uint64)
    reals = lambda b: np.frombuffer(b, np.float32)
    return pd.Series(
        [weighted_jaccard(words(a), reals(b), c, words(d), reals(e), f) for a, b, c, d, e, f in zip(ha, wa, ma, hb, wb, mb)], dtype=float
    )


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, similarity) by the whole weighted sets; pairs whose masses rule a link out get 0."""
    side = lambda x: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("mass", "shingles", "weights")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    got = _jaccard("shingles_a", "weights_a", "mass_a", "shingles_b", "weights_b", "mass_b")
    return both.select("a", "b", got.alias("similarity"))


def _alone(marks: str, other: str) -> Column:
    """How many marks of one text the other does not have."""
    bits = [F.bit_count(F.get(marks, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(i))))) for i in range(_MARKS)]
    return sum(bits[1:], bits[0])


def _further_rounds(banded: DataFrame, tested: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Labels after every member of a band group that is outside its leader's class, and can have a link, has led or joined that class.

    Two texts share at most what the poorer of them shares with any text, less one for each mark that it has alone (a shingle weighs one at
    least): that bounds their similarity.
    """
    # Similarity s of masses x, y: the shared mass is s / (1 + s) of x + y.
    need = similarity / (1 + similarity) * (1 - 1e-6)
    shared = F.col("common") * F.col("mass")
    near = tested.select(F.col("a").alias("node"), F.col("b").alias("lead"), "similarity")
    groups = written(banded.filter("node <> lead").join(near, ["node", "lead"]).join(sets.select("node", "marks"), "node"), "groups")
    groups = groups.withColumn("shared", shared)
    done, led, leaders = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), None, 8
    while True:
        lead_label = labels.select(F.col("node").alias("lead"), F.col("label").alias("lead_label"))
        now = groups.join(labels, "node", "left").join(lead_label, "lead", "left")
        now = now.withColumn("label", F.coalesce("label", "node")).withColumn("lead_label", F.coalesce("lead_label", "lead"))
        now = written(now, "now")
        odd = now.filter((F.col("label") != F.col("lead_label")) & (F.col("shared") >= need * (F.col("mass") + F.col("least"))))
        if led is not None:
            odd = odd.join(led, ["band", "node"], "left_anti")
        # Only groups that still have such members go on.
        groups = now.drop("label", "lead_label").join(odd.select("band").distinct(), "band", "left_semi")
        best = Window.partitionBy("band").orderBy(F.desc("common"), "node")
        odd = odd.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= leaders)
        odd = odd.select("band", *[F.col(c).alias(f"{c}_x") for c in ("node", "similarity", "label", "mass", "shared", "marks")])
        odd = written(odd.withColumnRenamed("node_x", "x"), "leaders")
        if not odd.limit(1).count():
            return labels
        led = odd.select("band", F.col("x").alias("node")) if led is None else led.union(odd.select("band", F.col("x").alias("node")))
        far = F.abs(F.col("similarity") - F.col("similarity_x")) > 1 - similarity + 1e-6
        enough = need * (F.col("mass") + F.col("mass_x"))
        rich = F.least("shared", "shared_x") >= enough  # cheaper than to look at the marks
        alike = F.least(F.col("shared") - _alone("marks", "marks_x"), F.col("shared_x") - _alone("marks_x", "marks")) >= enough
        meet = now.join(odd, "band").filter((F.col("label") != F.col("label_x")) & rich & ~far & alike)
        meet = meet.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
        more = written(_similarities(meet.join(done, ["a", "b"], "left_anti"), sets), "tested")
        done = done.union(more.select("a", "b"))
        links = more.filter(F.col("similarity") >= similarity)
        if links.limit(1).count():
            links = links.select("a", "b")
            for c in ("a", "b"):  # between classes
                of = labels.select(F.col("node").alias(c), F.col("label").alias("_l"))
                links = links.join(of, c, "left").withColumn(c, F.coalesce("_l", c)).drop("_l")
            merged = connected(links.distinct(), "a", "b").select(F.col("node").alias("label"), F.col("label").alias("to"))
            alone = merged.select(F.col("label").alias("node"), "label").join(labels, "node", "left_anti")
            both = labels.union(alone.select("node", "label")).join(merged, "label", "left")
            labels = written(both.select("node", F.coalesce("to", "label").alias("label")), "labels")
        leaders *= 4


def near_duplicates(
    notes: DataFrame,
    key: str = "seq",
    text: str = "reason",
    words: int = 5,
    similarity: float = 0.8,
    bands: int = 20,
    rows: int = 3,
    idf_share: float = 0.1,
    buckets: int | None = None,
) -> DataFrame:
    """One row for each note: the key and ``class_id``, the smallest key of its class.

    Notes are rows with a whole-number key and a free text.  Two texts are linked if the weighted Jaccard
    similarity of their shingles (``words`` lower-case words) is ``similarity`` or more; a class is what links
    connect, and equal texts always share one.  A shingle weighs its frequency times an idf between 1 (in all
    texts) and 1 + ``idf_share`` (in one), counted over all distinct texts.  The share is small because in a large
    group of near copies the edits are the rare shingles: with a plain idf they would outweigh what is common.

    Texts travel in blocks, as six bytes a shingle, dealt into ``buckets`` (as many as shuffle partitions unless given), where document
    frequencies are counted; what several texts have comes back to its block.  What only one text has is one private element.  Texts of
    which less than ``similarity`` is shared cannot be linked and go.  The others get ``bands`` x ``rows`` consistent
    samples; a pair of similarity 0.8 shares no band with a probability below 1e-6.  In every band group all
    members are compared with the one whose text is shared most.  While a group still has members outside that leader's class, the
    best of them lead in turn (eight in the first round, four times as many in each further one) and are compared with the members of other classes that neither the
    distances to the first leader (1 - similarity is a metric) nor what each shares at all rules out.  Links merge whole classes, so few
    rounds are needed; members that no mass in their group lets them link to don't lead.

    Null texts are empty.  Empty texts form one class; texts below ``words`` words have one shingle of all their
    words.  A null key takes no part in ``class_id`` unless all keys of a class are null.  Repeated rows stay, extra columns are
    left out, no rows give no rows.
    """
    spark = notes.sparkSession
    texts = notes_of(notes, key, text).withColumn("id", text_id("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or parts
    groups = written(texts.groupBy("id").agg(F.min("k").alias("node")), "texts")
    n_texts = groups.count()

    dealt = texts.select("id", "t").mapInArrow(_deal(words, buckets), _DEALT).repartitionById(buckets, "bucket")
    blocks = dealt.mapInArrow(_shared, _SHARED).groupBy("block")
    signed = blocks.applyInArrow(_sign(bands, rows, similarity, idf_share, n_texts), _SIGNED)
    sets = written(signed.join(groups.filter("node is not null"), "id").drop("id"), "sets")

    banded = written(sets.select("node", "common", "mass", F.explode("bands").alias("band")), "bands")
    lead = F.max(F.struct("common", F.negative("node").alias("low")))
    leads = banded.groupBy("band").agg(F.negative(lead["low"]).alias("lead"), F.min("mass").alias("least"), F.count("*").alias("n")).filter("n > 1")
    banded = banded.join(leads.select("band", "lead", "least"), "band")
    pairs = banded.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    tested = written(_similarities(pairs, sets), "tested")
    labels = connected(tested.filter(F.col("similarity") >= similarity), "a", "b")
    labels = _further_rounds(banded, tested, labels, sets, similarity)

    classes = groups.join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("class_id"))
    return texts.select("k", "id").join(classes, "id").select(F.col("k").alias(key), "class_id")
