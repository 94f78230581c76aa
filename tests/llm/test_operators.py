"""The text operators against brute force, reference libraries and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import codec, fingerprints, fixity, mixing, neardup, passages, pieces, token_counts, token_files, topk, toxicity
from barloom.llm.common import written

NOTES = "seq bigint, reason string, weight_name string, k string, t bigint, id string, source string"
VOCAB = [f"{a}{b}" for a in "walls gex skew trend vix pain floor range spot delta".split() for b in ("", "ing", "ed", "s", "er", "ly")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n))


def notes(spark, rows):
    """Notes with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, w, "x", 1, "y", "z") for k, t, w in rows], NOTES)


def simple(spark, texts):
    return notes(spark, [(i, t, "gex_levels") for i, t in enumerate(texts)])


def odd_texts(rng):
    return [None, "", " ", "\n", "a", "vix up", prose(rng, 60), prose(rng, 3000), "x" * 5000, "né 日本 \U0001f600 Σ", "same " * 80, "same " * 80]


@pytest.fixture()
def rng():
    return random.Random(5)


# ---- tokens ----


@pytest.fixture(scope="module")
def word_counter():
    return token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(spark, rng, word_counter):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bits = ["a", "the", "ing", " ", "\n", "é", "é", "Σ", "İ", "1", "²", "\x1c", "\xa0", "'s", "<|endoftext|>", "<|", "日本", "!!", "b" * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(500)] + [t or "" for t in odd_texts(rng)]
    assert [word_counter.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.add_token_counts(simple(spark, odd_texts(rng)).withColumn("n_tokens", F.lit("old")), path).orderBy("seq").collect()
    assert [r["n_tokens"] for r in got] == [word_counter.count(r["reason"] or "") for r in got]
    assert token_counts.add_token_counts(simple(spark, []), path).count() == 0


def test_merges_take_the_lowest_rank_then_the_leftmost():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}
    assert token_counts.merge_count(list("abc"), ranks) == 2
    assert token_counts.merge_count(list("aaaa"), {("a", "a"): 0, ("aa", "aa"): 1}) == 3
    assert token_counts.merge_count(["a"], ranks) == token_counts.merge_count([], ranks) == 0


def test_codec_round_trip_and_damage():
    r = np.random.default_rng(3)
    blocks = [r.zipf(1.3, n).clip(0, 65534).astype(np.uint32) for n in (0, 1, 7, 500, 500)] + [np.full(900, 7, np.uint32)]
    coded = codec.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, codec.decode_blocks(coded)))
    assert len(coded[-1]) < 200 and coded == codec.encode_blocks(blocks)
    assert codec.encode_blocks(blocks[3:4])[0] == coded[3]  # a block doesn't depend on its neighbours
    with pytest.raises(ValueError):
        codec.decode_blocks([coded[3][:-1] + bytes([coded[3][-1] ^ 1])])


def test_token_files(spark, rng):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i * 3, t, None) for i, t in enumerate(odd_texts(rng))] + [(None, "no key", None), (3, "again", None)]
    folder = token_files.write_token_files(notes(spark, rows), path, end_id=2, block_ids=64, lanes=8)
    got = token_files.token_directory(spark, folder, lanes=8).orderBy("start").collect()
    assert [r["k"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    want = Counter()
    for k, t, _ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[k, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["k"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    empty = token_files.write_token_files(simple(spark, []), path)
    assert token_files.token_directory(spark, empty).count() == 0


@pytest.fixture(scope="module")
def lattice():
    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def chunked(d, text, size):
    text = d.normal(text)
    at = list(range(0, len(text), size))
    ms = []
    for a in at:
        body, ahead, before = text[a : a + size], text[a + size : a + size + d.longest], text[max(0, a - d.longest) : a]
        ms.append(d.transfer(body + ahead, len(body), d.entries(before + body + ahead, len(before)) if a else [pieces.START]))
    states = pieces.boundary_states(ms)
    out = []
    for a, e, x in zip(at, [pieces.START, *states[:-1]], states):
        out += d.between(text[a : a + size], e, x, text[a + size : a + size + d.longest])
    return out


def test_pieces_equal_the_library(rng, lattice):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bits = ["a", "the", "ing", " ", "  ", "▁", "é", "日", "\U0001f600", "0", "12", "\n", "\t", ".", "--", "x" * 9, "\x00", "<s>"]
    for i in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        want = lib.encode(text)
        assert lattice.whole(text)[0].tolist() == want == chunked(lattice, text, rng.choice([1, 2, 5, 17, 60]))
        assert lattice.decode(want) == lib.decode(want)


def test_unigram_weights_find_the_best_path(rng):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type in (1, 4):
            p.type, p.score = 1, -8.0 - (i * 7919 % 1024) / 256
    raw = proto.SerializeToString()
    lib, d = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Pieces("", model=raw)
    weigh = lambda ids: sum(d.scores[d.names[i]] for i in ids)
    for size in (3, 11, 50, 400):
        text = " ".join(rng.choice(["walls", "skewed", "gamma", "expiry", "notional", "x"]) for _ in range(30))
        assert weigh(chunked(d, text, size)) == pytest.approx(weigh(lib.encode(text)))


def test_encode_pieces(spark, rng, lattice):
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = odd_texts(rng) + ["spot" * 400]
    coded = pieces.encode_pieces(simple(spark, texts), model, chunk=700).collect()
    assert len(coded) == len(texts) and all(r["round_trip"] for r in coded)
    for r in coded:
        assert r["ids"] == lattice.whole(texts[r["seq"]] or "")[0].tolist()
    assert pieces.encode_pieces(simple(spark, []), model).count() == 0


# ---- near duplicates and passages ----


def test_near_duplicates_equal_brute_force(spark, rng):
    texts = odd_texts(rng)
    for n in (30, 80, 200):
        for _ in range(6):
            base = prose(rng, n).split()
            texts.append(" ".join(base))
            for _ in range(4):
                copy = list(base)
                for _ in range(rng.randrange(1, 5)):
                    copy[rng.randrange(n)] = "edit"
                texts.append(" ".join(copy))
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(1000, texts[20], None), (20, texts[20], None), (None, texts[20], None)]
    got = neardup.near_duplicates(notes(spark, rows)).collect()
    assert len(got) == len(rows)
    distinct = sorted({t or "" for t in texts})
    sets = [dict(zip(*(x.tolist() for x in neardup.shingles(t, 5)))) for t in distinct]
    df = Counter(h for s in sets for h in s)
    w = [{h: c * float(neardup.idf(df[h], len(distinct), 0.1)) for h, c in s.items()} for s in sets]
    label = list(range(len(distinct)))
    for i in range(len(w)):
        for j in range(i):
            low = sum(min(x, w[j].get(h, 0)) for h, x in w[i].items())
            if low and low >= 0.8 * (sum(w[i].values()) + sum(w[j].values()) - low):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    member = defaultdict(list)
    where = {t: i for i, t in enumerate(distinct)}
    for k, t, _ in rows:
        member[label[where[t or ""]]].append(k)
    for r in got:
        if r["seq"] is not None:
            own = member[label[where[(texts + [None])[r["seq"]] or ""]]] if r["seq"] < 1000 else member[label[where[texts[20]]]]
            assert r["class_id"] == min(k for k in own if k is not None)
    assert neardup.near_duplicates(simple(spark, [])).count() == 0
    assert neardup.near_duplicates(simple(spark, [None, ""])).select("class_id").distinct().count() == 1


def test_large_groups_around_the_threshold_equal_brute_force(spark, rng):
    """Copies with one or two edits each: pairs of them lie on both sides of 0.8, and most are no link of the group's leader."""
    texts = []
    for n, copies, edits in ((110, 60, (1, 2)), (90, 40, (2, 2)), (130, 40, (1, 3))):
        base = prose(rng, n).split()
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(*edits)):
                copy[rng.randrange(n)] = prose(rng, 1)
            texts.append(" ".join(copy))
    got = {r["seq"]: r["class_id"] for r in neardup.near_duplicates(simple(spark, texts)).collect()}
    sets = [dict(zip(*(x.tolist() for x in neardup.shingles(t, 5)))) for t in texts]
    df = Counter(h for s in sets for h in s)
    w = [{h: c * float(neardup.idf(df[h], len(set(texts)), 0.1)) for h, c in s.items()} for s in sets]
    label = list(range(len(texts)))
    for i in range(len(w)):
        for j in range(i):
            low = sum(min(x, w[j].get(h, 0)) for h, x in w[i].items())
            if low >= 0.8 * (sum(w[i].values()) + sum(w[j].values()) - low):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert got == dict(enumerate(label))


def test_copies_in_several_blocks_count_once(spark, rng, monkeypatch):
    texts = [prose(rng, 60) for _ in range(30)] * 3
    texts += [t + " end" for t in texts[:30]]
    one = neardup.near_duplicates(simple(spark, texts)).orderBy("seq").collect()
    monkeypatch.setattr(neardup, "_BLOCK_SHINGLES", 200)
    assert neardup.near_duplicates(simple(spark, texts).repartition(6)).orderBy("seq").collect() == one
    assert [r["class_id"] for r in one] == list(range(30)) * 4


def test_samples_agree_as_often_as_the_weighted_jaccard_says():
    r = np.random.default_rng(1)
    h = neardup.mix(np.arange(1, 201, dtype=np.uint64))
    a, b = r.uniform(0.5, 3, 200), r.uniform(0.5, 3, 200)
    same = (neardup.consistent_samples(h, a, 4000) == neardup.consistent_samples(h, b, 4000)).mean()
    assert same == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_shared_passages(spark, rng):
    shared, other = prose(rng, 70), prose(rng, 120)
    fuzzy = shared.split()
    fuzzy[30] = "edited"
    del fuzzy[50]
    rows = [
        (1, prose(rng, 90) + " " + shared + " " + prose(rng, 20), None),
        (2, shared + "\n" + prose(rng, 200), None),
        (3, prose(rng, 10) + " " + " ".join(fuzzy) + " " + prose(rng, 30), None),
        (4, prose(rng, 40) + " " + " ".join(shared.split()[:30]) + " " + prose(rng, 40), None),  # too short to count
        (5, other, None), (5, other, None), (6, None, None), (7, "", None), (None, other, None), (8, other + " " + other, None),
    ]
    table = notes(spark, rows)
    spans = passages.shared_passages(table)
    got = {(r["seq"], r["source"]): r for r in spans.collect()}
    assert {(2, 1), (3, 1), (8, 5)} == set(got)
    text = {r[0]: r[1] for r in rows}
    assert text[2][got[2, 1]["start"] : got[2, 1]["end"]] == shared
    assert text[1][got[2, 1]["source_start"] : got[2, 1]["source_end"]] == shared
    assert got[3, 1]["n_words"] == 69 and got[3, 1]["similarity"] == pytest.approx(68 / 70)
    left = {r["seq"]: r["reason"] for r in passages.without_passages(table, spans).collect()}
    assert shared not in left[2] and left[2] == text[2].split("\n")[1] and left[1] == text[1] and left[6] is None
    assert passages.without_passages(table, spans).columns == table.columns
    assert passages.shared_passages(simple(spark, [])).count() == 0


def test_chains_equal_a_quadratic_search(rng):
    for _ in range(60):
        n = rng.randrange(1, 25)
        pos, other = [rng.randrange(60) for _ in range(n)], [rng.randrange(60) for _ in range(n)]
        points = sorted(set(zip(pos, other)))
        pos, other = [p for p, _ in points], [q for _, q in points]
        best = {}
        for i in sorted(range(len(pos)), key=lambda i: pos[i]):
            best[i] = 6.0
            for j in list(best):
                if pos[j] < pos[i] and other[j] < other[i]:
                    gain = best[j] - 0.1 * (pos[i] - pos[j] + other[i] - other[j])
                    if gain > 0:
                        best[i] = max(best[i], gain + min(6, pos[i] - pos[j], other[i] - other[j]))
        chains = passages.collinear_chains(pos, other, 6, 0.1, 10**6)
        assert sorted(i for c in chains for i in c) == list(range(len(pos)))
        for c in chains:
            assert all(pos[a] < pos[b] and other[a] < other[b] for a, b in zip(c, c[1:]))
        score = 6.0
        for a, b in zip(chains[0], chains[0][1:]):
            score += min(6, pos[b] - pos[a], other[b] - other[a]) - 0.1 * (pos[b] - pos[a] + other[b] - other[a])
        assert score <= max(best.values()) + 1e-9


def spans_of(spark, texts):
    """The passages' texts by (note, source), notes numbered from 0."""
    got = defaultdict(list)
    for r in passages.shared_passages(simple(spark, texts)).orderBy("seq", "source", "start").collect():
        got[r["seq"], r["source"]].append(texts[r["seq"]][r["start"] : r["end"]])
    return dict(got)


def test_two_passages_of_a_pair_far_apart_are_both_found(spark, rng):
    for first, between, second in ((100, 100, 100), (500, 300, 200)):
        p, q = prose(rng, first), prose(rng, second)
        texts = [" ".join([p, prose(rng, between), q]) for _ in range(2)]
        found = spans_of(spark, texts)[1, 0]
        assert len(found) == 2 and found[0] in p and found[1] in q


def test_unequal_words_between_passages_divide_them(spark, rng):
    for between in (8, 20, 30, 40, 50):
        p, q = prose(rng, 75), prose(rng, 75)
        texts = [" ".join([p, prose(rng, between), q]) for _ in range(2)]
        found = spans_of(spark, texts)[1, 0]
        assert len(found) == 2 and found[0] in p and found[1] in q


def test_passages_in_an_alignment(rng):
    same, other = lambda n: (n, n, n), lambda n: (n, n, 0)
    find = lambda *parts: passages.passages_in(list(parts), 50, 0.8, 6)
    assert find() == [] and find(same(49)) == [] and find(same(50)) == [(0, 1)]
    assert find(same(60), other(45), same(60)) == [(0, 1), (2, 3)]
    assert find(same(60), other(25), same(60)) == [(0, 1), (2, 3)]
    assert find(same(60), other(6), same(60)) == [(0, 3)]  # an edit
    assert find(same(45), other(16), same(45)) == [(0, 3)]  # no passage without the other half
    assert find(same(10), other(90), same(70)) == [(2, 3)]
    for _ in range(300):
        parts = [f(rng.randrange(1, 40)) for _ in range(4) for f in (same, other)]
        good = lambda x, y: (w := sum(m for m, _, _ in parts[x:y])) >= 50 and sum(e for *_, e in parts[x:y]) >= 0.8 * w  # noqa: E731, F821
        all_good = [(x, y) for x in range(0, 8, 2) for y in range(x + 1, 8, 2) if good(x, y)]
        found = find(*parts)
        assert set(found) <= set(all_good)
        covered = {i for x, y in found for i in range(x, y, 2)}
        assert covered == {i for x, y in all_good for i in range(x, y, 2)}  # no equal word is lost


def test_passages_reach_to_their_last_word(spark, rng):
    shared = [prose(rng, n) for n in (50, 51, 52, 55) for _ in range(8)]
    texts = [" ".join([prose(rng, 60), p, prose(rng, 60)]) for p in shared for _ in range(2)]
    found = spans_of(spark, texts)
    assert all(p in found[2 * i + 1, 2 * i][0] for i, p in enumerate(shared))


def test_few_places_of_words_are_kept_and_passages_start_anywhere(spark, rng):
    texts = ["", " ", "a", prose(rng, 17), "  " + prose(rng, 1000).replace(" ", " \n ")]
    for text, kept in zip(texts, passages._word_starts.func(pd.Series(texts))):
        starts = passages.word_places(text)[0]
        assert kept.tolist() == [len(starts), len(text), *starts[:: passages.STEP]]
    assert len(kept) < 130
    # Far from either end, behind any number of words.
    shared = [prose(rng, 60) for _ in range(17)]
    texts = [" ".join([prose(rng, 300 + i + j), p, prose(rng, 300 - 2 * i)]) for i, p in enumerate(shared) for j in range(2)]
    found = spans_of(spark, texts)
    assert all(found[2 * i + 1, 2 * i] == [p] for i, p in enumerate(shared))


def test_texts_of_shared_passages_move_once(spark, rng, monkeypatch):
    held = []
    keep = lambda df, name: held.append(name) or written(df, name)
    monkeypatch.setattr(passages, "written", keep)
    shared = prose(rng, 60)
    texts = [f"{prose(rng, 30)} {shared}", shared, f"{shared} {prose(rng, 5)}"]
    spans = passages.shared_passages(notes(spark, 2 * [(i, t, None) for i, t in enumerate(texts)]))  # repeated rows count as one
    assert held == ["chains"]
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_word_starts(") == 1
    assert sorted((r["seq"], r["source"]) for r in spans.collect()) == [(1, 0), (2, 0)]


def test_passages_with_seeds_of_several_earlier_notes(spark, rng):
    texts = []
    for edit in (0, 5):
        words = prose(rng, 75).split()
        texts += [" ".join([prose(rng, 60), *words[:40], prose(rng, 60)])]
        for _ in range(2):
            texts += [" ".join([prose(rng, 60), *words, prose(rng, 60)])]
            words[18 : 18 + edit] = prose(rng, edit).split()
    found = spans_of(spark, texts)
    for i in (2, 5):
        whole = " ".join(texts[i].split()[60:135])
        assert whole in found[i, i - 1][0]


def test_every_copy_of_a_passage_is_found(spark, rng):
    p, quoted, long = prose(rng, 75), prose(rng, 75).split(), "same " * 400
    texts = [" ".join([prose(rng, 40), p]), " ".join([p, prose(rng, 40), p, prose(rng, 40), p])]
    texts += [" ".join(quoted), " ".join([*quoted[20:50], prose(rng, 80), *quoted]), long, long]
    found = spans_of(spark, texts)
    assert found[1, 0] == [p] * 3 and found[3, 2] == [" ".join(quoted)]
    assert [x.count("same") for x in found[5, 4]] == [400]


# ---- top k, fixity, mixing, fingerprints, toxicity ----


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.integers(-4, 5, (300, 12)).astype(float)
    x[7] = x[11] = x[13]
    rows = [(i, v.tolist()[: 12 - i % 3]) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "seq bigint, factors array<double>").withColumn("id", F.lit("clash"))
    got = defaultdict(list)
    for row in topk.top_k(df, df.filter("seq % 20 = 0"), k=5, query_block=4).orderBy("query", "rank").collect():
        got[row["query"]].append((row["rank"], row["seq"], row["score"]))
    full = np.array([np.pad(v[: 12 - i % 3], (0, i % 3)) for i, v in enumerate(x)])
    for q in range(0, 300, 20):
        s = full @ full[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert got[q] == [(n, i, s[i]) for n, i in enumerate(best, 1)]
    assert topk.top_k(df.limit(0), df, k=5).count() == 0
    three = df.filter("seq < 3")
    assert topk.top_k(three, three, k=20).count() == 6


def test_top_k_deals_the_shards_of_a_query_block_over_tasks(spark):
    r = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(r.integers(-4, 5, (4000, 6)).astype(float))]
    df = spark.createDataFrame(rows, "seq bigint, factors array<double>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = topk.top_k(df, df.filter("seq < 3"), k=5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(x["query"], x["rank"]): x["score"] for x in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert re.search(r"Join \[block#\d+, salt#\d+\]", plan)
    full = np.array([v for _, v in rows])
    for q in range(3):
        assert [got[q, n] for n in range(1, 6)] == sorted(np.delete(full @ full[q], q).tolist(), reverse=True)[:5]


def test_audit_finds_every_fault(spark):
    r = np.random.default_rng(2)
    rows = [(f, i, bytes(r.integers(0, 256, r.integers(0, 90)).astype(np.uint8))) for f in ("a", "b", "c") for i in range(200)]
    base = spark.createDataFrame(rows, "file string, n int, payload binary").withColumn("length", F.lit("clash")).drop("length")
    base = fixity.layout(base, "file", "n", F.length("payload") + 1).drop("length").cache()
    assert fixity.audit(base, base, range_bytes=256).count() == 0
    other = base.filter("not (file = 'c' and n > 150) and not (file = 'a' and n = 7)")
    other = other.withColumn("payload", F.when((F.col("file") == "b") & (F.col("n") == 33), F.lit(b"?")).otherwise(F.col("payload")))
    extra = spark.createDataFrame([("d", 1, b"new", 0), ("d", 2, None, 10)], "file string, n int, payload binary, offset bigint")
    got = fixity.audit(base, other.unionByName(extra).unionByName(extra), range_bytes=256).collect()
    found = Counter((x["file"], x["fault"]) for x in got)
    assert found == {("c", "missing"): 49, ("a", "missing"): 1, ("b", "changed"): 1, ("d", "extra"): 2}
    assert fixity.audit(base.limit(0), base.limit(0)).count() == 0


def targets(sizes, weights, most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        t = {s: most * sizes[s] if s in capped else left * w[s] / free for s in order}
        new = {s for s in order if s not in capped and t[s] > most * sizes[s]}
        if not new:
            return t
        capped |= new


def test_mixing(spark, rng):
    names = ["a", "b", "é", "Z", None, "\U0001f600", "empty"]
    rows = [(i, prose(rng, 3 if names[i % 7] in ("Z", "a") else rng.randrange(1, 120)), names[i % 7]) for i in range(400) if names[i % 7] != "empty"]
    rows += [(500, "", "empty"), (501, None, "empty"), (502, prose(rng, 5), "b"), (502, rows[1][1], "b"), (502, rows[1][1], "b"), (None, "one", None)]
    out = mixing.mix_sources(notes(spark, rows), block=16).collect()
    assert len(out) == len(rows)
    again = mixing.mix_sources(notes(spark, rows[::-1]), block=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets(dict(sizes), (5, 2, 1)), Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[r["weight_name"]]) and r["source_size"] == sizes[r["weight_name"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["weight_name"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert any(want[s] == 3 * sizes[s] > 0 for s in want)
    assert mixing.mix_sources(simple(spark, [])).count() == 0


def test_schedule_keeps_proportions_everywhere(spark):
    t = spark.createDataFrame([("a", 1000, 5000.0), ("b", 1000, 2000.0), ("c", 1000, 3000.0)], "source string, source_size bigint, target double")
    slots = [r["source"] for r in mixing.schedule(t, 10).orderBy("slot").collect()]
    assert len(slots) == 1000
    for i in range(0, 900, 100):
        part = Counter(slots[i : i + 100])
        assert abs(part["a"] - 50) <= 3 and abs(part["b"] - 20) <= 3 and abs(part["c"] - 30) <= 3


def plain_print(text):
    """A fingerprint, paragraph by paragraph and word pair by word pair."""
    some, small, wide, pairs = 0, [0] * 16, [0] * 64, 0
    for p in text.split("\n"):
        if not p.strip(" "):
            continue
        some += 1
        own = xxhash.xxh64_intdigest(p.encode(), 42)
        for i in range(4):
            h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), own)
            for j in range(4):
                small[4 * i + j] += h >> 16 * j & 0xFFFF
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", p.strip(" ")) if w]
        for pair in [f"{a} {b}" for a, b in zip(words, words[1:])] or words:
            h = xxhash.xxh64_intdigest(pair.encode(), 42)
            pairs += 1
            for i in range(64):
                wide[i] += h >> i & 1
    return f"{some:08x}" + "".join(f"{v % 65536:04x}" for v in small) + "".join(f"{v % 2**32:08x}" for v in [*wide, pairs])


def plain_likeness(a, b):
    """From the two strings alone."""
    if a == b:
        return 1.0
    va, vb = (np.array([int(x[at : at + 8], 16) for at in range(72, 592, 8)], float) for x in (a, b))
    va, vb = 2 * va[:64] - va[64], 2 * vb[:64] - vb[64]
    norm = np.sqrt(va @ va * (vb @ vb))
    return min(1.0, max(0.0, va @ vb / norm)) if norm else 0.0


def test_fingerprints(spark, rng):
    a, b, c = prose(rng, 30), prose(rng, 40), prose(rng, 1)
    texts = [f"{a}\n{b}\n{c}", f"{c}\n\n{b}\n{a}\n", f"{a}\n{b}", c, f"{a}\n{a}", a, None, "", " \n"]
    got = {r["seq"]: r for r in fingerprints.fingerprints(simple(spark, texts).select("seq", "reason"), ["seq"], "reason").collect()}
    prints = [got[i]["fingerprint"] for i in range(len(texts))]
    assert prints[0] == prints[1] and prints[6] == prints[7] == prints[8] and len(set(prints)) == 6
    pair = spark.createDataFrame([(prints[2], prints[3], prints[0])], "a string, b string, c string")
    row = pair.select(fingerprints.combine(F.col("a"), F.col("b")).alias("plus"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("minus")).head()
    assert row["plus"] == prints[0] and row["minus"] == prints[2]


def test_edited_fingerprints(spark, rng):
    rows = [(i, t, None) for i, t in enumerate(odd_texts(rng))] + [(6, "vix up", None), (6, "vix up", None), (None, "last", None)]
    got = fingerprints.edited_fingerprints(notes(spark, rows)).collect()
    order = sorted({(k is not None, k or 0, hashlib.md5((t or "").encode()).digest(), t or "", k) for k, t, _ in rows}, reverse=True)
    assert len(got) == len(rows) and sum(r["seq"] == 6 for r in got) == sum(k == 6 for k, _, _ in rows)
    by = {(r["seq"], r["edited"], r["n_chars"]): r for r in got}
    for i, (_, _, _, t, k) in enumerate(order):
        behind = order[(i + 1) % len(order)][3]
        m = len(t) // 3
        assert (k, t[: len(t) - m] + behind[:m], len(t)) in by
    prints = {}
    for i, (_, _, _, t, k) in enumerate(order):
        behind = order[(i + 1) % len(order)][3]
        prints[k, t[: len(t) - len(t) // 3] + behind[: len(t) // 3], len(t)] = (t, behind)
    for r in got:
        t, behind = prints[r["seq"], r["edited"], r["n_chars"]]
        assert r["fingerprint"] == plain_print(t) and r["edited_fingerprint"] == plain_print(r["edited"])
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]), abs=1e-12)
        assert r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], plain_print(behind)), abs=1e-12)
    assert fingerprints.edited_fingerprints(simple(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(simple(spark, ["only one"])).head()["near_next"] == 1


def test_toxicity(spark, rng):
    def text(bad):
        words = prose(rng, rng.randrange(10, 200)).split()
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(["moron", "Scum!", "worthless"])
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), None) for i in range(800)] + [(900, None, None), (901, "", None), (902, "123 !!", None)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(1, None), (2, 7), (None, 1)], "seq bigint, toxic int")
    table = notes(spark, rows).withColumn("toxicity", F.lit("clash"))
    out = {r["seq"]: r["toxicity"] for r in toxicity.add_toxicity(table, toxicity.fit_toxicity(table, labels)).collect()}
    right = [(out[i]["score"] >= 0.3) == (i % 4 == 0) for i in range(600, 800)]
    assert np.mean(right) > 0.97
    assert out[900]["score"] == out[901]["score"] == out[902]["score"] and out[900]["n_words"] == 0
    # The rows that a smaller calibration sample leaves give counts, as the others do.
    few = toxicity.fit_toxicity(table, labels, calibration_rows=40)
    assert len(few.words) >= 3
    out = {r["seq"]: r["toxicity"]["score"] for r in toxicity.add_toxicity(table, few).collect()}
    assert np.mean([(out[i] >= 0.3) == (i % 4 == 0) for i in range(600, 800)]) > 0.9
    none = toxicity.fit_toxicity(table, labels.limit(0))
    assert toxicity.add_toxicity(table, none).filter("abs(toxicity.score - 0.5) > 1e-9").count() == 0
    assert toxicity.add_toxicity(simple(spark, []), none).count() == 0


def test_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    counts = r.integers(0, 9, (5, 5)).astype(float)
    follows = np.ones(5) / 5
    assert np.exp(toxicity._kneser_ney(counts, follows)).sum(1) == pytest.approx(np.ones(5))


def test_toxicity_every_telling_word_has_an_entry(spark, rng):
    telling = [f"{a}{b}{c}" for a in "kmprstvwxz" for b in "abcdefghijklm" for c in "nopqrstuvw"]
    plain = ["walls", "gex", "skew", "trend"]

    def text(bad):
        return " ".join(rng.sample(telling, 650) if bad else rng.choices(plain, k=60))

    rows = [(i, text(i % 2)) for i in range(160)]
    tried = [(1000 + i, f"{w} {w} {w}") for i, w in enumerate(telling + plain)]
    table = spark.createDataFrame(rows + tried, "seq bigint, reason string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "seq bigint, toxic int")
    model = toxicity.fit_toxicity(table, labels)
    assert set(telling) <= set(model.words)
    out = {r["seq"]: r["toxicity"]["score"] for r in toxicity.add_toxicity(table, model).collect()}
    scores = [out[k] for k, _ in tried]
    assert min(scores[: len(telling)]) > 0.5 > max(scores[len(telling) :])


def test_toxicity_bigrams_equal_brute_force(rng):
    size = 40
    pairs = [(rng.randrange(size) ** 2 % size, rng.randrange(size)) for _ in range(500)]
    count = Counter(pairs)
    shared = np.arange(1.0, size + 1) / (size * (size + 1) / 2)
    codes = np.array(sorted(v * size + w for v, w in count))
    model = toxicity._bigrams(codes, np.array([float(count[divmod(int(c), size)]) for c in codes]), shared)
    alone, context, kinds = Counter(w for _, w in pairs), Counter(v for v, _ in pairs), Counter(v for v, _ in count)
    spared = sum(min(n, 0.75) for n in alone.values()) / len(pairs)

    def chance(v, w):
        low = max(alone[w] - 0.75, 0) / len(pairs) + spared * shared[w]
        return (max(count[v, w] - 0.75, 0) + 0.75 * kinds[v] * low) / context[v] if context[v] else low

    before, words = (x.ravel() for x in np.indices((size, size)))
    assert model.logs(before, words) == pytest.approx(np.log([chance(v, w) for v, w in zip(before, words)]))


def test_toxicity_pair_counts_pass_on_what_they_hold(monkeypatch):
    monkeypatch.setattr(toxicity, "_HELD", 3)
    texts = ["a b a b c", "b a", "", "c c c c a b", "a b"] * 3
    batch = pa.record_batch({"t": texts, "label": [0, 1, 0, 1, 0] * 3})
    got = Counter()
    made = toxicity._pair_counts({"a": 1, "b": 2})(iter([batch.slice(i, 2) for i in range(0, 15, 2)]))
    for b in toxicity._pair_sums(made):
        for r in b.to_pylist():
            codes, counts = (np.frombuffer(r[name], np.int64).tolist() for name in ("codes", "counts"))
            assert not any((code, r["label"]) in got for code in codes)
            got.update({(code, r["label"]): n for code, n in zip(codes, counts)})
    want = Counter()
    for text, label in zip(texts, batch.column("label").to_pylist()):
        ids = [3, *({"a": 1, "b": 2}.get(w, 0) for w in text.split())]
        want.update((v * 4 + w, label) for v, w in zip(ids, ids[1:]))
    assert got == want
