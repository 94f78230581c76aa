"""Manifest, tokenizer agreement and language against brute force and odd inputs."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import alignment, language, manifest
from barloom.llm.common import numbered
from tests.conftest import walk

from .test_operators import notes, odd_texts, prose, simple

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


# ---- manifest ----


def runs(nodes):
    """Levels of a tree: lists of hashes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    left_right = []
    for lv in levels[:-1]:
        run = lv[i // 16 * 16 : i // 16 * 16 + 16]
        left_right.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return left_right


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def by_hand(rows, fields, key, group):
    """Counter of (group, key, leaf, subroot, root, path)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[group], []).append((r[key] is not None, r[key] or 0, H("".join(field(r[f]) for f in fields)), r[key]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: runs([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = runs([trees[g][-1][0] for g in names])
    out = Counter()
    for n, g in enumerate(names):
        for i, (_, _, leaf, k) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out[g, k, leaf, trees[g][-1][0], top[-1][0], tuple(siblings(trees[g], i) + siblings(top, n))] += 1
    return out


def as_counter(made, key, group):
    rows = made.collect()
    return Counter((r[group], r[key], r["leaf"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["path"])) for r in rows)


FIELDS = ("seq", "weight_name", "old_value", "reason")
LOG = "seq bigint, weight_name string, old_value string, reason string, s string, w bigint, i int, m string, h string"


def log(spark, rows):
    """Weight changes with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "s", 1, 2, "m", "h") for r in rows], LOG)


def weight_rows(rng):
    rows = [(i * 3, f"w{i % 3}", None, t) for i, t in enumerate(odd_texts(rng))]
    rows += [(i, "hot", "0.1", f"change {i}") for i in rng.sample(range(-50, 900), 600)]  # three levels
    rows += [(rng.randrange(-(1 << 62), 1 << 62), "far", "0.1", "x") for _ in range(40)]  # a directory of several levels
    rows += [(7, "again", "0.1", "same")] * 20 + [(7, "again", "0.1", f"other {i}") for i in range(30)] + [(8, "again", None, None)]
    rows += [(None, "hot", None, f"no key {i}") for i in range(40)] + [(None, None, None, None)] * 3 + [(5, "", "1", "empty name")]
    rows += [(1, f"name {i}é", "1", "lone") for i in range(20)]
    return rows


def test_manifest_equals_a_tree_by_hand(spark):
    rows = weight_rows(random.Random(3))
    made = manifest.manifest(log(spark, rows), fields=FIELDS)
    want = by_hand([dict(zip(FIELDS, r)) for r in rows], FIELDS, "seq", "weight_name")
    assert as_counter(made, "seq", "weight_name") == want
    kept = made.withColumn("up", manifest.folded("path", "leaf")).withColumn("proof", manifest.proof_hash("path")).collect()
    assert all(r["up"] == r["root"] for r in kept)
    assert all(r["proof"] == H("".join(p["left"] + p["right"] for p in r["path"])) for r in kept)


@pytest.mark.parametrize("rows", [[], [(1, "w", "0.1", "one")], [(1, "w", "0.1", "one"), (2, "w", "0.1", "two")], [(1, None, None, None)] * 17])
def test_small_manifests(spark, rows):
    made = manifest.manifest(log(spark, rows), fields=FIELDS)
    assert as_counter(made, "seq", "weight_name") == (by_hand([dict(zip(FIELDS, r)) for r in rows], FIELDS, "seq", "weight_name") if rows else Counter())


def test_manifest_of_bars_finds_changed_ones(spark):
    import pandas as pd

    bars = spark.createDataFrame(pd.concat([walk(300, 1, "AA"), walk(20, 2, "B")]))
    fields = ("symbol", "dt", "close", "volume")
    spoiled = F.when(F.dayofmonth("dt") == 7, F.col("close") + 0.01).otherwise(F.col("close"))
    bars = bars.withColumn("claim", manifest.leaf_hash("symbol", "dt", spoiled, "volume"))
    made = manifest.manifest(bars, key="dt", group="symbol", fields=fields, carry=("claim",))
    got = made.withColumn("ok", manifest.folded("path", "claim") == F.col("root")).collect()
    assert len(got) == 320 and all(isinstance(r["dt"], dt.date) for r in got)
    assert all(r["ok"] == (r["dt"].day != 7) for r in got)
    with pytest.raises(TypeError):
        manifest.manifest(bars, key="close", group="symbol", fields=fields)


def test_rows_are_numbered_over_partitions(spark):
    names = [None, "", "a", "é", "b", "ab", *[f"n{i}" for i in range(50)]]
    random.Random(1).shuffle(names)
    got = numbered(spark.createDataFrame([(n,) for n in names], "s string").repartition(5), "s", "i").collect()
    assert [r["s"] for r in sorted(got, key=lambda r: r["i"])] == sorted(names, key=lambda n: (n is not None, (n or "").encode()))
    assert sorted(r["i"] for r in got) == list(range(len(names)))


# ---- tokenizer agreement ----

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def test_byte_ids_equal_the_library(aligner):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    assert "tiktoken" in type(aligner.a.encode.__self__).__module__
    rng = random.Random(2)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "\U0001f600", "²", "12", "'s", "'S", "<|endoftext|>", "\xa0", " ", "--", "x" * 30, "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(2000)]
    texts += [chr(rng.randrange(0xD800)) + chr(rng.randrange(0xE000, 0x110000)) * 2 + " x" for _ in range(2000)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert aligner.a.encode(t) == ids
        assert b"".join(aligner.a.pieces[i] for i in ids) == t.encode()


def by_pairs(aligner, text):
    """(links, groups as text) by comparing all pairs of tokens."""
    a, b = (x.tolist() for x in aligner.tokens(text))
    spans = []
    for ids, pieces in ((a, aligner.a.pieces), (b, aligner.b.pieces)):
        ends = np.cumsum([len(pieces[i]) for i in ids]).tolist()
        spans.append(list(zip(ids, [0, *ends], ends)))
    links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, at = [], 0
    for c in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if s >= at and e <= c) for side in spans))
        at = c
    return links, ";".join(groups), len(a), len(b)


def test_agreement_equals_all_pairs(spark, aligner):
    rng = random.Random(9)
    texts = odd_texts(rng) + ["<s> <|endoftext|> </s>", "with ▁ in it", "a" * 300, "tab\there", "é", "café ﬁ"]
    texts += [prose(rng, rng.randrange(1, 30)) for _ in range(30)] + ["hot copy of a text"] * 50 + [" lead", "trail ", "\x00"]
    rows = [(i, t, "w") for i, t in enumerate(texts)] + [(None, "hot copy of a text", "w"), (3, texts[3], "w")]
    got = alignment.tokenizer_agreement(notes(spark, rows), A, B).collect()
    assert len(got) == len(rows)
    counts, best = Counter(), Counter()
    found = {}
    for _, t, _ in rows:
        if t and aligner.tokens(t) is not None:
            found[t] = by_pairs(aligner, t)
            counts.update(found[t][0])
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter()
    for k, t, _ in rows:
        if t in found:
            links, groups, n_a, n_b = found[t]
            sums = sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)
            want[k, n_a, n_b, groups.count(";") + 1, len(links), *sums, H(groups)] += 1
        else:
            want[k, 0, 0, 0, 0, 0, 0, ""] += 1
    cols = ("seq", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in cols) for r in got) == want
    assert {t for t in texts if t} - set(found) == {"with ▁ in it"}
    assert alignment.tokenizer_agreement(simple(spark, []), A, B).count() == 0
    assert alignment.tokenizer_agreement(simple(spark, [None, ""]), A, B).filter("n_links = 0 and groups_sha256 = ''").count() == 2


def test_agreement_over_several_blocks(spark, aligner, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, 20) for _ in range(60)]
    one = alignment.tokenizer_agreement(simple(spark, texts), A, B).orderBy("seq").collect()
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 300)
    assert alignment.tokenizer_agreement(simple(spark, texts), A, B).orderBy("seq").collect() == one


# ---- language ----

WORDS = {"en": "the of and with from that trading floor", "de": "der die und mit von nicht boden straße", "fr": "le la et avec depuis été plancher où"}


def sentences(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(1, 15))), lang))
    return out


def spoken(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "f") for r in rows], "seq bigint, reason string, lang string, n int, h string, features string")


def test_char_grams_equal_a_dictionary():
    seen = {}
    for text in ["Straße, été!", "A1b", "x", "The THE the", "a  b", "é" * 500]:
        words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        want = Counter(words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1))
        features, tf = language.char_grams(text)
        assert sorted(tf.tolist()) == sorted(want.values())
        for g in want:
            seen.setdefault(g, set()).update(features.tolist())
    assert (np.diff(features.astype(np.int64)) > 0).all()


def test_ftrl_equals_loops():
    rng = np.random.default_rng(5)
    model = language.Ftrl(6, 3, 0.5, 1.0, 0.05, 0.1)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))
    for _ in range(200):
        i = np.sort(rng.choice(6, 3, replace=False))
        x, y = rng.random(3), int(rng.integers(3))
        w = np.zeros((3, 3))
        for a, f in enumerate(i):
            for c in range(3):
                if abs(z[f, c]) > 0.05:
                    w[a, c] = -(z[f, c] - np.sign(z[f, c]) * 0.05) / ((1.0 + n[f, c] ** 0.5) / 0.5 + 0.1)
        e = np.exp([sum(x[a] * w[a, c] for a in range(3)) for c in range(3)])
        for a, f in enumerate(i):
            for c in range(3):
                g = (e[c] / e.sum() - (c == y)) * x[a]
                z[f, c] += g - ((n[f, c] + g * g) ** 0.5 - n[f, c] ** 0.5) / 0.5 * w[a, c]
                n[f, c] += g * g
        model.learn(i, x, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert (model.weights(slice(None)) == 0).sum() == (np.abs(z) <= 0.05).sum()


def test_temperature_finds_the_likeliest():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert abs(language.temperature(logits * 3, y) - 3) < 0.3


def test_language_of_held_out_notes(spark):
    rng = random.Random(8)
    rows = sentences(rng, 400)
    model = language.fit_language(spoken(spark, rows[:300] + [(900, "the of", None), (901, None, "en"), (902, "12 !", "de")]))
    assert model.languages == ["de", "en", "fr"] and model.slot.max() + 2 == len(model.weights)
    odd = [(k, t, "en") for k, t in enumerate([None, "", "123 ?!", "²", "日本", "the " * 20000, "der"], 1000)] + [(None, "avec la", "x"), rows[300], rows[300]]
    got = language.add_language(spoken(spark, rows[300:] + odd).withColumn("language", F.lit(1)), model).collect()
    assert len(got) == 110
    told = {r["seq"]: r["language"] for r in got}
    right = [told[k]["lang"] == lang for k, _, lang in rows[300:]]
    assert np.mean(right) > 0.97
    assert [told[k]["lang"] for k in range(1000, 1004)] == ["und"] * 4 and told[1000]["score"] == 0
    assert told[1005]["lang"] == "en" and told[1006]["lang"] == "de" and told[None]["lang"] == "fr"
    assert all(0 <= r["language"]["score"] <= 1 for r in got)


def test_languages_none_or_one(spark):
    rows = sentences(random.Random(1), 20)
    none = language.fit_language(spoken(spark, [(1, "the", None)]))
    assert none.predict("the") == ("und", 0.0)
    assert language.fit_language(spoken(spark, [])).languages == []
    one = language.fit_language(spoken(spark, [(k, t, "en") for k, t, _ in rows] * 3))
    assert one.predict("der")[0] == "en" and one.predict("der")[1] == 1.0
    assert language.add_language(spoken(spark, []), one).count() == 0


def test_sample_is_bounded_and_even(spark):
    rows = [(i, f"the of {i} and", "en") for i in range(200)] + [(i, f"der die {i}", "de") for i in range(3)] + [(1, "same", "fr")] * 100
    model = language.fit_language(spoken(spark, rows), rows=30)
    assert model.languages == ["de", "en", "fr"]
    assert [model.predict(t)[0] for t in ("der die", "the of", "same")] == ["de", "en", "fr"]
