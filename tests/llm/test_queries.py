"""The registered queries on the smallest tables, and the pipeline's stages."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from barloom.llm.queries import QUERIES, SQL
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.execute(SQL[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), [d[0] for d in rel.description]) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] == kept[3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == kept[-1] and out.filter("not round_trip").count() == 0


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, k string, times int"


def odd_documents(spark, rows):
    """Documents with extra columns whose names the stages use inside."""
    return spark.createDataFrame([(k, t, lang, s, len(t or ""), "x", "y", 7) for k, t, lang, s in rows], ODD)


def texts(n, words=70):
    rng = random.Random(n)
    return [" ".join(f"{rng.choice('vega skew wall trend floor'.split())}{rng.randrange(400)}" for _ in range(words)) for _ in range(n)]


STAGES = dict(corpus_pipeline.STAGES)


def test_toxicity_keeps_odd_rows(spark):
    t = texts(3)
    rows = [(None, t[0], None, None), (1, None, "en", "a"), (1, None, "en", "a"), (2, "", "en", "a"), (3, t[1] * 300, "en", None), (3, t[1] * 300, "en", None)]
    out = STAGES["toxicity"](spark, odd_documents(spark, rows), SF)
    assert out.columns == corpus_pipeline.COLUMNS
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter((r[0], r[1]) for r in rows)


def test_one_document_of_a_class_stays(spark):
    t = texts(4)
    rows = [(None, t[0], "en", "a"), (None, t[1], "en", "a"), (5, t[2], "en", "a"), (5, t[2], "en", "a"), (6, t[2], None, "b"), (5, t[3] * 200, "en", None)]
    rows += [(7, None, "en", "a"), (8, "", "en", "a")]
    out = STAGES["near duplicates"](spark, odd_documents(spark, rows), SF)
    assert out.columns == corpus_pipeline.COLUMNS
    got = out.collect()
    assert Counter(r["text"] or "" for r in got) == Counter([t[0], t[1], t[2], t[3] * 200, ""])
    unique = [(k, x, "en", "a") for k, x in ((9, t[0]), (3, t[0]), (4, t[1]))]
    assert sorted(r["doc_id"] for r in STAGES["near duplicates"](spark, odd_documents(spark, unique), SF).collect()) == [3, 4]


def test_passages_are_cut_from_odd_rows(spark):
    t = texts(4)
    rows = [(1, t[0] + " " + t[1], "en", "a"), (1, t[2] + " " + t[1], "en", "a"), (None, t[3] + " " + t[1], None, None), (2, None, "en", "a"), (2, None, "en", "a")]
    out = STAGES["passages"](spark, odd_documents(spark, rows), SF)
    assert out.columns == corpus_pipeline.COLUMNS
    got = out.collect()
    assert len(got) == 5 and sum(t[1] in (r["text"] or "") for r in got) == 1
    assert all(any(x in (r["text"] or "") for r in got) for x in (t[0], t[2], t[3]))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_mixing_does_not_multiply_equal_rows(spark):
    rows = [(1, "a b c", "en", s) for s in ("a", "b", "c")] * 4 + [(None, "a b c", "en", "a")] * 2 + [(2, None, "en", None), (3, "", "en", None), (3, "", "en", None)]
    out = STAGES["mixing"](spark, odd_documents(spark, rows), SF)
    assert out.columns == corpus_pipeline.COLUMNS
    got = Counter((r["text"], r["source"]) for r in out.collect())
    assert got[None, None] == 1 and got["", None] == 2
    # 14 documents of equal size: targets 3.6, 6 of 4 (5 / 8 of 42 words: at most 3 times its source's) and so on; rounding moves each by one.
    assert abs(sum(got[("a b c", s)] for s in "abc") - 14) <= 7 and max(got.values()) <= 18


def test_stages_of_an_empty_table(spark):
    docs = odd_documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        if name != "encoding":
            assert out.columns == corpus_pipeline.COLUMNS


def test_encoding_of_odd_rows(spark):
    rows = [(None, "vega", "en", "a"), (1, None, None, None), (1, "", "en", "a"), (1, "vega " * 30000, "en", "a"), (1, "vega " * 30000, "en", "a")]
    got = STAGES["encoding"](spark, odd_documents(spark, rows), SF).collect()
    assert len(got) == 5 and all(r["round_trip"] for r in got) and sorted(r["n_tokens"] > 0 for r in got) == [False, False, True, True, True]
