"""From raw documents to encoded training text: five stages over whole tables.

A stage takes documents and, but for the last, returns documents: the five columns of that table, in their order; other columns are left out.
Any column may be null, rows may repeat, texts may be empty or of any length, and a table may be empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import queries as Q
from barloom.llm.common import written
from barloom.llm.mixing import mix_sources
from barloom.llm.neardup import near_duplicates
from barloom.llm.passages import shared_passages, without_passages
from barloom.llm.pieces import encode_pieces
from barloom.llm.toxicity import add_toxicity, fit_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; labels of held-out rows are not read.

    Equal rows go or stay together.  Where the labels teach nothing (none, or of one class only), all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit_toxicity(docs, Q.train_labels(labels, "doc_id"), key="doc_id", text="text")
    if not model.words:
        return docs.select(*COLUMNS)
    return add_toxicity(docs, model, text="text", into="toxicity").filter(F.col("toxicity.score") < TOXIC).select(*COLUMNS)


def identified(docs: DataFrame) -> DataFrame:
    """The documents with ``_row``, a whole number of their own: ``doc_id`` where all are there and different.

    Otherwise every row is numbered and the table written once, so that the numbers stay.
    """
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    docs = docs.select(*COLUMNS)
    if not unclear.limit(1).count():
        return docs.withColumn("_row", F.col("doc_id").cast("bigint"))
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class, the one with the smallest id.

    A missing doc_id is no duplicate of another; of equal rows one stays.  Documents without a text are one class.
    """
    docs = identified(docs)
    classes = near_duplicates(docs, key="_row", text="text")
    return docs.join(classes.filter("_row = class_id").select("_row"), "_row", "left_semi").select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages that an earlier one has are cut out, and n_chars counts what is left (null: no text)."""
    docs = identified(docs)
    spans = written(shared_passages(docs, key="_row", text="text"), "spans")
    out = without_passages(docs, spans, key="_row", text="text")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words, whole: taken / size, rounded by a hash of the row's number.

    A document that is taken one and a quarter times stays once, and one in four such documents twice.  Documents without a word stay.
    """
    docs = identified(docs)
    taken = mix_sources(docs, key="_row", text="text", source="source").select("_row", "size", "taken")
    dice = F.shiftrightunsigned(F.xxhash64("_row", F.lit(5)), 11) * F.lit(2.0**-53)
    times = taken.filter("size > 0").select("_row", F.floor(F.col("taken") / F.col("size") + dice).cast("int").alias("times"))
    held = docs.join(times, "_row", "left").filter(F.coalesce("times", F.lit(1)) > 0)
    copies = F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1))))
    return held.withColumn("copy", copies).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document's text, and whether they decode to it: one row for each, without a text no ids."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_pieces(docs, model, key="doc_id", text="text")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("mixing", mix),
    ("encoding", encode),
]

#: The stages learn a model, sample, align and encode: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
