"""Registered queries of this package: the given tables as notes, the operators' rows as asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment as AL
from . import fingerprints as FP
from . import fixity as FX
from . import language as LA
from . import manifest as MA
from . import mixing as MX
from . import neardup as ND
from . import passages as PA
from . import pieces as SP
from . import token_counts as TC
from . import token_files as TF
from . import topk as TK
from . import toxicity as TX

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def documents(spark, sf):
    """documents as notes: seq, reason."""
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("text").alias("reason"))


def train_labels(labels, key):
    """Labels of rows that are not held out."""
    return labels.filter(~held_out(key))


def held_out(key):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


@query("op10_toxicity")
def toxicity(spark, sf):
    notes = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("seq"), "toxic")
    scored = TX.add_toxicity(notes, TX.fit_toxicity(notes, train_labels(labels, "seq")))
    score = F.col("toxicity.score")
    return scored.select(
        F.col("seq").alias("doc_id"),
        held_out("seq").alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.3, 1).otherwise(0).alias("predicted"),
        F.col("toxicity.n_words").alias("n_words"),
    )


@query("op6_near_duplicates")
def near_duplicates(spark, sf):
    return ND.near_duplicates(documents(spark, sf)).select(F.col("seq").alias("doc_id"), "class_id")


@query("op1_shared_passages")
def shared_passages(spark, sf):
    found = PA.shared_passages(documents(spark, sf))
    return found.withColumnsRenamed({"seq": "doc_id", "source": "source_doc_id"})


@query("op8_mixing")
def mixing(spark, sf):
    notes = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("reason"), F.col("source").alias("weight_name")
    )
    mix = MX.mix_sources(notes)
    return mix.select(F.col("seq").alias("doc_id"), "size", "source_size", "target", "taken", F.col("weight_name").alias("source"))


@query("op5_pieces")
def pieces(spark, sf):
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = SP.encode_pieces(documents(spark, sf), model)
    return coded.select(F.col("seq").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


@query("op2_token_counts")
def token_counts(spark, sf):
    counted = TC.add_token_counts(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    n_bytes = F.coalesce(F.octet_length("reason"), F.lit(0)).cast("bigint")
    return counted.select(F.col("seq").alias("doc_id"), n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op9_fingerprints")
def fingerprints(spark, sf):
    pairs = FP.edited_fingerprints(documents(spark, sf))
    sha = F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    return pairs.select(F.col("seq").alias("doc_id"), "n_chars", sha, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query(
    "op3_top_k",
    """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
""",
)
def top_k(spark, sf):
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter(finite)
    factors = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64.0)).alias("factors")
    rows = rows.select(F.col("vec_id").alias("seq"), factors)
    found = TK.top_k(rows, rows.filter("seq % 20 = 0"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("seq").alias("vec_id"), "score")


#: Pages of one archive file, and the damage done to the second replica: one byte of these, no record of those.
FILE_PAGES = 1000
DAMAGED, LOST = "page_id % 97 = 13", "page_id % 211 = 40"

_ARCHIVE_SQL = f"""
WITH body AS (SELECT page_id, page_id // {FILE_PAGES} AS file, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
sized AS (SELECT page_id, file, octet_length(encode(body)) AS n,
          octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:snapshot:' || page_id || '>'
          || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ')) + 4 + 4 AS fixed FROM body),
placed AS (SELECT page_id, file, CAST(fixed + n + length(CAST(n AS VARCHAR)) AS BIGINT) AS length FROM sized),
laid AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM placed)
SELECT file, start AS "offset", length, CASE WHEN {LOST} THEN NULL ELSE length END AS other_length, CASE WHEN {LOST} THEN 'missing' ELSE 'changed' END AS fault
FROM laid WHERE {DAMAGED} OR {LOST}
"""


@query("op7_fixity", _ARCHIVE_SQL)
def fixity(spark, sf):
    """The archive of all pages against a replica of it that is damaged by rule."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").filter("page_id is not null")
    rows = pages.select("page_id", F.floor(F.col("page_id") / FILE_PAGES).alias("file"), FX.archive_record("url", "html", "page_id").alias("payload"))
    archive = FX.layout(rows, "file", "page_id", F.length("payload"))
    n = F.length("payload")
    flipped = F.concat(F.substring("payload", 1, 40), F.lit(b"?"), F.substring(F.col("payload"), F.lit(42), n))
    replica = archive.filter(f"not ({LOST})").withColumn("payload", F.when(F.expr(DAMAGED), flipped).otherwise(F.col("payload")))
    return FX.audit(archive, replica)


@query("op4_token_files")
def token_files(spark, sf):
    path = TF.write_token_files(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return TF.token_directory(spark, path).withColumnRenamed("k", "doc_id")


#: The fields of a document's leaf, as columns of a log.
_LEAF = {"doc_id": "seq", "source": "weight_name", "lang": "lang", "n_chars": "n_chars", "text": "reason"}
#: Levels the SQL can climb: 16 ** 5 documents a source, 16 ** 4 sources.
_CLIMB = 5


def _climb(level0: str, prefix: str, key: str, levels: int) -> str:
    """SQL of a tree over (key, idx, h, n): at level l+1 each run of 16 has its hash and the hashes of its children."""
    out = [f"{prefix}0 AS ({level0})"]
    for lv in range(levels):
        out.append(
            f"{prefix}{lv + 1} AS (SELECT {key}, CASE WHEN n > 1 THEN idx // 16 ELSE idx END AS idx, "
            f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h, "
            f"CASE WHEN any_value(n) > 1 THEN list(h ORDER BY idx) END AS kids, any_value((n + 15) // 16) AS n "
            f"FROM {prefix}{lv} GROUP BY {key}, CASE WHEN n > 1 THEN idx // 16 ELSE idx END)"
        )
    return ",\n".join(out)


def _steps(prefix: str, key: str, at: str, levels: int) -> tuple[str, str, str]:
    """Joins to the runs above a node, its siblings' hashes and the nested hash of a claim."""
    joins, proof, fold = "", [], "claim"
    for lv in range(1, levels + 1):
        place, slot = f"{at} // {16**lv}", f"({at} // {16 ** (lv - 1)}) % 16"
        t = f"{prefix}j{lv}"
        joins += f" JOIN {prefix}{lv} {t} ON {t}.{key} = {key}_of AND {t}.idx = {place}"
        proof.append(f"CASE WHEN {t}.kids IS NULL THEN '' ELSE array_to_string([x FOR x, i IN {t}.kids IF i <> {slot} + 1], '') END")
        left = f"array_to_string({t}.kids[1:{slot}], '')"
        right = f"array_to_string({t}.kids[{slot} + 2:], '')"
        fold = f"(CASE WHEN {t}.kids IS NULL THEN {fold} ELSE sha256({left} || {fold} || {right}) END)"
    return joins, " || ".join(proof), fold


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF_SQL = "sha256(" + " || ".join(_field(c) for c in _LEAF) + ")"
_JOINS, _PROOF, _FOLD = _steps("r", "sid", "leaf_idx", _CLIMB)
_TOP_JOINS, _TOP_PROOF, _TOP_FOLD = _steps("t", "one", "sid", 4)
_MANIFEST_SQL = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
rolled AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, x: xor(crcs[xor(c & 255, x) + 1], c >> 8))) AS crc FROM documents, crc_table),
hashed AS (
  SELECT doc_id, source, {_LEAF_SQL} AS leaf, {_LEAF_SQL.replace("text", "tampered")} AS claim
  FROM (SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS tampered FROM rolled)),
sources AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS sid, n FROM (SELECT source, count(*) AS n FROM hashed GROUP BY source)),
placed AS (
  SELECT doc_id, sid AS sid_of, leaf, claim, n, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS leaf_idx
  FROM hashed JOIN sources ON hashed.source IS NOT DISTINCT FROM sources.source),
{_climb("SELECT sid_of AS sid, leaf_idx AS idx, leaf AS h, NULL::VARCHAR[] AS kids, n FROM placed", "r", "sid", _CLIMB)},
{_climb(f"SELECT 1 AS one, sid AS idx, h, NULL::VARCHAR[] AS kids, (SELECT count(*) FROM r{_CLIMB}) AS n FROM r{_CLIMB}", "t", "one", 4)},
risen AS (
  SELECT doc_id, sid_of AS sid, 1 AS one_of, leaf, {_PROOF} AS siblings, {_FOLD} AS claim, rj{_CLIMB}.h AS subroot FROM placed{_JOINS}),
whole AS (
  SELECT doc_id, leaf, subroot, tj4.h AS root, sha256(siblings || {_TOP_PROOF}) AS proof_sha256, {_TOP_FOLD} AS folded_root FROM risen{_TOP_JOINS})
SELECT *, folded_root = root AS verified FROM whole
"""


@query("op11_manifest", _MANIFEST_SQL)
def manifest(spark, sf):
    """The manifest of all documents, and what the paths make of copies of which every fifth is tampered with."""
    log = spark.read.parquet(f"{sf}/documents.parquet").withColumnsRenamed(_LEAF)
    crc = F.crc32(F.col("seq").cast("string").cast("binary"))
    lower = F.translate("reason", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claim = F.when(crc % 5 == 0, MA.leaf_hash("seq", "weight_name", "lang", "n_chars", lower))
    made = MA.manifest(log.withColumn("claim", claim), fields=tuple(_LEAF.values()), carry=("claim",))
    out = made.select(
        F.col("seq").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        MA.proof_hash("path").alias("proof_sha256"),
        MA.folded("path", F.coalesce("claim", "leaf")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_language")
def language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("text").alias("reason"), "lang")
    apart = F.coalesce(F.crc32(F.col("seq").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = LA.fit_language(docs.filter(~apart))
    told = LA.add_language(docs.select("seq", "reason"), model)
    return told.select(
        F.col("seq").alias("doc_id"), apart.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


@query("op12_agreement")
def agreement(spark, sf):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return AL.tokenizer_agreement(documents(spark, sf), a, b).withColumnRenamed("seq", "doc_id")
