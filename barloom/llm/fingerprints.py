"""Fingerprints of notes as multisets of paragraphs: sums of hashed vectors modulo powers of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_id, written

#: A fingerprint in hex: the number of paragraphs (8 digits), 16 lanes of 16 bits, 64 lanes of 32 bits, the number of word pairs (8 digits).
_SMALL, _WIDE = 9, 9 + 16 * 4
#: Lanes of 16 bits for equality: four for each of four 64-bit hashes of a paragraph.
_HASHES = ("h0", "h1", "h2", "h3")
#: Two lanes of 32 bits in a long that take one bit each.
_PAIR = 0x0000000100000001


def _words(p: str) -> Column:
    return F.filter(F.split(F.trim(p), r"\s+"), lambda w: w != "")


def fingerprints(notes: DataFrame, key: list[str], text: str) -> DataFrame:
    """The key and ``fingerprint`` (592 hex digits).

    Paragraphs are lines that are not blank.  Each is hashed to a wide vector: 16 lanes of 16 bits from its own hashes,
    and 64 lanes that count the set bits in the hashes of its pairs of neighbouring words (the word, if it is
    alone).  The sum of the vectors, modulo 2^16 and 2^32 lane by lane, is the fingerprint: the order of paragraphs does not
    matter, and one is added or taken out by adding or subtracting its vector (``combine``).  Equal multisets of
    paragraphs have equal fingerprints; ``likeness`` estimates from two fingerprints how much the texts have in common.

    Null and empty texts are the empty multiset, whose lanes are 0.  The key has to be unique; no rows give no rows.
    """
    lines = notes.select(*key, F.explode_outer(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")).alias("p"))
    own = [F.xxhash64("p", F.lit(i)).alias(n) for i, n in enumerate(_HASHES)]
    lines = lines.select(*key, *own, F.col("p").isNotNull().alias("some"), F.coalesce(_words("p"), F.array().cast("array<string>")).alias("w"))
    more = F.size("w") - 1
    pairs = F.when(more < 1, F.col("w")).otherwise(F.zip_with(F.slice("w", 1, more), F.slice("w", 2, more), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = lines.select(*key, *_HASHES, "some", F.posexplode_outer(pairs).alias("n", "pair"))
    first = F.col("some") & (F.coalesce("n", F.lit(0)) == 0)
    rows = rows.select(*key, *[F.when(first, F.col(h)).otherwise(0).alias(h) for h in _HASHES], first.cast("int").alias("one"),
                       F.col("pair").isNotNull().cast("int").alias("counted"), F.when(F.col("pair").isNotNull(), F.xxhash64("pair")).otherwise(0).alias("bits"))
    sums = [F.sum(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(0xFFFF).cast("bigint"))).alias(f"{h}_{s}") for h in _HASHES for s in (0, 16, 32, 48)]
    bits = [F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(_PAIR))).alias(f"b{i}") for i in range(32)]
    got = rows.groupBy(*key).agg(*sums, *bits, F.sum("one").alias("paragraphs"), F.sum("counted").alias("pairs"))
    wide = [F.lpad(F.hex(F.col(f"{h}_{s}") % (1 << 16)), 4, "0") for h in _HASHES for s in (0, 16, 32, 48)]
    half = lambda i: F.col(f"b{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    lanes = F.array(*[half(i) for i in range(32)], *[F.shiftrightunsigned(f"b{i}", 32) for i in range(32)], F.col("pairs"))
    return got.select(*key, F.lower(F.concat(F.lpad(F.hex("paragraphs"), 8, "0"), *wide, _hex(lanes))).alias("fingerprint"))


def _hex(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def _lanes(print_: Column) -> Column:
    """The 64 wide lanes of a fingerprint and its number of word pairs."""
    places = F.sequence(F.lit(_WIDE), F.lit(_WIDE + 64 * 8), F.lit(8))
    return F.transform(places, lambda at: F.conv(F.substring(print_, at, F.lit(8)), 16, 10).cast("bigint"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the paragraphs of both (sign 1), or of those of a without those of b (sign -1)."""
    part = lambda x, at, n: F.conv(F.substring(x, at, n), 16, 10).cast("bigint")
    lane = lambda at, n: F.lower(F.lpad(F.hex(F.pmod(part(a, at, n) + sign * part(b, at, n), F.lit(1 << (4 * n)).cast("bigint"))), n, "0"))
    wide = F.zip_with(_lanes(a), _lanes(b), lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32).cast("bigint")))
    return F.concat(lane(1, 8), *[lane(_SMALL + 4 * i, 4) for i in range(16)], F.lower(_hex(wide)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints: the cosine of their wide lanes, each counted from half the number of word pairs.

    1 for equal fingerprints; 0 if only one of two different ones has words, or neither.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    centred = lambda x: F.transform(F.slice(x, 1, 64), lambda v: v * 2.0 - F.element_at(x, 65))
    # Arrays of one element, so that a lambda's variable holds what is used more than once.
    read = F.array(F.struct(_lanes(a).alias("a"), _lanes(b).alias("b")))
    both = F.transform(read, lambda s: F.struct(centred(s["a"]).alias("a"), centred(s["b"]).alias("b")))
    parts = F.transform(both, lambda s: F.struct(dot(s["a"], s["b"]).alias("dot"), F.sqrt(dot(s["a"], s["a"]) * dot(s["b"], s["b"])).alias("norm")))
    cosine = F.transform(parts, lambda s: F.when(s["norm"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["dot"] / s["norm"]))).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(F.element_at(cosine, 1))


def next_rows(keys: DataFrame, order: list[Column], cols: list[str]) -> DataFrame:
    """Each row of a small table of keys with a struct ``next`` of the row behind it; behind the last comes the first.

    The keys are dealt by range and written, so no window holds more than one range.
    """
    dealt = written(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "keys")
    inside = Window.partitionBy("_range").orderBy(*order)
    one = F.struct(*cols)
    rows = dealt.withColumn("next", F.lead(one).over(inside)).withColumn("_n", F.row_number().over(inside))
    firsts = rows.filter("_n = 1").select("_range", one.alias("_first"))
    whole = Window.orderBy("_range")  # one row for each range
    firsts = firsts.select(
        F.col("_range"), F.coalesce(F.lead("_first").over(whole), F.first("_first").over(whole.rowsBetween(Window.unboundedPreceding, 0))).alias("_behind")
    )
    return rows.join(firsts, "_range").withColumn("next", F.coalesce("next", "_behind")).drop("_range", "_n", "_behind")


def edited_fingerprints(notes: DataFrame, key: str = "seq", text: str = "reason") -> DataFrame:
    """Every note beside an edited one: key, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    Notes are rows with a whole-number key and a free text.  The edit replaces the last third of a text (code points,
    rounded down) by the beginning of the next note's, all of it if that is shorter; notes follow each other
    by descending key, equal keys by the text's hash, a null key last, and the first follows the last.  ``near_edited`` and
    ``near_next`` are the likeness of the note's fingerprint to the edited text's and to the next note's.

    Null texts are empty.  Rows with the same key and text share a place in the order, so that the next note is another one,
    and each has its row; other columns are left out; no rows give no rows.
    """
    base = notes.select(F.coalesce(F.col(key), F.lit(-(1 << 63))).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(key).isNull().alias("none"))
    base = base.withColumn("id", text_id("t")).groupBy("k", "id", "none").agg(F.any_value("t").alias("t"), F.count("*").alias("copies"))
    same = ["k", "id", "none"]
    order = [F.col("none"), F.col("k").desc(), F.col("id").desc()]
    keys = next_rows(base.select(*same, "copies", F.char_length("t").cast("bigint").alias("n_chars")), order, same)
    wants = keys.select(F.struct(*same).alias("to"), (F.floor(F.col("n_chars") / 3)).cast("int").alias("m"), *[F.col(f"next.{c}").alias(c) for c in same])
    given = base.join(wants, same).select("to.*", F.substring(F.col("t"), F.lit(1), F.col("m")).alias("tail"))
    kept = F.substring(F.col("t"), F.lit(1), F.char_length("t") - F.floor(F.char_length("t") / 3).cast("int"))
    edited = base.join(given, same).select(*same, F.concat(kept, "tail").alias("edited"))
    prints = written(fingerprints(base, same, "t"), "prints")
    other = fingerprints(edited, same, "edited").withColumnRenamed("fingerprint", "edited_fingerprint")
    behind = keys.select(*same, "copies", "n_chars", *[F.col(f"next.{c}").alias(f"next_{c}") for c in same])
    nexts = prints.select(*[F.col(c).alias(f"next_{c}") for c in same], F.col("fingerprint").alias("next_fingerprint"))
    out = prints.join(behind, same).join(nexts, [f"next_{c}" for c in same]).join(other, same).join(edited, same)
    out = out.select(
        F.when(~F.col("none"), F.col("k")).alias(key),
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "copies",
    )
    # In two steps, so that no array has a place for every copy.
    some = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / 4096)))
    out = out.withColumn("_block", some)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(4096), F.col("copies") - F.col("_block") * 4096)))
    return out.withColumn("_one", each).drop("copies", "_block", "_one")
