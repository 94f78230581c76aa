"""Merkle manifest of a log: bitmaps of keys with popcount directories give every row its leaf, slot arrays the levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.logs import WEIGHT_SCHEMA
from .common import numbered, written

#: Children of a node.
FAN_OUT = 16
#: Entries of one node of a popcount directory, as a power of two.
DIRECTORY_BITS = 12
#: The word of the bitmap that stands for a missing key: before all others.
_NO_KEY = -(1 << 63)
_PATH = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: str | Column) -> Column:
    """SHA-256 (hex) over the fields: ``-`` for a missing one, else its number of UTF-8 bytes, ``:`` and its text."""

    def part(c: str | Column) -> Column:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in fields]).cast("binary"), 256)


def proof_hash(path: str | Column) -> Column:
    """SHA-256 (hex) of all sibling hashes of a path, from the leaf up, left to right."""
    path = F.col(path) if isinstance(path, str) else path
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)


def folded(path: str | Column, leaf: str | Column) -> Column:
    """The root that a leaf's hash leads to along a path."""
    path, leaf = (F.col(c) if isinstance(c, str) else c for c in (path, leaf))
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]).cast("binary"), 256))


def key_bitmaps(keys: DataFrame) -> DataFrame:
    """(s, w, b, n) -> (s, w, bits, extra, n): which of 64 neighbouring keys a group has, and which of them several times.

    Only words with a key are there, so a group costs what it holds, not what it spans.
    """
    one = F.expr("shiftleft(1L, b)")
    again = F.when(F.col("n") > 1, F.struct("b", (F.col("n") - 1).alias("more")))
    return keys.groupBy("s", "w").agg(F.bit_or(one).alias("bits"), F.collect_list(again).alias("extra"), F.sum("n").alias("n"))


def directory(words: DataFrame, low: int, high: int) -> DataFrame:
    """Adds ``base``, the rows of the group before a word, and ``m``, all rows of the group.

    A directory node counts at most 2 ** DIRECTORY_BITS neighbours, so no window holds more, however large a group is; as
    many levels as the words between ``low`` and ``high`` need.
    """
    nodes = [words.select("s", "w", "n")]
    while high - low >= 1 << DIRECTORY_BITS:
        up = F.shiftright("w", DIRECTORY_BITS).alias("w")
        nodes.append(written(nodes[-1].groupBy("s", up).agg(F.sum("n").alias("n")), "directory"))
        low, high = low >> DIRECTORY_BITS, high >> DIRECTORY_BITS
    top = Window.partitionBy("s")
    before = F.sum("n").over(top.orderBy("w").rowsBetween(Window.unboundedPreceding, -1))
    out = nodes.pop().select("s", "w", F.coalesce(before, F.lit(0)).alias("base"), F.sum("n").over(top).alias("m"))
    while nodes:
        near = Window.partitionBy("s", "up").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
        low_nodes = nodes.pop().withColumn("up", F.shiftright("w", DIRECTORY_BITS))
        low_nodes = low_nodes.select("s", "w", "up", F.coalesce(F.sum("n").over(near), F.lit(0)).alias("near"))
        out = low_nodes.join(out.withColumnRenamed("w", "up"), ["s", "up"]).select("s", "w", (F.col("base") + F.col("near")).alias("base"), "m")
    return words.drop("n").join(out, ["s", "w"])


def rank_in_word() -> Column:
    """How many rows of a word lie before the key ``b``: a population count, and what repeated keys add."""
    below = F.expr("~shiftleft(-1L, b)")
    more = F.aggregate("extra", F.lit(0).cast("bigint"), lambda a, e: a + F.when(e["b"] < F.col("b"), e["more"]).otherwise(0))
    return F.bit_count(F.col("bits").bitwiseAND(below)) + F.when(F.size("extra") > 0, more).otherwise(0)


def _ties(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``tie``: the rows of the same key with a smaller hash.  A hot key is dealt over 4,096 cells of the hash."""
    cell = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    leaves = leaves.withColumn("cell", cell)
    several = keys.filter("leaves > 1").select("s", "w", "b")
    cells = leaves.join(several, ["s", "w", "b"], "left_semi").groupBy("s", "w", "b", "cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("s", "w", "b").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("s", "w", "b", "cell", F.sum("n").over(before).alias("cells_before"))
    inside = Window.partitionBy("s", "w", "b", "cell").orderBy("h", "c").rowsBetween(Window.unboundedPreceding, -1)
    near = leaves.withColumn("near", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    tied = near.join(cells, ["s", "w", "b", "cell"], "left")
    return tied.withColumn("tie", F.col("near") + F.coalesce("cells_before", F.lit(0))).drop("cell", "near", "cells_before")


def _in_order(kids: str = "kids") -> Column:
    """The hashes of a run by slot: slot arrays are keyed, not sorted."""
    slots = F.map_from_entries(F.transform(kids, lambda k: F.struct(k["slot"], k["h"])))
    return F.transform(F.sequence(F.lit(0), F.size(kids) - 1), lambda i: F.element_at(slots, i))


def _levels(nodes: DataFrame, highest: int, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Trees over nodes (s, i, h, m): the runs (s, p, kids, m) of every level, and (s, depth, top).

    ``highest`` is the largest m.  A group of one node has no run: the node is its top.
    """
    runs, tops, depth = [], [], 0
    kid = ["h", *carry]
    while True:
        tops.append(nodes.filter("m = 1").select("s", F.lit(depth).alias("depth"), F.col("h").alias("top")))
        if highest <= 1:
            break
        slot = F.col("i").bitwiseAND(FAN_OUT - 1).cast("int").alias("slot")
        grouped = nodes.filter("m > 1").groupBy("s", F.shiftright("i", 4).alias("p"))
        run = grouped.agg(F.collect_list(F.struct(slot, *kid)).alias("kids"), F.first("m").alias("m"))
        runs.append(written(run, "runs"))
        up = F.sha2(F.array_join(_in_order(), "").cast("binary"), 256)
        nodes = runs[-1].select("s", F.col("p").alias("i"), up.alias("h"), F.ceil(F.col("m") / FAN_OUT).alias("m"))
        kid, depth, highest = ["h"], depth + 1, -(-highest // FAN_OUT)
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return runs, out


def _paths(runs: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """(s, depth, top, path) of the tops -> (s, i, path, top) and the kid's fields, for every leaf that is no top itself."""
    paths = None
    for depth in range(len(runs), 0, -1):
        here = tops.filter(F.col("depth") == depth).select("s", F.lit(0).cast("bigint").alias("p"), "path", "top")
        paths = here if paths is None else paths.select("s", F.col("i").alias("p"), "path", "top").union(here)
        both = runs[depth - 1].join(paths, ["s", "p"]).withColumn("hashes", _in_order())
        both = both.select("s", "p", "path", "top", "hashes", F.explode("kids").alias("kid"))
        slot = F.col("kid.slot")
        left, right = F.slice("hashes", 1, slot), F.slice("hashes", slot + 2, FAN_OUT)
        step = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
        more = [F.col(f"kid.{c}").alias(c) for c in ("h", *carry)] if depth == 1 else []
        paths = both.select(
            "s", (F.col("p") * FAN_OUT + slot).alias("i"), F.concat(F.array(step), "path").cast(_PATH).alias("path"), "top", *more
        )
    return paths


def manifest(
    log: DataFrame,
    key: str = "seq",
    group: str = "weight_name",
    fields: tuple[str, ...] = tuple(WEIGHT_SCHEMA.names),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of a log as a leaf of a Merkle tree: ``group``, ``key``, leaf, subroot, root, path, and the columns of ``carry``.

    A log is the weight-change log (by ``weight_name`` and ``seq``), or bars by symbol and day: any rows with a whole-number or date
    ``key`` and a ``group``.  The leaf is the ``leaf_hash`` of ``fields``.  Per group, leaves ascend by key; while several
    nodes remain, every FAN_OUT neighbours become the hash of their hashes; what remains is the ``subroot``.  Subroots,
    ordered by the UTF-8 bytes of their group (a missing one first), likewise give the ``root``.  ``path`` holds, from the leaf up, the
    joined hashes of the siblings to the ``left`` and the ``right``: ``folded(path, leaf)`` is the root,
    ``proof_hash(path)`` a digest of the siblings.  ``carry`` are small columns that ride along, such as a copy's leaf hash to be folded.

    No sort finds the places.  The keys of a group are a bitmap of the words that are not empty, merged from the tasks' parts; a
    directory of population counts gives the rows before a word, a count of bits those inside it: the leaf's number.
    Runs collect in arrays by slot, a level from the one below; paths grow from the top down, so siblings of the upper
    levels travel once for each node, not for each row.

    A missing key comes first in its group.  Rows of one key stand in the order of their leaf hashes; equal rows are
    as many leaves.  Missing fields hash as ``-``, empty ones as ``0:``.  Texts of any length are hashed whole, in one pass.  Columns that are not
    asked for are left out, whatever their names.  An empty log gives no rows.
    """
    kind = log.schema[key].dataType
    if not isinstance(kind, (T.IntegralType, T.DateType)):
        raise TypeError(f"{key} is {kind.simpleString()}: a whole number or a date is needed")
    day = isinstance(kind, T.DateType)
    k = (F.unix_date(key) if day else F.col(key)).cast("bigint")
    # Never null, in the order of the groups.
    s = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("s")
    w = F.coalesce(F.shiftright(k, 6), F.lit(_NO_KEY)).alias("w")
    b = F.coalesce(k.bitwiseAND(63), F.lit(0)).cast("int").alias("b")
    rides = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("c")
    rows = log.select(s, w, b, leaf_hash(*fields).alias("h"), rides)
    leaves = written(rows.groupBy("s", "w", "b", "h", "c").agg(F.count("*").alias("n")), "leaves")

    keys = leaves.groupBy("s", "w", "b").agg(F.sum("n").alias("n"), F.count("*").alias("leaves"))
    words = written(key_bitmaps(keys), "bitmaps")
    span = words.filter(F.col("w") != _NO_KEY).agg(F.min("w"), F.max("w")).head()
    ranked = words.transform(directory, span[0] or 0, span[1] or 0)
    if leaves.count() > (words.agg(F.sum(F.bit_count("bits"))).head()[0] or 0):  # some key has several leaves
        leaves = _ties(leaves, keys)
    else:
        leaves = leaves.withColumn("tie", F.lit(0))
    found = leaves.join(ranked, ["s", "w"])
    first = F.col("base") + rank_in_word() + F.col("tie")
    places = F.explode(F.sequence(first, first + F.col("n") - 1)).alias("i")
    ride = F.struct("w", "b", "c").alias("row")
    nodes = written(found.select("s", "h", ride, "m", places), "places")

    highest = nodes.agg(F.max("m")).head()[0]
    runs, tops = _levels(nodes, highest or 0, ["row"])
    tops = numbered(written(tops, "subroots"), "s", "i")
    n_tops = tops.count()
    forest = tops.select(F.lit("").alias("s"), "i", F.col("top").alias("h"), F.lit(n_tops).cast("bigint").alias("m"), F.struct("s", "depth").alias("of"))
    high_runs, root = _levels(forest, n_tops, ["of"])
    root = root.withColumn("path", F.array().cast(_PATH))
    if n_tops > 1:
        placed = _paths(high_runs, root, ["of"]).select("of.s", "of.depth", F.col("h").alias("subroot"), "path", F.col("top").alias("root"))
    else:
        placed = tops.select("s", "depth", F.col("top").alias("subroot"), F.array().cast(_PATH).alias("path"), F.col("top").alias("root"))
    placed = written(placed, "subroot-paths")
    # The pair of subroot and root goes down with the path.
    below = placed.select("s", "depth", "path", F.struct("subroot", "root").alias("top"))
    out = _paths(runs, below, ["row"]) if runs else None
    alone = nodes.filter("m = 1").join(below.select("s", "path", "top"), "s").select("s", "i", "path", "top", "h", "row")
    out = alone if out is None else out.select("s", "i", "path", "top", "h", "row").union(alone)
    at = F.when(F.col("row.w") != _NO_KEY, F.shiftleft(F.col("row.w"), 6) + F.col("row.b"))
    at = F.date_from_unix_date(at.cast("int")) if day else at.cast(kind)
    name = F.when(F.col("s") != "", F.expr("substring(s, 2)")).cast(log.schema[group].dataType)
    return out.select(
        name.alias(group),
        at.alias(key),
        F.col("h").alias("leaf"),
        "top.subroot",
        "top.root",
        "path",
        *[F.col(f"row.c.c{i}").alias(c) for i, c in enumerate(carry)],
    )
