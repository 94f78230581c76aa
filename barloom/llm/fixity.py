"""Fixity audit of archived snapshots: Merkle trees over records and offset ranges, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Children of a node.
FAN_OUT = 16


def archive_record(uri: str | Column, payload: str | Column, record_id: str | Column) -> Column:
    """The bytes of a WARC resource record: header lines, an empty line, the payload, two line ends."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    body = F.encode(F.coalesce(c(payload), F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:snapshot:"), F.coalesce(c(record_id).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(c(uri), F.lit("")), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def layout(records: DataFrame, file: str, order: str, length: Column) -> DataFrame:
    """Adds ``length`` and ``offset``: where each record starts in its file, records in ascending ``order``.

    A window holds one file.
    """
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("length", length.cast("bigint")).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))


def record_digests(replica: DataFrame, file: str = "file", payload: str = "payload") -> DataFrame:
    """(file, offset, payload) -> file, offset, length, digest (SHA-256, hex); the payload is read once.

    A null payload has no bytes; rows with a null file or offset are left out; repeated rows count once.
    """
    body = F.coalesce(F.col(payload), F.lit(b""))
    rows = replica.select(F.col(file).alias("file"), "offset", F.length(body).cast("bigint").alias("length"), F.sha2(body, 256).alias("digest"))
    return rows.filter("file is not null and offset is not null").dropDuplicates(["file", "offset", "length", "digest"])


def _nodes(children: DataFrame, by: list[Column], node: str) -> DataFrame:
    """Each group's children, in order of their place, hashed into one node."""
    kids = F.array_sort(F.collect_list(F.struct("place", "hash")))
    line = F.array_join(F.transform(kids, lambda c: F.concat_ws(":", c["place"].cast("string"), c["hash"])), "\n")
    return children.groupBy(*by).agg(F.sha2(line, 256).alias("hash")).withColumnRenamed("parent", node)


def merkle_levels(digests: DataFrame, range_bytes: int, levels: int) -> list[DataFrame]:
    """Trees of all files, from level 0 (byte ranges) up to the roots: (file, place, hash) each.

    A leaf range is ``range_bytes`` of a file: the hash of offset, length and digest of the records that start in it.  A node
    covers FAN_OUT places of the level below.  ``levels`` is the same for both replicas, so that places agree.
    """
    leaf = digests.select(
        "file", F.floor(F.col("offset") / range_bytes).cast("bigint").alias("parent"), F.col("offset").alias("place"), F.concat_ws(":", "length", "digest").alias("hash")
    )
    out = [_nodes(leaf, ["file", "parent"], "place")]
    for _ in range(levels):
        low = out[-1].select("file", F.floor(F.col("place") / FAN_OUT).cast("bigint").alias("parent"), "place", "hash")
        out.append(_nodes(low, ["file", "parent"], "place"))
    return out


def audit(replica: DataFrame, other: DataFrame, file: str = "file", payload: str = "payload", range_bytes: int = 1 << 16) -> DataFrame:
    """Where two replicas of archived snapshot records differ: file, offset, length, other_length, fault.

    A replica has rows (file, offset, payload), the stored records of option-chain or page snapshots.  ``fault`` is
    "changed" (bytes differ), "missing" (not in ``other``) or "extra" (only there).  The records of either replica
    are hashed into one Merkle tree a file.  The roots are compared; of files whose roots differ, the children are, and so on
    down: only branches that differ are followed to their byte ranges, and only records of those ranges are compared.

    Payloads are read once for each replica; everything after works on digests, which are written to the shared folder.  Equal
    replicas give no rows, as do two empty ones; a whole file can be missing or extra.  Several records at one offset are
    compared as a set: a digest both have is no fault.  Null payloads are empty records.
    """
    a, b = (written(record_digests(x, file, payload), "digests") for x in (replica, other))
    far = a.agg(F.max("offset")).union(b.agg(F.max("offset"))).agg(F.max("max(offset)")).head()[0] or 0
    levels, places = 0, far // range_bytes
    while places:
        levels, places = levels + 1, places // FAN_OUT
    trees = [merkle_levels(x, range_bytes, levels) for x in (a, b)]
    odd = None
    for x, y in zip(reversed(trees[0]), reversed(trees[1])):
        both = []
        for side in (x, y):
            if odd is not None:  # children of what differs above
                side = side.withColumn("up", F.floor(F.col("place") / FAN_OUT).cast("bigint")).join(odd, ["file", "up"], "left_semi")
            both.append(side.select("file", "place", "hash"))
        same = both[0].alias("x").join(both[1].alias("y"), ["file", "place"], "full")
        odd = same.filter(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select("file", F.col("place").alias("up"))
    inside = lambda d: d.withColumn("up", F.floor(F.col("offset") / range_bytes).cast("bigint")).join(odd, ["file", "up"], "left_semi")
    x, y = inside(a), inside(b)
    key = ["file", "offset", "length", "digest"]
    lost = x.join(y, key, "left_anti").select("file", "offset", "length")
    new = y.join(x, key, "left_anti").select("file", "offset", F.col("length").alias("other_length"))
    fault = F.when(F.col("other_length").isNull(), "missing").when(F.col("length").isNull(), "extra").otherwise("changed")
    return lost.join(new, ["file", "offset"], "full").select("file", "offset", "length", "other_length", fault.alias("fault"))
